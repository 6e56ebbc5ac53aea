"""Near hashes against brute force at every threshold, with hot keys and families."""

import itertools
import random

import pytest

from tilewright.operators import dedup, graph


def planted(seed, bits, n=50):
    """Random hashes, near copies of them, and a third of all that share most of their bits."""
    rng = random.Random(seed)
    h = [rng.getrandbits(bits) for _ in range(n)]
    h += [x ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(1, min(15, bits)))) for x in h]
    h += [rng.getrandbits(20) << (bits - 40) for _ in range(n)]
    return [x - (1 << 64) if x >> 63 else x for x in h]


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def pairs(h, threshold):
    return {(min(a, b), max(a, b)): distance(a, b) for a, b in itertools.combinations(set(h), 2) if distance(a, b) <= threshold}


@pytest.mark.parametrize("threshold", range(1, 13))
def test_all_thresholds(spark, threshold, monkeypatch):
    """Cheap and dear rows of the index make other parts; hot keys are cut."""
    bits = 64 if threshold % 2 else 60
    h = planted(threshold, bits)
    df = spark.createDataFrame([*enumerate(h), (1000, None), (1001, h[0])], "id long, hash long").coalesce(2)
    want = pairs(h, threshold)
    monkeypatch.setattr(dedup, "ROW", (20, 0.01, 500)[threshold % 3])
    monkeypatch.setattr(dedup, "HOT", 8)
    monkeypatch.setattr(dedup, "FLIPS", 200)
    got = [tuple(r) for r in dedup.hamming_pairs(df, "id", threshold=threshold, bits=bits).collect()]
    assert len(got) == len(set(got)) and {(a, b): d for a, b, d in got} == want


@pytest.mark.parametrize("n", [0, 100, 60_000, 10**6, 10**9])
@pytest.mark.parametrize("threshold", [0, 1, 3, 8, 12])
def test_parts_cover_every_pair(n, threshold):
    """The radii and one for each part make one more than the threshold; the cost of a hash grows slowly."""
    parts = dedup.index_parts(n, threshold, list(range(64)))
    assert sum(p + q + 1 for _, p, q, _ in parts) == threshold + 1
    assert sorted(x for part in parts for x in part[3]) == list(range(64))
    for mask, _, _, own in parts:
        assert mask == sum(1 << x for x in own)


def cost(n, threshold=8, bits=60):
    from math import comb

    ball = lambda w, r: sum(comb(w, k) for k in range(r + 1))
    return sum(dedup.ROW * (ball(len(x), p) + ball(len(x), q)) + n * ball(len(x), p) * ball(len(x), q) / 2 ** len(x) for _, p, q, x in dedup.index_parts(n, threshold, list(range(bits))))


def test_four_times_the_hashes_cost_at_most_six_times():
    for n in (15_000, 60_000, 240_000):
        assert 4 * cost(4 * n) <= 6 * cost(n)


def test_clusters_link_families(spark, monkeypatch):
    """A family of many near hashes has a link or two each, not its pairs; strangers at its edge are found."""
    rng = random.Random(9)
    centre = rng.getrandbits(60)
    family = list({centre ^ sum(1 << b for b in rng.sample(range(60), 4)) for _ in range(400)})
    edge = [family[0] ^ sum(1 << b for b in rng.sample(range(60), 8)), rng.getrandbits(60), rng.getrandbits(60)]
    h = [*family, *edge, *family[:5]]
    df = spark.createDataFrame([*enumerate(h), (5000, None)], "id long, hash long").coalesce(2)
    listed = []
    whole = dedup.components
    monkeypatch.setattr(dedup, "components", lambda e, *a: listed.append(e.count()) or whole(e, *a))
    got = dict(map(tuple, dedup.clusters(df, "id", threshold=8, bits=60).collect()))
    root = {i: i for i in range(len(h))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(h)), 2):
        if distance(h[i], h[j]) <= 8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert got == {**{i: find(i) for i in root}, 5000: 5000}
    assert max(listed) < 12 * len(h) < len(pairs(family, 8))


def test_components_keep_all_nodes(spark):
    """Nodes of edges that the node table lacks are there, and nodes without edges."""
    out = dict(map(tuple, graph.components(spark.createDataFrame([(1, 2), (8, 9)], "src long, dst long"), nodes=spark.createDataFrame([(2,), (5,)], "n long")).collect()))
    assert out == {1: 1, 2: 1, 5: 5, 8: 8, 9: 8}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, hash long")
    assert dedup.hamming_pairs(df, "id").count() == 0 and dedup.clusters(df, "id").count() == 0
