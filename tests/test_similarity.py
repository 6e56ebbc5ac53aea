"""Structural similarity against all pairs: no pair lost at any threshold, crowded rings cut."""

import itertools
import random

import pytest

from tilewright.operators import similarity


def ssim(x, y):
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    vx, vy = sum((a - mx) ** 2 for a in x) / n, sum((b - my) ** 2 for b in y) / n
    cov = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / n
    return (2 * mx * my + 2.55**2) * (2 * cov + 7.65**2) / ((mx * mx + my * my + 2.55**2) * (vx + vy + 7.65**2))


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    out = [[rng.randrange(256) for _ in range(24)] for _ in range(60)]
    out += [[min(255, max(0, v + rng.randrange(-k, k + 1))) for v in out[i]] for i, k in zip(range(40), itertools.cycle([2, 8, 20, 40]), strict=False)]
    smooth = [[128 + (j * 3 + i) % 7 for j in range(24)] for i in range(40)]  # a crowd
    return out + smooth + [out[0], out[0], smooth[3]]


@pytest.mark.parametrize("threshold,hot", [(0.95, 2048), (0.95, 3), (0.8, 3), (0.5, 5)])
def test_all_pairs(spark, vectors, monkeypatch, threshold, hot):
    monkeypatch.setattr(similarity, "HOT", hot)
    df = spark.createDataFrame([*((i, v, 1, 2) for i, v in enumerate(vectors)), (900, None, 1, 2), (901, [], 1, 2)], "id long, pixels array<int>, cell int, ring int").repartition(4)
    first = {}
    for i, v in enumerate(vectors):
        first.setdefault(tuple(v), i)
    want = {(i, j): s for (x, i), (y, j) in itertools.combinations(first.items(), 2) if (s := ssim(x, y)) >= threshold + 1e-9 or abs(s - threshold) < 1e-9}
    got = [(r.id_i, r.id_j, r.ssim) for r in similarity.ssim_pairs(df, "id", "pixels", threshold).collect()]
    assert len(got) == len({x[:2] for x in got}) and {x[:2] for x in got} == set(want) and len(want) > 20
    assert {x[:2]: x[2] for x in got} == pytest.approx(want)


def test_clusters_and_odd_rows(spark, vectors):
    df = spark.createDataFrame([*enumerate(vectors), (900, None), (901, [])], "id long, pixels array<int>")
    got = dict(map(tuple, similarity.ssim_clusters(df, "id", "pixels").collect()))
    root = list(range(len(vectors)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(vectors)), 2):
        if ssim(vectors[i], vectors[j]) >= 0.95:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert got == {**{i: find(i) for i in range(len(vectors))}, 900: 900, 901: 901}
    assert similarity.ssim_pairs(df.limit(0), "id", "pixels").count() == 0
    with pytest.raises(ValueError):
        similarity.ssim_pairs(spark.createDataFrame([(1, [1]), (2, [1, 2])], "id long, v array<int>"), "id", "v")
