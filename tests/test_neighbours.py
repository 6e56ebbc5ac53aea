"""Mutual information by neighbours against a plain version over all pairs."""

import math
import random
from collections import Counter

import pytest

from tilewright.operators import contract


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(rows, k):
    """From (value, class) rows, as the docstring says."""
    rows = [(float(v), y) for v, y in rows if v is not None and math.isfinite(v) and y is not None]
    sizes = Counter(y for _, y in rows)
    rows = [(v, y) for v, y in rows if sizes[y] > 1]
    if not rows:
        return 0.0
    total = psi(len(rows))
    for i, (v, y) in enumerate(rows):
        t = min(k, sizes[y] - 1)
        r = sorted(abs(w - v) for j, (w, z) in enumerate(rows) if z == y and j != i)[t - 1]
        m = sum(w == v if r == 0 else v - r < w < v + r for w, _ in rows)
        total += (psi(t) - psi(sizes[y]) - psi(m)) / len(rows)
    return max(0.0, total)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_equals_plain(spark, k):
    rng = random.Random(k)
    rows = []
    for i in range(1200):
        y = rng.choices("abcd", (6, 3, 2, 1))[0]
        rows.append((y, rng.gauss("abcd".index(y), 1.0), float(rng.randrange(9)), rng.random() if i % 7 else None, 0.5 if i % 3 else rng.random()))
    rows += [("lonely", 1.0, 1.0, 1.0, 1.0), (None, 1.0, 2.0, 3.0, 4.0), ("a", float("nan"), 2.0, float("inf"), 4.0), ("pair", 50.0, 50.0, 50.0, 50.0), ("pair", 51.0, 51.0, 51.0, 51.0)]
    names = ["shifted", "coarse", "noise", "hot"]
    df = spark.createDataFrame(rows, "y string, shifted double, coarse double, noise double, hot double").repartition(5)
    got = {r.feature: r.mi for r in contract.mutual_info_neighbours(df, names, "y", k).collect()}
    for j, f in enumerate(names):
        assert got[f] == pytest.approx(plain([(r[j + 1], r[0]) for r in rows], k), abs=1e-9), f
    assert max(got, key=got.get) == "shifted"


def test_nothing_to_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "y string, v double")
    assert contract.mutual_info_neighbours(df, ["v"], "y").first().mi == 0.0
    assert contract.mutual_info_neighbours(df.limit(0), ["v"], "y").first().mi == 0.0
