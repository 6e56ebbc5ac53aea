"""As-of joins against a plain search: gaps, ties, keys, a hot key, NULLs, tolerance."""

import random

import pytest

from tilewright.operators.prefix import asof


def plain(left, right, tolerance, exact):
    out = []
    for i, k, t in left:
        found = [(u, v) for j, u, v in right if j == k and u is not None and t is not None and (u <= t if exact else u < t)]
        best = max(found, default=None)
        out.append((i, *((best[1], best[0]) if best and (tolerance is None or t - best[0] <= tolerance) else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tolerance,exact", [(None, True), (5.0, True), (None, False), (3.0, False)])
def test_asof(spark, tolerance, exact):
    rng = random.Random(6)
    key = lambda: rng.choices(["hot", "b", "c", None, "left only"], (8, 2, 2, 1, 1))[0]
    left = [(i, key(), rng.choice([None, float(rng.randrange(0, 60))])) for i in range(300)]
    right = [(k, rng.choice([None, float(rng.randrange(0, 60, 3))]), rng.randrange(100)) for k in (rng.choice(["hot", "hot", "b", None, "right only"]) for _ in range(150))]
    a = spark.createDataFrame(left, "_row long, _part string, t double").repartition(4)
    b = spark.createDataFrame(right, "_part string, t double, _hit int").repartition(3)
    got = asof(a, b, "t", ["_hit"], ("_part",), tolerance, exact)
    assert got.columns == ["_row", "_part", "t", "_hit", "t_right"]
    assert sorted(((r[0], r[3], r[4]) for r in got.collect()), key=repr) == plain(left, right, tolerance, exact)
    whole = asof(a, b, "t", ["_hit"], (), tolerance, exact)
    one = lambda rows: [(x[0], 0, *x[2:]) if len(x) == 3 and x is not None else x for x in rows]
    assert sorted(((r[0], r[3], r[4]) for r in whole.collect()), key=repr) == plain(one(left), [(0, u, v) for _, u, v in right], tolerance, exact)


def test_nothing_on_a_side(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "i long, t double"), spark.createDataFrame([], "t double, v int")
    assert tuple(asof(a, b, "t", ["v"]).first()) == (1, 2.0, None, None)
    assert asof(a.limit(0), b, "t", ["v"]).count() == 0
