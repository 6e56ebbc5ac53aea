"""Hard negatives against brute force and SQL, products against numpy, odd rows."""

import math
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tilewright.llm import hard_negatives as hn


@pytest.mark.parametrize("m,k,n,top", [(1, 1, 1, 9), (33, 64, 70, 300), (101, 77, 205, 300), (64, 128, 64, 1 << 27), (70, 65, 66, 1 << 24), (5, 200, 3, 7)])
def test_strassen(m, k, n, top):
    rng = np.random.default_rng(m * n)
    a, b = rng.integers(-top, top + 1, (m, k)), rng.integers(-top, top + 1, (k, n))
    exact = np.array([[sum(x * y for x, y in zip(r, c, strict=True)) for c in b.T.tolist()] for r in a.tolist()], dtype=object)
    assert (hn.strassen(a, b, leaf=8) == exact).all() and (hn.strassen(a, b) == exact).all()


def test_heaps_merge():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 5, (6, 40)), np.sort(rng.integers(0, 30, 40))
    whole = hn.best(scores.copy(), ids, 7)
    parts = [hn.best(scores[:, i : i + 9].copy(), ids[i : i + 9], 7) for i in range(0, 40, 9)]
    while len(parts) > 1:
        parts = [hn.merge(parts[0], parts[-1]), *parts[1:-1]]
    assert (whole[0] == parts[0][0]).all() and (whole[1] == parts[0][1]).all()
    for s, i, row in zip(*whole, scores, strict=True):
        assert list(zip((-s).tolist(), i.tolist(), strict=True)) == sorted(zip((-row).tolist(), ids.tolist(), strict=True))[:7]


def plain(rows, scale=256, positives=5, negatives=3, low=50, high=95):
    """From (id, label, vector, anchor) rows."""
    ok = [(i, lab, [math.floor(scale * x) for x in v], a) for i, lab, v, a in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    nulls_last = lambda i: (i is None, i or 0)
    out = []
    for i, lab, v, is_anchor in ok:
        if is_anchor:
            scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other) for j, other, w, _ in ok if j != i]
            scored.sort(key=lambda x: (-x[0], nulls_last(x[1])))
            for p, pid, _ in [x for x in scored if x[2] == lab][:positives]:
                hard = [x for x in scored if x[2] != lab and low * p <= 100 * x[0] <= high * p][:negatives]
                out += [(i, pid, r + 1, j, p, n) for r, (n, j, _) in enumerate(hard)]
    return out


def same(got, want):
    return sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_query_equals_sql(spark, sf):
    assert oracle.differences(spark, oracle.connect(sf), "op12", hn.query, hn.SQL, sf) is None


def test_many_tiles(spark, monkeypatch):
    """Small tiles, many cells and both turns of the merge; a third of the rows under one label, ties everywhere."""
    monkeypatch.setattr(hn, "TILE_ROWS", 16)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 5)
    monkeypatch.setattr(hn, "GROUP_TILES", 1)
    monkeypatch.setattr(hn, "MERGE", 4)
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(6), [rng.randrange(-2, 4) / 4 for _ in range(5)], i % 11 == 0) for i in range(-50, 350)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, chosen boolean").repartition(6)
    got = hn.mine(df, F.col("chosen"), scale=256.0).collect()
    assert len(got) > 300 and same(got, plain(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5], True), (1, 1, [1.0, 0.4], False), (2, 2, [0.7, 0.3], False), (2, 2, [0.7, 0.3], False), (None, 2, [0.7, 0.3], False), (3, 1, [0.9], False), (4, 2, [0.5, 0.5, 8.0], False), (5, 2, [], False), (6, None, [1.0, 1.0], True), (7, 2, None, True), (8, 2, [1.0, None], False), (9, 2, [nan, 1.0], False), (10, 2, [inf, 1.0], False), (11, 3, [], True), (0, 1, [1.0, 0.5], True), (12, 3, [-0.001, -1.0], True)]
    schema = "vec_id long, label int, embedding array<double>, block long, tile long, scores string, side int, chosen boolean"
    df = spark.createDataFrame([(i, lab, v, 1, 2, "x", 3, a) for i, lab, v, a in rows], schema)
    got = hn.mine(df, F.col("chosen"), scale=256.0).collect()
    assert len(got) > 6 and same(got, plain(rows))
    named = df.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))
    assert same(hn.mine(named, F.col("chosen"), scale=256.0).collect(), plain(rows))
    assert hn.mine(df.limit(0), F.col("chosen")).count() == 0
    assert hn.mine(df, F.lit(False)).count() == 0
    with pytest.raises(Exception, match="too long"):
        hn.mine(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>"), F.lit(True)).count()
