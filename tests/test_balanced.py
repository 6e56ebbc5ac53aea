"""Splits by several labels and folds by class counts against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tilewright.operators import splits


def md5(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16)


def plain(rows, labels, shares, seed=42):
    """Part of each group: strata of equal count vectors, each dealt by ``deal`` and in md5 order."""
    vectors = defaultdict(Counter)
    for group, *values in rows:
        for i, v in enumerate(values):
            vectors[group][(i, v)] += 1
    names = sorted({c for v in vectors.values() for c in v}, key=lambda c: (c[0], c[1] is not None, str(c[1])))
    number = {c: k for k, c in enumerate(names)}
    strata = defaultdict(list)
    for group, v in vectors.items():
        entries = sorted((number[c], n) for c, n in v.items())
        strata["[" + ",".join(f'{{"c":{c},"n":{n}}}' for c, n in entries) + "]"].append(group)
    order = sorted(strata)
    counts = splits.deal([(len(strata[s]), {number[c]: float(n) for c, n in vectors[strata[s][0]].items()}) for s in order], shares)
    out = {}
    for s, c in zip(order, counts, strict=True):
        members = sorted(strata[s], key=lambda g: (md5(seed, g), g))
        at = 0
        for part, n in enumerate(c):
            out.update(dict.fromkeys(members[at : at + n], part))
            at += n
    return out, vectors


def within_one_group(out, vectors, shares, groups=1.0):
    """Every class's rows in every part are within so many of the largest group's rows of the class of its target."""
    total, most, have = Counter(), Counter(), defaultdict(Counter)
    for g, v in vectors.items():
        for c, n in v.items():
            total[c] += n
            most[c] = max(most[c], n)
            have[out[g]][c] += n
    for part, share in enumerate(shares):
        for c, t in total.items():
            assert abs(have[part][c] - share * t) <= groups * most[c] + 1e-9, (part, c, have[part][c], share * t)


def test_folds_by_counts(spark):
    rng = random.Random(3)
    rows = [(g, rng.choices("abcd", (8, 4, 2, 1))[0]) for g in range(300) for _ in range(rng.randrange(1, 5))]
    df = spark.createDataFrame([*rows, (7, None), (7, None)], "n long, m string")
    got = splits.balanced_kfold(df, "n", ["m"], 5)
    assert got.columns == ["n", "fold", "split"]
    own = {}
    for r in got.collect():
        if r.split == "val":
            assert r.n not in own
            own[r.n] = r.fold
    want, vectors = plain([*rows, (7, None), (7, None)], ["m"], [0.2] * 5)
    assert own == want
    within_one_group(own, vectors, [0.2] * 5)


def test_query_deals_all_users(spark, sf):
    from __spark_entry__ import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = [tuple(r) for r in events.select("user_id", "event_type").collect()]
    want, vectors = plain(rows, ["event_type"], [0.2] * 5)
    got = {r.user_id: r.fold for r in QUERIES["splits_balanced_kfold"](spark, sf).where("split = 'val'").collect()}
    assert got == want
    within_one_group(got, vectors, [0.2] * 5)


def test_several_labels(spark, sf):
    from __spark_entry__ import QUERIES

    rows = [(r.c_custkey, r.c_mktsegment, str(r.c_nationkey), str(r.c_acctbal < 0).lower()) for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    shares = [0.8 - 0.8 * 0.15, 0.8 * 0.15, 0.2]
    want, vectors = plain(rows, 3, shares)
    got = QUERIES["splits_stratified_labels"](spark, sf)
    assert got.columns == ["c_custkey", "c_mktsegment", "c_nationkey", "owes", "split"]
    assert {r.c_custkey: ["train", "val", "test"].index(r.split) for r in got.collect()} == want
    within_one_group(want, vectors, shares, 1.5)  # 33 values of three labels over 150 groups


@pytest.mark.parametrize("limit", [60, 12, 3])
def test_many_vectors_become_alike(spark, limit, monkeypatch):
    """With few strata allowed, counts are rounded; groups stay whole and shares close."""
    monkeypatch.setattr(splits, "STRATA", limit)
    rng = random.Random(8)
    rows = [(g, rng.choice("ab"), rng.choice("xyz")) for g in range(400) for _ in range(1 if g % 3 else rng.randrange(2, 30))]
    df = spark.createDataFrame(rows, "g long, u string, v string")
    got = [(r.g, r.part) for r in splits.balanced(df, "g", ["u", "v"], [0.25] * 4).collect()]
    assert len(got) == 400 == len({g for g, _ in got})
    _, vectors = plain(rows, 2, [0.25] * 4)
    have, total = defaultdict(Counter), Counter()
    for g, part in got:
        have[part].update(vectors[g])
        total.update(vectors[g])
    assert all(abs(have[p][c] / total[c] - 0.25) < 0.09 for p in range(4) for c in total)


def test_empty_and_too_many(spark, monkeypatch):
    df = spark.createDataFrame([], "g long, u string")
    assert splits.balanced_kfold(df, "g", ["u"]).count() == 0
    monkeypatch.setattr(splits, "CLASSES", 2)
    with pytest.raises(ValueError):
        splits.balanced(spark.createDataFrame([(i, str(i)) for i in range(4)], "g long, u string"), "g", ["u"], [1.0])
