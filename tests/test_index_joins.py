"""Sides of an index are never broadcast, whatever Spark takes their size for."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import dedup


@pytest.mark.parametrize("hot", [4096, 8])
@pytest.mark.parametrize("group", [None, "_group"])
def test_only_hot_keys_are_broadcast(spark, monkeypatch, hot, group):
    """Spark's own limit of 10 MB, which a million hashes don't reach: their index has tens of millions of rows."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    rng = random.Random(3)
    monkeypatch.setattr(dedup, "HOT", hot)
    h = list({rng.getrandbits(60) for _ in range(100)} | {rng.getrandbits(9) << 50 for _ in range(100)})
    distinct = dedup.written(spark.createDataFrame([(x,) for x in h], "_h long").withColumn("_group", F.col("_h")))
    plan = dedup._pairs(distinct if group else distinct.drop("_group"), 470_000, 8, 60, group)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    broadcast = [x for x in joins if "BroadcastHashJoin" in x]  # hot keys only, a row for HOT rows of the index
    assert any("SortMergeJoin" in x for x in joins) and not any("hash_i" in x and "hash_j" in x for x in broadcast)
    assert bool(broadcast) == (hot == 8)


def test_links_to_roots_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    seen = []
    whole = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df: seen.append(df._jdf.queryExecution().sparkPlan().toString()) or whole(df))
    dedup.clusters(spark.createDataFrame([(i, rng.getrandbits(60)) for i in range(50)], "id long, hash long"), "id", threshold=3, bits=60)
    roots = [x for x in seen if "_root" in x and "Generate" in x]
    assert roots and not any("BroadcastHashJoin" in x for x in roots)
