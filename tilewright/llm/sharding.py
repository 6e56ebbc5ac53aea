"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows are dealt into buckets by a hash of their id. How many rows of each bucket
go to each shard is drawn as in a uniform permutation of all rows, a
multivariate hypergeometric draw bucket by bucket. Each bucket permutes its rows
and hands the first part to shard 0, the next to shard 1 and so on; each shard
permutes what it got. Only the matrix is on the driver, BUCKETS x shards counts at most.
Buckets and shards are permuted in hash ranges, so neither step has a task that
grows with the input: ``rows_per_task`` sets the number of ranges.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.names import own_names
from tilewright.plans.lineage import written

SHARDS = 16
SEED = 20240229
ROWS_PER_TASK = 20_000
#: Most rows of the communication matrix.
BUCKETS = 1024


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from ``good`` + ``bad`` are good: inversion from the mode outwards, any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u = rng.random() - p
    up, down, x, y = p, p, mode, mode
    while u > 0 and (x < high or y > low):
        if x < high:
            up *= (good - x) * (n - x) / ((x + 1) * (bad - n + x + 1))
            x += 1
            u -= up
            if u <= 0:
                return x
        if y > low:
            down *= y * (bad - n + y) / ((good - y + 1) * (n - y + 1))
            y -= 1
            u -= down
            if u <= 0:
                return y
        if up + down < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Rows of each bucket for each shard; shard sizes are at most one apart and exact."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (k < total % shards) for k in range(shards)]
    out = []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for k in range(shards):
            rest -= room[k]
            x = hypergeometric(rng, room[k], rest, left)
            row.append(x)
            left -= x
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def _placed(df: DataFrame, group: str, ranges: int, id_col: str) -> DataFrame:
    """``_nth``: the place from 0 by ``_order`` within a group, from ranges of the order and their offsets."""
    df = df.withColumn("_range", F.floor((F.shiftrightunsigned("_order", 1) / F.lit(float(1 << 63))) * ranges).cast("int"))
    counts = df.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    offset = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), (F.sum("_n").over(W.partitionBy(group).orderBy("_range")) - F.col("_n")).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(group, "_range").orderBy(F.shiftrightunsigned("_order", 1), F.col(id_col).asc_nulls_first(), "size", "text_crc32")) - 1
    out = df.withColumn("_inside", inside).join(offset, (F.col(group) == F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("_nth", (F.col("_inside") + F.col("_offset")).cast("long")).drop("_inside", "_offset", "_range", "_g", "_r")


@own_names("id_col", "text_col", frame="docs")
def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    Null text: size 1, crc of nothing. Null ids and repeated ids are rows like
    any other (rows alike in id and text may swap places among themselves). An
    empty table gives no rows. A very long text is a row like any other: only its size and checksum travel.
    Extra columns are left out; an id column that is named like one of the result's leaves that with ``_`` at its end.
    Reruns give the same shards and slots.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = docs.count()
    buckets = min(BUCKETS, n // rows_per_task + 1)
    hashed = lambda k: F.xxhash64(F.lit(seed + k), F.col(id_col), F.col("size"), F.col("text_crc32"))
    dealt = base.withColumn("_bucket", F.pmod(hashed(0), F.lit(buckets)).cast("int"))
    found = {r["_bucket"]: r["n"] for r in dealt.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}  # at most BUCKETS rows
    matrix = communication_matrix([found.get(b, 0) for b in range(buckets)], shards, seed)
    bounds = [(b, [sum(row[: k + 1]) for k in range(shards)]) for b, row in enumerate(matrix)]
    table = docs.sparkSession.createDataFrame(bounds, "_b int, _upto array<long>")
    placed = _placed(dealt.withColumn("_order", hashed(1)), "_bucket", n // buckets // rows_per_task + 1, id_col)
    placed = placed.join(table, F.col("_bucket") == F.col("_b"))
    placed = placed.withColumn("shard", F.size(F.filter("_upto", lambda x: x <= F.col("_nth"))).cast("int"))
    # a second permutation over each whole shard
    placed = written(placed.withColumn("_order", hashed(2)).select(id_col, "size", "text_crc32", "shard", "_order"))
    out = _placed(placed, "shard", n // shards // rows_per_task + 1, id_col)
    return out.select(id_col, "size", "text_crc32", "shard", F.col("_nth").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents in 16 shards whose counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
