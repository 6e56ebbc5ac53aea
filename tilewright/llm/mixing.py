"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to
``EPOCHS`` times. An entry's virtual finish time is the words of its source up to
and with it, divided by the source's target. Entries are served by finish time
until the budget (all words of the input) is spent, so each source has come to
its target when the queue is cut.

Sums along a queue are split by hash ranges: a window inside each (source, range),
offsets from the ranges' totals. An id that has more rows than a range is to have gets ranges of its
own, by a hash of its rows. The cut is found by histograms of finish times, each inside the one bin of the last that
holds it, until few entries are left to be sorted. Neither a source nor an id is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.names import own_names
from tilewright.plans.lineage import written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Documents in a hash range of all queues, about, and entries that are sorted in one task; bins of a histogram of finish times; most ids with ranges of their own.
RANGE_ROWS = 1 << 16
BINS = 1 << 14
HOT_IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` of each source; a row each, so small.

    Water-filling: sources whose weight asks for more than ``cap`` times their size
    stop there, in the order of size over weight; the rest share what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_need = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("left", left).withColumn("weight_left", weight_left)
    per = per.withColumn("full", F.col("weight") * F.col("left") > F.col("source_size") * cap * F.col("weight_left"))
    # the first source that isn't full sets the level for itself and all after it
    level = F.first(F.when(~F.col("full"), F.struct("left", "weight_left")), ignorenulls=True).over(by_need.rowsBetween(W.unboundedPreceding, 0))
    share = F.col("weight").cast("double") * level["left"].cast("double") / level["weight_left"].cast("double")
    return per.select("source", "source_size", F.coalesce(share, (F.col("source_size") * cap).cast("double")).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _ranges(sizes: DataFrame, n: int) -> DataFrame:
    """``sizes`` with ``range``: the beginning of ``key``, and for an id with very many rows the whole key and a part of its rows."""
    digits = 2
    while 16**digits * RANGE_ROWS < n and digits < 8:
        digits += 1
    start = F.substring("key", 1, digits)
    most = max(RANGE_ROWS, n // HOT_IDS)
    crowded = sizes.groupBy("source", start.alias("start")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    if crowded.isEmpty():
        return sizes.withColumn("range", start)
    hot = sizes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = written(hot.select(F.col("key").alias("hot_key"), F.ceil(F.col("n") / RANGE_ROWS).alias("cuts")))  # at most HOT_IDS rows
    part = F.concat("key", F.lit("-"), F.lpad(F.pmod(F.xxhash64("size", "hash", "row"), F.col("cuts")).cast("string"), 12, "0"))
    return sizes.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").withColumn("range", F.when(F.col("cuts").isNull(), start).otherwise(part)).drop("hot_key", "cuts")


def _cut(entries: DataFrame, budget: int, low: float, high: float) -> tuple[float | None, float, int]:
    """``low``, ``high``, ``room``: entries that finish before ``low`` are served, and from it to ``high`` the first that fit ``room``.

    ``low`` is None where all are served. A histogram of BINS bins at most is read by the driver in each
    round; the next one is of the bin in which the budget ends. At one finish time there is an entry a source.
    """
    room, finish = budget, F.col("finish")
    while True:
        width = (high - low) / BINS
        bin_ = F.least(F.floor((finish - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = entries.where(finish.between(low, high)).groupBy(bin_.cast("int").alias("bin"))
        found = bins.agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("finish").alias("low"), F.max("finish").alias("high")).collect()
        for b in sorted(found, key=lambda b: b.bin):
            if b["size"] > room:
                break
            room -= b["size"]
        else:
            return None, high, room
        narrower = b.low > low or b.high < high
        low, high = b.low, b.high
        if b.rows <= RANGE_ROWS or low == high or not narrower:
            return low, high, room


@own_names("id_col", "text_col", "source_col", frame="docs")
def mix(docs: DataFrame, weights=WEIGHTS, cap: int = EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``times`` and ``taken`` of every document.

    A null text has size 0 and is never taken. A null source is a source of its
    own, the last. Ties in the shuffled order go by id; rows that repeat id and
    source are served one by one, in the order of their size (in parts, where they are very many). Of a very long text only
    the size travels. Extra columns are left out; an id column that is named like one of the result's leaves
    that with ``_`` at its end. Empty table: no rows.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))))
    text = F.col(text_col)
    # the number of a row holds for good, as it is written; it only parts rows that are alike
    columns = [F.col(id_col), F.col(source_col).alias("source"), word_count(text).alias("size"), key.alias("key"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row")]
    sizes = written(docs.select(*columns))
    targets = written(source_targets(sizes, weights, cap))
    keyed = _ranges(sizes, sizes.count())
    inside = W.partitionBy("source", "range").orderBy("key", F.col(id_col).asc_nulls_first(), "size", "hash", "row").rowsBetween(W.unboundedPreceding, 0)
    totals = keyed.groupBy("source", "range").agg(F.sum("size").alias("n"))
    offset = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.sum("n").over(W.partitionBy("source").orderBy("range")) - F.col("n")).alias("offset"))
    queued = keyed.withColumn("own", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
    queued = queued.join(offset, _same(queued["source"], offset["s"]) & (queued["range"] == offset["r"]))
    t = targets.withColumnRenamed("source", "ts")
    queued = queued.join(t, _same(queued["source"], t["ts"])).select(id_col, "source", "range", "nth", "size", "source_size", "target", (F.col("own") + F.col("offset")).alias("sum"))
    queued = written(queued)

    epoch = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    entries = queued.where("size > 0").withColumn("epoch", epoch).withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("sum")).cast("double") / F.col("target"))
    budget, last = targets.where("source_size > 0").agg(F.sum("source_size"), F.max(F.col("source_size") * cap / F.col("target"))).first()
    low, high, room = _cut(entries, budget or 0, 0.0, float(last or 0.0))
    if low is None:
        served = entries
    else:
        order = W.orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "sum").rowsBetween(W.unboundedPreceding, 0)
        edge = entries.where(F.col("finish").between(low, high)).withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= room).drop("upto")
        served = entries.where(F.col("finish") < low).unionByName(edge)
    # a range's nth row in its source names an entry's document
    times = served.groupBy("source", "range", "nth").agg(F.count("*").alias("times")).select(F.col("source").alias("es"), F.col("range").alias("er"), F.col("nth").alias("en"), "times")
    out = queued.join(times, _same(queued["source"], times["es"]) & (queued["range"] == times["er"]) & (queued["nth"] == times["en"]), "left")
    return out.select(id_col, "source", "size", "source_size", "target", F.coalesce("times", F.lit(0)).alias("times"), (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: how many words of each document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '-')) k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] weight FROM d GROUP BY source),
fill AS (
  SELECT 0 step, source, source_size, weight, false full_ FROM per
  UNION ALL
  SELECT step + 1, source, source_size, weight, full_ OR weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (full_) OVER (), 0)) > 3 * source_size * sum(weight) FILTER (NOT full_) OVER ()
  FROM fill WHERE step < (SELECT count(*) FROM per)),
level AS (SELECT *, CASE WHEN full_ THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (full_) OVER (), 0) AS DOUBLE) / CAST(sum(weight) FILTER (NOT full_) OVER () AS DOUBLE) END target
          FROM fill WHERE step = (SELECT max(step) FROM fill)),
q AS (SELECT d.doc_id, d.source, d.size, l.source_size, l.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) upto FROM d JOIN level l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT *, CAST(epoch * source_size + upto AS DOUBLE) / target finish FROM q, range(3) r(epoch) WHERE size > 0),
s AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, upto ROWS UNBOUNDED PRECEDING) total FROM e),
t AS (SELECT doc_id, count(*) times FROM s WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) source_size, q.target, CAST(q.size * coalesce(times, 0) AS BIGINT) taken FROM q LEFT JOIN t USING (doc_id)
"""
