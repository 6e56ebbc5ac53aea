"""Trial logs: running bests, suspicious jumps, early stopping, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.names import own_names
from tilewright.operators.prefix import ranged


@own_names("order", "metric", "by")
def running_best(df: DataFrame, order: str, metric: str = "metric", mode: str = "max", by: tuple[str, ...] = ()) -> DataFrame:
    """``best_before`` and ``improved`` (strictly better). A failed trial has a NULL metric and moves nothing.

    Trials are unique in their order. Ranges of the order hold their own bests and take over the best of the ranges
    before them, so neither all trials nor those of one ``by`` are in one task.
    """
    best, better_of = (F.max, F.greatest) if mode == "max" else (F.min, F.least)
    dealt = ranged(df, order)
    totals = dealt.groupBy(*by, "_part").agg(best(metric).alias("_best"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    carried = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), best("_best").over(earlier).alias("_carried"))
    same = reduce(lambda a, x: a & F.col(x[1]).eqNullSafe(F.col(f"_by{x[0]}")), enumerate(by), F.col("_part") == F.col("_p"))
    inside = W.partitionBy(*by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(carried, same).withColumn("best_before", better_of(best(metric).over(inside), F.col("_carried")))
    better = F.col(metric) > F.col("best_before") if mode == "max" else F.col(metric) < F.col("best_before")
    improved = F.coalesce(F.when(F.col("best_before").isNull(), F.col(metric).isNotNull()).otherwise(better), F.lit(False))
    return out.select(*df.columns, "best_before", improved.alias("improved"))


@own_names("order", "metric", "by")
def suspicious(df: DataFrame, order: str, metric: str = "metric", mode: str = "max", threshold: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """``suspicious``: further from the best so far than the threshold; never the first trial."""
    return running_best(df, order, metric, mode, by).withColumn("suspicious", F.coalesce(F.abs(F.col(metric) - F.col("best_before")) > threshold, F.lit(False)))


@own_names("run", "epoch", "loss")
def early_stop(df: DataFrame, patience: int, run: str, epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """``best_epoch`` and ``stop_epoch`` of each run: the first epoch with ``patience`` epochs since the last improvement (NULL: never)."""
    w = W.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(W.unboundedPreceding, -1))
    better = before.isNull() | (F.col(loss) < before)
    marked = df.withColumn("_best", F.last(F.when(better, F.col(epoch)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    marked = marked.withColumn("_since", F.col("_n") - F.max(F.when(F.col("_best") == F.col(epoch), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    stop = marked.groupBy(run).agg(F.min(F.when(F.col("_since") >= patience, F.col(epoch))).alias("stop_epoch"))
    seen = marked.join(stop, run).where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return seen.groupBy(run).agg(F.max("_best").alias("best_epoch"), F.max("stop_epoch").alias("stop_epoch"))


@own_names("name", "metric", "by")
def retain(df: DataFrame, max_keep: int, name: str, metric: str, mode: str = "max", by: tuple[str, ...] = ()) -> DataFrame:
    """The latest ``max_keep`` checkpoints by their unique name, and the best (the earliest on ties); ``is_best`` tells it.

    The latest come from a limit that each task applies first, the best from one aggregate: nothing is sorted as a whole.
    """
    good = F.struct(F.col(metric).isNull(), (-F.col(metric) if mode == "max" else F.col(metric)), F.col(name))
    top = df.groupBy(*by).agg(F.min_by(name, good).alias("_top"))
    if not by:
        late = df.orderBy(F.desc(name)).limit(max_keep)
        marked = late.join(F.broadcast(top)).withColumn("is_best", F.col(name) == F.col("_top"))  # one row
        first = df.join(F.broadcast(top)).where(F.col(name) == F.col("_top")).withColumn("is_best", F.lit(True))
        return marked.where("NOT is_best").unionByName(first).select(*df.columns, "is_best")
    late = df.withColumn("_late", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(name)))).where(F.col("_late") <= max_keep).drop("_late")
    top = top.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_top")
    same = reduce(lambda a, x: a & F.col(x[1]).eqNullSafe(F.col(f"_by{x[0]}")), enumerate(by), F.lit(True))
    marked = late.join(top, same).withColumn("is_best", F.col(name) == F.col("_top"))
    first = df.join(top, same & (F.col(name) == F.col("_top"))).withColumn("is_best", F.lit(True))
    return marked.where("NOT is_best").unionByName(first).select(*df.columns, "is_best")


def leaderboard(df: DataFrame, metric: str, name: str, k: int = 10, mode: str = "max") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(metric) if mode == "max" else F.asc_nulls_last(metric), name).limit(k)


def config_diff(a: Column, b: Column) -> Column:
    """Keys of two maps whose values differ, with ``old`` and ``new``."""
    merged = F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("old"), y.alias("new")))
    return F.map_filter(merged, lambda k, v: ~v["old"].eqNullSafe(v["new"]))


def config_hash(m: Column) -> Column:
    """16 digits of the map's entries in the order of their keys."""
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return F.substring(F.sha2(F.array_join(entries, ";"), 256), 1, 16)


def merge_config(base: Column, over: Column) -> Column:
    """Entries of ``over`` replace those of ``base``."""
    return F.map_zip_with(base, over, lambda k, x, y: F.coalesce(y, x))


@own_names("trial", "metric", "diff")
def journal(df: DataFrame, trial: str = "trial_id", metric: str = "metric", diff: str = "diff") -> DataFrame:
    """A line for each trial: ``| id | metric | diff |``, the diff cut to 50 characters, failed trials marked."""
    value = F.when(F.col(metric).isNull(), "failed").otherwise(F.format_string("%.4f", F.col(metric)))
    return df.select(trial, F.format_string("| %s | %s | %s |", F.col(trial).cast("string"), value, F.substring(F.coalesce(diff, F.lit("")), 1, 50)).alias("line"))


def log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def verify(df: DataFrame, required: list[str]) -> DataFrame:
    """Manifest rows with a required field missing, and which."""
    gone = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull())
    return df.withColumn("missing", F.array_join(gone, ",")).where("missing <> ''")


def training_curves(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    """``epoch, metric, phase, value`` from columns named train_* and val_*."""
    wide = [c for c in df.columns if c.startswith(("train_", "val_"))]
    long = df.unpivot(epoch, wide, "name", "value")
    return long.select(epoch, F.regexp_extract("name", "^(train|val)_(.*)$", 2).alias("metric"), F.regexp_extract("name", "^(train|val)_", 1).alias("phase"), "value")
