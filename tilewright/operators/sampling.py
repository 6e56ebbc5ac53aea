"""Bootstrap replicates as tables, with draws that depend on keys alone."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.hashing import draw
from tilewright.functions.names import own_names
from tilewright.operators.prefix import numbered
from tilewright.plans.lineage import written


@own_names()
def replicates(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each replicate (explode, no join)."""
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


@own_names("key")
def bootstrap_simple(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``replicate`` and the rows of ``df``: as many draws as rows, with replacement. Exact; for large tables use ``poisson``."""
    rows = df.count()
    draws = df.sparkSession.range(n * rows).select(F.expr(f"cast(id div {max(rows, 1)} as int)").alias("replicate"), (F.col("id") % max(rows, 1)).alias("_j"))
    draws = draws.select("replicate", F.pmod(draw(seed, "replicate", "_j"), F.lit(max(rows, 1))).alias("_at"))
    return draws.join(numbered(df, key, name="_place"), F.col("_at") == F.col("_place")).select(*df.columns, "replicate")


@own_names("key", "label")
def bootstrap_stratified(df: DataFrame, key: str, label: str, n: int, seed: int = 42, n_samples: int | None = None) -> DataFrame:
    """Per class as many draws as it has rows: the classes keep their shares.

    With ``n_samples`` each class gets max(1, round(share * n_samples)) draws instead,
    and the classes in order are cut where ``n_samples`` are reached. Each row is a
    draw of its class (or several, or none), so draws are never listed in one place.
    """
    placed = numbered(df, key, (label,), "_place")
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_m")).withColumn("_k", F.col("_m"))
    if n_samples is not None:  # a row for each class
        share = F.col("_m") / F.sum("_m").over(W.partitionBy(F.lit(0)))
        sizes = sizes.withColumn("_k", F.greatest(F.lit(1), F.bround(share * n_samples).cast("long")))
        before = F.coalesce(F.sum("_k").over(W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("_l")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.withColumn("_k", F.greatest(F.lit(0), F.least(F.col("_k"), F.lit(n_samples) - before)))
    turns = F.sequence(F.lit(0).cast("long"), F.expr("(_k - _place - 1) div _m"))
    draws = placed.select(F.col(label).alias("_c"), "_place").join(sizes, F.col("_c").eqNullSafe(F.col("_l"))).where("_place < _k")
    draws = replicates(draws.withColumn("_turn", F.explode(turns)).withColumn("_j", F.col("_place") + F.col("_turn") * F.col("_m")), n)
    draws = draws.select("_l", "replicate", F.pmod(draw(seed, "_l", "replicate", "_j"), F.col("_m")).alias("_at"))
    return draws.join(placed, F.col("_l").eqNullSafe(F.col(label)) & (F.col("_at") == F.col("_place"))).select("replicate", *df.columns)


@own_names("group")
def bootstrap_group(df: DataFrame, group: str, n: int, seed: int = 42) -> DataFrame:
    """Groups drawn with replacement, each with all its rows."""
    ids = written(numbered(df.select(group).distinct(), group, name="_place"))
    m = ids.count()
    draws = replicates(ids.select("_place"), n)
    draws = draws.select("replicate", F.pmod(draw(seed, "replicate", "_place"), F.lit(max(m, 1))).alias("_at"))
    return draws.join(ids, F.col("_at") == F.col("_place")).select("replicate", group).join(df, group)


def poisson_steps(most: int = 11) -> list[float]:
    """Shares of Poisson draws with mean 1 that are at most 0, 1 ... ``most`` - 1."""
    term = upto = math.exp(-1)
    out = [upto]
    for k in range(1, most):
        term /= k
        upto += term
        out.append(upto)
    return out


@own_names("key")
def poisson(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``replicate`` and ``weight`` (Poisson with mean 1, from a hash of key and replicate): no join, no shuffle. Rows of weight 0 go."""
    u = (draw(seed, key, "replicate") + 0.5) / F.lit(2.0**32)
    weight = sum((F.when(u > step, 1).otherwise(0) for step in poisson_steps()), F.lit(0))
    return replicates(df, n).withColumn("weight", weight).where("weight > 0")


@own_names("value", "by")
def ci(df: DataFrame, value: str, by: tuple[str, ...] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``value, ci_lower, ci_upper`` over replicates: linear percentiles; NULL and NaN replicates are skipped."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(low)).alias("ci_lower"), F.percentile(value, F.lit(high)).alias("ci_upper"), F.count("*").alias("replicates"))


def ci_for(sampled: DataFrame, metric: Callable, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Any metric of a pandas frame, with its interval: one call for each replicate of a bounded sample; ``little_bootstraps`` takes tables of any size."""

    def one(pdf):
        import pandas as pd

        return pd.DataFrame({"replicate": [int(pdf.replicate.iloc[0])], "value": [float(metric(pdf))]})

    return ci(sampled.groupBy("replicate").applyInPandas(one, "replicate int, value double"), "value", (), low, high)


def little_bootstraps(df: DataFrame, key: str, metric: Callable, rows_per_task: int = 5000, n: int = 100, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``value, ci_lower, ci_upper, subsets`` of any metric ``metric(frame, weights)``: a bag of little bootstraps.

    The rows fall by the draw of their unique ``key`` into disjoint subsets of about ``rows_per_task``. Each subset draws ``n``
    resamples of as many rows as there are in all, as multinomial weights of its own rows, and has an interval from them;
    the result is the mean over the subsets. A task holds one subset, however many rows there are. A metric that is undefined (NaN) on a
    resample is left out; so is a subset where it always is. NULLs without rows.
    """
    import numpy as np
    import pandas as pd

    rows = df.count()
    subsets = max(1, round(rows / rows_per_task))

    def one(pdf):
        number = int(pdf["_subset"].iloc[0])
        frame = pdf.drop(columns="_subset").sort_values(key, kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, number])
        values = np.array([metric(frame, rng.multinomial(rows, np.full(len(frame), 1 / len(frame)))) for _ in range(n)], float)
        values = values[~np.isnan(values)]
        if not len(values):
            return pd.DataFrame({"value": [], "ci_lower": [], "ci_upper": []}, dtype=float)
        return pd.DataFrame({"value": [values.mean()], "ci_lower": [np.quantile(values, low)], "ci_upper": [np.quantile(values, high)]})

    dealt = df.withColumn("_subset", F.pmod(draw(seed, key), F.lit(subsets)).cast("int"))
    each = dealt.groupBy("_subset").applyInPandas(one, "value double, ci_lower double, ci_upper double")
    return each.agg(*[F.avg(c).alias(c) for c in ("value", "ci_lower", "ci_upper")], F.count("*").alias("subsets"))
