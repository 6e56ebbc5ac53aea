"""What drove a prediction: top tiles and features, heat maps, perturbation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.names import own_names


@own_names("key", "weight", "tie")
def top_tiles(df: DataFrame, key: str, weight: str, tie: str, k: int = 10) -> DataFrame:
    """The k largest weights of each slide, with their ``rank``."""
    w = W.partitionBy(key).orderBy(F.desc(weight), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@own_names("feature", "value")
def top_features(df: DataFrame, feature: str, value: str, k: int = 10, absolute: bool = True) -> DataFrame:
    v = F.abs(F.col(value)) if absolute else F.col(value)
    return df.orderBy(F.desc(v), feature).limit(k)


@own_names("feature", "coef")
def hazard_ratios(df: DataFrame, feature: str, coef: str, k: int = 10) -> DataFrame:
    return df.withColumn("hazard_ratio", F.exp(coef)).orderBy(F.desc("hazard_ratio"), feature).limit(k)


@own_names("modality", "weight")
def modality_importance(df: DataFrame, modality: str, weight: str) -> DataFrame:
    """Mean absolute weight, scaled to sum 1; all zero stays zero."""
    per = df.groupBy(modality).agg(F.avg(F.abs(F.col(weight))).alias("_mean"))
    total = per.agg(F.sum("_mean").alias("_total"))
    return per.join(F.broadcast(total)).select(modality, F.when(F.col("_total") > 0, F.col("_mean") / F.col("_total")).otherwise(F.lit(0.0)).alias("importance"))  # one row


@own_names("key", "weight", "x", "y")
def heatmap(df: DataFrame, key: str, height: int, width: int, weight: str = "weight", x: str = "x", y: str = "y") -> DataFrame:
    """``key, row, col, heat``: weights scaled to [0, 1] and spread by an 11 x 11 kernel; overlapping cells keep the maximum. Sparse."""
    span = df.groupBy(key).agg(*[f(c).alias(f"_{n}_{c}") for c in (x, y, weight) for n, f in (("lo", F.min), ("hi", F.max))])
    unit = lambda c: (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-5)
    placed = df.join(span, key).select(key, F.floor(unit(x) * (width - 1)).cast("int").alias("cx"), F.floor(unit(y) * (height - 1)).cast("int").alias("cy"), unit(weight).alias("w"))
    kernel = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(math.exp(-(dx * dx + dy * dy) / 25)).alias("g")) for dx in range(-5, 6) for dy in range(-5, 6)])
    spread = placed.withColumn("k", F.explode(kernel)).select(key, (F.col("cy") + F.col("k.dy")).alias("row"), (F.col("cx") + F.col("k.dx")).alias("col"), (F.col("w") * F.col("k.g")).alias("heat"))
    return spread.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).groupBy(key, "row", "col").agg(F.max("heat").alias("heat"))


def perturb(df: DataFrame, features: list[str], score, key: str, background: dict[str, float] | None = None) -> DataFrame:
    """``feature, importance``: mean absolute change of a prediction when the feature is set to its background mean (or 0).

    ``score`` takes a list of columns and returns a column: the model as an expression.
    """
    values = background or {}
    real = score([F.col(f) for f in features])
    changed = [F.struct(F.lit(f).alias("feature"), F.abs(real - score([F.lit(float(values.get(g, 0.0))) if g == f else F.col(g) for g in features])).alias("change")) for f in features]
    return df.select(F.explode(F.array(*changed)).alias("c")).groupBy("c.feature").agg(F.avg("c.change").alias("importance"))


def slide_report(predictions: DataFrame, tiles: DataFrame, key: str, weight: str, tie: str, k: int = 3, modalities: DataFrame | None = None, features: DataFrame | None = None, n_features: int = 10) -> DataFrame:
    """Prediction, confidence and the top tiles (at most k) of each slide.

    ``modalities`` (key, modality, weight) adds ``modality_importance``, shares of the
    mean absolute weights; ``features`` (key, feature, value) adds ``top_features``, at
    most ``n_features`` by absolute value. A slide without rows there has NULL.
    """
    top = top_tiles(tiles, key, weight, tie, k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(tie).alias("tile"), F.col(weight).alias("weight")))).alias("top_tiles"))
    out = predictions.join(top, key, "left").withColumn("confidence", F.greatest(F.col("score"), 1 - F.col("score")))
    if modalities is not None:
        per = modalities.groupBy(key, "modality").agg(F.avg(F.abs(F.col("weight"))).alias("_mean"))
        share = F.coalesce(F.try_divide("_mean", F.sum("_mean").over(W.partitionBy(key))), F.lit(0.0))  # a row for each modality
        per = per.withColumn("importance", share).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("modality", "importance"))).alias("modality_importance"))
        out = out.join(per, key, "left")
    if features is not None:
        best = top_tiles(features.withColumn("_size", F.abs(F.col("value"))), key, "_size", "feature", n_features)
        best = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature", "value"))), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))).alias("top_features"))
        out = out.join(best, key, "left")
    return out
