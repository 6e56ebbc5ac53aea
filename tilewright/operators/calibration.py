"""Calibration: bins of the score against the share of positives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.names import own_names


@own_names("y", "score")
def curve(df: DataFrame, y: str = "y_true", score: str = "score", bins: int = 10, include_one: bool = False) -> DataFrame:
    """``bin, n, mean_score, positive`` per non-empty bin ``[lo, hi)``; a score of 1 is in no bin unless included in the last."""
    s = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    b = F.floor(s * bins).cast("int")
    b = F.when(b < bins, b).when(F.lit(include_one), F.lit(bins - 1))
    rows = df.select(b.alias("bin"), s.alias("s"), F.col(y).cast("double").alias("t")).where(F.col("bin").isNotNull())
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg("t").alias("positive"))


@own_names("y", "score")
def ece(df: DataFrame, y: str = "y_true", score: str = "score", bins: int = 10, include_one: bool = False) -> DataFrame:
    """Expected calibration error; scores outside all bins still count in n."""
    n = df.agg(F.count("*").alias("total"))
    return curve(df, y, score, bins, include_one).join(F.broadcast(n)).agg(F.coalesce(F.sum(F.abs(F.col("positive") - F.col("mean_score")) * F.col("n") / F.col("total")), F.lit(0.0)).alias("ece"))


@own_names("y", "score")
def mce(df: DataFrame, y: str = "y_true", score: str = "score", bins: int = 10, include_one: bool = False) -> DataFrame:
    return curve(df, y, score, bins, include_one).agg(F.coalesce(F.max(F.abs(F.col("positive") - F.col("mean_score"))), F.lit(0.0)).alias("mce"))
