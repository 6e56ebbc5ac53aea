"""Loss values as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import arrays as A
from tilewright.functions.names import own_names


@own_names("label")
def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (classes * count)`` of each class."""
    per = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return per.select(label, "n", (F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))).alias("weight"))


def log_loss(logits: Column, label: Column) -> Column:
    """Cross entropy of one row from its logits."""
    top = F.array_max(logits)
    return F.log(A.total(F.transform(logits, lambda x: F.exp(x - top)))) + top - F.get(logits, label)


def focal(logits: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0, weight: Column | None = None) -> Column:
    ce = log_loss(logits, label)
    out = F.lit(alpha) * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce
    return out if weight is None else out * weight


@own_names("p", "t", "by")
def dice(df: DataFrame, p: str, t: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``1 - (2 * intersection + 1) / (sum of both + 1)``."""
    inter, both = F.sum(F.col(p) * F.col(t)), F.sum(F.col(p) + F.col(t))
    return df.groupBy(*by).agg((1 - (2 * inter + 1) / (both + 1)).alias("dice_loss"))


@own_names("key", "p")
def smooth_topk(df: DataFrame, key: str, p: str, temperature: float = 1.0) -> DataFrame:
    """``-log(sum of softmax(p / T) * p + 1e-8)`` of each bag."""
    top = df.groupBy(key).agg(F.max(p).alias("_top"))
    e = df.join(top, key).withColumn("_e", F.exp((F.col(p) - F.col("_top")) / temperature))
    return e.groupBy(key).agg((-F.log(F.sum(F.col("_e") * F.col(p)) / F.sum("_e") + 1e-8)).alias("loss"))
