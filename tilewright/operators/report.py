"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.names import own_names

#: Published figures to compare with (benchmark, metric, value): fixed values from the literature.
PUBLISHED = [
    ("t11_14_detection", "auroc", 0.85), ("t11_14_detection", "sensitivity", 0.88), ("t11_14_detection", "specificity", 0.831),
    ("multimodal_t11_14", "auroc", 0.892), ("multimodal_t11_14", "accuracy", 0.87), ("multimodal_t11_14", "f1_macro", 0.88),
    ("pet_ct_radiomics", "c_index", 0.693), ("pet_ct_radiomics", "auroc", 0.71),
    ("multiomics_signature", "auroc", 0.76), ("multiomics_signature", "c_index", 0.72),
]


def published(spark) -> DataFrame:
    return spark.createDataFrame(PUBLISHED, "benchmark string, metric string, value double")


def vs_benchmark(metrics: DataFrame, bench: DataFrame) -> DataFrame:
    """Every model's metric beside every published value of that metric, and the difference."""
    b = bench.select("benchmark", "metric", F.col("value").alias("published"))
    return metrics.join(F.broadcast(b), "metric").withColumn("difference", F.col("value") - F.col("published"))


def metric_table(df: DataFrame, metrics: list[str], as_text: bool = False) -> DataFrame:
    """A row for each model with ``<metric>_value/_ci_lower/_ci_upper``, or text ``v [lo--hi]``."""
    if as_text:
        text = F.format_string("%.3f [%.3f--%.3f]", "value", "ci_lower", "ci_upper")
        return df.groupBy("model").pivot("metric", metrics).agg(F.max(text))
    return df.groupBy("model").pivot("metric", metrics).agg(F.max("value").alias("value"), F.max("ci_lower").alias("ci_lower"), F.max("ci_upper").alias("ci_upper"))


def run_summary(df: DataFrame, order: str = "started") -> DataFrame:
    """Stages, total seconds and whether the last stage failed."""
    return df.agg(F.count("*").alias("stages"), F.sum("seconds").alias("total_seconds"), F.max_by(F.col("status") != "ok", order).alias("last_failed"))


@own_names("group", "label")
def dataset_summary(df: DataFrame, group: str, label: str) -> DataFrame:
    """A row for each class: patients, samples and share of all samples in percent."""
    per = df.groupBy(label).agg(F.count_distinct(group).alias("patients"), F.count("*").alias("samples"))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return per.withColumn("share", 100.0 * F.col("samples") / F.sum("samples").over(whole))
