"""Fusing modalities: vectors and scores as columns, weights as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import arrays as A


def early(df: DataFrame, modalities: list[str], name: str = "fused") -> DataFrame:
    """Vectors joined end to end in the given order."""
    return df.withColumn(name, F.concat(*[F.transform(m, lambda x: x.cast("double")) for m in modalities]))


def late(df: DataFrame, scores: list[str], weights: list[float] | None = None, masks: list[str] | None = None, name: str = "fused") -> DataFrame:
    """The weighted sum of scores; masked-out modalities (mask 0 or score NULL) leave their weight to the others (divided by the sum + 1e-5)."""
    weights = weights or [1.0 / len(scores)] * len(scores)
    use = [F.lit(float(w)) * F.when(F.col(s).isNull() | ((F.col(m) == 0) if m else F.lit(False)), 0.0).otherwise(1.0) for s, w, m in zip(scores, weights, masks or [None] * len(scores), strict=True)]
    total = sum(use[1:], use[0]) + 1e-5 if masks else F.lit(1.0)
    value = [u * F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for u, s in zip(use, scores, strict=True)]
    return df.withColumn(name, sum(value[1:], value[0]) / total)


def gate(df: DataFrame, modalities: list[str], gates: str, masks: str | None = None, name: str = "fused") -> DataFrame:
    """``gate`` (softmax of the gate scores, masked and renormalised) and the scaled vectors joined end to end."""
    g = A.softmax(F.col(gates))
    if masks:
        g = F.zip_with(g, F.col(masks), lambda a, m: a * m.cast("double"))
        g = F.transform(g, lambda a: a)
    out = df.withColumn("_g", g)
    out = out.withColumn("gate", F.transform("_g", lambda a: a / (A.total(F.col("_g")) + F.lit(1e-5))) if masks else F.col("_g")).drop("_g")
    return out.withColumn(name, F.concat(*[F.transform(m, lambda x, i=i: x.cast("double") * F.get(F.col("gate"), F.lit(i))) for i, m in enumerate(modalities)]))


def mean_gate(df: DataFrame, modalities: list[str], gate_col: str = "gate") -> DataFrame:
    return df.select(F.posexplode(gate_col).alias("i", "g")).groupBy("i").agg(F.avg("g").alias("mean_gate")).select(F.get(F.array(*[F.lit(m) for m in modalities]), F.col("i")).alias("modality"), "mean_gate")
