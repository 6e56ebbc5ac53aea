"""Bags of vectors: pooling, alignment, top-k, padding, moments."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import arrays as A
from tilewright.functions.names import own_names
from tilewright.functions.hashing import draw, present


def by_prefix(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix)])


def select_features(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, *names)


def align(labels: DataFrame, key: str, *features: DataFrame) -> DataFrame:
    """Rows present in every table, columns in the given order."""
    return reduce(lambda a, b: a.join(b, key), features, labels)


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


@own_names("slide", "vector", "coords")
def check_shape(df: DataFrame, slide: str = "slide_id", vector: str = "embedding", coords: tuple[str, ...] = ()) -> DataFrame:
    """Slides whose vectors differ in length or are NULL, or that lack a coordinate."""
    missing = F.lit(False)
    for c in coords:
        missing = missing | F.col(c).isNull()
    per = df.groupBy(slide).agg(F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"), F.count_if(F.col(vector).isNull()).alias("null_vectors"), F.count_if(missing).alias("missing_coords"))
    return per.where("min_dim <> max_dim OR null_vectors > 0 OR missing_coords > 0")


@own_names("key", "vector")
def mean_pool(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean of each bag: partial sums per task, one row per bag and task in the shuffle."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    return df.groupBy(key).agg(vector_to_array(Summarizer.mean(v)).alias("pooled"))


@own_names("key", "vector")
def max_pool(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    return df.groupBy(key).agg(vector_to_array(Summarizer.max(v)).alias("pooled"))


def long_form(df: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def gather(df: DataFrame, *keys: str, value: str = "v", name: str = "pooled") -> DataFrame:
    """Arrays from (keys, pos, value) rows; one element each, so groups have the vector's length."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias(name))


@own_names("key", "score")
def softmax_weights(df: DataFrame, key: str, score: str) -> DataFrame:
    """``weight``: softmax of the score within the bag, shifted by the bag's maximum."""
    top = df.groupBy(key).agg(F.max(score).alias("_top"))
    joined = df.join(top, key).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = joined.groupBy(key).agg(F.sum("_e").alias("_total"))
    return joined.join(total, key).withColumn("weight", F.col("_e") / F.col("_total")).drop("_top", "_e", "_total")


def _weighted_sum(df: DataFrame, keys: tuple[str, ...], vector: str, weight: str) -> DataFrame:
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double") * F.col(weight)))
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.sum(v)).alias("pooled"))


@own_names("key", "score", "vector")
def softmax_pool(df: DataFrame, key: str, score: str, vector: str = "embedding") -> DataFrame:
    """Attention pooling: the sum of softmax weight times vector."""
    return _weighted_sum(softmax_weights(df, key, score), (key,), vector, "weight")


@own_names("key", "score", "vector")
def two_tier_pool(df: DataFrame, key: str, score: str, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    """Tiles assigned softly (softmax of cosine) to fixed centres, pooled per centre, then over centres by a softmax of their mean weight."""
    w = softmax_weights(df, key, score)
    c = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in centres])
    soft = w.withColumn("_a", A.softmax(F.transform(c, lambda v: F.coalesce(A.cosine(F.col(vector), v), F.lit(0.0)))))
    long = soft.select(key, vector, "weight", F.posexplode("_a").alias("centre", "a")).withColumn("_w", F.col("a") * F.col("weight"))
    sums = _weighted_sum(long, (key, "centre"), vector, "_w")
    mass = long.groupBy(key, "centre").agg(F.sum("a").alias("mass"), F.sum("_w").alias("score"))
    per = sums.join(mass, [key, "centre"]).withColumn("pooled", F.transform("pooled", lambda x: x / (F.col("mass") + 1e-5)))
    return _weighted_sum(softmax_weights(per, key, "score"), (key,), "pooled", "weight")


def regions(df: DataFrame, key: str, count: int, x: str = "x", y: str = "y", index: str | None = None) -> DataFrame:
    """``region`` of each tile on a square grid over the bag's extent, or the place modulo ``count`` without coordinates."""
    if index is not None:
        return df.withColumn("region", F.pmod(F.col(index), F.lit(count)).cast("int"))
    g = int(count**0.5)
    span = df.groupBy(key).agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    unit = lambda c: (F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}") + 1e-5)
    raw = F.floor(F.floor(unit(x) * g) * g + unit(y) * g)
    return df.join(span, key).withColumn("region", F.greatest(F.lit(0), F.least(F.lit(count - 1), raw)).cast("int")).select(*df.columns, "region")


def region_pool(df: DataFrame, key: str, count: int, dim: int, vector: str = "embedding", **where) -> DataFrame:
    """Mean inside each region, then over all regions; an empty region is a zero vector."""
    per = regions(df, key, count, **where).groupBy(key, "region").agg(vector_to_array(Summarizer.mean(array_to_vector(F.transform(vector, lambda x: x.cast("double"))))).alias("r"))
    return per.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector("r"))).alias("s")).select(key, F.transform("s", lambda x: x / F.lit(float(count))).alias("pooled"))


def pool_or_zero(slides: DataFrame, patches: DataFrame, key: str, dim: int, vector: str = "embedding") -> DataFrame:
    """A row for every slide: pooled vector, or zeros with ``num_patches`` 0 and ``empty`` true."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    pooled = patches.groupBy(key).agg(vector_to_array(Summarizer.mean(v)).alias("pooled"), F.count("*").alias("num_patches"))
    return slides.select(key).distinct().join(pooled, key, "left").select(key, F.coalesce("pooled", A.zeros(dim)).alias("pooled"), F.coalesce("num_patches", F.lit(0)).alias("num_patches"), F.col("num_patches").isNull().alias("empty"))


@own_names("key", "proba")
def slide_vote(df: DataFrame, key: str, proba: str) -> DataFrame:
    """Mean class probabilities of the tiles and the first class with the largest."""
    return mean_pool(df, key, proba).select(key, F.col("pooled").alias("mean_proba"), A.argmax(F.col("pooled")).alias("vote"))


@own_names("group", "columns", "bounds")
def moment_match(df: DataFrame, group: str, columns: list[str], reference, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Each group's columns moved to the mean and population deviation of the reference group; values clipped to optional bounds."""
    stats = df.groupBy(group).agg(*[f(present(F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    ref = stats.where(F.col(group) == F.lit(reference)).select(*[F.col(f"_{n}_{c}").alias(f"_r{n}_{c}") for c in columns for n in "ms"])
    out = df.join(stats, group).join(F.broadcast(ref))  # one row
    for c in columns:
        v = (F.col(c) - F.col(f"_m_{c}")) * (F.col(f"_rs_{c}") / (F.col(f"_s_{c}") + 1e-8)) + F.col(f"_rm_{c}")
        lo, hi = (bounds or {}).get(c, (None, None))
        v = F.greatest(v, F.lit(lo)) if lo is not None else v
        out = out.withColumn(c, F.least(v, F.lit(hi)) if hi is not None else v)
    return out.select(*df.columns)


def first_valid_group(df: DataFrame, group: str, columns: list[str]):
    """The least group whose columns all have a spread: a default reference."""
    stats = df.groupBy(group).agg(F.least(*[F.stddev_pop(present(F.col(c))) for c in columns]).alias("s") if len(columns) > 1 else F.stddev_pop(present(F.col(columns[0]))).alias("s"))
    return stats.where("s > 0").agg(F.min(group)).first()[0]


@own_names("key", "tie", "vector")
def top_k_norm(df: DataFrame, key: str, k: int, tie: str, vector: str = "embedding") -> DataFrame:
    """The k largest norms of each bag (all of a smaller bag)."""
    w = W.partitionBy(key).orderBy(F.desc("norm"), tie)
    return df.withColumn("norm", A.l2_norm(F.col(vector))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


@own_names("key", "tie")
def sample_k(df: DataFrame, key: str, k: int, tie: str, seed: int = 42) -> DataFrame:
    """k rows of each bag without replacement, by the draw of their id."""
    w = W.partitionBy(key).orderBy("_d", tie)
    return df.withColumn("_d", draw(seed, tie)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "_d")


def pad(df: DataFrame, key: str, k: int, dim: int, vector: str = "embedding") -> DataFrame:
    """``key, slot, vector, x, y, is_pad``: bags of fewer than k rows filled with zero vectors at (0, 0)."""
    short = df.groupBy(key).agg(F.count("*").cast("int").alias("n")).where(F.col("n") < k)
    pads = short.select(key, F.explode(F.sequence(F.col("n"), F.lit(k - 1))).alias("slot")).select(key, A.zeros(dim).alias(vector), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("is_pad"))
    real = df.select(key, F.transform(vector, lambda v: v.cast("double")).alias(vector), *[F.col(c).cast("int").alias(c) if c in df.columns else F.lit(0).alias(c) for c in "xy"], F.lit(False).alias("is_pad"))
    return real.unionByName(pads)


@own_names("key", "weight", "label")
def pseudo_labels(df: DataFrame, key: str, weight: str, label: str) -> DataFrame:
    """``pseudo``: the bag's label above the bag's lower median weight, else the other."""
    mid = df.groupBy(key).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {weight})").alias("_mid"))
    return df.join(mid, key).withColumn("pseudo", F.when(F.col(weight) > F.col("_mid"), F.col(label)).otherwise(1 - F.col(label))).drop("_mid")
