"""Scans, sinks and work lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.hashing import require_columns
from tilewright.plans.lineage import written


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", **options) -> DataFrame:
    """A scan with a fixed schema; nothing is inferred."""
    reader = spark.read.schema(schema).options(**options)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def list_files(spark: SparkSession, path: str, *suffixes: str, recursive: bool = True) -> DataFrame:
    """``path, length, modified`` of the files with one of the suffixes, any case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    wanted = "|".join(s.lstrip(".").lower() for s in suffixes)
    return files.where(F.lower("path").rlike(rf"\.({wanted})$")).distinct() if suffixes else files


def read_images(spark: SparkSession, path: str, keep_broken: bool = True) -> DataFrame:
    """Images of a folder; a file that can't be decoded has height -1 unless dropped."""
    return spark.read.format("image").option("dropInvalid", not keep_broken).load(path)


def image_errors(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("files"), F.count_if(F.col("image.height") <= 0).alias("errors"))


def parse_embedding_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """``slide_id`` and ``x, y`` from keys such as emb_S1/tile_12_34; (0, 0) where there are no coordinates."""
    parts = F.split(F.element_at(F.split(F.col(key), "/"), -1), "_")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    ok = (F.size(parts) >= 3) & number(2).isNotNull() & number(3).isNotNull()
    at = lambda i: F.when(ok, number(i)).otherwise(F.lit(0))
    return df.withColumns({"slide_id": F.regexp_replace(F.element_at(F.split(F.col(key), "/"), 1), "^emb_", ""), "x": at(2), "y": at(3)})


def write_patches(df: DataFrame, path: str, slide: str = "slide_id", buckets: int = 64) -> None:
    """Replace the slides of ``df``; all other slides stay, also those that share a bucket with one of them. Attention defaults to ones."""
    require_columns(df, slide, "embedding")
    out = df if "attention_score" in df.columns else df.withColumn("attention_score", F.lit(None).cast("float"))
    out = out.withColumn("attention_score", F.coalesce("attention_score", F.lit(1.0)).cast("float")).withColumn("bucket", F.pmod(F.crc32(F.col(slide).cast("string")), F.lit(buckets)))
    old = _stored(df.sparkSession, path)
    if old is not None:  # the rest of the buckets that are written anew
        out = written(out)
        rest = old.join(out.select("bucket").distinct(), "bucket", "left_semi").join(out.select(slide).distinct(), slide, "left_anti")
        out = written(out.unionByName(rest, allowMissingColumns=True))
    (out.repartition("bucket").sortWithinPartitions("bucket", slide).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_patches(patches: DataFrame, slide=None, split: str | None = None, catalog: DataFrame | None = None, slide_col: str = "slide_id") -> DataFrame:
    """Patches of one slide, or of the slides that the catalog puts in a split. An unknown slide raises."""
    out = patches
    if slide is not None:
        out = out.where(F.col(slide_col) == F.lit(slide))
        if out.isEmpty():
            raise KeyError(f"no slide {slide!r}")
    if split is not None:
        out = out.join(catalog.where(F.col("split") == split).select(slide_col), slide_col, "left_semi")
    return out


def slide_catalog(patches: DataFrame, slide: str = "slide_id", vector: str = "embedding", extra: tuple[str, ...] = ()) -> DataFrame:
    """Patches, dimension and the given attributes (least value) of each slide."""
    return patches.groupBy(slide).agg(F.count("*").alias("num_patches"), F.max(F.size(vector)).alias("embedding_dim"), *[F.min(c).alias(c) for c in extra])


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """A manifest, feature or split table as Parquet, CSV (with header) or JSON records."""
    w = df.write.mode(mode)
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def json_records(df: DataFrame, name: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias(name))


def skip_existing(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is left: keys not in ``done``."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def default_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add the columns that are absent, with a value or a Column."""
    return df.withColumns({c: v if hasattr(v, "_jc") else F.lit(v) for c, v in defaults.items() if c not in df.columns})


def file_stem(path):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def pair_files(images: DataFrame, masks: DataFrame, suffix: str = "_mask", path: str = "path") -> DataFrame:
    """Images with the mask of the same stem plus suffix; ``mask_path`` NULL and ``matched`` false where there is none."""
    i = images.select(F.col(path).alias("image_path"), file_stem(F.col(path)).alias("stem"))
    m = masks.select(F.col(path).alias("mask_path"), file_stem(F.col(path)).alias("mask_stem"))
    return i.join(m, F.concat("stem", F.lit(suffix)) == F.col("mask_stem"), "left").select("stem", "image_path", "mask_path", F.col("mask_path").isNotNull().alias("matched"))


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)
