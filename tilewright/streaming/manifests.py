"""Incremental ingestion of tile manifests and windowed quality counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.tiles import quality_filter, reject_reason


def read_manifests(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_manifest(stream: DataFrame, out: str, checkpoint: str, key: str = "tile_id", time: str = "ts", late: str | None = None):
    """New manifest rows that pass the gate, each id once for ever, in ``out``. Takes what is there and ends.

    A batch keeps the earliest of its rows of an id (the least by all its columns on ties; NULL is an id), leaves out ids that earlier batches
    have written, and overwrites the folder ``batch=<number>``: a batch that runs again after a failure writes the
    same rows in the same place. Earlier ids are read as one column. ``late`` drops rows later than that behind the latest time; by default none is too late.
    """
    rows = stream.withWatermark(time, late) if late else stream

    def take(batch: DataFrame, number: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        row = F.struct(*columns)
        first = quality_filter(batch).groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(F.col(time).isNull(), F.col(time), F.to_json(row))).alias("_row"))
        seen = written_ids(spark, out, key, number)
        if seen is not None:
            first = first.join(seen, F.col("_key").eqNullSafe(F.col("_seen")), "left_anti")
        first.select("_row.*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_ids(spark: SparkSession, out: str, key: str, before: int) -> DataFrame | None:
    """``_seen``: the ids in ``out`` of batches before a number; None if there is nothing yet."""
    try:
        rows = spark.read.parquet(out)
    except AnalysisException:
        return None
    return rows.where(F.col("batch") < before).select(F.col(key).alias("_seen")).distinct()


def qc_counts(df: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Kept and rejected tiles for each window of event time; batch or stream."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    reason = reject_reason()
    per = rows.groupBy(F.window(time, width)).agg(F.count_if(reason.isNull()).alias("kept"), F.count_if(reason.isNotNull()).alias("rejected"))
    return per.select(F.col("window.start").alias("start"), "kept", "rejected")
