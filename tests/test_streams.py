"""Manifests taken in for ever once, late rows of windowed counts, and intervals of any metric in subsets."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import metrics, sampling
from tilewright.plans.queries_metrics import weighted_accuracy
from tilewright.plans.registry import Tables
from tilewright.streaming import manifests

SCHEMA = "tile_id string, ts timestamp, background_fraction double, laplacian_var double, pen_fraction double"
NOON = dt.datetime(2024, 1, 1, 12)


def put(spark, path, rows):
    good = [(i, NOON + dt.timedelta(minutes=m), 0.1, sharp, 0.0) for i, m, sharp in rows]
    spark.createDataFrame(good, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_each_id_once_for_ever(spark, tmp_path):
    """A repeat long after the first, a repeat in its batch, a rejected row, and a batch that runs again."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def take(checkpoint=check):
        stream = manifests.read_manifests(spark, source, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
        manifests.ingest_manifest(stream, out, checkpoint).awaitTermination()
        return sorted((r.tile_id or "", r.laplacian_var) for r in spark.read.parquet(out).collect())

    put(spark, source, [("a", 5, 20.0), ("a", 1, 21.0), ("b", 0, 30.0), ("blurred", 0, 1.0), (None, 0, 40.0)])
    assert take() == [("", 40.0), ("a", 21.0), ("b", 30.0)]
    put(spark, source, [("a", 60 * 24 * 400, 99.0), ("c", 60 * 24 * 400, 50.0), (None, 9, 41.0), ("blurred", 3, 60.0)])
    assert take() == [("", 40.0), ("a", 21.0), ("b", 30.0), ("blurred", 60.0), ("c", 50.0)]
    put(spark, source, [("old", -60 * 24 * 400, 70.0)])
    assert take() == [("", 40.0), ("a", 21.0), ("b", 30.0), ("blurred", 60.0), ("c", 50.0), ("old", 70.0)]
    # all files again, as after the loss of the checkpoint: the same batches over the same folders, nothing twice
    again = take(str(tmp_path / "check2"))
    assert len({i for i, _ in again}) == len(again) == 6


def test_late_rows_of_windows(spark, tmp_path):
    """A row later than the watermark isn't counted; one within it is."""
    source = str(tmp_path / "in")
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        counts = manifests.qc_counts(manifests.read_manifests(spark, source, schema, files_per_trigger=1), late="30 minutes")
        counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    put(spark, source, [("a", 0, 20.0), ("b", 50, 2.0)])
    run()
    put(spark, source, [("c", 40, 20.0), ("d", 75, 20.0)])  # c is within 30 minutes of b
    run()
    put(spark, source, [("e", 200, 20.0)])
    run()
    put(spark, source, [("late", 10, 20.0), ("f", 210, 20.0)])
    run()
    put(spark, source, [("g", 400, 20.0)])
    run()
    got = {r.start: (r.kept, r.rejected) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[NOON] == (2, 1) and got[NOON + dt.timedelta(hours=1)] == (1, 0)
    batch = {r.start: (r.kept, r.rejected) for r in manifests.qc_counts(spark.read.parquet(source)).collect()}
    assert batch[NOON] == (3, 1)


def plain(rows, metric, subsets, total, n, seed=42):
    """Of (id, ...) pandas rows."""
    draw = lambda i: int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:8], 16)
    rows = rows.assign(s=[draw(i) % subsets for i in rows["id"]]).sort_values("id")
    found = []
    for number, part in rows.groupby("s"):
        rng = np.random.default_rng([seed, number])
        part = part.drop(columns="s").reset_index(drop=True)
        values = [metric(part, rng.multinomial(total, np.full(len(part), 1 / len(part)))) for _ in range(n)]
        found.append((np.mean(values), np.quantile(values, 0.025), np.quantile(values, 0.975)))
    return [*np.mean(found, axis=0), len(found)]


def test_little_bootstraps_query(spark, sf):
    from __spark_entry__ import QUERIES

    rows = Tables(spark, sf).predictions().select("id", "y_true", "y_pred").toPandas()
    got = QUERIES["sampling_little_bootstraps"](spark, sf).first()
    assert list(got) == pytest.approx(plain(rows, weighted_accuracy, max(1, round(len(rows) / 100)), len(rows), 100), abs=1e-6)


def test_little_bootstraps_near_the_exact_interval(spark):
    """Subsets of 500 of 4,000 rows: the interval of all rows, not of 500."""

    def auroc(frame, weights):
        order = np.argsort(frame.score.to_numpy(), kind="stable")
        y, w, s = frame.y.to_numpy()[order], weights[order].astype(float), frame.score.to_numpy()[order]
        _, tie = np.unique(s, return_inverse=True)
        neg = np.bincount(tie, weights=w * (y == 0))
        below = np.cumsum(neg) - neg / 2
        pos = w * (y == 1)
        return float((pos * below[tie]).sum() / (pos.sum() * neg.sum()))

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    score = np.round(rng.normal(y, 1.2), 2)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, score, strict=True))], "id long, y int, score double")
    got = sampling.little_bootstraps(df, "id", auroc, rows_per_task=500, n=60).first()
    exact = sampling.ci(metrics.auroc(sampling.bootstrap_simple(df, "id", 60), "y", "score", ("replicate",)), "auroc").first()
    assert got.subsets == 8
    assert got.ci_lower == pytest.approx(exact.ci_lower, abs=0.006) and got.ci_upper == pytest.approx(exact.ci_upper, abs=0.006)
    largest = df.withColumn("s", F.pmod(sampling.draw(42, "id"), F.lit(8))).groupBy("s").count().agg(F.max("count")).first()[0]
    assert largest < 600
    assert sampling.little_bootstraps(df.limit(0), "id", auroc).first().value is None
