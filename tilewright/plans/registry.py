"""Named queries over the test tables, each with the SQL that DuckDB runs on the same files where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``; ``t(name)`` reads a table and ``t.spark`` is the session."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -------------------------------------------------- the tables in their roles

    def slides(self) -> DataFrame:
        power = F.when(F.col("o_orderkey") % 3 == 0, 40.0).when(F.col("o_orderkey") % 3 == 1, 20.0)
        return self("orders").select(F.col("o_orderkey").alias("slide_id"), (500 + F.col("o_orderkey") % 700).cast("int").alias("width"), (400 + F.col("o_custkey") % 500).cast("int").alias("height"), power.alias("objective_power"))

    def tiles(self) -> DataFrame:
        return self("lineitem").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("tile"), F.col("l_partkey").cast("int").alias("x"), F.col("l_suppkey").cast("int").alias("y"), (F.col("l_discount") * 10).alias("tissue_fraction"), F.col("l_quantity").alias("laplacian_var"), (F.col("l_tax") * 12).alias("background_fraction"), F.col("l_discount").alias("pen_fraction"))

    def predictions(self) -> DataFrame:
        score = F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0))
        return self("documents").join(self("labels"), "doc_id").select(F.col("doc_id").alias("id"), "source", F.col("quality").alias("y_true"), score.alias("score"), (score >= 0.5).cast("int").alias("y_pred"))

    def survival(self) -> DataFrame:
        return self("lineitem").select(F.col("l_quantity").alias("time"), (F.col("l_returnflag") == "R").alias("event"), F.col("l_discount").alias("risk"), F.col("l_linestatus").alias("grp"))

    def patches(self) -> DataFrame:
        """Vectors scaled by 1 to 7, so that their norms differ."""
        k = (1 + F.col("vec_id") % 7).cast("double")
        return self("embeddings").select(F.col("label").alias("slide_id"), F.col("vec_id").alias("patch"), F.transform("embedding", lambda v: v.cast("double") * k).alias("embedding"), (F.col("vec_id") * 37 % 101).cast("int").alias("x"), (F.col("vec_id") * 53 % 97).cast("int").alias("y"), ((F.col("vec_id") * 29 % 83) / F.lit(41.0)).alias("score"))

    def trials(self) -> DataFrame:
        ok = F.col("event_id") % 11 != 0
        return self("events").select(F.col("event_id").alias("trial_id"), "event_type", F.when(ok, F.col("value")).alias("metric"))

    def voxels(self) -> DataFrame:
        cell = self("lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 10).cast("int").alias("x"), (F.floor(F.col("l_partkey") / 10) % 10).cast("int").alias("y"), F.pmod(F.col("l_orderkey"), F.lit(3)).cast("int").alias("z"))
        return cell.agg(F.floor(F.min("l_quantity") / 10).cast("int").alias("level"))

    def features(self) -> DataFrame:
        gap = lambda c, k: F.when(F.col("l_orderkey") % k != 0, F.col(c)).alias(c)
        return self("lineitem").select("l_orderkey", "l_linenumber", gap("l_quantity", 7), gap("l_extendedprice", 11), F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag").alias("label"))


SLIDES = "(SELECT o_orderkey slide_id, CAST(500 + o_orderkey % 700 AS INT) width, CAST(400 + o_custkey % 500 AS INT) height, CASE o_orderkey % 3 WHEN 0 THEN CAST(40 AS DOUBLE) WHEN 1 THEN CAST(20 AS DOUBLE) END objective_power FROM orders)"
TILES = "(SELECT l_orderkey slide_id, l_linenumber tile, CAST(l_partkey AS INT) x, CAST(l_suppkey AS INT) y, l_discount * 10 tissue_fraction, l_quantity laplacian_var, l_tax * 12 background_fraction, l_discount pen_fraction FROM lineitem)"
PRED = "(SELECT d.doc_id id, source, quality y_true, least(CAST(1 AS DOUBLE), d.n_chars / CAST(4000 AS DOUBLE)) score, CAST(least(CAST(1 AS DOUBLE), d.n_chars / CAST(4000 AS DOUBLE)) >= 0.5 AS INT) y_pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
SURV = "(SELECT l_quantity \"time\", l_returnflag = 'R' event, l_discount risk, l_linestatus grp FROM lineitem)"
PATCH = "(SELECT label slide_id, vec_id patch, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * (1 + vec_id % 7)) embedding, CAST(vec_id * 37 % 101 AS INT) x, CAST(vec_id * 53 % 97 AS INT) y, (vec_id * 29 % 83) / CAST(41 AS DOUBLE) score FROM embeddings)"
TRIALS = "(SELECT event_id trial_id, event_type, CASE WHEN event_id % 11 <> 0 THEN value END metric FROM events)"
VOXELS = "(SELECT l_suppkey sample, CAST(l_partkey % 10 AS INT) x, CAST((l_partkey // 10) % 10 AS INT) y, CAST(l_orderkey % 3 AS INT) z, CAST(floor(min(l_quantity) / 10) AS INT) level FROM lineitem GROUP BY ALL)"
FEATURES = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END l_quantity, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END l_extendedprice, l_discount, l_tax, l_returnflag AS label FROM lineitem)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison with another engine."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})
