"""Preprocessing contracts: fitted on the training rows, frozen, hashed, applied as literals."""

from __future__ import annotations

import hashlib
import json
import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.hashing import is_missing, present
from tilewright.operators.prefix import percentiles, ranged, running
from tilewright.plans.lineage import written


def fit_normalization(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, mean, std`` (population), ``min, max`` over the values that aren't missing: one aggregate for all features."""
    aggs = [F.struct(F.lit(f).alias("feature"), F.avg(present(F.col(f))).alias("mean"), F.stddev_pop(present(F.col(f))).alias("std"), F.min(present(F.col(f))).alias("min"), F.max(present(F.col(f))).alias("max")) for f in features]
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def fit_imputation(df: DataFrame, features: list[str], method: str = "median") -> DataFrame:
    """``feature, value``: exact median, mean, or mode (the lowest on ties) of what isn't missing."""
    if method == "median":
        long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), present(F.col(f)).alias("_v")) for f in features])).alias("x")).select("x.*")
        found = percentiles(long, "_v", [0.5], ("feature",))
        named = F.broadcast(df.sparkSession.createDataFrame([(f,) for f in features], "feature string"))  # a row for each feature
        return named.join(found, "feature", "left").select("feature", F.col("p0").alias("value"))
    kinds = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}
    aggs = [F.struct(F.lit(f).alias("feature"), kinds[method](present(F.col(f))).cast("double").alias("value")) for f in features]
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def variance(df: DataFrame, features: list[str], threshold: float = 0.01) -> DataFrame:
    """Features whose population variance is above the threshold."""
    aggs = [F.struct(F.lit(f).alias("feature"), F.var_pop(present(F.col(f))).alias("variance")) for f in features]
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*").where(F.col("variance") > threshold)


def mutual_info(df: DataFrame, features: list[str], label: str, k: int | None = None, bins: int = 10) -> DataFrame:
    """``feature, mi``: mutual information (nats) of equal-width bins with the label; the best ``k`` (20 or fewer features)."""
    bounds = fit_normalization(df, features).select("feature", "min", "max")
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), present(F.col(f)).alias("v")) for f in features])).alias("x")).select("y", "x.*").where("v IS NOT NULL")
    binned = long.join(F.broadcast(bounds), "feature").withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide((F.col("v") - F.col("min")) * bins, F.col("max") - F.col("min"))), F.lit(bins - 1)), F.lit(0)))
    cell = binned.groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    total = lambda *c: F.sum("n").over(W.partitionBy("feature", *c))
    part = F.col("n") / total() * F.log(F.col("n") * total() / (total("bin") * total("y")))
    return cell.withColumn("part", part).groupBy("feature").agg(F.sum("part").alias("mi")).orderBy(F.desc("mi"), "feature").limit(k or min(20, len(features)))


def digamma(n: Column) -> Column:
    """Of whole numbers from 1: eight steps of the recurrence, then the asymptotic series; error below 1e-11."""
    z = n.cast("double") + 8
    steps = sum((1 / (n + i) for i in range(8)), F.lit(0.0))
    return F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z) - steps


def _neighbour_radius(cells: DataFrame, k: int) -> DataFrame:
    """``cells`` (feature, y, v, n, size) with ``r``: the distance to the k-th nearest other row of the same class (the last, if it has fewer).

    Ranges of (feature, value) with a halo: the k distinct values before and after a range in the same class are copied
    to it, so no class is sorted in one task. k distinct values on either side hold the k nearest rows.
    """
    part = ranged(cells.withColumn("_order", F.struct("feature", "v")), "_order").drop("_order")
    edge = W.partitionBy("feature", "y", "_part")
    ends = part.withColumns({"_up": F.row_number().over(edge.orderBy("v")), "_down": F.row_number().over(edge.orderBy(F.desc("v")))})
    cell = F.struct("v", "n")
    ends = ends.groupBy("feature", "y", "_part").agg(*[F.sort_array(F.collect_list(F.when(F.col(c) <= k, cell))).alias(c) for c in ("_up", "_down")])
    along = W.partitionBy("feature", "y").orderBy("_part")  # a row for each range
    empty = F.slice("_up", 1, 0)
    before = F.concat(*[F.coalesce(F.lag("_down", i).over(along), empty) for i in range(k, 0, -1)])
    after = F.concat(*[F.coalesce(F.lead("_up", i).over(along), empty) for i in range(1, k + 1)])
    halo = ends.select("feature", "y", "_part", F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - k + 1), k), F.slice(after, 1, k)).alias("_near"))
    halo = halo.select("feature", "y", "_part", F.explode("_near").alias("_c")).select("feature", "y", "_part", "_c.v", "_c.n", F.lit(None).cast("long").alias("size"))
    both = part.select("feature", "y", "_part", "v", "n", "size").unionByName(halo)
    w = W.partitionBy("feature", "y", "_part").orderBy("v")
    step = lambda f, i: F.struct(F.abs(f("v", i).over(w) - F.col("v")).alias("d"), f("n", i).over(w).alias("n"))
    near = F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n")), *[step(f, i) for f in (F.lag, F.lead) for i in range(1, k + 1)])
    near = F.sort_array(F.filter(near, lambda x: x["n"].isNotNull()))
    found = both.withColumn("_near", near).where("size IS NOT NULL").withColumn("k", F.least(F.lit(k).cast("long"), F.col("size") - 1))
    first = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("r"))
    walk = F.aggregate("_near", first, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["seen"] < F.col("k"), x["d"]).otherwise(a["r"]).alias("r")))
    return found.select("feature", "y", "v", "n", "size", "k", walk["r"].alias("r"))


def mutual_info_neighbours(df: DataFrame, features: list[str], label: str, neighbours: int = 3, k: int | None = None) -> DataFrame:
    """``feature, mi``: mutual information (nats) of continuous features with a class, by nearest neighbours; the best ``k`` (20 or fewer features).

    For each row r is the distance to its ``neighbours``-th nearest row of its class (fewer in a small class), m counts the rows of
    all classes with values between v - r and v + r, ends excluded (equal to v where r is 0), and with N rows, class sizes s and
    the neighbours t it is digamma(N) + mean digamma(t) - mean digamma(s) - mean digamma(m), at least 0. Rows alike are one cell, radii come from ranges with
    halos, counts from running sums over values and asked values: no pairs. Missing values, NULL classes and classes of one row don't count;
    a feature without others has 0.
    """
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), present(F.col(f)).alias("v")) for f in features])).alias("x")).select("x.feature", "y", (F.col("x.v") + 0.0).alias("v"))
    cells = long.where("v IS NOT NULL AND y IS NOT NULL").groupBy("feature", "y", "v").agg(F.count("*").alias("n"))
    sizes = cells.groupBy(F.col("feature").alias("_f"), F.col("y").alias("_y")).agg(F.sum("n").alias("size")).where("size > 1")
    cells = written(cells.join(sizes, (F.col("feature") == F.col("_f")) & (F.col("y") == F.col("_y"))).drop("_f", "_y"))
    rows = written(_neighbour_radius(cells, neighbours))
    zero = F.col("r") == 0
    asks = [(-1, F.when(zero, F.col("v")).otherwise(F.col("v") - F.col("r")), F.when(zero, 0).otherwise(2)), (1, F.when(zero, F.col("v")).otherwise(F.col("v") + F.col("r")), F.when(zero, 2).otherwise(0))]
    asked = rows.select("feature", "y", "v", F.explode(F.array(*[F.struct(F.struct(at.alias("at"), side.alias("side")).alias("o"), F.lit(sign).alias("sign")) for sign, at, side in asks])).alias("a"))
    asked = asked.select("feature", "y", "v", "a.o", "a.sign", F.lit(0).cast("long").alias("n"))
    have = cells.select("feature", "y", "v", F.struct(F.col("v").alias("at"), F.lit(1).alias("side")).alias("o"), F.lit(0).alias("sign"), "n")
    run = running(have.unionByName(asked), "o", ["n"], ("feature",)).where("sign <> 0")
    counted = run.groupBy("feature", "y", "v").agg(F.sum(F.col("sign") * F.col("cum_n")).alias("m"))
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / n
    per = rows.join(counted, ["feature", "y", "v"]).groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(n) + mean("k") - mean("size") - mean("m")).alias("mi"))
    named = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")  # a row for each feature
    return named.join(per, "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi")).orderBy(F.desc("mi"), "feature").limit(k or min(20, len(features)))


def transform(df: DataFrame, params: dict[str, dict], method: str = "zscore") -> DataFrame:
    """Features scaled by literal parameters; a spread of zero counts as 1."""
    out = {}
    for f, p in params.items():
        shift, spread = (p["mean"], p["std"]) if method == "zscore" else (p["min"], p["max"] - p["min"])
        out[f] = (F.col(f).cast("double") - F.lit(float(shift))) / F.lit(float(spread) or 1.0)
    return df.withColumns(out)


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Missing values replaced; features without a value stay as they are."""
    return df.withColumns({f: F.when(is_missing(F.col(f)), F.lit(float(v))).otherwise(F.col(f).cast("double")) for f, v in values.items() if v is not None})


def distribution(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``feature, n, missing, below, above, bins``: rows, missing values, values outside the first and last edge, and how many of the others are above each number of inner edges.

    One pass: a row for each feature and bin leaves a task. Values equal to an edge are not above it.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), present(F.col(f)).alias("v"), F.lit([float(x) for x in e]).alias("e")) for f, e in edges.items()])).alias("x")).select("x.*")
    v, inner = F.col("v"), F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    above = F.size(F.filter(inner, lambda x: x < v))
    cells = long.select("feature", F.when(v.isNull(), -1).when(v < F.element_at("e", 1), -2).when(v > F.element_at("e", -1), -3).otherwise(above).alias("bin")).groupBy("feature", "bin").agg(F.count("*").alias("c"))
    count = lambda b: F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("c"))), F.lit(0))
    return cells.groupBy("feature").agg(F.sum("c").alias("n"), count(-1).alias("missing"), count(-2).alias("below"), count(-3).alias("above"), F.sort_array(F.collect_list(F.when(F.col("bin") >= 0, F.struct("bin", "c")))).alias("bins"))


class Contract:
    """Parameters in three parts (normalization, imputation, selection). Fit, freeze, then apply."""

    def __init__(self, method: str = "zscore"):
        self.method, self.frozen = method, False
        self.parts: dict[str, object] = {}

    def _fit(self, name: str, value) -> Contract:
        if self.frozen:
            raise RuntimeError("the contract is frozen")
        self.parts[name] = value
        return self

    def fit_normalization(self, df: DataFrame, features: list[str]) -> Contract:
        rows = fit_normalization(df, features).collect()  # a row for each feature
        return self._fit("normalization", {r.feature: {k: r[k] for k in ("mean", "std", "min", "max")} for r in rows})

    def fit_distribution(self, df: DataFrame, features: list[str], bins: int = 10) -> Contract:
        """Freezes each feature's quantiles as the edges of ``bins`` bins, the shares of values in them and the share of missing ones. A feature without values has no edges."""
        long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), present(F.col(f)).alias("v")) for f in features])).alias("x")).select("x.*")
        found = percentiles(long, "v", [i / bins for i in range(bins + 1)], ("feature",)).collect()  # a row for each feature
        edges = {r.feature: [r[f"p{i}"] for i in range(bins + 1)] for r in found}
        if not edges:
            return self._fit("distribution", {})
        parts = {}
        for r in distribution(df, edges).collect():
            inside = {x.bin: x.c for x in r.bins}
            total = max(1, r.n - r.missing)
            parts[r.feature] = {"edges": edges[r.feature], "shares": [inside.get(i, 0) / total for i in range(bins)], "missing": r.missing / r.n}
        return self._fit("distribution", parts)

    def fit_imputation(self, df: DataFrame, features: list[str], method: str = "median") -> Contract:
        return self._fit("imputation", {r.feature: r.value for r in fit_imputation(df, features, method).collect()})

    def select(self, features: list[str]) -> Contract:
        return self._fit("selected", list(features))

    def freeze(self) -> Contract:
        if not self.parts:
            warnings.warn("an empty contract was frozen", stacklevel=2)
        self.frozen = True
        return self

    def validate(self) -> bool:
        return bool(self.parts)

    def _json(self) -> str:
        def plain(x):
            if isinstance(x, dict):
                return {str(k): plain(v) for k, v in x.items()}
            if isinstance(x, list):
                return [plain(v) for v in x]
            return format(x, ".10g") if isinstance(x, float) and math.isfinite(x) else None if isinstance(x, float) else x

        return json.dumps(plain({"method": self.method, **self.parts}), sort_keys=True)

    def hash(self) -> str:
        """16 digits that depend on the parameters alone (numbers to 10 digits)."""
        return hashlib.sha256(self._json().encode()).hexdigest()[:16]

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.frozen:
            raise RuntimeError("freeze the contract before it is applied")
        if "imputation" in self.parts:
            df = impute(df, self.parts["imputation"])
        if "normalization" in self.parts:
            df = transform(df, self.parts["normalization"], self.method)
        if "selected" in self.parts:
            dropped = set(self.parts.get("normalization", {})) - set(self.parts["selected"])
            df = df.drop(*dropped)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        record = json.dumps({"method": self.method, "frozen": self.frozen, "parts": self.parts})
        spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Contract:
        record = json.loads(spark.read.text(path).first()[0])
        out = cls(record["method"])
        out.parts, out.frozen = record["parts"], record["frozen"]
        return out

    def drift(self, df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
        """Features whose parameters on ``df`` differ from the frozen ones: ``feature, frozen_mean, mean, frozen_std, std``."""
        frozen = self.parts["normalization"]
        table = df.sparkSession.createDataFrame([(f, p["mean"], p["std"]) for f, p in frozen.items()], "feature string, frozen_mean double, frozen_std double")
        now = fit_normalization(df, list(frozen))
        far = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col(a)))
        return now.join(F.broadcast(table), "feature").where(far("frozen_mean", "mean") | far("frozen_std", "std")).select("feature", "frozen_mean", "mean", "frozen_std", "std")

    def distribution_drift(self, df: DataFrame, psi: float = 0.2, ks: float = 0.1, outside: float = 0.01, missing: float = 0.05) -> DataFrame:
        """``feature, psi, ks, below, above, missing, frozen_missing, drifted`` of every feature with a frozen distribution.

        ``psi`` is the population stability index over the frozen bins (shares of at least 1e-4), ``ks`` the largest
        distance of the two cumulative shares at the bins' edges, ``below`` and ``above`` the shares of values outside the frozen range, ``missing`` that of
        missing values. A feature has drifted if one of them (the missing share by its difference) passes its limit. Values outside count in the first and last
        bin. Without rows there is no row.
        """
        frozen = self.parts["distribution"]
        schema = "f string, shares array<double>, frozen_missing double"
        table = df.sparkSession.createDataFrame([(f, p["shares"], p["missing"]) for f, p in frozen.items()], schema)
        if not frozen:
            return table.select(F.col("f").alias("feature"), *[F.lit(0.0).alias(c) for c in ("psi", "ks", "below", "above", "missing")], "frozen_missing", F.lit(False).alias("drifted"))
        now = distribution(df, {f: p["edges"] for f, p in frozen.items()}).join(F.broadcast(table), F.col("feature") == F.col("f"))  # a row for each feature
        last = F.size("shares") - 1
        own = lambda i: F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bin"] == i, x["c"]).otherwise(0)) + F.when(i == 0, F.col("below")).otherwise(0) + F.when(i == last, F.col("above")).otherwise(0)
        values = (F.col("n") - F.col("missing")).cast("double")
        shares = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_divide(own(i).cast("double"), values), F.lit(0.0)))
        now = now.withColumn("now", shares)
        least = lambda x: F.greatest(x, F.lit(1e-4))
        pairs = F.arrays_zip("shares", "now")
        index = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (least(x["now"]) - least(x["shares"])) * F.log(least(x["now"]) / least(x["shares"])))
        zero = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("most"))
        far = F.aggregate(pairs, zero, lambda a, x: F.struct((a["gap"] + x["now"] - x["shares"]).alias("gap"), F.greatest(a["most"], F.abs(a["gap"] + x["now"] - x["shares"])).alias("most")))["most"]
        share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), values), F.lit(0.0))
        out = now.select("feature", F.when(values > 0, index).otherwise(0.0).alias("psi"), F.when(values > 0, far).otherwise(0.0).alias("ks"), share("below").alias("below"), share("above").alias("above"), (F.col("missing") / F.col("n")).alias("missing"), "frozen_missing")
        drifted = (F.col("psi") > psi) | (F.col("ks") > ks) | (F.col("below") > outside) | (F.col("above") > outside) | (F.abs(F.col("missing") - F.col("frozen_missing")) > missing)
        return out.withColumn("drifted", drifted)
