"""Texture and shape features of voxel tables ``sample, x, y, z, level``."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.names import own_names
from tilewright.operators.graph import components

AXES = {"x": (1, 0, 0), "y": (0, 1, 0), "z": (0, 0, 1)}


def discretise(df: DataFrame, bin_width: float = 25.0, level: str = "level") -> DataFrame:
    return df.withColumn(level, F.floor(F.col(level) / F.lit(float(bin_width))).cast("int"))


@own_names("sample", "level")
def first_order(df: DataFrame, sample: str, level: str = "level", bin_width: float = 25.0) -> DataFrame:
    """Seventeen first-order features of each sample: moments, percentiles and the histogram of bins."""
    v = F.col(level).cast("double")
    base = df.select(F.col(sample), v.alias("v"), F.floor(v / F.lit(float(bin_width))).alias("bin"))
    m = base.groupBy(sample).agg(
        F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("energy"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("mean"),
        F.percentile("v", F.lit(0.5)).alias("median"), F.percentile("v", F.lit(0.1)).alias("p10"), F.percentile("v", F.lit(0.9)).alias("p90"), F.percentile("v", F.lit(0.25)).alias("p25"), F.percentile("v", F.lit(0.75)).alias("p75"), F.var_pop("v").alias("variance"),
    )
    near = (F.col("v") >= F.col("p10")) & (F.col("v") <= F.col("p90"))
    d = F.col("v") - F.col("mean")
    dev = base.join(m, sample).groupBy(sample).agg(F.avg(F.abs(d)).alias("mad"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"), F.avg(F.when(near, F.col("v"))).alias("near_mean"))
    robust = base.join(m.select(sample, "p10", "p90"), sample).where(near).join(dev.select(sample, "near_mean"), sample).groupBy(sample).agg(F.avg(F.abs(F.col("v") - F.col("near_mean"))).alias("rmad"))
    bins = base.groupBy(sample, "bin").agg(F.count("*").alias("c")).join(m.select(sample, "n"), sample).withColumn("p", F.col("c") / F.col("n"))
    hist = bins.groupBy(sample).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("uniformity"))
    out = m.join(dev, sample).join(robust, sample).join(hist, sample)
    return out.select(
        sample, "energy", "entropy", "minimum", "p10", "p90", "maximum", "mean", "median", (F.col("p75") - F.col("p25")).alias("iqr"), (F.col("maximum") - F.col("minimum")).alias("range"), "mad", "rmad", F.sqrt(F.col("energy") / F.col("n")).alias("rms"),
        F.coalesce(F.try_divide("m3", F.pow("variance", F.lit(1.5))), F.lit(0.0)).alias("skewness"), F.coalesce(F.try_divide("m4", F.col("variance") * F.col("variance")), F.lit(0.0)).alias("kurtosis"), "variance", "uniformity",
    )


def neighbours(df: DataFrame, sample: str, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``sample, axis, level_i, level_j`` and the coordinates of i: each voxel with the next along each axis."""
    steps = F.array(*[F.struct(F.lit(a).alias("axis"), *[F.lit(d).alias(f"d{n}") for n, d in zip("xyz", AXES[a], strict=True)]) for a in axes])
    a = df.withColumn("s", F.explode(steps)).select(F.col(sample).alias("sample"), F.col("s.axis").alias("axis"), "x", "y", "z", F.col("level").alias("level_i"), *[(F.col(c) + F.col(f"s.d{c}")).alias(f"n{c}") for c in "xyz"])
    b = df.select(F.col(sample).alias("sample"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), F.col("level").alias("level_j"))
    return a.join(b, ["sample", "nx", "ny", "nz"])


def glcm_counts(df: DataFrame, sample: str, axes=("x", "y", "z")) -> DataFrame:
    """Symmetric co-occurrence counts ``sample, axis, i, j, n``."""
    p = neighbours(df, sample, axes)
    both = p.select("sample", "axis", F.col("level_i").alias("i"), F.col("level_j").alias("j")).union(p.select("sample", "axis", "level_j", "level_i"))
    return both.groupBy("sample", "axis", "i", "j").agg(F.count("*").alias("n"))


def glcm(df: DataFrame, sample: str, axes=("x", "y", "z")) -> DataFrame:
    """Contrast, energy, homogeneity, correlation and entropy of each sample and axis."""
    c = glcm_counts(df, sample, axes)
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    d2 = (i - j) * (i - j)
    # whole numbers up to the last division, so that the order of rows changes no digit
    far = c.groupBy("sample", "axis", d2.alias("d2")).agg(F.sum("n").alias("c")).groupBy("sample", "axis").agg(F.sort_array(F.collect_list(F.struct("d2", "c"))).alias("far"))
    same = c.groupBy("sample", "axis", "n").agg(F.count("*").alias("c")).groupBy("sample", "axis").agg(F.sort_array(F.collect_list(F.struct("n", "c"))).alias("same"))
    s = c.groupBy("sample", "axis").agg(F.sum("n").alias("N"), F.sum(n * d2).alias("con"), F.sum(n * n).alias("en"), F.sum(n * i).alias("si"), F.sum(n * i * i).alias("sii"), F.sum(n * i * j).alias("sij"))
    out = s.join(far, ["sample", "axis"]).join(same, ["sample", "axis"])
    N = F.col("N").cast("double")
    ordered = lambda array, value: F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))
    spread = F.col("N") * F.col("sii") - F.col("si") * F.col("si")
    return out.select(
        "sample", "axis", (F.col("con") / N).alias("contrast"), (F.col("en") / (N * N)).alias("energy"), (ordered("far", lambda x: x["c"].cast("double") / (1 + x["d2"])) / N).alias("homogeneity"),
        F.when(spread > 0, (F.col("N") * F.col("sij") - F.col("si") * F.col("si")).cast("double") / spread.cast("double")).otherwise(1.0).alias("correlation"),
        (F.log2(N) - ordered("same", lambda x: (x["c"] * x["n"]).cast("double") * F.log2(x["n"].cast("double"))) / N).alias("entropy"),
    )


@own_names("line", "order", "level")
def runs(df: DataFrame, line: str, order: str, level: str = "level") -> DataFrame:
    """Maximal runs of one level along a line: ``line, level, start, length``."""
    w = W.partitionBy(line).orderBy(order)
    new = (~F.lag(level).over(w).eqNullSafe(F.col(level)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(line, "_run", level).agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("_run")


@own_names("sample", "line", "order", "level")
def glrlm(df: DataFrame, sample: str, line: str, order: str, level: str = "level") -> DataFrame:
    """Run-length features of each sample: short and long run emphasis, level and length non-uniformity, run percentage."""
    r = runs(df, line, order, level).join(df.select(line, sample).distinct(), line) if sample != line else runs(df, line, order, level)
    total = r.groupBy(sample).agg(F.count("*").alias("runs"), F.sum("length").alias("voxels"), F.avg(1.0 / (F.col("length") * F.col("length"))).alias("sre"), F.avg(F.col("length") * F.col("length")).alias("lre"))
    square = lambda by: r.groupBy(sample, by).agg(F.count("*").alias("c")).groupBy(sample).agg(F.sum(F.col("c") * F.col("c")).alias("q"))
    gl, rl = square(level).withColumnRenamed("q", "g"), square("length").withColumnRenamed("q", "l")
    return total.join(gl, sample).join(rl, sample).select(sample, "sre", "lre", (F.col("g") / F.col("runs")).alias("gln"), (F.col("l") / F.col("runs")).alias("rln"), (F.col("runs") / F.col("voxels")).alias("run_percentage"))


def zones(df: DataFrame, sample: str, axes=("x", "y", "z")) -> DataFrame:
    """``sample, level, size`` of each connected zone of one level (face neighbours)."""
    name = lambda a, b, c, s=sample: F.concat_ws("/", F.col(s).cast("string"), F.col(a).cast("string"), F.col(b).cast("string"), F.col(c).cast("string"))
    same = neighbours(df, sample, axes).where("level_i = level_j")
    edges = same.select(name("x", "y", "z", "sample").alias("src"), name("nx", "ny", "nz", "sample").alias("dst"))
    comp = components(edges, "src", "dst")
    named = df.withColumn("_id", name("x", "y", "z"))
    full = named.join(comp, named["_id"] == comp["id"], "left").select(F.col(sample).alias("sample"), "level", F.coalesce("component", "_id").alias("zone"))
    return full.groupBy("sample", "level", "zone").agg(F.count("*").alias("size")).drop("zone")


def glszm(df: DataFrame, sample: str, axes=("x", "y", "z")) -> DataFrame:
    z = zones(df, sample, axes)
    return z.groupBy("sample").agg(F.count("*").alias("zones"), F.avg(1.0 / (F.col("size") * F.col("size"))).alias("sae"), F.avg(F.col("size") * F.col("size")).alias("lae"), (F.count("*") / F.sum("size")).alias("zone_percentage"))


def gldm(df: DataFrame, sample: str, alpha: float = 0, axes=("x", "y", "z")) -> DataFrame:
    """``sample, dependence, n``: voxels by how many face neighbours differ by at most ``alpha``."""
    p = neighbours(df, sample, axes).where(F.abs(F.col("level_i") - F.col("level_j")) <= alpha)
    ends = p.select("sample", "x", "y", "z").union(p.select("sample", F.col("nx"), F.col("ny"), F.col("nz")))
    dep = ends.groupBy("sample", "x", "y", "z").agg(F.count("*").alias("dependence"))
    all_ = df.select(F.col(sample).alias("sample"), "x", "y", "z")
    return all_.join(dep, ["sample", "x", "y", "z"], "left").groupBy("sample", F.coalesce("dependence", F.lit(0)).cast("long").alias("dependence")).agg(F.count("*").alias("n"))


#: Side of a block of voxels.
BLOCK = 16


def _blocks(df: DataFrame, sample: str) -> DataFrame:
    """Each voxel in its block and, at a block's faces, in the blocks beside it (``own`` is false there): all neighbours of a block's own voxels are in it."""

    def beside(c: str):
        at = F.floor(F.col(c) / F.lit(BLOCK)).cast("long")
        inside = F.pmod(F.col(c), F.lit(BLOCK))
        others = F.when(inside == 0, F.array(at, at - 1)).when(inside == BLOCK - 1, F.array(at, at + 1)).otherwise(F.array(at))
        return F.explode(others).alias(f"b{c}")

    rows = df.select(F.col(sample).alias("sample"), *[F.col(c).cast("long").alias(c) for c in "xyz"], F.col("level").cast("long").alias("level"))
    for c in "xyz":
        rows = rows.select("*", beside(c))
    own = reduce(lambda a, b: a & b, [F.floor(F.col(c) / F.lit(BLOCK)) == F.col(f"b{c}") for c in "xyz"])
    return rows.withColumn("own", own)


def neighbour_differences(df: DataFrame, sample: str) -> DataFrame:
    """``sample, level, neighbours, n, difference``: voxels by level and number of neighbours (of 26), and the sum of
    ``abs(level * neighbours - sum of the neighbours' levels)``; voxels without neighbours don't count.

    One exchange: blocks of voxels with a halo of one, a stencil of shifted arrays inside, whole sums out. A row a voxel; a NULL coordinate or level has none.
    """
    kind = df.schema[sample].dataType

    def stencil(key, table):
        import numpy as np
        import pyarrow as pa

        side = BLOCK + 2
        level, there = np.zeros((side,) * 3, np.int64), np.zeros((side,) * 3, np.int64)
        at = tuple(table.column(c).to_numpy() - k.as_py() * BLOCK + 1 for c, k in zip("xyz", key[1:], strict=True))
        level[at], there[at] = table.column("level").to_numpy(), 1
        total, count = np.zeros((BLOCK,) * 3, np.int64), np.zeros((BLOCK,) * 3, np.int64)
        for dx, dy, dz in product(range(3), repeat=3):
            if (dx, dy, dz) != (1, 1, 1):
                window = (slice(dx, dx + BLOCK), slice(dy, dy + BLOCK), slice(dz, dz + BLOCK))
                total += level[window]
                count += there[window]
        inner = (slice(1, -1),) * 3
        use = (there[inner] == 1) & (count > 0)
        g, c, d = level[inner][use], count[use], np.abs(level[inner] * count - total)[use]
        pairs, back = np.unique(np.stack([g, c], axis=1), axis=0, return_inverse=True)
        back = back.reshape(-1)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, back, d)
        return pa.table({"sample": pa.array([key[0].as_py()] * len(pairs), key[0].type), "level": pairs[:, 0], "neighbours": pairs[:, 1], "n": np.bincount(back, minlength=len(pairs)), "difference": sums})

    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("x", "y", "z", "level")])
    blocks = _blocks(df.where(whole), sample).drop("own")
    schema = T.StructType([T.StructField("sample", kind), *[T.StructField(c, T.LongType()) for c in ("level", "neighbours", "n", "difference")]])
    return blocks.groupBy("sample", "bx", "by", "bz").applyInArrow(stencil, schema).groupBy("sample", "level", "neighbours").agg(F.sum("n").alias("n"), F.sum("difference").alias("difference"))


def ngtdm(df: DataFrame, sample: str) -> DataFrame:
    """``sample, coarseness, contrast, busyness, complexity, strength`` from neighbouring grey tone differences.

    A level's p is its share of the voxels that have neighbours, its s the sum of the differences between the level
    and its neighbours' mean. Coarseness is at most 1e6; the others are 0 where their denominator is.
    """
    part = neighbour_differences(df, sample)
    level = part.groupBy("sample", "level").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("neighbours", "difference"))).alias("d"))  # 26 entries at most
    s = F.aggregate("d", F.lit(0.0), lambda a, x: a + x["difference"].cast("double") / x["neighbours"])
    level = level.select("sample", "n", F.struct(F.col("level").cast("double").alias("i"), F.col("n").cast("double").alias("n"), s.alias("s")).alias("v"))
    per = level.groupBy("sample").agg(F.sum("n").cast("double").alias("N"), F.sort_array(F.collect_list("v")).alias("v"))  # a struct for each level
    per = per.select("sample", "N", F.transform("v", lambda x: F.struct(x["i"].alias("i"), (x["n"] / F.col("N")).alias("p"), x["s"].alias("s"))).alias("v"))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x))
    pairs = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: a + F.aggregate("v", F.lit(0.0), lambda b, y: b + f(x, y)))
    square = lambda a: a * a
    ps, all_s, levels = total(lambda x: x["p"] * x["s"]), total(lambda x: x["s"]), F.size("v").cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.select(
        "sample",
        F.least(F.coalesce(F.try_divide(F.lit(1.0), ps), F.lit(1e6)), F.lit(1e6)).alias("coarseness"),
        zero(F.try_divide(pairs(lambda x, y: x["p"] * y["p"] * square(x["i"] - y["i"])), levels * (levels - 1)) * all_s / F.col("N")).alias("contrast"),
        zero(F.try_divide(ps, pairs(lambda x, y: F.abs(x["i"] * x["p"] - y["i"] * y["p"])))).alias("busyness"),
        (pairs(lambda x, y: F.abs(x["i"] - y["i"]) * (x["p"] * x["s"] + y["p"] * y["s"]) / (x["p"] + y["p"])) / F.col("N")).alias("complexity"),
        zero(F.try_divide(pairs(lambda x, y: (x["p"] + y["p"]) * square(x["i"] - y["i"])), all_s)).alias("strength"),
    )


def shape(df: DataFrame, sample: str, voxel: float = 1.0) -> DataFrame:
    """Volume, surface faces and extents of each sample."""
    inner = neighbours(df.withColumn("level", F.lit(0)), sample).groupBy("sample").agg(F.count("*").alias("inner"))
    per = df.groupBy(F.col(sample).alias("sample")).agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c) + 1).alias(f"extent_{c}") for c in "xyz"])
    return per.join(inner, "sample", "left").select("sample", (F.col("n") * F.lit(float(voxel))).alias("volume"), (6 * F.col("n") - 2 * F.coalesce("inner", F.lit(0))).alias("faces"), "extent_x", "extent_y", "extent_z")
