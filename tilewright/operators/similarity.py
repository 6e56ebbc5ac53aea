"""Near-duplicates by structural similarity: a metric join with pivots.

The similarity of two vectors is S1 * S2, of their means and of their centred values. sqrt(2 - S1 - S2) is a metric, and a
product of at least t keeps it within sqrt(2 - 2 * sqrt(t)). Each vector belongs to the cell of its nearest pivot, a cell is dealt to
blocks of a bounded size, and two blocks meet unless their distances to some pivot lie further apart than that. In a meeting
tiles of both blocks are left out by the same rule; others are multiplied, as scaled vectors have an inner product of S2 at least.
What that leaves is checked exactly, so no pair is lost and none is wrong.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators.graph import components
from tilewright.plans.lineage import written

PIVOTS = 16
#: Vectors of a cell that stay in one block in any case; a block has up to 1 / SHARES of all beyond that, as each vector travels to every block that its own meets, and up to VALUES values.
HOT, SHARES, VALUES = 2048, 12, 1 << 22
#: Vectors of a tile, and pairs in a batch of results.
TILE, BATCH = 1024, 1 << 16


def _parts(x: np.ndarray, y: np.ndarray, high: float) -> tuple[np.ndarray, np.ndarray]:
    """S1 and S2 of the last axis."""
    c1, c2 = (0.01 * high) ** 2, (0.03 * high) ** 2
    mx, my = x.mean(axis=-1), y.mean(axis=-1)
    vx, vy = x.var(axis=-1), y.var(axis=-1)
    cov = (x * y).mean(axis=-1) - mx * my
    return (2 * mx * my + c1) / (mx * mx + my * my + c1), (2 * cov + c2) / (vx + vy + c2)


def _unit(x: np.ndarray, high: float) -> np.ndarray:
    """Unit vectors whose inner product is at least S2 where S2 isn't negative: centred values and the root of half its constant, scaled."""
    half = (0.03 * high) ** 2 / 2
    own = np.hstack([(x - x.mean(axis=1, keepdims=True)) / math.sqrt(x.shape[1]), np.full((len(x), 1), math.sqrt(half))])
    with np.errstate(divide="ignore", invalid="ignore"):
        return (own / np.sqrt(x.var(axis=1) + half)[:, None]).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def ssim_pairs(df: DataFrame, key: str, vector: str = "embedding", threshold: float = 0.95, high: float = 255.0) -> DataFrame:
    """``id_i < id_j`` with ``ssim`` of at least ``threshold``: all pairs of different vectors, each named by the least key that has it.

    ``high`` is the range of the values, which aren't negative as a mean. NULL and empty vectors have no pairs; vectors of several lengths raise; so does a component
    that is NULL. Extra columns have no effect. Pairs are listed, so a family has as many as it has; ``ssim_clusters`` groups them.
    """
    base = df.where(F.size(vector) > 0).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    lengths = base.agg(F.min(F.size("v")), F.max(F.size("v")), F.count_if(F.exists("v", lambda x: x.isNull()))).first()
    if lengths[0] != lengths[1] or lengths[2]:
        raise ValueError("vectors of one length without NULLs are needed")
    base = base.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
    pivots = np.array([r.v for r in base.orderBy(F.xxhash64("v"), "id").limit(PIVOTS).collect()], float)  # PIVOTS vectors
    radius = math.sqrt(max(0.0, 2 - 2 * math.sqrt(threshold))) + 1e-9

    def distances(x):
        s1, s2 = _parts(x[:, None, :], pivots[None, :, :], high)
        return np.sqrt(np.maximum(0.0, 2 - s1 - s2))

    def place(batches):
        for batch in batches:
            d = distances(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.tolist(), pa.list_(pa.float64()))], names=["id", "v", "home", "d"])

    placed = written(base.mapInArrow(place, T.StructType([*base.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("d", T.ArrayType(T.DoubleType()))])))
    cells = {r.home: r.n for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}  # PIVOTS rows
    most = min(max(HOT, sum(cells.values()) // SHARES), max(1, VALUES // (lengths[0] or 1)))
    cut = F.get(F.array(*[F.lit(-(-cells.get(q, 1) // most)) for q in range(PIVOTS)]), F.col("home"))
    blocks = placed.withColumn("block", F.col("home") + PIVOTS * F.pmod(F.xxhash64("v", "id"), cut))
    side = lambda f: F.array(*[f(F.get("d", q)) for q in range(PIVOTS)])
    boxes = written(blocks.groupBy("block").agg(side(F.min).alias("lo"), side(F.max).alias("hi")))
    one, two = (boxes.select(*[F.col(c).alias(f"{c}_{s}") for c in boxes.columns]) for s in "ab")
    touch = lambda lo, hi: F.forall(F.zip_with(lo, hi, lambda x, y: x.isNull() | (x <= y + radius)), lambda x: x)
    units = written(one.join(two, (F.col("block_a") <= F.col("block_b")) & touch("lo_a", "hi_b") & touch("lo_b", "hi_a")).select(F.col("block_a").alias("a"), F.col("block_b").alias("b")))
    dealt = blocks.select("block", "id", "v").join(units.withColumn("block", F.explode(F.array_distinct(F.array("a", "b")))), "block")
    limit = np.float32(threshold - 2.5e-7 * ((lengths[0] or 0) + 16))  # beyond the rounding of an inner product of unit vectors in single precision

    def tiles(x, rows, home):
        d = np.concatenate([distances(x[rows[k : k + TILE]]) for k in range(0, len(rows), TILE)])
        order = np.argsort(d[:, home])
        for k in range(0, len(rows), TILE):
            at = order[k : k + TILE]
            yield rows[at], np.fmin.reduce(d[at]), np.fmax.reduce(d[at]), _unit(x[rows[at]], high)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one or two blocks
        ids, x, block = table.column("id").combine_chunks(), _matrix(table.column("v").combine_chunks()), table.column("block").to_numpy()
        a, b = block.min(), block.max()
        first = list(tiles(x, np.flatnonzero(block == a), a % PIVOTS))
        second = first if a == b else list(tiles(x, np.flatnonzero(block == b), b % PIVOTS))
        mean, c1 = x.mean(axis=1), (0.01 * high) ** 2
        found, n, step = [], 0, max(1, (1 << 20) // x.shape[1])

        def batch():
            p, q, ssim = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(ssim)], names=["p", "q", "ssim"])

        for i, (rows_i, lo_i, hi_i, u_i) in enumerate(first):
            for j, (rows_j, lo_j, hi_j, u_j) in enumerate(second):
                if (a == b and j < i) or (lo_i > hi_j + radius).any() or (lo_j > hi_i + radius).any():
                    continue
                near = u_i @ u_j.T >= limit
                if not near.any():
                    continue
                p, q = np.nonzero(np.triu(near, 1) if a == b and i == j else near)
                p, q = rows_i[p], rows_j[q]
                alike = (2 * mean[p] * mean[q] + c1) / (mean[p] ** 2 + mean[q] ** 2 + c1) >= threshold - 1e-9
                p, q = p[alike], q[alike]
                for k in range(0, len(p), step):
                    s1, s2 = _parts(x[p[k : k + step]], x[q[k : k + step]], high)
                    s = s1 * s2
                    ok = (s >= threshold) & (s1 > 0)
                    found.append((p[k : k + step][ok], q[k : k + step][ok], s[ok]))
                    n += int(ok.sum())
                    if n >= BATCH:
                        yield batch()
                        found, n = [], 0
        if n:
            yield batch()

    kind = base.schema["id"].dataType
    met = dealt.groupBy("a", "b").applyInArrow(meet, T.StructType([T.StructField("p", kind), T.StructField("q", kind), T.StructField("ssim", T.DoubleType())]))
    return met.where("p IS NOT NULL AND q IS NOT NULL").select(F.least("p", "q").alias("id_i"), F.greatest("p", "q").alias("id_j"), "ssim").where("id_i < id_j")


def ssim_clusters(df: DataFrame, key: str, vector: str = "embedding", threshold: float = 0.95, high: float = 255.0) -> DataFrame:
    """``key, component``: the least key of all that are linked by similarity or equality; singletons, NULL and empty vectors are their own."""
    base = df.select(F.col(key).alias("key"), F.when(F.size(vector) > 0, F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    linked = components(written(ssim_pairs(base, "key", "v", threshold, high).select("id_i", "id_j")), "id_i", "id_j")
    least = base.where("v IS NOT NULL").groupBy(F.col("v").alias("_v")).agg(F.min("key").alias("_first"))
    named = base.join(least, F.col("v") == F.col("_v"), "left").select("key", F.coalesce("_first", "key").alias("_first"))
    return named.join(linked, F.col("_first") == F.col("id"), "left").select(F.col("key").alias(key), F.coalesce("component", "_first").alias("component"))
