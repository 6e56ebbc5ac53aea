"""Hard negatives of anchors by exact integer inner products, tile against tile.

Rows become tiles: up to ``TILE_ROWS`` candidates, or ``ANCHOR_ROWS`` anchors, with their integer
vectors in one matrix. Every tile of anchors meets every tile of candidates once a pass, over a grid of (anchor block,
candidate group), so both sides are dealt and neither is broadcast. The matrix of scores is a Strassen product of
int64 tiles, padded with zeros. From it each anchor keeps a heap: of its best rows of the same label in the first pass,
of the best rows inside each positive's score window in the second. Heaps of two tiles merge into one, so a task
holds one tile, one matrix of scores and one heap, and the heaps of an anchor block come together one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans.lineage import written

TILE_ROWS = 2048
ANCHOR_ROWS = 512
#: Most components of a tile, so that long vectors make tiles of fewer rows.
TILE_VALUES = 1 << 18
#: Tiles of a candidate group; the grid has a cell for each anchor block and group.
GROUP_TILES = 4
#: Heaps of an anchor block that one task merges in the first of two turns.
MERGE = 64
#: A side of this or less is multiplied as it is.
LEAF = 32
NONE = np.iinfo(np.int64).min
#: Stands for a null id inside a tile, so that nulls come last.
NO_ID = np.iinfo(np.int64).max
#: Scores have to stay below this, as windows compare a hundredfold.
MOST_SCORE = float(1 << 56)


# ---------------------------------------------------------------- products


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two small matrices: by floating point where every partial sum is a whole number below 2**53, else in int64."""
    high = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1) * a.shape[1]
    if 0 <= high < 1 << 53 and a.min(initial=0) > NONE and b.min(initial=0) > NONE:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices with seven products of quarters; odd sides get a row or column of zeros.

    Sums wrap around as int64 does, so the result is exact wherever it fits into int64.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    i, j, l = m // 2, k // 2, n // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out


# ---------------------------------------------------------------- heaps


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each row's ``k`` highest scores; ``ids`` ascend, so the first of equal scores has the least id. ``scores`` is used up."""
    m, n = scores.shape
    out = np.full((m, k), NONE, np.int64), np.full((m, k), NO_ID, np.int64)
    rows = np.arange(m)
    for j in range(min(k, n)):
        at = scores.argmax(axis=1)
        value = scores[rows, at]
        out[0][:, j] = value
        out[1][:, j] = np.where(value == NONE, NO_ID, ids[at])
        scores[rows, at] = NONE
    return out


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One heap of two, along the last axis, as long as either."""
    scores, ids = (np.concatenate(x, axis=-1) for x in zip(a, b, strict=True))
    order = np.lexsort((ids, ~scores), axis=-1)[..., : a[0].shape[-1]]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


# ---------------------------------------------------------------- tiles

_TILE = "block long, tile long, ids binary, labels binary, vectors binary, kind string, width int"


def _pack(ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> dict:
    """A tile of rows in the order of their ids; vectors as short as their components allow."""
    order = np.argsort(ids, kind="stable")
    top = int(max(values.max(initial=0), -values.min(initial=0)))
    kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
    return {"ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": values[order].astype(kind).tobytes(), "kind": kind, "width": values.shape[1]}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["width"]).astype(np.int64)


def _cuts(lengths: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows that make a tile."""
    begin, width = 0, 0
    for i, n in enumerate(lengths.tolist()):
        wide = max(width, n, 1)
        if i > begin and (i - begin >= rows or wide * (i - begin + 1) > TILE_VALUES):
            yield begin, i
            begin, wide = i, max(n, 1)
        width = wide
    if begin < len(lengths):
        yield begin, len(lengths)


def _tiles(rows: int, scale: float):
    """For mapInArrow over (block, id, label, vector): tiles of the rows whose vectors are whole."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            block = batch.column("block").to_numpy()
            ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_numpy()
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().cast(pa.float64())
            bad = np.asarray(flat.is_null())
            values = np.floor(flat.fill_null(0.0).to_numpy(zero_copy_only=False) * scale)
            owner = np.repeat(np.arange(len(ids)), lengths)
            good = np.bincount(owner, weights=bad | ~np.isfinite(values), minlength=len(ids)) == 0
            if (np.bincount(owner, weights=np.where(np.isfinite(values), values, 0.0) ** 2, minlength=len(ids))[good] >= MOST_SCORE).any():
                raise ValueError("vectors too long: their inner products may not fit")
            begin = np.cumsum(lengths) - lengths
            keep = np.flatnonzero(good)
            for of in np.split(keep, np.flatnonzero(np.diff(block[keep])) + 1):
                for a, b in _cuts(lengths[of], rows):
                    part = of[a:b]
                    matrix = np.zeros((len(part), int(lengths[part].max(initial=0))), np.int64)
                    for r, i in enumerate(part):
                        matrix[r, : lengths[i]] = values[begin[i] : begin[i] + lengths[i]]
                    row = {"block": int(block[part[0]]), "tile": number, **_pack(ids[part], labels[part], matrix)}
                    number += 1
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("tile", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string()), ("width", pa.int32())]))

    return run


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; the narrower one is padded with zeros."""
    width = max(anchors.shape[1], candidates.shape[1], 1)
    wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return strassen(wide(anchors), wide(candidates).T)


# ---------------------------------------------------------------- passes


def _heap_row(tile: int, heap: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"tile": tile, "scores": heap[0].tobytes(), "near": heap[1].tobytes()}])


_HEAP = "tile long, scores binary, near binary"


def _meet(pick: Callable):
    """For mapInArrow over the cells of the grid, the anchors of a cell first: a heap for each anchor tile of a cell."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        cell, anchors, heaps = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if cell != (row["block"], row["cell"]):
                    yield from (_heap_row(t, h) for t, h in heaps.items())
                    cell, anchors, heaps = (row["block"], row["cell"]), {}, {}
                if row["side"] == 0:
                    anchors[row["tile"]] = (*_unpack(row), row)
                    continue
                ids, labels, vectors = _unpack(row)
                for t, (own, kinds, matrix, more) in anchors.items():
                    s = scores(matrix, vectors)
                    found = pick(s, kinds[:, None] == labels[None, :], own[:, None] == ids[None, :], ids, more)
                    heaps[t] = merge(heaps[t], found) if t in heaps else found
        yield from (_heap_row(t, h) for t, h in heaps.items())

    return run


def _merged(heaps: DataFrame, shape: tuple[int, ...], cells: int) -> DataFrame:
    """One heap for each anchor tile: heaps of a tile follow each other in a task and merge; many cells meet in two turns."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tile, heap = None, None
        for batch in batches:
            for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("tile", "scores", "near")), strict=True):
                one = tuple(np.frombuffer(x, np.int64).reshape(-1, *shape) for x in (a, b))
                if t != tile:
                    if tile is not None:
                        yield _heap_row(tile, heap)
                    tile, heap = t, one
                else:
                    heap = merge(heap, one)
        if tile is not None:
            yield _heap_row(tile, heap)

    if cells > MERGE:
        heaps = heaps.withColumn("turn", F.pmod(F.xxhash64("scores", "near"), F.lit(cells // MERGE + 1))).repartition("tile", "turn").sortWithinPartitions("tile", "turn").drop("turn").mapInArrow(run, _HEAP)
    return heaps.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, _HEAP)


def _positives(k: int):
    def pick(s, same, own, ids, _):
        s[~same | own] = NONE
        return best(s, ids, k)

    return pick


def _negatives(positives: int, k: int, low: int, high: int):
    def pick(s, same, own, ids, more):
        s[same] = NONE
        want = np.frombuffer(more["scores"], np.int64).reshape(len(s), positives)
        out = np.full((len(s), positives, k), NONE, np.int64), np.full((len(s), positives, k), NO_ID, np.int64)
        for j in range(positives):
            # a negative score has an empty window
            rows = np.flatnonzero(want[:, j] >= 0)
            floor, ceiling = -(-low * want[rows, j] // 100), high * want[rows, j] // 100
            inside = s[rows]
            inside[(inside < floor[:, None]) | (inside > ceiling[:, None])] = NONE
            out[0][rows, j], out[1][rows, j] = best(inside, ids, k)
        return out

    return pick


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 1.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(``scale`` * x). Each row for which ``anchor`` is true has as positives its
    ``positives`` best other rows of the same label; for each the ``negatives`` best rows of another label with a score
    from ``low`` to ``high`` percent of the positive's. Best is the highest inner product, ties by the smaller id
    (null last). ``low`` and ``high`` are from 0 to 120.

    Rows with a null label, a null vector or a component that is null or not finite take no part. Rows with the
    anchor's own id aren't other rows. Repeated rows count as often as they occur, repeated anchors are mined each.
    Vectors of different lengths meet as if the shorter ended in zeros. Labels that are no
    whole numbers are compared by 64-bit hashes. Extra columns have no effect; an empty table gives no rows;
    vectors whose squared length passes 2**56 after scaling raise.
    """
    if not 0 <= low <= high <= 120:
        raise ValueError("0 <= low <= high <= 120")
    kind = rows.schema[label_col].dataType.typeName()
    label = F.col(label_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64(label_col)
    base = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("vector"), anchor.alias("anchor"))
    take = lambda df, n: df.select("block", "id", "label", "vector").mapInArrow(_tiles(n, scale), _TILE)
    candidates = written(take(base.withColumn("block", F.lit(0).cast("long")), TILE_ROWS))
    chosen = base.where("anchor")
    blocks = chosen.count() // ANCHOR_ROWS + 1
    chosen = chosen.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    anchors = written(take(chosen.repartition("block").sortWithinPartitions("block"), ANCHOR_ROWS))
    groups = candidates.count() // GROUP_TILES + 1

    parts = min(blocks * groups, max(200, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    none = F.lit(None).cast("binary")
    # of a cell's rows the anchors come first
    right = candidates.withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = right.withColumns({"side": F.lit(1), "scores": none, "near": none})

    def grid(left: DataFrame, pick: Callable, shape: tuple[int, ...]) -> DataFrame:
        left = left.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("side", F.lit(0))
        cells = left.unionByName(right).repartition(parts, "block", "cell").sortWithinPartitions("block", "cell", "side")
        return written(_merged(cells.mapInArrow(_meet(pick), _HEAP), shape, groups))

    near = grid(anchors.withColumns({"scores": none, "near": none}), _positives(positives), (positives,))
    known = anchors.join(near, "tile")
    far = grid(known, _negatives(positives, negatives, low, high), (positives, negatives))
    return known.select("tile", "ids", F.col("scores").alias("p_scores"), F.col("near").alias("p_ids")).join(far, "tile").mapInArrow(_rows(positives, negatives), _RESULT)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _rows(positives: int, negatives: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, p_scores, p_ids, n_scores, n_ids in zip(*(batch.column(c).to_pylist() for c in ("ids", "p_scores", "p_ids", "scores", "near")), strict=True):
                read = lambda x, *shape: np.frombuffer(x, np.int64).reshape(-1, *shape)
                s = read(n_scores, positives, negatives)
                i, j, k = np.nonzero(s != NONE)
                ids = lambda x: pa.array(x, mask=x == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [ids(read(anchors)[i]), ids(read(p_ids, positives)[i, j]), pa.array((k + 1).astype(np.int32)), ids(read(n_ids, positives, negatives)[i, j, k]), pa.array(read(p_scores, positives)[i, j]), pa.array(s[i, j, k])],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
                )

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the hard negatives of every anchor of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0, scale=256.0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id IS DISTINCT FROM c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
