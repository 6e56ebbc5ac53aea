"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints within ``max_bits`` differing bits are linked; documents that are
linked, directly or over others, make a component.

The bits of a fingerprint are cut into ``b`` blocks. Two fingerprints that
differ in at most ``k`` bits agree on at least ``b - k`` blocks, so dealing every
distinct fingerprint under each choice of ``b - k`` blocks brings every pair
together somewhere; ``b`` grows with the number of fingerprints, so that the
groups stay small. Within a shard the codes are sorted by group and Gray rank.
Each node above holds the bits that all its codes share; the differences of a
query with those bits prune the node once they exceed ``k``, and a node whose
free bits leave the sum within ``k`` is taken as a whole. A shard returns one link for each
code, to the root of its local component, never all pairs.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.names import own_names
from tilewright.plans.lineage import written
from tilewright.operators.graph import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Codes of one group in a task; a larger group is cut into blocks.
MOST_CODES = 1 << 15
_U = np.uint64
_FAN = 8


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z lowered, joined by a space (fewer words: of all of them)."""
    words = text.lower().split()  # bytes: A-Z only, and white space is 0x20, 0x09-0x0D
    if not words:
        return np.empty(0, _U)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), _U, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: 0."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """Columns ``row`` (struct of the input's columns) and ``code`` (long, the fingerprint's bits). Null text counts as empty."""
    base = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([base.schema["row"], T.StructField("code", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("row").field(text_col).cast(pa.binary()).to_pylist()
            codes = np.array([fingerprint(shingle_hashes(t or b"", shingle)) for t in texts], _U)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(codes.view(np.int64))], names=["row", "code"])

    return base.mapInArrow(run, schema)


# ----------------------------------------------------------------------- index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of a code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> _U(s))
    return codes


def _levels(codes: np.ndarray, group: np.ndarray) -> list[dict]:
    """Nodes from the leaves up to one root a group: first code, end, shared bits (mask, pattern), first child and end."""
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(begins, len(codes)))
    child0, child1 = np.arange(len(codes)), np.arange(len(codes)) + 1
    start, end, owner = child0, child1, np.repeat(np.arange(len(begins)), sizes)
    levels = [{"start": start, "end": end, "mask": np.full(len(codes), ~_U(0)), "pattern": codes, "free": np.zeros(len(codes), np.int64)}]
    while True:
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        counts = np.diff(np.append(first, len(owner)))
        if len(levels) > 1 and counts.max() == 1:
            return levels
        place = np.arange(len(owner)) - np.repeat(first, counts)
        head = np.flatnonzero(place % _FAN == 0)
        tail = np.append(head[1:], len(owner))
        start, end = levels[-1]["start"][head], levels[-1]["end"][tail - 1]
        both, either = np.bitwise_and.reduceat(codes, start), np.bitwise_or.reduceat(codes, start)
        mask = ~(both ^ either)
        levels.append({"start": start, "end": end, "mask": mask, "pattern": both, "free": 64 - np.bitwise_count(mask).astype(np.int64), "first": head, "last": tail})
        owner = owner[head]


def local_roots(codes: np.ndarray, group: np.ndarray, max_bits: int, step: int = 2048) -> np.ndarray:
    """The least place of the component of each place, over what is within ``max_bits`` in one group. Sorted by (group, Gray rank).

    The pairs of a step go into the roots at once; none are kept.
    """
    levels = _levels(codes, group)
    root = np.arange(len(codes))
    for level in levels[1:2]:  # a lowest node with so few free bits: all its codes are within reach of each other
        for s in range(1, _FAN):
            near = np.flatnonzero((level["free"] <= max_bits) & (level["end"] - level["start"] > s))
            root = united(root, level["start"][near], level["start"][near] + s)
    tops = np.repeat(np.arange(len(levels[-1]["start"])), levels[-1]["end"] - levels[-1]["start"])
    for i in range(0, len(codes), step):
        query = np.arange(i, min(i + step, len(codes)))
        node = tops[query]
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            ahead = level["end"][node] > query + 1
            query, node = query[ahead], node[ahead]
            apart = np.bitwise_count((codes[query] ^ level["pattern"][node]) & level["mask"][node]).astype(np.int64)
            near = apart <= max_bits
            taken = near & (apart + level["free"][node] <= max_bits) if depth < 2 else np.zeros(len(near), bool)
            root = united(root, query[taken], level["end"][node[taken]] - 1)
            near &= ~taken
            query, node = query[near], node[near]
            if depth:
                width = level["last"][node] - level["first"][node]
                query = np.repeat(query, width)
                node = np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(level["first"][node], width)
    return root


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each place's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least member of each place's component) after the pairs are joined."""
    a, b = root[a], root[b]
    a, b = a[a != b], b[a != b]
    if not len(a):
        return root
    ends, back = np.unique(np.append(a, b), return_inverse=True)
    new = np.arange(len(root))
    new[ends] = ends[roots_of(len(ends), back[: len(a)], back[len(a) :])]
    return new[root]


def block_choices(n: int, max_bits: int) -> list[int]:
    """Masks: one for each choice of blocks on which two fingerprints may agree. More blocks for more fingerprints."""
    blocks = max_bits + 1
    while blocks < max_bits + 3 and n >> (64 * (blocks - max_bits) // blocks) > 4096:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def links(codes: DataFrame, max_bits: int = MAX_BITS, most: int = MOST_CODES) -> DataFrame:
    """Links (``a``, ``b``) that connect the distinct ``code``s (long) within ``max_bits``.

    A group of over ``most`` codes is cut into blocks, and each two of its blocks
    meet in a task of their own, so every pair still does.
    """
    n = codes.count()
    masks = block_choices(n, max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = max(1, n * len(masks) // 65536)
    keys = codes.select("code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "part"))
    hot = written(keys.groupBy("choice", "part").count().where(F.col("count") > most).select("choice", "part", F.ceil(F.col("count") * 2 / most).cast("int").alias("cuts")))
    keyed = keys.withColumn("pair", F.lit(0).cast("long"))
    if not hot.isEmpty():
        block = F.pmod(F.xxhash64("code"), F.col("cuts")).cast("long")
        others = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.least(block, o.cast("long")) * F.col("cuts") + F.greatest(block, o.cast("long")))
        pairs = F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)
        keyed = keys.join(F.broadcast(hot), ["choice", "part"], "left").select("choice", "part", "code", F.explode(pairs).alias("pair"))  # few keys are hot
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("choice", "part", "pair"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        code = table.column("code").to_numpy().view(_U)
        choice, part, pair = (table.column(c).to_numpy() for c in ("choice", "part", "pair"))
        order = np.lexsort((gray_rank(code), pair, part, choice))
        code, choice, part, pair = code[order], choice[order], part[order], pair[order]
        group = np.cumsum(np.append(False, (choice[1:] != choice[:-1]) | (part[1:] != part[:-1]) | (pair[1:] != pair[:-1])))
        root = local_roots(code, group, max_bits)
        own = np.flatnonzero(root != np.arange(len(code)))
        pairs = np.unique(np.stack([code[own], code[root[own]]], axis=1), axis=0).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return keyed.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


@own_names("id_col", "text_col", frame="docs")
def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``code`` and ``component_id``, a row for each input row.

    ``component_id`` is the smallest id reachable (null only where all ids of the
    component are null). Null and empty texts and texts without words have the
    fingerprint zero, which links like any other. Repeated rows come back
    repeated. An empty table gives no rows. A very long text is read whole, in one task; only its
    fingerprint travels. Extra columns are left out; an id column that is named ``code`` leaves ``code_`` to the fingerprint.
    """
    codes = written(with_fingerprints(docs.select(id_col, text_col), shingle, text_col).select(F.col(f"row.{id_col}").alias(id_col), "code"))
    return grouped(codes, max_bits, id_col)


def grouped(codes: DataFrame, max_bits: int, id_col: str = "doc_id") -> DataFrame:
    """``codes`` (id and code) with ``component_id``."""
    distinct = written(codes.groupBy("code").agg(F.min(id_col).alias("least")))
    joined = components(written(links(distinct.select("code"), max_bits)), "a", "b")  # id, component: only linked codes
    least = distinct.join(joined, distinct["code"] == joined["id"], "left").select("code", "least", F.coalesce("component", "code").alias("root"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(of_root, "root").select("code", "component_id")
    return codes.join(named, "code")


# ------------------------------------------------- similarity of word shingles

#: Pairs at least this alike (Jaccard of their sets of five-word shingles) are near copies.
SIMILARITY, WORDS = 0.8, 5
#: Bands of two least hashes each deal similar texts together: at 0.8 all bands miss a pair with probability 0.36 ** 10.
BANDS, SKETCH = 10, 128
#: The sketch decides alone where it is wrong with less than this probability, for any pair; else the sets do.
ODDS = 1e-6
#: Texts of one band key in a task; a larger group is cut into blocks.
MOST_TEXTS = 2048
#: Sets of shingles in a task, about.
SHARD_BYTES = 1 << 25


def signature(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A byte of each of SKETCH least hashes (their agreement estimates the Jaccard similarity), and the keys of the bands."""
    distinct = np.unique(hashes)
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 2**63, SKETCH, np.uint64) * _U(2) + _U(1)
    with np.errstate(over="ignore"):
        least = np.full(SKETCH, ~_U(0))
        for i in range(0, len(distinct), 4096):
            x = distinct[None, i : i + 4096] * odd[:, None]
            x ^= x >> _U(29)
            x *= _U(0x9E3779B97F4A7C15)
            least = np.minimum(least, x.min(axis=1))
        pairs = least[: 2 * BANDS].reshape(BANDS, 2)
        keys = (pairs[:, 0] * _U(0xD6E8FEB86659FD93)) ^ pairs[:, 1] ^ (pairs[:, 1] >> _U(17)) ^ np.arange(BANDS, dtype=_U)
    return (least >> _U(13)).astype(np.uint8).tobytes(), keys  # not the top bits: a least value has zeros there


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``hash`` (of the text; with the id it names a row), ``words`` (a hash of the whole sequence of words), ``code``, ``sketch``, ``keys``."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, WORDS)
                sketch, keys = signature(hashes)
                out.append((xxhash.xxh3_128_digest(b" ".join(text.lower().split())), fingerprint(np.unique(hashes)), sketch, keys.view(np.int64).tolist()))
            words, codes, sketches, keys = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.binary()), pa.array(np.array(codes, _U).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "hash", "words", "code", "sketch", "keys"],
            )

    return _named(docs, id_col, text_col).mapInArrow(run, "id long, hash long, words binary, code long, sketch binary, keys array<long>")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


@cache
def limits(similarity: float) -> tuple[int, int]:
    """Agreeing bytes of a sketch from which a pair is surely alike, and below which it surely isn't (each wrong below ODDS)."""
    chance = lambda p: [comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(SKETCH + 1)]
    under, at = chance(similarity + (1 - similarity) / 256), chance(similarity)  # a byte agrees by chance in 1 of 256
    sure = next(k for k in range(SKETCH + 2) if sum(under[k:]) < ODDS)
    return sure, max(k for k in range(SKETCH + 1) if sum(at[:k]) < ODDS)


def _join(root: np.ndarray, i: int, hits: np.ndarray) -> None:
    """Put the components of ``hits`` and ``i`` under the least of their places."""
    old = np.unique(np.append(root[hits], root[i]))
    root[np.isin(root, old)] = old[0]


def first_of(labels: np.ndarray) -> np.ndarray:
    """The first place with the same label as each place."""
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    return first[back]


def linked(sketches: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """One group's components: the root of each place after the sure links, and whether the sketch leaves a pair of the place open.

    Every pair counts that isn't connected yet: no bound on fingerprints holds for all
    pairs at a similarity.
    """
    sure, unlike = limits(similarity)
    root, unsure = root.copy(), np.zeros(len(root), bool)
    agree = lambda i, others: (sketches[others] == sketches[i]).sum(axis=1)
    for i in range(len(root)):
        others = np.flatnonzero(root != root[i])
        hits = others[agree(i, others) >= sure]
        if len(hits):
            _join(root, i, hits)
    for i in range(len(root)):
        others = np.flatnonzero(root != root[i])
        open_ = others[agree(i, others) >= unlike]
        unsure[open_] = True
        unsure[i] |= len(open_) > 0
    return root, unsure


def decided(sets: list[np.ndarray], sketches: np.ndarray, root: np.ndarray, similarity: float) -> np.ndarray:
    """The roots after every open pair is decided by its sets of shingles (a pair that is connected by then needs no look)."""
    root, unlike = root.copy(), limits(similarity)[1]
    for i in range(len(root)):
        others = np.flatnonzero(root != root[i])
        for j in others[(sketches[others] == sketches[i]).sum(axis=1) >= unlike].tolist():
            small, large = sorted((len(sets[i]), len(sets[j])))
            if root[i] != root[j] and small / max(1, large) >= similarity:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both / (small + large - both) >= similarity:
                    _join(root, i, np.array([j]))
    return root


def _groups(table: pa.Table, names: tuple[str, ...]):
    """Places of each group of rows that are alike in ``names`` (longs), if it has two rows or more."""
    cols = [table.column(c).to_numpy() for c in names]
    order = np.lexsort(cols)
    new = np.zeros(max(0, len(order) - 1), bool)
    for c in cols:
        new |= np.diff(c[order]) != 0
    return [g for g in np.split(order, np.flatnonzero(new) + 1) if len(g) > 1]


def _sketches(table: pa.Table, group: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").take(pa.array(group)).to_pylist()), np.uint8).reshape(len(group), SKETCH)


def _with_labels(df: DataFrame, found: DataFrame) -> DataFrame:
    named = found.select(F.col("id").alias("node"), "component")
    return df.join(named, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


#: What meets in one task: a band key's texts, or of a hot key a block, or two blocks.
UNIT = ("key", "block", "other")


def _sweep(dealt: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links (``b`` set) and open rows (``b`` null: ``a`` has an undecided pair in the unit) of rows with a ``label``, unit by unit."""
    shard = F.pmod(F.xxhash64(*UNIT), F.lit(max(1, n // 50_000)))

    def run(table: pa.Table) -> pa.Table:
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        unit, a, b = [], [], []
        for group in _groups(table, UNIT):
            before = first_of(np.array([label[i] for i in group.tolist()], object))
            root, unsure = linked(_sketches(table, group), before, similarity)
            for k in np.flatnonzero((root != before) & (before == np.arange(len(group)))).tolist():
                unit.append(group[k]), a.append(node[group[k]]), b.append(node[group[root[k]]])
            for k in np.flatnonzero(unsure).tolist():
                unit.append(group[k]), a.append(node[group[k]]), b.append(None)
        cols = {c: table.column(c).take(pa.array(unit, pa.int64())) for c in UNIT}
        return pa.table(cols | {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    out = dealt.select(shard.alias("shard"), *UNIT, "node", "label", "sketch").groupBy("shard")
    return written(out.applyInArrow(run, ", ".join(f"{c} long" for c in UNIT) + ", a binary, b binary"))


def _blocks(dealt: DataFrame, hot: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Units for the pairs of a hot key that lie in different blocks and aren't connected yet.

    Texts of the key's largest component need no comparison among themselves: every
    text meets the blocks of all other texts, and these meet the blocks of all.
    """
    rows = written(_with_labels(dealt.join(F.broadcast(hot), "key").drop("label"), found))
    per = rows.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("rest")).where("rest > 0")
    rows = rows.join(per, "key").withColumn("parts", F.ceil(F.col("rest") / most).cast("int"))
    at = F.pmod(F.xxhash64("node", F.lit(1)), F.col("cuts")).cast("long")
    as_any = rows.withColumn("block", at).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("long")
    as_rest = rows.where(~(F.col("label") == F.col("main"))).withColumn("other", own).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1)))
    cols = [*UNIT, "node", "label", "sketch"]
    return as_any.select(*cols).union(as_rest.select(*cols)).dropDuplicates([*UNIT, "node"])


def _decide(open_: DataFrame, texts: DataFrame, found: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Links (``a``, ``b``) among the open rows of each unit, by their sets of shingles. Only texts with an open pair are read again."""
    rows = _with_labels(open_.withColumnRenamed("a", "node"), found)
    several = rows.groupBy(*UNIT).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(*UNIT)
    rows = written(rows.join(several, list(UNIT), "left_semi"))
    own = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "s.sketch", F.col("own.id").alias("own_id"), F.col("own.hash").alias("own_hash"))

    def shingled(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, WORDS)).tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["node", "sketch", "shingles"])

    named = _named(docs, id_col, text_col)
    on = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))
    # rows alike in id and text are one text
    sets = written(own.join(named, on).select("node", "sketch", "text").mapInArrow(shingled, "node binary, sketch binary, shingles binary").dropDuplicates(["node"]))
    dealt = rows.join(sets, "node")
    n, size = dealt.agg(F.count("*"), F.sum(F.octet_length("shingles"))).first()  # a shard has about so many rows, and so many bytes of sets
    shard = F.pmod(F.xxhash64(*UNIT), F.lit(max(1, n // 2_000, (size or 0) // SHARD_BYTES)))

    def run(table: pa.Table) -> pa.Table:
        node, label, shingles = (table.column(c).to_pylist() for c in ("node", "label", "shingles"))
        a, b = [], []
        for group in _groups(table, UNIT):
            before = first_of(np.array([label[i] for i in group.tolist()], object))
            root = decided([np.frombuffer(shingles[i], _U) for i in group.tolist()], _sketches(table, group), before, similarity)
            for k in np.flatnonzero((root != before) & (before == np.arange(len(group)))).tolist():
                a.append(node[group[k]]), b.append(node[group[root[k]]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    dealt = dealt.select(shard.alias("shard"), *UNIT, "node", "label", "sketch", "shingles")
    return written(dealt.groupBy("shard").applyInArrow(run, "a binary, b binary"))


def _met(dealt: DataFrame, edges: DataFrame | None, n: int, similarity: float, most: int) -> DataFrame:
    """What ``_sweep`` returns for all rows that have a ``key`` in common. ``edges``: links found before.

    A key of over ``most`` texts is cut into blocks, each linked inside; then, in a
    further round, blocks meet blocks for what isn't connected by that time.
    """
    hot = written(dealt.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("cuts")))
    if hot.isEmpty():
        return _sweep(dealt.withColumns({"block": F.lit(0).cast("long"), "other": F.lit(-1).cast("long")}), n, similarity)
    block = F.pmod(F.xxhash64("node", "key"), F.coalesce("cuts", F.lit(1))).cast("long")  # other blocks for every key, so that keys connect blocks
    out = _sweep(dealt.join(F.broadcast(hot), "key", "left").withColumns({"block": block, "other": F.lit(-1).cast("long")}), n, similarity)  # few keys are hot
    found = components(_edges(out) if edges is None else edges.union(_edges(out)), "a", "b")
    return out.union(_sweep(_blocks(dealt, hot, found, most), n, similarity))


def _edges(out: DataFrame) -> DataFrame:
    return out.where("b is not null").select("a", "b")


def _copies(docs: DataFrame, similarity: float, id_col: str, text_col: str, most: int = MOST_TEXTS, max_bits: int = MAX_BITS) -> DataFrame:
    """``id``, ``hash`` and ``root`` (a hash of words that names the group of near copies) of every row.

    First the SimHash index: texts whose fingerprints are linked within ``max_bits``, over
    others too, are a family, and all pairs of a family are checked. Then the bands bring the pairs
    that are alike with fingerprints further apart; what the index has linked isn't compared again.
    """
    rows = written(_signed(docs, id_col, text_col))
    own = F.struct(F.col("id").isNull().alias("last"), "id", "hash")
    texts = written(rows.groupBy(F.col("words").alias("node")).agg(F.min(own).alias("own"), F.first(F.struct("code", "sketch", "keys")).alias("s")))
    n = texts.count()
    family = grouped(texts.select("node", "s.code", "s.sketch"), max_bits, "node")
    by_index = _met(written(family.select("node", F.col("node").alias("label"), "sketch", F.xxhash64("component_id").alias("key"))), None, n, similarity, most)
    edges = _edges(by_index)
    labelled = _with_labels(texts.select("node", "s"), components(edges, "a", "b"))
    by_bands = _met(labelled.select("node", "label", "s.sketch", F.explode("s.keys").alias("key")), edges, n * BANDS, similarity, most)
    out = by_index.union(by_bands)
    edges = _edges(out)
    found = components(edges, "a", "b")
    open_ = out.where("b is null").drop("b")
    if not open_.isEmpty():
        edges = edges.union(_decide(open_, texts, found, docs, similarity, id_col, text_col))
        found = components(edges, "a", "b")
    roots = _with_labels(texts.select("node"), found).select(F.col("node").alias("words"), F.col("label").alias("root"))
    return rows.select("id", "hash", "words").join(roots, "words").select("id", "hash", "root")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TEXTS) -> DataFrame:
    """``id`` and ``component_id`` (its smallest id) of every row: near copies on five-word shingles, linked over others too.

    Rows with the same words are one text from the start. The others meet where the SimHash
    index links their fingerprints, then by bands; of the pairs that meet, a sketch
    decides those far from the similarity and the sets of shingles all others. Wordless rows (null too) are alike. ``component_id``
    is null where no row of the group has an id; empty table: no rows.
    """
    rows = written(_copies(docs, similarity, id_col, text_col, most))
    return rows.join(rows.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies of a smaller id: one row of each group stays, also where ids are null or shared."""
    rows = _copies(docs, similarity, id_col, text_col)
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "hash"))  # rows without an id come last
    kept = rows.groupBy("root").agg(least.alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.hash").alias("kept_hash"))
    row = F.struct("*").alias("row")  # the input's columns by themselves, whatever their names
    named = docs.select(row, F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    on = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    return named.join(kept, on, "left_semi").dropDuplicates(["own_id", "own_hash"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
