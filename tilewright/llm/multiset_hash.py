"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (line) is hashed to a wide vector and a document's fingerprint is
the sum of its paragraphs' vectors, lane by lane modulo a power of two. The order
of paragraphs doesn't matter, and a paragraph is put in or taken out by adding or
subtracting its vector (``plus``, ``minus``) without the rest of the text.

Lanes: ``STRONG`` sums modulo 2**32 of seeded hashes of the whole paragraph, for
equality; then, for likeness, ``WORDS`` longs of two sums modulo 2**30 each (more
than a text has phrases), which count how many of the paragraph's phrases have a
given hash bit; last the number of phrases modulo 2**32. Centred on half the phrases, the counts of two texts have
about the cosine of their phrase counts (error about 1/8 with 64 counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.plans.lineage import written

STRONG, WORDS = 8, 32
MOD32 = (1 << 32) - 1
ONES = 0x0000000100000001
MOD30 = 0x3FFFFFFF3FFFFFFF
#: A phrase ends at a line's end, or at spaces after one of these letters or signs.
PHRASE_END = r"(?<=[en.,;:!?])[ \t]+|\n+"


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def lanes(text: Column) -> Column:
    """The fingerprint of a text as an array of longs. Null counts as empty; empty lines count for nothing."""
    text = F.coalesce(text, F.lit(""))
    full = lambda parts: F.filter(parts, lambda p: p != "")
    strong = F.aggregate(full(F.split(text, "\n")), _zeros(STRONG), lambda acc, p: F.transform(acc, lambda a, k: (a + F.xxhash64(k, p).bitwiseAND(F.lit(MOD32))).bitwiseAND(F.lit(MOD32))))
    hashes = F.transform(full(F.split(text, PHRASE_END)), lambda p: F.xxhash64(p))
    bit = lambda h, k: F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(ONES))
    light = F.aggregate(hashes, F.array_append(_zeros(WORDS), F.lit(0).cast("long")), lambda acc, h: F.transform(acc, lambda a, k: (a + F.when(k < WORDS, bit(h, k)).otherwise(F.lit(1).cast("long"))).bitwiseAND(F.lit(MOD30))))
    return F.concat(strong, light)


def _lane_wise(a: Column, b: Column, op) -> Column:
    mask = F.concat(F.array_repeat(F.lit(MOD32), STRONG), F.array_repeat(F.lit(MOD30), WORDS), F.array(F.lit(MOD32)))
    return F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), mask, lambda p, m: op(p["x"], p["y"], m))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return _lane_wise(a, b, lambda x, y, m: (x + y).bitwiseAND(m))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint after the paragraphs of ``b`` are taken out of ``a``."""
    guard = F.lit(ONES << 30)  # a bit above each of the two sums, so that none borrows from the next

    def op(x, y, m):
        return F.when(m == F.lit(MOD32), (x - y).bitwiseAND(F.lit(MOD32))).otherwise((x + guard - y).bitwiseAND(F.lit(MOD30)))

    return _lane_wise(a, b, op)


def text_form(lane: Column) -> Column:
    """The fingerprint as a hexadecimal string."""
    return F.lower(F.array_join(F.transform(lane, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _centred(lane: Column) -> Column:
    """2 * count - phrases of each of the 64 counts."""
    n = F.element_at(lane, -1)
    counts = F.flatten(F.transform(F.slice(lane, STRONG + 1, WORDS), lambda x: F.array(*[F.shiftrightunsigned(x, 32 * i).bitwiseAND(F.lit((1 << 30) - 1)) for i in range(2)])))
    return F.transform(counts, lambda c: (2 * c - n).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the centred counts, at least 0."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    u, v = _centred(a), _centred(b)
    norm = F.sqrt(dot(u, u) * dot(v, v))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot(u, v), norm))), F.lit(0.0)))


def following(ids: DataFrame, *order: str) -> DataFrame:
    """Each distinct row of ``ids`` with the next in order (after the last: the first) in ``next_*`` columns.

    Sorted by ranges; the first row of each range serves the last of the range before.
    """
    at = [F.col(c).asc_nulls_first() for c in order]
    # written out, so that a range's number stays what it was when it is read again
    ranged = written(ids.select(*order).distinct().repartitionByRange(*at).withColumn("part", F.spark_partition_id()))
    # where the order repeats in the window the sort is local to a range
    here = F.struct(*order)
    inside = ranged.withColumn("next", F.lead(here).over(W.partitionBy("part").orderBy(*at)))
    heads = ranged.groupBy("part").agg(F.min(here).alias("head"))
    ends = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select(F.col("part").alias("p"), F.coalesce(F.lead("head").over(W.orderBy("part")), F.first("head").over(ends)).alias("jump"))
    out = inside.join(F.broadcast(heads), inside["part"] == heads["p"])  # a row for each range
    nxt = F.when(F.col("next").isNull(), F.col("jump")).otherwise(F.col("next"))
    return out.withColumn("next", nxt).select(*order, *[F.col(f"next.{c}").alias(f"next_{c}") for c in order])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_chars``, ``edited`` (text), ``lanes``, ``edited_lanes``, ``next_lanes`` of every row.

    Edited: the last quarter of the code points replaced by as many of the next
    document. Null text counts as empty; a null id comes first; rows that share an
    id are in the order of a hash of their text; rows alike in id and text are one
    document in the order and each gets its values. One document is its own next.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("body"))
    links = following(base.select("id", "hash", F.length("body").cast("long").alias("n_chars")), "id", "hash", "n_chars")
    # both joins read these four columns by the same key, so the texts are shuffled once
    full = base.withColumn("lanes", lanes(F.col("body")))
    to = links.select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), F.col("n_chars").alias("of_chars"), F.col("next_id").alias("id"), F.col("next_hash").alias("hash"))
    n, t = full.alias("n"), to.alias("t")
    on = F.col("n.id").eqNullSafe(F.col("t.id")) & (F.col("n.hash") == F.col("t.hash"))
    lent = n.join(t, on).select("of_id", "of_hash", F.expr("substring(body, 1, cast(of_chars div 4 as int))").alias("lent"), F.col("n.lanes").alias("next_lanes")).dropDuplicates(["of_id", "of_hash"])
    d = full.alias("d").join(lent, F.col("d.id").eqNullSafe(F.col("of_id")) & (F.col("d.hash") == F.col("of_hash")))
    edited = F.expr("concat(substring(body, 1, cast(n_chars - n_chars div 4 as int)), lent)")
    d = d.withColumn("n_chars", F.length("body").cast("long")).select("id", "n_chars", "lanes", "next_lanes", edited.alias("edited"))
    return d.withColumn("edited_lanes", lanes(F.col("edited"))).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprints of every document and of its edited text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("lanes")).alias("fingerprint"),
        text_form(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
