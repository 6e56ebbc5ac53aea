"""Near-duplicates by 60- to 64-bit hashes: hash, join within a Hamming distance, components, representatives."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import arrays as A
from tilewright.functions.names import own_names
from tilewright.operators.graph import components
from tilewright.operators.prefix import numbered
from tilewright.plans.lineage import written


def ahash(v: Column) -> Column:
    """Average hash of a vector: bit i is set where v[i] is above the mean (up to 63 values)."""
    return A.bits(F.transform(v, lambda x: x.cast("double") > A.mean(v)))


def dhash(v: Column) -> Column:
    """Difference hash: bit i is set where v[i + 1] > v[i]."""
    return A.bits(F.transform(F.slice(v, F.lit(2), F.size(v) - 1), lambda x, i: x > F.get(v, i)))


def _median(v: Column) -> Column:
    s, n = F.sort_array(v), F.size(v)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def phash(v: Column, size: int, keep: int = 32) -> Column:
    """Cosine-transform hash: the first ``keep`` coefficients against their median."""
    import math

    basis = [F.array(*[F.lit(math.cos(math.pi * k * (2 * i + 1) / (2 * size))) for i in range(size)]) for k in range(keep)]
    c = F.array(*[A.dot(v, b) for b in basis])
    return F.transform(F.array(c), lambda c: A.bits(F.transform(c, lambda x: x > _median(c))))[0]


def whash(v: Column) -> Column:
    """Haar hash: pairwise means against their median."""
    means = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: (F.get(v, 2 * i) + F.get(v, 2 * i + 1)).cast("double") / 2)
    return F.transform(F.array(means), lambda m: A.bits(F.transform(m, lambda x: x > _median(m))))[0]


@own_names("key", "text")
def text_simhash(df: DataFrame, key: str, text: str = "text", bits: int = 60) -> DataFrame:
    """``key`` and ``hash``: bit i is set if more than half of the distinct words have bit i of their md5 (first ``bits`` bits) set."""
    words = df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != ""))).alias("w"))
    h = words.select(key, F.conv(F.substring(F.md5("w"), 1, bits // 4), 16, 10).cast("long").alias("h"))
    votes = h.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(bits)])
    value = sum((F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(1, bits)), F.when(2 * F.col("b0") > F.col("n"), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return df.select(key).join(votes.select(key, value.alias("hash")), key, "left").select(key, F.coalesce("hash", F.lit(0)).cast("long").alias("hash"))


#: What a row of an index costs, in candidates that are looked at.
ROW = 20
#: Most flips of a part of a hash.
FLIPS = 1024
#: Most hashes with one key of the index before the key is cut by further parts of the hash.
HOT = 4096


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _flips(positions: list[int], most: int) -> list[int]:
    """Masks of up to ``most`` of the bits at ``positions``."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(positions, k)]


def index_parts(n: int, threshold: int, positions: list[int]) -> list[tuple[int, int, int, list[int]]]:
    """Parts of a hash in which near hashes meet: ``(mask, p, q, positions)`` each.

    Two hashes within ``threshold`` differ in at most ``p + q`` bits of one of the parts, as the parts' radii and one more for
    each part are one more than the threshold. There one side flips up to p bits and the other up to q. How many parts, and how a
    radius is shared, is chosen by the rows of the index and the chance candidates that ``n`` hashes make: more hashes
    have wider parts with more flips, so the candidates of a hash hardly grow.
    """
    best = None
    for m in range(1, min(threshold + 1, len(positions)) + 1):
        edges = [len(positions) * i // m for i in range(m + 1)]
        radii = [(threshold + 1 - m) // m + (i < (threshold + 1 - m) % m) for i in range(m)]
        cost, parts = 0.0, []
        for i, r in enumerate(radii):
            own = positions[edges[i] : edges[i + 1]]
            options = []
            for q in range(r // 2 + 1):
                a, b = (sum(comb(len(own), k) for k in range(x + 1)) for x in (r - q, q))
                options.append((ROW * (a + b) + n * a * b / 2 ** len(own), q, max(a, b)))
            c, q, most = min(options)
            cost += c if most <= FLIPS or m == threshold + 1 else float("inf")
            parts.append((sum(1 << x for x in own), r - q, q, own))
        if best is None or cost < best[0]:
            best = cost, parts
    return best[1]


def _keys(df: DataFrame, name: str, parts: list, side: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the index: ``name``, the part's number ``_at`` and its value ``_part`` with each flip of this side (1: p, 2: q)."""

    def flipped(i: int, part: tuple) -> Column:
        value = F.col(name).bitwiseAND(F.lit(_signed(part[0])))
        flips = F.array(*[F.lit(_signed(x)).cast("long") for x in _flips(part[3], part[side])])
        return F.transform(flips, lambda x: F.struct(F.lit(i).alias("_at"), value.bitwiseXOR(x).alias("_part")))

    each = [flipped(i, part) for i, part in enumerate(parts)]
    return df.select(name, *keep, F.explode(F.concat(*each)).alias("_k")).select(name, *keep, "_k.*")


def _once(parts: list, differ: Column, at: Column, value: Column, a: Column) -> Column:
    """Whether a pair meets here first: at the first part where it is within the radius, and there where the first side flips the lowest bits that the second side can't."""
    masked = [differ.bitwiseAND(F.lit(_signed(m))) for m, _, _, _ in parts]
    out = F.lit(False)
    for i in reversed(range(len(parts))):
        mask, p, q, _ = parts[i]
        rest, low = masked[i], F.lit(0).cast("long")
        for k in range(p if q else 0):  # with q = 0 there is one meeting
            more = F.bit_count(masked[i]) > q + k
            bit = rest.bitwiseAND(-rest)
            low, rest = F.when(more, low.bitwiseOR(bit)).otherwise(low), rest.bitwiseXOR(bit)
        here = (at == i) & ((a.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(value) == low) if q else F.lit(True))
        out = F.when(F.bit_count(masked[i]) <= p + q, here).otherwise(out)
    return out


def _met(a: DataFrame, b: DataFrame, parts: list, threshold: int, apart: Column | None = None, within: list | None = None) -> DataFrame:
    """Pairs of two sides' index rows within ``threshold``, each once. ``within``: the parts of the key that the rows were cut from.

    Never by a broadcast: Spark takes the size of an index from its hashes, each of which has many rows in it.
    """
    differ = F.col("hash_i").bitwiseXOR(F.col("hash_j"))
    on = ["_at", "_part"] + (["_at0", "_part0"] if within else [])
    near = (F.col("hash_i") < F.col("hash_j")) & (F.bit_count(differ) <= threshold)
    met = a.join(b.hint("merge"), on).where(near if apart is None else near & apart).where(_once(parts, differ, F.col("_at"), F.col("_part"), F.col("hash_i")))
    if within:
        met = met.where(_once(within, differ, F.col("_at0"), F.col("_part0"), F.col("hash_i")))
    return met.select("hash_i", "hash_j", F.bit_count(differ).alias("distance"))


def _pairs(distinct: DataFrame, n: int, threshold: int, bits: int, group: str | None = None) -> DataFrame:
    """Pairs of the hashes ``_h``; with ``group``, of different groups only, and keys with one group are left out."""
    parts = index_parts(n, threshold, list(range(bits)))
    keep = (group,) if group else ()
    sides = [distinct.select(F.col("_h").alias(h), *[F.col(g).alias(f"{g}_{h[-1]}") for g in keep]) for h in ("hash_i", "hash_j")]
    a, b = (_keys(df, h, parts, side, tuple(f"{g}_{h[-1]}" for g in keep)) for side, (h, df) in enumerate(zip(("hash_i", "hash_j"), sides, strict=True), 1))
    apart = F.col(f"{group}_i") != F.col(f"{group}_j") if group else None
    if group:
        one = b.groupBy("_at", "_part").agg(F.min(f"{group}_j").alias("_lo"), F.max(f"{group}_j").alias("_hi"))
        a = a.join(one.hint("merge"), ["_at", "_part"]).where((F.col("_lo") != F.col("_hi")) | (F.col("_lo") != F.col(f"{group}_i"))).drop("_lo", "_hi")
    hot = written(b.groupBy("_at", "_part").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT))  # at most a row for HOT rows of the index
    most = hot.agg(F.max("_n")).first()[0]
    if most is None:
        return _met(a, b, parts, threshold, apart)
    keys = hot.select("_at", "_part", F.lit(True).alias("_hot"))
    a, b = a.join(keys, ["_at", "_part"], "left"), b.join(keys, ["_at", "_part"], "left")
    out = _met(a.where("_hot IS NULL"), b.where("_hot IS NULL"), parts, threshold, apart)
    for i, part in enumerate(parts):  # hashes with a hot key meet where they are near in a further part, too
        others = [x for x in range(bits) if x not in set(part[3])]
        finer = index_parts(most, threshold, others)
        cut = [_keys(df.where(F.col("_hot") & (F.col("_at") == i)).select(h, *[f"{g}_{h[-1]}" for g in keep], F.col("_at").alias("_at0"), F.col("_part").alias("_part0")), h, finer, side, (*[f"{g}_{h[-1]}" for g in keep], "_at0", "_part0")) for side, (h, df) in enumerate((("hash_i", a), ("hash_j", b)), 1)]
        out = out.unionByName(_met(*cut, finer, threshold, apart, parts))
    return out


@own_names("key", "hash_col", frame="hashes")
def hamming_pairs(hashes: DataFrame, key: str, hash_col: str = "hash", threshold: int = 8, bits: int = 64) -> DataFrame:
    """``hash_i < hash_j`` (distinct hashes) within ``threshold`` bits, and their ``distance``.

    Hashes meet by an equality join on parts of their bits, flipped within each part's radius
    (``index_parts``); of several meetings of a pair one is kept by rule, so nothing is
    deduplicated. A key with more than ``HOT`` hashes is cut by further parts. Equal hashes are one row, NULL has none. The result lists
    pairs, so a family of near hashes has as many as it has; ``clusters`` links families without listing them.
    """
    distinct = written(hashes.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).cast("long").alias("_h")).distinct())
    return _pairs(distinct, distinct.count(), threshold, bits)


@own_names("key", "hash_col", frame="hashes")
def clusters(hashes: DataFrame, key: str, hash_col: str = "hash", threshold: int = 8, bits: int = 64) -> DataFrame:
    """``key, component``: the least key of all that are linked, singletons included; a NULL hash is linked to none.

    First each hash is linked to the least hash that shares one of its blocks of bits, its local root, if
    that is near. Pairs are then sought between different components of these links only, and an index key with one component has none, so
    a family costs links to its roots, not its pairs.
    """
    base = written(hashes.select(F.col(key).alias("key"), F.col(hash_col).cast("long").alias("h")))
    distinct = base.where("h IS NOT NULL").select(F.col("h").alias("_h")).distinct()
    blocks = [(m, 0, 0, x) for m, _, _, x in index_parts(0, threshold, list(range(bits)))]
    keyed = _keys(distinct, "_h", blocks, 1)
    roots = keyed.groupBy("_at", "_part").agg(F.min("_h").alias("_root"))
    local = keyed.join(roots.hint("merge"), ["_at", "_part"]).where((F.col("_h") != F.col("_root")) & (F.bit_count(F.col("_h").bitwiseXOR(F.col("_root"))) <= threshold)).select("_h", "_root").distinct()
    local = written(local)
    first = components(local, "_h", "_root").withColumnRenamed("id", "_h")
    grouped = written(distinct.join(first, "_h", "left").select("_h", F.coalesce("component", "_h").alias("_group")))
    across = _pairs(grouped, grouped.count(), threshold, bits, "_group")
    links = local.select(F.col("_h").alias("hash_i"), F.col("_root").alias("hash_j")).union(across.select("hash_i", "hash_j"))
    linked = components(written(links), "hash_i", "hash_j")
    rooted = base.join(linked, F.col("h") == F.col("id"), "left").select("key", "h", F.coalesce("component", "h").alias("root"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("component"))
    return rooted.join(least, "root", "left").select(F.col("key").alias(key), F.coalesce("component", "key").alias("component"))


def representative(comp: DataFrame, key: str) -> DataFrame:
    """The first member of each cluster, and its size."""
    return comp.groupBy("component").agg(F.min(key).alias("representative"), F.count("*").alias("size"))


def stats(comp: DataFrame, key: str) -> DataFrame:
    per = representative(comp, key)
    return per.agg(F.sum("size").alias("total"), F.count("*").alias("clusters"), F.count("*").alias("kept"), (F.sum("size") - F.count("*")).alias("removed"), F.count_if(F.col("size") > 1).alias("duplicate_clusters"))


def report(comp: DataFrame, key: str) -> DataFrame:
    """``component, size, representative, member, rank``: clusters of two or more, a row for each member in order."""
    per = representative(comp, key).where("size > 1").withColumnRenamed("component", "_of")
    several = comp.join(per, F.col("component") == F.col("_of")).select("component", "size", "representative", F.col(key).alias("member"))
    return numbered(several, "member", ("component",), "_place").select("component", "size", "representative", "member", (F.col("_place") + 1).alias("rank"))


def to_remove(comp: DataFrame, key: str) -> DataFrame:
    """Members that aren't their cluster's representative."""
    return comp.where(F.col(key) != F.col("component")).select(key)


def run(df: DataFrame, key: str, text: str = "text", threshold: int = 3, bits: int = 60) -> DataFrame:
    """The rows of ``df`` that stay: one for each cluster of near-duplicate texts."""
    comp = clusters(text_simhash(df, key, text, bits), key, "hash", threshold, bits)
    return df.join(comp.where(F.col(key) == F.col("component")).select(key), key, "left_semi")
