"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A word (a match of the pre-token pattern) is its bytes in hexadecimal. A fold
over its neighbours, each a long of rank and places, merges those of the least rank, leftmost first, until no
neighbours have a rank (in a long word, an array of pieces, all places of the least rank at once); the ranks come from a literal map, split by hash into
small maps because a lookup scans its map. The fold runs once for each of the most
frequent distinct words of the input: the results of the ``words`` first become a
second literal map, those of ``more`` others, which stand more than once, lists of text in a scalar
subquery, a tenth of the size. Words outside both are folded where they stand. Text is never
shuffled, only distinct words with their counts. Decoding joins the ids' byte pieces.
"""

from __future__ import annotations

import base64
import json
from functools import cached_property
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.plans.lineage import written

#: Bound of the dictionary of folded words, in words (of the literal, of the lists) and in bytes of a word.
WORDS, MORE, WORD_BYTES = 1 << 17, 3 << 18, 64
#: Marks before and after a word in a list of folded words; words with a mark in them are in no list.
BEFORE, AFTER = "\x01", "\x02"
#: Name of the lists' column beside the input's.
LISTS = "lists_of_folded_words"
#: Bins of a word's count in each doubling.
BINS = 16
#: Words of more bytes merge all places of the least rank in one step.
LONG = 64
#: Two neighbours are a long: rank (NONE if they have none), start of the first, of the second, end of the second, each of these in PLACE bits.
PLACE, NONE = 7, 1 << 31
#: Characters of a plan's text that the session keeps.
PLAN_TEXT = 1 << 16
RANK_MAPS, WORD_MAPS = 1 << 14, 1 << 15


def rank_table(path: str | None = None) -> dict[bytes, int]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def java_pattern(pattern: str | None = None) -> str:
    r"""The pattern in Java's spelling: \s there is ASCII only, so the Unicode property takes its place."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")


def _literal(value, kind: str) -> Column:
    """A constant of a nested type: folded into the plan once."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _bytes(values: list[bytes]) -> Column:
    """A constant array of strings of any bytes, which ``array_join`` joins as they are."""
    return _literal([base64.b64encode(v).decode() for v in values], "array<binary>").cast("array<string>")


def _split_map(entries: dict[str, object], maps: int) -> list[dict]:
    out: list[dict] = [{} for _ in range(maps)]
    for k, v in entries.items():
        h = xxhash.xxh64_intdigest(k.encode(), 42)
        out[(h - (1 << 64) if h >> 63 else h) % maps][k] = v
    return out


def _looked_up(table: Column, maps: int, key: Column) -> Column:
    """``maps`` is a power of two, so the low bits are the remainder."""
    return F.try_element_at(F.get(table, F.xxhash64(key).bitwiseAND(F.lit(maps - 1)).cast("int")), key)


def _let(value: Column, kind: str, body) -> Column:
    """``body`` (of type ``kind``) of a value that is named once: a large constant is then in the plan once. A fold of one step doesn't copy its result, as ``transform`` does."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def _if(test: Column, yes: Column, no: Column) -> Column:
    """``when`` with one branch; interpreted, it is slower."""
    return F.call_function("if", test, yes, no)


def _listed(lists: Column, number: int, key: Column) -> Column:
    """Ids of a word from the lists; null if it is in none. A list begins with a mark, so what is before its first one is empty."""
    own = F.get(lists, F.pmod(F.xxhash64(key), F.lit(number)).cast("int"))
    after = F.call_function("substring_index", own, F.concat(F.lit(BEFORE), key, F.lit(AFTER)), F.lit(-1))
    return _let(F.substring_index(after, BEFORE, 1), "array<int>", lambda ids: F.when(ids != "", F.split(ids, ",").cast("array<int>")))


def _map_table(rows: DataFrame, key: str, value: str, maps: int) -> DataFrame:
    """Entries of ``maps`` small maps by the keys' hashes, as a table with a row for each."""
    own = rows.select(F.pmod(F.xxhash64(key), F.lit(maps)).alias("map"), F.struct(F.col(key).alias("key"), F.col(value).alias("value")).alias("entry"))
    every = own.sparkSession.range(maps).select(F.col("id").alias("map"), F.lit(None).cast(own.schema["entry"].dataType).alias("entry"))
    return written(own.union(every).groupBy("map").agg(F.collect_list("entry").alias("entries")))


def _maps(table: DataFrame) -> Column:
    """The maps by number (array of map), as a scalar subquery: no text in the plan."""
    rows = F.sort_array(F.collect_list(F.struct("map", "entries")))
    return table.agg(F.transform(rows, lambda r: F.map_from_entries(r["entries"])).alias("maps")).scalar()


class Dictionary(NamedTuple):
    """Folded words: the literal's JSON, and a table of ``number`` lists (or None); ``known``, in the literal's place: a table of its maps."""

    maps: str
    lists: DataFrame | None
    number: int
    known: DataFrame | None = None

    def column(self) -> Column:
        """The lists by number (array of string), as a scalar subquery."""
        rows = F.sort_array(F.collect_list(F.struct("list", "entries")))
        return self.lists.agg(F.transform(rows, lambda r: r["entries"]).alias("lists")).scalar()


def _fitting(sizes: dict[int, int], most: int) -> int:
    """The least bin from which on all bins together have at most ``most`` words."""
    total, least = 0, max(sizes, default=0) + 1
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    return least


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


class Encoder:
    """Columns for one vocabulary. ``ranks``: byte pieces and their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ranks = pattern, ranks
        self.by_id = {i: p for p, i in ranks.items()}

    @cached_property
    def table(self) -> Column:
        return _literal(_split_map({p.hex().upper(): i for p, i in self.ranks.items()}, RANK_MAPS), "array<map<string,int>>")

    def rank_maps(self, spark: SparkSession) -> DataFrame:
        """What ``table`` has, as a table."""
        return _map_table(spark.createDataFrame([(p.hex().upper(), i) for p, i in self.ranks.items()], "piece string, rank int"), "piece", "rank", RANK_MAPS)

    @cached_property
    def pieces(self) -> Column:
        return _bytes([self.by_id.get(i, b"") for i in range(max(self.by_id) + 1)])

    @cached_property
    def digits(self) -> Column:
        return _bytes([i.to_bytes(4, "little") for i in range(max(self.by_id) + 1)])

    def fold(self, word: Column, table: Column) -> Column:
        """Ids of one word, by merges alone. ``table``: the rank maps."""
        rank = lambda piece: _let(piece, "int", lambda key: _looked_up(table, RANK_MAPS, key))
        gone = F.lit(-1)
        bits = lambda x, n: x.bitwiseAND(F.lit(((1 << PLACE) - 1) << n * PLACE))
        first, second, end = (lambda x, n=n: F.shiftright(bits(x, n), n * PLACE).cast("int") for n in (2, 1, 0))

        def piece(h, start, end):
            return F.substring(h, start * 2 + 1, (end - start) * 2)

        def pair(h, start, places, end):
            # two neighbours from ``start`` to ``end``; the number that has their places
            return F.shiftleft(F.coalesce(rank(piece(h, start, end)).cast("long"), F.lit(NONE)), 3 * PLACE).bitwiseOR(places)

        def pairs(h, n):
            places = lambda i: i.cast("long") * F.lit(1 + (1 << PLACE) + (1 << 2 * PLACE)) + F.lit(2 + (1 << PLACE))
            return F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(h, i, places(i), i + 2))

        def merged(h, s, m):
            # the pair before ends where m does, the pair after begins where m does
            keep = lambda *n: F.lit(sum(((1 << PLACE) - 1) << i * PLACE for i in n))
            before = lambda x: pair(h, first(x), x.bitwiseAND(keep(2, 1)).bitwiseOR(bits(m, 0)), end(m))
            after = lambda x: pair(h, first(m), x.bitwiseAND(keep(1, 0)).bitwiseOR(bits(m, 2)), end(x))
            near = lambda at, to: F.transform(s, lambda x: _if(bits(x, 1) == at, before(x), _if(bits(x, 2) == to, after(x), x)))
            new = _let(F.shiftright(bits(m, 2), PLACE), "array<bigint>", lambda at: _let(F.shiftleft(bits(m, 1), PLACE), "array<bigint>", lambda to: near(at, to)))
            return F.array_remove(new, m)

        def step(h, s):
            return _let(F.array_min(s), "array<bigint>", lambda m: _if(m < F.lit(NONE << 3 * PLACE), merged(h, s, m), s))

        def short(h, n):
            folded = F.aggregate(F.sequence(F.lit(2), n), pairs(h, n), lambda s, _: step(h, s))
            last = lambda s: rank(piece(h, second(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0))), n))
            ids = lambda s: F.concat(F.transform(s, lambda x: rank(piece(h, first(x), second(x)))), F.array(last(s)))
            return _if(n == 1, F.array(rank(h)), _let(folded, "array<int>", ids))

        def start(p):
            return F.struct(p.alias("p"), F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x, i: rank(F.concat(F.get(p, i), x))).alias("r"))

        state = "struct<p:array<string>,r:array<int>>"
        leasts = "struct<p:array<string>,r:array<int>,least:int>"

        def all_merged(s):
            # of places in a row every other one merges, from the left; p[i] takes p[i + 1] in where m[i] is 1
            hits = F.array_join(F.transform(s["r"], lambda x: F.when(x == s["least"], "1").otherwise("0")), "")
            return _let(F.split(F.regexp_replace(hits, "11", "10"), ""), state, lambda m: with_marks(s["p"], s["r"], m))

        def with_marks(p, r, m):
            one = lambda i: F.coalesce(F.get(m, i) == "1", F.lit(False))
            left = lambda i: F.concat(F.when(one(i - 1), F.get(p, i - 1)).otherwise(""), F.get(p, i))
            right = lambda i: F.concat(F.get(p, i + 1), F.when(one(i + 1), F.get(p, i + 2)).otherwise(""))
            pieces = F.transform(p, lambda x, i: F.when(one(i), F.concat(x, F.get(p, i + 1))).when(~one(i - 1), x))
            ranks = F.transform(r, lambda x, i: F.when(one(i), gone).when(one(i - 1) | one(i + 1), rank(F.concat(left(i), right(i)))).otherwise(x))
            return F.struct(F.filter(pieces, lambda x: x.isNotNull()).alias("p"), F.filter(ranks, lambda x: x.isNull() | (x != gone)).alias("r"))

        def with_least(s):
            return F.struct(s["p"].alias("p"), s["r"].alias("r"), F.array_min(s["r"]).alias("least"))

        def long_step(s, _):
            return F.when(s["least"].isNull(), s).otherwise(_let(all_merged(s), leasts, with_least))

        def long(p):
            # a fold copies its state in every step, so the steps that are left when all is merged are skipped in turns
            turns = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size(p))).cast("int"))
            run = F.aggregate(turns, _let(start(p), leasts, with_least), lambda s, _: F.when(s["least"].isNull(), s).otherwise(F.aggregate(turns, s, long_step)))
            return F.transform(run["p"], rank)

        def either(h, n):
            return _if(n <= LONG, short(h, n), _let(F.regexp_extract_all(h, F.lit(".."), F.lit(0)), "array<int>", long))

        return _let(F.hex(word), "array<int>", lambda h: _let(F.octet_length(word), "array<int>", lambda n: either(h, n)))

    def dictionary(self, docs: DataFrame, text_col: str = "text", words: int = WORDS, more: int = MORE, ranks: DataFrame | None = None) -> Dictionary:
        """Ids of the most frequent distinct words of all texts: at most ``words`` as a literal, at most ``more`` others that stand more than once as lists.

        Words are taken by bins of their counts, so no task sorts them: a bin that doesn't fit whole stays out.
        With ``ranks`` (``rank_maps``) no literal is made, the maps of the first words are a table, too.
        """
        counted = docs.select(F.explode(words_of(F.col(text_col), self.pattern)).alias("word")).where(F.octet_length("word") <= WORD_BYTES).groupBy("word").count()
        counted = written(counted.select("word", F.floor(F.log2("count") * BINS).cast("int").alias("bin")))
        sizes = {r["bin"]: r["n"] for r in counted.groupBy("bin").agg(F.count("*").alias("n")).collect()}
        first, last = _fitting(sizes, words), _fitting({b: n for b, n in sizes.items() if b}, words + more)
        picked = counted.where(F.col("bin") >= min(first, last))
        if ranks is not None:
            picked = picked.withColumn(LISTS, _maps(ranks))
        ids = _let(self.table if ranks is None else F.col(LISTS), "array<int>", lambda t: self.fold(F.col("word"), t))
        folded = written(picked.select("word", "bin", F.array_join(ids.cast("array<string>"), ",").alias("ids")))
        lists = self._lists(folded.where(F.col("bin") < first), more) if last < first else (None, 0)
        if ranks is not None:
            known = folded.where(F.col("bin") >= first).select("word", F.split("ids", ",").cast("array<int>").alias("ids"))
            return Dictionary("", *lists, _map_table(known, "word", "ids", WORD_MAPS))
        entry = F.concat(F.expr("substring(to_json(struct(word)), 9, length(to_json(struct(word))) - 9)"), F.lit(":["), F.col("ids"), F.lit("]"))
        number = F.pmod(F.xxhash64("word"), F.lit(WORD_MAPS)).cast("int")
        # a lookup scans its map, so the more frequent words come first
        often_first = F.sort_array(F.collect_list(F.struct("bin", entry.alias("entry"))), asc=False)["entry"]
        maps = folded.where(F.col("bin") >= first).groupBy(number.alias("map")).agg(F.array_join(often_first, ",").alias("entries"))
        parts = [""] * WORD_MAPS
        for r in maps.toLocalIterator():
            parts[r["map"]] = r.entries
        return Dictionary("[{" + "},{".join(parts) + "}]", *lists)

    @staticmethod
    def _lists(folded: DataFrame, more: int) -> tuple[DataFrame, int]:
        """Lists of the words and their ids, dealt by the words' hashes; every number has one."""
        number = max(1, more // 4)
        entry = F.concat(F.lit(BEFORE), "word", F.lit(AFTER), "ids")
        own = folded.where(~F.col("word").rlike(f"[{BEFORE}{AFTER}]")).select(F.pmod(F.xxhash64("word"), F.lit(number)).alias("list"), entry.alias("entry"))
        every = folded.sparkSession.range(number).select(F.col("id").alias("list"), F.lit(BEFORE).alias("entry"))
        return written(own.union(every).groupBy("list").agg(F.array_join(F.collect_list("entry"), "").alias("entries"))), number

    def encode(self, text: Column, dictionary: Dictionary | None = None, lists: Column | None = None, constants: Column | None = None) -> Column:
        """Ids of a text (array of int); null counts as empty. ``lists``: the dictionary's lists by number, if they are to be used.

        ``constants``, in place of literals and ``lists``: a struct of ``ranks``, ``known`` and, where there are any, ``lists``.
        """
        words = words_of(text, self.pattern)
        if not dictionary:
            return _let(self.table, "array<int>", lambda t: F.flatten(F.transform(words, lambda w: self.fold(w, t))))
        if constants is not None:
            more = lambda c: [c["lists"]] if dictionary.lists is not None else []
            word = lambda c, w: F.coalesce(_looked_up(c["known"], WORD_MAPS, w), *(_listed(m, dictionary.number, w) for m in more(c)), self.fold(w, c["ranks"]))
            return _let(constants, "array<int>", lambda c: F.flatten(F.transform(words, lambda w: word(c, w))))
        known = F.from_json(F.lit(dictionary.maps), "array<map<string,array<int>>>")
        ids = lambda t, k, *more: F.flatten(F.transform(words, lambda w: F.coalesce(_looked_up(k, WORD_MAPS, w), *(_listed(m, dictionary.number, w) for m in more), self.fold(w, t))))
        if lists is None:
            return _let(self.table, "array<int>", lambda t: _let(known, "array<int>", lambda k: ids(t, k)))
        return _let(self.table, "array<int>", lambda t: _let(known, "array<int>", lambda k: _let(lists, "array<int>", lambda m: ids(t, k, m))))

    def decode(self, ids: Column) -> Column:
        """Bytes (binary) of ids: their pieces joined."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "").cast("binary")

    def packed(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers (binary)."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.digits, i)), "").cast("binary")


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None, text_col: str = "text", words: int = WORDS, ids_col: str = "ids", more: int = MORE, tables: bool = False) -> tuple[DataFrame, Encoder]:
    """``docs`` with a column of ids (a column of that name is replaced), and the encoder.

    Null and empty texts have no ids. Repeated rows come back repeated, an empty
    table gives no rows, extra columns stay. A long word takes a step for each different
    rank that it merges, each as long as what is left of it. Merging all places of a
    rank at once gives the library's ids if every token of the vocabulary encodes to
    itself, as those of a trained vocabulary do: then no merge makes a pair of a lower rank.

    The plan holds constants of some megabytes, and Spark keeps each plan's text, so
    the session's limit of that text is lowered to PLAN_TEXT. With ``tables`` ranks and words are
    scalar subqueries over tables instead: no text of theirs is in a plan, which spares the driver.
    """
    docs.sparkSession.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    e = Encoder(ranks or rank_table(), java_pattern(pattern))
    ranks = e.rank_maps(docs.sparkSession) if tables else None
    known = e.dictionary(docs, text_col, words, more, ranks)
    if known.lists is None and not tables:
        return docs.withColumn(ids_col, e.encode(F.col(text_col), known)), e
    # higher-order functions take a subquery only by a column's name; that is read once, so the optimizer puts the subquery in its place
    if tables:
        lists = {} if known.lists is None else {"lists": known.column()}
        own = docs.withColumn(LISTS, F.struct(*[c.alias(n) for n, c in ({"ranks": _maps(ranks), "known": _maps(known.known)} | lists).items()]))
        ids = e.encode(F.col(text_col), known, constants=F.col(LISTS)).alias(ids_col)
    else:
        own = docs.withColumn(LISTS, known.column())
        ids = e.encode(F.col(text_col), known, F.col(LISTS)).alias(ids_col)
    at = [i for i, c in enumerate(docs.columns) if c.lower() == ids_col.lower()]
    return own.select(*[ids if i in at else own[f"`{c}`"] for i, c in enumerate(docs.columns)], *([] if at else [ids])), e


def query(spark, sf_dir: str) -> DataFrame:
    """op8: ids of every text, and the text they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded, e = encode(docs)
    ids = F.col("ids")
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(e.packed(ids), 256).alias("ids_sha256"), F.sha2(e.decode(ids), 256).alias("decoded_sha256"))
