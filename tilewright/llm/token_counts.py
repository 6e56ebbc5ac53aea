"""Token counts by a two-tier lookup on the map side.

The tokenizer splits a text into pre-tokens and encodes each by itself, so a
text's count is the sum over its pre-tokens. Tier one is a compact table of
frequent pre-tokens and their lengths, broadcast once; its size is bounded by
``table_size``. Tier two is a cache in each worker that encodes what the table
misses, bounded by ``cache_size``. No pre-token is ever shuffled. Which
pre-tokens the table holds changes the speed alone, never a count.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 512
TABLE_SIZE = 1 << 16
CACHE_SIZE = 1 << 20
WARM_ROWS = 2000
#: Longer pre-tokens are encoded whenever they occur, so that the cache is bounded in bytes, too.
LONGEST = 256


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitter(pattern: str) -> regex.Pattern:
    r"""The pre-token pattern; \s spelled as the Unicode property that the tokenizer means by it."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Lengths(dict):
    """Token counts of pre-tokens: the broadcast table, then a bounded cache."""

    def __init__(self, table: dict[str, int], tokenizer, cache_size: int):
        super().__init__(table)
        self.table, self.tokenizer, self.most = table, tokenizer, len(table) + cache_size

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.table)
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            self[piece] = n
        return n


def _pieces(text: str, find, cut):
    """Pre-tokens of the stretches between special strings, and how many such strings there are."""
    if cut is None or not cut.search(text):
        return find(text), 0
    parts = cut.split(text)
    return [p for part in parts for p in find(part)], len(parts) - 1


def _load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = special_strings(tokenizer)
    return tokenizer, regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None


def frequent_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text", table_size: int = TABLE_SIZE, warm_rows: int = WARM_ROWS) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about ``warm_rows`` rows: tier one. Counted on the executors, a table of bounded size each."""

    def count(batches):
        find, seen = splitter(pattern).findall, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(find(text or ""))
        top = [x for x in seen.most_common(table_size) if len(x[0]) <= LONGEST]
        yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in top], "n": [n for _, n in top]}, schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    turn = max(1, docs.count() // warm_rows)  # a share of the rows by a hash of the text: nothing is shuffled
    counted = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(turn)) == 0).mapInArrow(count, "piece string, n long")
    top = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_size).collect()
    tokenizer, _ = _load(path)
    pieces = [r.piece for r in top]
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True) if p}


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE, warm_rows: int = WARM_ROWS) -> DataFrame:
    """Columns ``row`` (struct of the input's columns) and ``n_tokens`` (long).

    Null and empty texts have no tokens. Special strings inside a text count as
    the library's default counts them: one token each. Repeated rows come back
    repeated; an empty table gives no rows; extra columns travel in ``row``.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = path or vocabulary_path()
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, pattern, text_col, table_size, warm_rows))
    base = docs.select(F.struct("*").alias("row"))

    def run(batches):
        tokenizer, cut = _load(path)
        find, length = splitter(pattern).findall, Lengths(table.value, tokenizer, cache_size).__getitem__
        for batch in batches:
            counts = []
            for text in batch.column("row").field(text_col).to_pylist():
                pieces, special = _pieces(text or "", find, cut)
                counts.append(special + sum(map(length, pieces)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts, pa.int64())], names=["row", "n_tokens"])

    return base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("n_tokens", T.LongType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: tokens of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
