"""Alignment of two tokenizers' tokens over the same bytes, by products of sparse incidence matrices.

A token-byte incidence matrix has a row for each token and a one for each of its bytes. The row-wise
(Gustavson) product A.B' of two tokenizers' matrices has an entry for each pair of tokens that share bytes, and its value is how
many: the overlap links. Those of them that end at the same byte are the end links, and their bytes cut the text into
groups. Token-group incidence matrices multiply into the shared-group links.

Both tokenizers begin anew where a space follows something else, so a text falls into stretches that are aligned by
themselves. A worker keeps the alignment of the stretches it has seen, up to a bound, and multiplies matrices only for new ones,
many at once. Which end links the corpus holds how often is summed over all documents by pair of ids. Two
tokens that end together are one a suffix of the other, so the pairs there can be follow from the vocabularies alone: that bounds
the table of counts, which is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.token_counts import vocabulary_path
from tilewright.llm.token_files import BYTE_LETTERS
from tilewright.plans.lineage import written

#: Most stretches that a worker keeps.
KEPT = 3 << 17
#: Characters of texts that are aligned at a time, and of stretches that are encoded in one call.
AT_ONCE = 1 << 20
IN_ONE = 1 << 16
#: A cut that neither tokenizer's tokens cross: before a space, after anything that isn't white space.
CUT = re.compile(r"(?<=\S)(?= )")
#: A space that is no cut.
UNCUT = re.compile(r"\s ")


# ---------------------------------------------------------------- sparse matrices


class CSR:
    """A sparse matrix by rows: ``indices[indptr[i]:indptr[i + 1]]`` are the columns of row i, ``data`` their values."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, columns: int):
        self.indptr, self.indices, self.data, self.columns = indptr, indices, data, columns

    @classmethod
    def spans(cls, lengths: np.ndarray) -> CSR:
        """Row i has ones in the next ``lengths[i]`` columns after those of the rows before it."""
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return cls(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64), int(ends[-1]))

    @classmethod
    def labels(cls, columns_of_rows: np.ndarray, columns: int) -> CSR:
        """Row i has a one in its column."""
        n = len(columns_of_rows)
        return cls(np.arange(n + 1), columns_of_rows.astype(np.int64), np.ones(n, np.int64), columns)

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> CSR:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.columns)
        return CSR(np.concatenate([[0], np.cumsum(counts)]), self.rows[order], self.data[order], len(self.indptr) - 1)

    def times(self, other: CSR) -> CSR:
        """Gustavson's product: each row gathers the other's rows that its entries name, and adds what falls into one column."""
        n = np.diff(other.indptr)[self.indices]
        rows = np.repeat(self.rows, n)
        at = np.repeat(other.indptr[self.indices] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        columns, values = other.indices[at], np.repeat(self.data, n) * other.data[at]
        key = rows * max(other.columns, 1) + columns
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            rows, columns, values, key = rows[order], columns[order], values[order], key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(values, first) if len(first) else values
        counts = np.bincount(rows[first], minlength=len(self.indptr) - 1)
        return CSR(np.concatenate([[0], np.cumsum(counts)]), columns[first], sums, other.columns)


# ---------------------------------------------------------------- tokenizers


class ByteLevel:
    """Tokenizer A: byte-level BPE of the tokenizers library; special strings inside texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        letters = {chr(letter): byte for byte, letter in BYTE_LETTERS.items()}
        of = {i: bytes(letters[c] for c in x) if set(x) <= letters.keys() else x.encode() for x, i in self.library.get_vocab().items()}
        self.bytes = [of.get(i, b"") for i in range(max(of) + 1)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        known = config.get("normalizer") is None and config.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        model = config["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.ranks = None
        if known and made == sorted(made) and not model.get("ignore_merges") and len(of) - len(made) - len(config["added_tokens"]) == 256:
            # merges in the order of their ids: the ids are ranks, and tiktoken merges by ranks
            import tiktoken

            special = {t["id"] for t in config["added_tokens"]}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in of.items() if i not in special}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        if self.ranks is not None:
            return [self.ranks.encode_ordinary(" " + x) for x in texts]
        return [x.ids for x in self.library.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B: sentencepiece with byte pieces; it puts the first space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        piece = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(piece)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.space = self.library.encode("x ")[1:]  # of a space at the end of a text

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it; an empty text is that space alone."""
        out = self.library.encode(texts, num_threads=1)
        return [x if t else self.space for t, x in zip(texts, out, strict=True)]


def suffix_pairs(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids, ascending, of which one's bytes end with the other's: those that can end at the same byte."""
    found = set()
    for swap, (long, short) in enumerate([(a, b), (b, a)]):
        of: dict[bytes, list[int]] = {}
        for i, x in enumerate(short):
            of.setdefault(x, []).append(i)
        for i, x in enumerate(long):
            for k in range(len(x)):
                found.update((j, i) if swap else (i, j) for j in of.get(x[k:], ()))
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


# ---------------------------------------------------------------- alignment


def _each(texts: list[str], a: ByteLevel, b: Pieces) -> tuple:
    """Of texts encoded one by one: which are good, and the ids and how many each text has, of both sides; none of a bad text."""
    a_ids, b_ids = a.encode(texts), b.encode(texts)
    good = [b"".join(map(a.bytes.__getitem__, x)) == b" " + t.encode() == b"".join(map(b.bytes.__getitem__, y)) for t, x, y in zip(texts, a_ids, b_ids, strict=True)]
    kept = [[x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (a_ids, b_ids)]
    return np.array(good, bool), *((list(chain.from_iterable(ids)), np.array([len(x) for x in ids], np.int64)) for ids in kept)


def _together(texts: list[str], a: ByteLevel, b: Pieces) -> tuple | None:
    """``_each`` of texts that are put one behind the other, each after its space: tokens end where texts do. None if some text isn't good."""
    parts, size = [[]], 0
    for t in texts:
        size += len(t)
        if size > IN_ONE and parts[-1]:
            parts.append([])
            size = len(t)
        parts[-1].append(t)
    whole = [" ".join(x) for x in parts if x]
    raw = b"".join(b" " + x.encode() for x in whole)
    ends = np.cumsum([1 + len(t.encode()) for t in texts], dtype=np.int64)
    out = []
    for side in (a, b):
        ids = list(chain.from_iterable(side.encode(whole)))
        if b"".join(map(side.bytes.__getitem__, ids)) != raw:
            return None
        token_ends = np.cumsum(side.lengths[ids]) if ids else np.zeros(0, np.int64)
        last = np.searchsorted(token_ends, ends)
        if len(ends) and (token_ends[last] != ends).any():
            return None
        out.append((ids, np.diff(last, prepend=-1)))
    return np.ones(len(texts), bool), *out


class Aligned:
    """Many texts with a space before each, aligned at once: tokens and links of all, text after text.

    A text whose joined bytes on either side aren't its own has no tokens (``good`` is false).
    """

    def __init__(self, texts: list[str], a: ByteLevel, b: Pieces, joined: int = 0):
        """The first ``joined`` texts end in no white space, so they may be encoded as one text."""
        ids = _together(texts[:joined], a, b) or _each(texts[:joined], a, b)
        rest = _each(texts[joined:], a, b)
        self.good = np.concatenate([ids[0], rest[0]])
        (a_ids, self.n_a), (b_ids, self.n_b) = (([*x[0], *y[0]], np.concatenate([x[1], y[1]])) for x, y in zip(ids[1:], rest[1:], strict=True))
        self.a, self.b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        long_a, long_b = a.lengths[self.a], b.lengths[self.b]
        self.end_a, self.end_b = np.cumsum(long_a), np.cumsum(long_b)
        self.overlap = CSR.spans(long_a).times(CSR.spans(long_b).transposed())
        row, column = self.overlap.rows, self.overlap.indices
        ends = self.end_a[row] == self.end_b[column]
        self.link_a, self.link_b = row[ends], column[ends]
        cuts = self.end_a[self.link_a]
        self.group_a, self.group_b = np.searchsorted(cuts, self.end_a), np.searchsorted(cuts, self.end_b)
        self.members_a, self.members_b = CSR.labels(self.group_a, len(cuts)), CSR.labels(self.group_b, len(cuts))
        self.shared = self.members_a.times(self.members_b.transposed())
        # of which text each link, overlap, shared pair is
        self.text_a = np.repeat(np.arange(len(texts)), self.n_a)
        count = lambda of: np.bincount(self.text_a[of], minlength=len(texts))
        self.n_links, self.n_overlap, self.n_shared = count(self.link_a), count(row), count(self.shared.rows)

    def groups(self) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2``."""
        sides = []
        for ids, members in ((self.a, self.members_a), (self.b, self.members_b)):
            names, at = list(map(str, ids.tolist())), members.transposed().indptr
            begin = names if len(names) == len(at) - 1 else [names[i] for i in at[:-1].tolist()]
            for i in np.flatnonzero(np.diff(at) > 1).tolist():
                begin[i] = ",".join(names[at[i] : at[i + 1]])
            sides.append(begin)
        each = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
        at = [0, *np.cumsum(self.n_links).tolist()]
        return [";".join(each[x:y]) for x, y in zip(at, at[1:], strict=False)]


class Stretches:
    """Alignments of the stretches that a worker has seen, numbered; forgotten all at once beyond ``kept``."""

    def __init__(self, a_path: str, b_path: str, kept: int = KEPT):
        self.a, self.b, self.kept = ByteLevel(a_path), Pieces(b_path), kept
        self.pair_a, self.pair_b = suffix_pairs(self.a.bytes, self.b.bytes)
        self.pair_key = self.pair_a << 32 | self.pair_b
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 6), np.int64)  # good, n_a, n_b, links, overlaps, shared
        self.codes, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, texts: list[list[str]]) -> None:
        """Aligns what is new in the stretches of some texts."""
        if len(self.number) > self.kept:
            self.forget()
        new = set(chain.from_iterable(texts)).difference(self.number)
        if new:
            alone = [x for x in new if not x or x[-1].isspace() or "▁" in x]
            new = [*new.difference(alone), *alone]
            x = Aligned(new, self.a, self.b, len(new) - len(alone))
            self.number.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            self.groups += x.groups()
            self.counts = np.concatenate([self.counts, np.stack([x.good, x.n_a, x.n_b, x.n_links, x.n_overlap, x.n_shared], axis=1)])
            codes = np.searchsorted(self.pair_key, x.a[x.link_a] << 32 | x.b[x.link_b]).astype(np.int32)
            self.codes = np.concatenate([self.codes, codes])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(x.n_links)])

    def of(self, text: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray] | None:
        """Counts, groups and end links (pairs and how often) of a text from its stretches; None if it has no tokens."""
        at = np.fromiter(map(self.number.__getitem__, text), np.int64, len(text))
        counts = self.counts[at].sum(axis=0)
        if counts[0] < len(at):
            return None
        kinds, often = np.unique(at, return_counts=True)
        begin, n = self.begin[kinds], self.begin[kinds + 1] - self.begin[kinds]
        codes = self.codes[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        kinds, back = np.unique(codes, return_inverse=True)
        return counts[1:], [self.groups[i] for i in at.tolist()], kinds, np.bincount(back, weights=np.repeat(often, n), minlength=len(kinds)).astype(np.int64)


def stretches(text: str) -> list[str]:
    """The text cut into stretches, each without the space it begins with (the first with the space put before the text)."""
    if text[0] != " " and not UNCUT.search(text):
        return text.split(" ")
    return [x[1:] for x in CUT.split(" " + text)]


def slices(batches, column: str, at_once: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts have about ``at_once`` bytes; a longer text is a part by itself."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + at_once, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


@lru_cache(maxsize=1)
def _worker(a_path: str, b_path: str, kept: int) -> Stretches:
    return Stretches(a_path, b_path, kept)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocabulary_path("byte_bpe_50k.json"), b_path or vocabulary_path("piece_bpe_32k.model")


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlap", "n_shared"]


def digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_overlap, n_shared, n_best, count_sum, groups_sha256`` of every row.

    Tokens of space + text by both tokenizers. A text that is null or empty, or whose joined bytes on either side
    aren't space + text, has no tokens: zeros and an empty ``groups_sha256``. ``n_links`` counts pairs of tokens that end at the same byte;
    a link's count is how many links of all rows have its two ids, ``count_sum`` sums it over the links, and
    ``n_best`` counts links whose count no other partner of their B id exceeds. Repeated rows count and come back each; extra
    columns are left out; an empty table gives no rows; long texts are taken whole.
    """
    a_path, b_path = _paths(a_path, b_path)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = [base.schema["id"], *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))]

    def align(batches) -> Iterator[pa.RecordBatch]:
        worker = _worker(a_path, b_path, kept)
        empty = np.zeros(0, np.int64)
        for batch in slices(batches, "text", AT_ONCE):
            texts = [stretches(x) if x else None for x in batch.column("text").to_pylist()]
            worker.learn([x for x in texts if x])
            found = [worker.of(x) if x else None for x in texts]
            n = np.array([[x[0][0], x[0][1], x[0][2], *x[0][2:]] if x else [0] * 6 for x in found], np.int64).reshape(-1, 6)
            sha = [hashlib.sha256(";".join(x[1]).encode()).hexdigest() if x else "" for x in found]
            ends = np.concatenate([[0], np.cumsum([len(x[2]) if x else 0 for x in found])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([empty, *[x[k] for x in found if x]]).astype(np.int32))) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(np.ascontiguousarray(n[:, i])) for i in range(6)], pa.array(sha, pa.string()), *lists], names=[c.name for c in columns])

    aligned = written(base.mapInArrow(align, T.StructType(columns)))

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            if len(pairs):
                own = np.bincount(pairs, weights=times).astype(np.int64)
                short, long = sorted((total, own), key=len)
                total = long.copy()
                total[: len(short)] += short
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    # at most a row for each pair that the vocabularies allow
    counted = aligned.select("pairs", "times").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    context = docs.sparkSession.sparkContext
    table = context.broadcast((counted.column("pair").to_numpy(), counted.column("n").to_numpy()))

    def weigh(batches) -> Iterator[pa.RecordBatch]:
        worker = _worker(a_path, b_path, kept)
        counts = np.zeros(len(worker.pair_b) + 1, np.int64)
        counts[table.value[0]] = table.value[1]
        top = np.zeros(int(worker.pair_b.max(initial=0)) + 1, np.int64)
        np.maximum.at(top, worker.pair_b, counts[:-1])
        best = np.concatenate([counts[:-1] == top[worker.pair_b], [False]])
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            sums = [np.concatenate([[0], np.cumsum(times * x[pairs])]) for x in (best, counts)]
            at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", *_COUNTS, "groups_sha256")], *[pa.array(x[at[1:]] - x[at[:-1]]) for x in sums]], names=["id", *_COUNTS, "groups_sha256", "n_best", "count_sum"])

    out = aligned.mapInArrow(weigh, T.StructType([*columns[:8], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))
    return out.select(F.col("id").alias(id_col), *_COUNTS, "n_best", "count_sum", "groups_sha256")


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Everything about every row: ``id_col``, the ids and byte ends of both sides' tokens, ``groups`` (a struct of A and B ids each) and the links.

    ``overlap`` (places of the two tokens and the bytes they share), ``shared`` (places of two tokens of one group) and ``ended`` (places of
    two tokens that end together); places count from 0 within the text, ends from the start of space + text. Rows without tokens have empty lists.
    """
    a_path, b_path = _paths(a_path, b_path)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pair = "array<struct<a: int, b: int>>"
    lists = f"a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>, groups array<struct<a: array<int>, b: array<int>>>, overlap array<struct<a: int, b: int, bytes: int>>, shared {pair}, ended {pair}"

    def one(text: str | None, worker: Stretches) -> dict:
        x = Aligned([text] if text else [], worker.a, worker.b)
        places = lambda rows, columns: [{"a": i, "b": j} for i, j in zip(rows.tolist(), columns.tolist(), strict=True)]
        split = lambda ids, groups: [s.tolist() for s in np.split(ids, np.cumsum(np.bincount(groups, minlength=len(x.link_a)))[:-1])]
        groups = [{"a": p, "b": q} for p, q in zip(split(x.a, x.group_a), split(x.b, x.group_b), strict=True)] if len(x.link_a) else []
        overlap = [{**p, "bytes": n} for p, n in zip(places(x.overlap.rows, x.overlap.indices), x.overlap.data.tolist(), strict=True)]
        return {"a_ids": x.a.tolist(), "a_ends": x.end_a.tolist(), "b_ids": x.b.tolist(), "b_ends": x.end_b.tolist(), "groups": groups, "overlap": overlap, "shared": places(x.shared.rows, x.shared.indices), "ended": places(x.link_a, x.link_b)}

    schema = T.StructType([base.schema["id"], *T.StructType.fromDDL(lists).fields])

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        worker, kinds = _worker(a_path, b_path, KEPT), to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([{"id": batch.column("id")[i].as_py(), **one(batch.column("text")[i].as_py(), worker)}], schema=kinds)

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the alignment of every document's tokens, in figures."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlap", "n_shared")
