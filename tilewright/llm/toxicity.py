"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled text (U, drawn from all rows) train a
linear numpy classifier on words and word beginnings. The risk of calling U clean
also counts the toxic rows inside U; with the class prior ``p`` that part is taken out,
``p * R_P(toxic) + max(0, R_U(clean) - p * R_P(clean))``, and where the difference
falls below zero the step goes the other way. Confirmed clean rows serve to
estimate the prior alone.

The sample is bounded (``positives``, ``unlabelled`` rows at most, different in id or text
and chosen by a hash of both, however many rows share an id); near copies inside it count once. Features that are no more frequent in toxic
rows than the lift asks for are left out before the fit: with all of them, hashed
into 2**18 places, the same risk found a third of the held-out toxic rows that it
finds now. Scoring covers every whole text.

Null text counts as empty; an empty text scores the bias. A very long text is one
set of features. Repeated rows come back repeated, an empty table gives no rows,
extra columns travel in ``row``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIVES, UNLABELLED = 2000, 6000
FEATURES, LEAST_ROWS, LEAST_LIFT = 4096, 6, 8.0
BEGINNINGS = (4, 5, 6)
CACHE = 1 << 19
FOLDS = 5
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


# -------------------------------------------------------------------- features


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings."""
    return tuple(xxhash.xxh32_intdigest(x) for x in dict.fromkeys([word + "$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]))


class _Cache(dict):
    """What ``make`` gives for a word, kept for up to ``CACHE`` words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = self.make(word)
        return out


def _sketch(words: list[str], size: int = 8) -> list[int]:
    """The least hashes of the text's runs of three words: near copies share most of them."""
    runs = {xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2))}
    return sorted(runs)[:size]


def _chosen(of: DataFrame, among: DataFrame, n: int) -> DataFrame:
    """``text`` of ``n`` rows (all, if fewer) of ``among``; rows alike in ``id`` and ``hash`` (of the text) are one."""
    keys = among.select("id", "hash").distinct().orderBy(F.xxhash64(F.lit("pu"), "id", "hash"), "id", "hash").limit(n)
    keys = F.broadcast(keys.select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash")))  # at most ``n`` rows
    found = of.join(keys, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left_semi")
    return found.groupBy("id", "hash").agg(F.first("text").alias("text")).select("text")


def _sample(texts: DataFrame) -> list[np.ndarray]:
    """Feature hashes of each row (packed, so that the driver holds 4 bytes a feature), without near copies."""

    def run(batches):
        features = _Cache(word_features)
        for batch in batches:
            found, sketches = [], []
            for text in batch.column(0).to_pylist():
                words = _WORD.findall((text or "").lower())
                found.append(np.array(sorted(set().union(*map(features.__getitem__, set(words)))), "<u4").tobytes())
                sketches.append(np.array(_sketch(words), "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sketches, pa.binary())], names=["found", "sketch"])

    rows = sorted((bytes(r.found), bytes(r.sketch)) for r in texts.mapInArrow(run, "found binary, sketch binary").toLocalIterator())
    out, seen = [], set()
    for found, packed in rows:
        sketch = np.frombuffer(packed, "<i8").tolist()
        if 2 * sum(x in seen for x in sketch) <= len(sketch) or not sketch:
            out.append(np.frombuffer(found, "<u4"))
        seen.update(sketch)
    return out


# ----------------------------------------------------------------------- model


class _Rows:
    """The features of each row, one list after the other; a last weight is the bias."""

    def __init__(self, rows: list[np.ndarray], features: int):
        self.n, self.features = len(rows), features
        self.feature = np.concatenate([np.empty(0, np.int64), *rows])
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], self.n) + w[-1]

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        """Of the mean over rows."""
        return np.append(np.bincount(self.feature, by_row[self.row], self.features), by_row.sum()) / self.n


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4, beta: float = 0.0) -> tuple[dict[int, float], float]:
    """Weights by feature, and the bias, of a linear classifier under the non-negative risk (logistic loss)."""
    named, in_p = np.unique(np.concatenate(positive), return_counts=True)
    often = in_p >= LEAST_ROWS
    named, in_p = named[often], in_p[often]

    def places(row):  # where a row's features stand among the named ones
        at = np.searchsorted(named, row)
        at[at == len(named)] = 0
        return at[named[at] == row] if len(named) else at[:0]

    in_u = np.zeros(len(named))
    for row in unlabelled:
        in_u[places(row)] += 1
    # a feature's share of clean rows, rather too high: its share of U (and a deviation) less what the toxic rows in U make up
    high = (in_u + np.sqrt(in_u) + 0.5) / len(unlabelled)
    share = np.maximum(0.5 / len(unlabelled), high - prior * in_p / len(positive)) / (1 - prior)
    lift = in_p / len(positive) / share
    best = np.flatnonzero(lift >= LEAST_LIFT)
    best = np.sort(best[np.lexsort((named[best], -in_p[best] * np.log(lift[best])))][:FEATURES])
    named = named[best]

    p, u = _Rows([places(row) for row in positive], len(named)), _Rows([places(row) for row in unlabelled], len(named))
    w = np.zeros(len(named) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p.scores(w), u.scores(w)
        gp, gu = sigmoid(zp), sigmoid(zu)
        as_clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_clean = u.gradient(gu) - prior * p.gradient(gp)
        grad_toxic = prior * p.gradient(gp - 1)
        grad = grad_toxic + grad_clean if as_clean >= -beta else -grad_clean
        grad = grad + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {int(f): float(x) for f, x in zip(named, w, strict=False) if x != 0}, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, float], float]:
    """A model from the rows that aren't held out. Labels other than 0 and 1, and null labels, don't count.

    Without a confirmed toxic row or without text every score is the prior (0 where nothing is labelled).
    """
    rows = docs.where(~held_out(id_col))
    known = labels.where(~held_out(id_col)).where(F.col("toxic").isin(0, 1))
    toxic, total = known.agg(F.sum("toxic"), F.count("*")).first()
    prior = (toxic or 0) / total if total else 0.0
    of = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    confirmed = of.join(known.where("toxic = 1").select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    p = _sample(_chosen(of, confirmed, positives)) if toxic else []
    if not p:
        return {}, -30.0
    u = _sample(_chosen(of, of, unlabelled))
    prior = min(max(prior, 1e-3), 0.9)
    return nnpu(p, u, prior)


def score(docs: DataFrame, model: tuple[dict[int, float], float], text_col: str = "text") -> DataFrame:
    """Columns ``row`` (struct of the input's columns) and ``score`` (0 to 1). Null counts as empty; an empty text scores the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    base = docs.select(F.struct("*").alias("row"))

    def run(batches):
        weights, bias = shared.value
        hits = _Cache(lambda word: tuple(f for f in word_features(word) if f in weights))
        for batch in batches:
            out = []
            for text in batch.column("row").field(text_col).to_pylist():
                found = set().union(*map(hits.__getitem__, set(_WORD.findall((text or "").lower()))))
                z = bias + sum(weights[f] for f in sorted(found))
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], names=["row", "score"])

    return base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, train(docs, labels)).select("row.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
