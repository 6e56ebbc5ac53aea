"""Language identification with a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed
length, each filter keeps its maximum and a softmax names the language. A whole
text is cut into windows; its windows' scores are averaged, weighted by their
bytes. Training happens on a bounded sample of labelled rows (about ``per_lang`` rows a
language and ``most_rows`` in all, ``WINDOWS`` windows a row); all else covers every text,
however long, and every language that is labelled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 8, 8
PER_LANG, ROWS, WINDOWS = 500, 50_000, 4
BATCH = 512
UNKNOWN = "und"
FOLDS, HELD = 4, 2


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD


class ByteCnn:
    """Embedding (256 x DIM), one filter bank as wide as the widest (narrower filters hold zeros), output layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, widest, n = langs, max(WIDTHS), FILTERS * len(WIDTHS)
        self.emb = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.mask = (np.arange(widest * DIM)[:, None] < np.repeat(WIDTHS, FILTERS) * DIM).astype(np.float32)
        self.conv = (rng.normal(0, 0.3, (widest * DIM, n)) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.3, (n, len(langs))).astype(np.float32)
        self.base = np.zeros(len(langs), np.float32)

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, widest * DIM) of windows (n, WINDOW) of bytes."""
        e = self.emb[windows].reshape(len(windows), -1)
        widest = max(WIDTHS) * DIM
        return np.lib.stride_tricks.sliding_window_view(e, widest, axis=1)[:, ::DIM]

    def pooled(self, windows: np.ndarray):
        p = np.ascontiguousarray(self.patches(windows))
        z = p.reshape(-1, p.shape[2]) @ self.conv
        z = z.reshape(len(windows), -1, z.shape[1])
        return p, z

    def logits(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[1].max(axis=1) + self.bias
        return np.maximum(z, 0) @ self.out + self.base

    def fit(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        params = [self.emb, self.conv, self.bias, self.out, self.base]
        m, v, t = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), 128):
                rows = order[i : i + 128]
                x = windows[rows]
                p, z = self.pooled(x)
                at = z.argmax(axis=1)
                top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias
                h = np.maximum(top, 0)
                s = h @ self.out + self.base
                s = np.exp(s - s.max(axis=1, keepdims=True))
                s /= s.sum(axis=1, keepdims=True)
                s[np.arange(len(rows)), target[rows]] -= 1
                s *= (weight[rows] / weight[rows].sum())[:, None]
                back = (s @ self.out.T) * (top > 0)
                picked = np.take_along_axis(p, at[:, :, None], 1)  # (rows, filters, widest * DIM)
                g_conv = np.einsum("bf,bfk->kf", back, picked, optimize=True) * self.mask
                g_patch = (back[:, :, None] * self.conv.T[None]).reshape(len(rows), at.shape[1], -1, DIM)
                g_emb = np.zeros_like(self.emb)
                for j in range(max(WIDTHS)):
                    np.add.at(g_emb, x[np.arange(len(rows))[:, None], at + j], g_patch[:, :, j])
                g_emb[0] = 0
                t += 1
                for k, g in enumerate([g_emb, g_conv, back.sum(0), h.T @ s, s.sum(0)]):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def cut(text: bytes) -> np.ndarray:
    """All windows of a text, the last filled with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def train(docs: DataFrame, per_lang: int = PER_LANG, most_rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCnn | None:
    """A network for all languages of the labelled rows that aren't held out. None without any.

    A language gives the share of its rows that is expected to be ``per_lang`` rows, or fewer
    where there are more than ``most_rows / per_lang`` languages, chosen by a hash.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    langs = counts.count()
    share = F.least(F.lit(1.0), F.lit(min(per_lang, most_rows / max(1, langs))) / F.col("_n"))
    chosen = F.shiftrightunsigned(F.xxhash64(F.lit("lang"), "id", "text"), 11) / F.lit(float(1 << 53)) < F.col("_share")
    sample = rows.join(counts.select(F.col("lang").alias("_lang"), share.alias("_share")), F.col("lang") == F.col("_lang")).where(chosen).select("id", "lang", "text").distinct()  # rows alike in all three are chosen together

    def windows(batches):
        for batch in batches:
            langs, parts = [], []
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = np.random.default_rng(zlib.crc32(str(i).encode()))
                raw = text.encode()
                for k in range(min(WINDOWS, 1 + len(raw) // WINDOW)):
                    size = WINDOW if k % 2 else int(rng.integers(min(24, len(raw)), min(WINDOW, len(raw)) + 1))
                    at = int(rng.integers(0, max(1, len(raw) - size + 1)))
                    langs.append(lang)
                    parts.append(raw[at : at + size])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    found = sorted((r.lang, bytes(r.part)) for r in sample.mapInArrow(windows, "lang string, part binary").collect() if r.part)
    names = sorted({lang for lang, _ in found})
    if not names:
        return None
    place = {lang: i for i, lang in enumerate(names)}
    target = np.array([place[lang] for lang, _ in found])
    weight = (1 / np.bincount(target))[target].astype(np.float32)
    return ByteCnn(names).fit(np.concatenate([cut(p)[:1] for _, p in found]), target, weight)


def predict(docs: DataFrame, model: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """Columns ``row`` (struct of the input's columns), ``lang_pred`` and ``score``.

    ``und`` with score 0 where the text is null or has no letter, and where no language was learned.
    Repeated rows come back repeated, an empty table gives no rows, extra columns travel in ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    base = docs.select(F.struct("*").alias("row"), letters.alias("letters"))

    def run(batches):
        net = shared.value
        for batch in batches:
            texts = batch.column("row").field(text_col).cast(pa.binary()).to_pylist()
            known = [i for i, ok in enumerate(batch.column("letters").to_pylist()) if ok and net is not None]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            total = np.zeros((len(texts), len(net.langs) if net else 1))
            held, of = [], []

            def flush(held=held, of=of, total=total):
                x = np.concatenate(held)
                rows = np.repeat(of, [len(h) for h in held])
                for i in range(0, len(x), BATCH):
                    part = x[i : i + BATCH]
                    s = net.logits(part).astype(np.float64)
                    s -= s.max(axis=1, keepdims=True)
                    s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
                    np.add.at(total, rows[i : i + BATCH], s * (part != 0).sum(axis=1)[:, None])
                held.clear()
                of.clear()

            for i in known:
                held.append(cut(texts[i]))
                of.append(i)
                if sum(map(len, held)) >= BATCH:
                    flush()
            if held:
                flush()
            for i in known:
                s = total[i] / max(1, len(texts[i]))
                s = np.exp(s - s.max())
                lang[i], score[i] = net.langs[int(s.argmax())], float(s.max() / s.sum())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score").withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
