"""Token files against the library, the perfect hash against all its keys, odd rows."""

import random
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import token_files
from tilewright.llm.token_counts import vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def expected(library, rows, end=2):
    """(id, turn, start, n, crc) of (id, text) rows in file order."""
    out, start, turns = [], 0, {}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        turns[i] = turns.get(i, -1) + 1
        out.append((i, turns[i], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["Ünïcode ÀÉ ß ſ İstanbul", "ΣΑΣ ΟΔΟΣ", "é ö ́x a ́b", "it's we'LL DON'T 'S", "<|startoftext|>a<|endoftext|> <|END|> <| |>", "a\x1fb\x1c c", "a b c \u0085d", "١٢٣ 4५6", "漢字 かな 한글", "👍👍🏽 ☃️", "  two  spaces \t\n", "x" * 300 + " " + "ab" * 2000, "ǅ Ǆ K Å", "²³ ½ Ⅷ"]


def test_encoder_equals_library(library, corpus):
    encoder = token_files.Encoder(vocabulary_path("word_bpe_49k.json"), cache_size=50)
    rng = random.Random(3)
    letters = "aábcÇ'sS<|>1½ \t\n\x1f ́éßſΣσİ漢👍ɏɐ."
    texts = [*ODD, *[x or "" for x in corpus], *["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3000)]]
    for x in texts:
        assert np.frombuffer(encoder.encode(x), encoder.dtype).tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)


def test_other_tokenizers_get_whole_texts(corpus):
    path = vocabulary_path("byte_bpe_50k.json")
    encoder, library = token_files.Encoder(path), Tokenizer.from_file(path)
    for x in corpus:
        assert np.frombuffer(encoder.encode(x or ""), encoder.dtype).tolist() == library.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    f = token_files.PerfectHash.build(h1, h2)
    assert f.n == n and sorted(f.places(h1, h2).tolist()) == list(range(n))
    slots = np.zeros(n, token_files.SLOT)
    slots["print"], slots["at"] = h2, np.arange(n)
    bucket = token_files.unpack_bucket(token_files.pack_bucket(h1, h2, slots))
    found, got = token_files.find(bucket, h1, h2)
    assert found.all() and got["at"].tolist() == list(range(n))
    assert not token_files.find(bucket, h1 + np.uint64(1), h2 ^ np.uint64(5))[0].any()


def test_equal_hashes_raise():
    h = np.array([7, 7], np.uint64)
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(h, h)


def test_query_equals_library(spark, make, corpus, library, tmp_path):
    texts = [*corpus, *ODD]
    ids = [7 * i - 90 for i in range(len(texts))]
    make(texts, ids).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.query(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == expected(library, list(zip(ids, texts, strict=True)))


def test_repeated_ids_and_small_shards(spark, library):
    """A third of the rows under one id, repeats, null ids; shards of a few ids, so that texts and ids go over many."""
    texts = [f"word{i % 7} and{i} more" for i in range(60)]
    ids = [5 if i % 3 == 0 else None if i % 10 == 1 else i for i in range(60)]
    rows = [*zip(ids, texts, strict=True), (5, texts[0]), (5, texts[0])]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, key string, range int, part int").repartition(7)
    files = token_files.write(docs, shard_bytes=64)
    got = files.read(files.keys(), token_files.crc32, token_files.T.LongType()).collect()
    assert len(got) == len(rows) and len({(r.key, r.turn) for r in got}) == len(rows)
    got.sort(key=lambda r: r.start)
    hashes = {t: h for t, h in docs.select("text", F.xxhash64("text")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    assert [(r.key, r.turn, r.start, r.n_tokens, r.value) for r in got] == expected(library, order)
    # any keys in any order; strangers get no row
    asked = spark.createDataFrame([(5, 3), (5, 999), (-4, 0), (None, 0), (2, 0)], "key long, turn long")
    assert {(r.key, r.turn) for r in files.ids(asked).collect()} == {(5, 3), (None, 0), (2, 0)}
    ids = files.ids(spark.createDataFrame([(2, 0)], "key long, turn long")).first().value
    assert ids == library.encode(texts[2], add_special_tokens=False).ids + [2]


def test_reopened_strings_and_empty(spark, library):
    docs = spark.createDataFrame([("b", "two"), ("a", None), ("c", "")], "name string, body string")
    root = tempfile.mkdtemp(prefix="spark-")
    token_files.write(docs, f"{root}/x", id_col="name", text_col="body", end_id=None)
    files = token_files.TokenFiles(spark, f"{root}/x")
    assert {r.key: r.value for r in files.ids(files.keys()).collect()} == {"a": [], "b": library.encode("two", add_special_tokens=False).ids, "c": []}
    files = token_files.write(docs.limit(0), id_col="name", text_col="body")
    assert files.ids(files.keys()).count() == 0 and files.ids(spark.createDataFrame([("a", 0)], "key string, turn long")).count() == 0
