"""Every opN query over a small table, all contract columns against a plain version."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
import xxhash

from tilewright.llm import byte_bpe, language_id, mpeg_audio, multiset_hash, sharding, simhash, token_counts, toxicity


@pytest.fixture(scope="module")
def texts(corpus):
    return [*corpus, "A" * 3000 + "TAG" + "b" * 125, "x" * 700 + "TAG" + "y" * 61]


@pytest.fixture(scope="module")
def table(spark, make, texts, tmp_path_factory):
    """A folder with ``documents`` and ``labels``."""
    sf = tmp_path_factory.mktemp("tables")
    ids = [3 * i - 40 for i in range(len(texts))]
    make(texts, ids).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0, int(k % 9 == 0)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return str(sf), dict(zip(ids, texts, strict=True))


def rows(spark, query, sf):
    got = query(spark, sf).collect()
    out = {r.doc_id: r for r in got}
    assert len(out) == len(got)
    return out


def raw(t):
    return (t or "").encode()


def least_reachable(ids, codes):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_op2(spark, table):
    sf, docs = table
    got = rows(spark, simhash.query, sf)
    codes = {}
    for i, t in docs.items():
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in raw(t)).split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        codes[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = least_reachable(list(docs), codes)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{codes[i]:016x}", least[i]) for i in docs}


def test_op3(spark, table):
    sf, docs = table
    got = rows(spark, toxicity.query, sf)
    weights, bias = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for i, t in docs.items():
        r = got[i]
        words = set(toxicity._WORD.findall((t or "").lower()))
        features = {f for w in words for f in toxicity.word_features(w)}
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights.get(f, 0.0) for f in features)))))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.score == pytest.approx(score) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_risk_equals_dense_matrices():
    rng = np.random.default_rng(1)
    dense = rng.random((7, 5)) < 0.4
    own = toxicity._Rows([np.flatnonzero(r) for r in dense], 5)
    w, g = rng.normal(size=6), rng.normal(size=7)
    x = np.hstack([dense, np.ones((7, 1))])
    assert np.allclose(own.scores(w), x @ w) and np.allclose(own.gradient(g), x.T @ g / 7)


def test_op4(spark, table):
    from tokenizers import Tokenizer

    sf, docs = table
    got = rows(spark, token_counts.query, sf)
    library = Tokenizer.from_file(token_counts.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    for i, t in docs.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(raw(t)), n, n > 512)


def fingerprint(t):
    """The lanes of a text by whole numbers: strong sums of lines, bit counts of phrases, the number of phrases."""
    import regex

    h = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    lines = [p for p in (t or "").split("\n") if p]
    strong = [sum(h(p.encode(), h(struct.pack("<i", k))) & 0xFFFFFFFF for p in lines) & 0xFFFFFFFF for k in range(multiset_hash.STRONG)]
    phrases = [h(p.encode()) for p in regex.split(r"(?<=[en.,;:!?])[ \t]+|\n+", t or "") if p]
    counts = [sum(x >> (k + 32 * half) & 1 for x in phrases) for k in range(multiset_hash.WORDS) for half in (0, 1)]
    return strong, counts, len(phrases)


def cosine(a, b):
    if a == b:
        return 1.0
    u, v = ([2 * c - f[2] for c in f[1]] for f in (a, b))
    norm = math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(u, v, strict=True)) / norm)) if norm else 0.0


def test_op5(spark, table):
    sf, docs = table
    got = rows(spark, multiset_hash.query, sf)
    order = sorted(docs)
    for k, i in enumerate(order):
        own, other = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + other[:cut]
        r, f = got[i], [fingerprint(x) for x in (own, edited, other)]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        for text, (strong, counts, n) in ((r.fingerprint, f[0]), (r.edited_fingerprint, f[1])):
            longs = [counts[2 * w] | counts[2 * w + 1] << 32 for w in range(multiset_hash.WORDS)]
            assert text == "".join(f"{x:016x}" for x in [*strong, *longs, n])
        assert r.near_edited == pytest.approx(cosine(f[0], f[1])) and r.near_next == pytest.approx(cosine(f[0], f[2]))


def test_op7(spark, table):
    sf, docs = table
    got = rows(spark, language_id.query, sf)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    net = language_id.train(d)
    for i, t in docs.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    two = language_id.ByteCnn(["a", "b"])
    text = b"some bytes to look at, and then a few more" * 9
    windows = language_id.cut(text)
    for row, window in zip(two.logits(windows), windows, strict=True):  # filter by filter
        top = np.full(two.conv.shape[1], -np.inf)
        for at in range(language_id.WINDOW - max(language_id.WIDTHS) + 1):
            patch = np.concatenate([two.emb[window[at + j]] for j in range(max(language_id.WIDTHS))])
            top = np.maximum(top, [float(patch @ two.conv[:, f]) for f in range(two.conv.shape[1])])
        assert np.allclose(np.maximum(top + two.bias, 0) @ two.out + two.base, row, atol=1e-4)
    assert net.langs == ["en"]


def test_op8(spark, table):
    import public_tokenizers
    import tiktoken

    sf, docs = table
    got = rows(spark, byte_bpe.query, sf)
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(), special_tokens={})
    for i, t in docs.items():
        ids = library.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw(t)).hexdigest())


def test_long_words(spark, make):
    import random

    import public_tokenizers
    import tiktoken
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = ["a" * 100_000, "ab" * 50_000, "-=" * 20_000, "-" * 65, "".join(rng.choice("abcdefABCDEF012+/") for _ in range(1500)), "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(300))]
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(), special_tokens={})
    df, _ = byte_bpe.encode(make(texts), words=16)
    got = {r.doc_id: r.ids for r in df.select("doc_id", F.col("ids")).collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]


def walk(stream):
    """Frames of a stream without breaks, by the fields of their headers: offsets and main data."""
    at = 10 + (stream[6] << 21 | stream[7] << 14 | stream[8] << 7 | stream[9])
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    out = []
    while at < len(stream):
        assert stream[at : at + 2] == b"\xff\xfa" and stream[at + 3] >> 6 == 3  # MPEG-1 Layer III with a checksum, mono
        hz = (44100, 48000, 32000)[stream[at + 2] >> 2 & 3]
        size = 144 * kbps[stream[at + 2] >> 4] * 1000 // hz
        out.append((at, stream[at + 23 : at + size]))
        at += size
    assert at == len(stream)
    return out


def test_op9(spark, table):
    sf, docs = table
    got = rows(spark, mpeg_audio.query, sf)
    for i, t in docs.items():
        b = raw(t)
        payload = b + bytes(64 if not b else -len(b) % 64)
        stream = mpeg_audio.mux(payload)
        frames = walk(stream)
        assert frames[0][1][:4] == b"Xing" and b"".join(x for _, x in frames[1:])[: len(payload)] == payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest())
        parts = dict(x.split("=") for x in r.feature.split(";"))
        assert parts["frames"] == str(len(frames) - 1) and parts["duration"] == f"{1152 * (len(frames) - 1)}/48000" and parts["crc_bad"] == "0"
        assert parts["seek"] == f"{frames[1][0]}..{frames[-1][0]}"


def test_audio_of_other_kinds():
    def stream(head, size, body=b"", n=3):
        """Frames with a right checksum."""
        out = b""
        for _ in range(n):
            frame = bytes(head) + b"\0\0" + body.ljust(size - 6, b"\0")
            covered = mpeg_audio.protected_bits(4 - (head[1] >> 1 & 3), frame, 17 if head[1] >> 1 & 3 == 1 else 0)
            out += frame[:4] + struct.pack(">H", mpeg_audio.crc16(frame[2:4], covered)) + frame[6:]
        return out

    one = stream([0xFF, 0xFE, 0x14, 0xC0], 4 * (12 * 32000 // 48000), b"\x12\x34" * 8)
    two = stream([0xFF, 0xFC, 0x14, 0xC0], 144 * 32000 // 48000, b"\x43\x21" * 8)
    for data in (one, two):
        p = mpeg_audio.parse(data)
        assert (p["frames"], p["bad_crc"], p["skipped"]) == (3, 0, 0)
        bad = mpeg_audio.parse(data[:6] + bytes([data[6] ^ 0x10]) + data[7:])
        assert bad["bad_crc"] == 1
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 999, 42, 2, 1, 2, 1) + struct.pack(">HH", 7, 8)
    first = bytes([0xFF, 0xFB, 0x94, 0x40]).ljust(36, b"\0") + vbri
    p = mpeg_audio.parse(first.ljust(144 * 128000 // 48000, b"\0") * 1 + bytes([0xFF, 0xFB, 0x94, 0x40]).ljust(384, b"\0") + b"TAG".ljust(128, b"\0"))
    assert (p["frames"], p["table"]["frames"], p["table"]["bytes"], p["table"]["toc"], p["skipped"]) == (1, 42, 999, [7, 8], 0)


def test_foreign_bytes_never_raise():
    rng = np.random.default_rng(9)
    good = mpeg_audio.mux(b"some payload" * 50)
    for k in range(400):
        cut = bytearray(good[int(rng.integers(0, 60)) : int(rng.integers(60, len(good)))])
        for _ in range(8):
            cut[int(rng.integers(len(cut)))] = int(rng.integers(256))
        mpeg_audio.parse(bytes(cut))
        mpeg_audio.parse(rng.integers(0, 256, 90).astype(np.uint8).tobytes())
    tag = b"\0payload_bytes\0-9"
    head = b"ID3\x03\0\0\0\0\0" + bytes([10 + len(tag)]) + b"TXXX" + struct.pack(">I", len(tag)) + b"\0\0" + tag
    assert mpeg_audio.parse(head + good)["frames"] >= 1
    assert mpeg_audio.parse(bytes([0xFF, 0xF3, 0x14, 0xC0]) + bytes(9) + b"Xing" + b"\0" * 7)["frames"] in (0, 1)


def test_op10(spark, table):
    sf, docs = table
    got = rows(spark, sharding.query, sf)
    assert {(r.law, r.grown_shard) for r in got.values()} == {("rows", None)}
    for i, t in docs.items():
        assert (got[i].size, got[i].text_crc32) == (len(raw(t)) + 1, zlib.crc32(raw(t)))
    by = [sorted(r.slot for r in got.values() if r.shard == k) for k in range(16)]
    assert all(s == list(range(len(s))) for s in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert got == rows(spark, sharding.query, sf)


def test_shards_in_many_ranges(spark):
    docs = spark.range(900).selectExpr("id doc_id", "repeat('x', cast(id % 7 as int)) text")
    out = sharding.shard(docs, shards=5, rows_per_task=20)
    per = out.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert sorted(r["count(1)"] for r in per) == [180] * 5 and all(r["max(slot)"] == 179 for r in per)
    assert out.select("shard", "slot").distinct().count() == 900
    matrix = sharding.communication_matrix([400, 300, 200], 5)
    assert [sum(r) for r in matrix] == [400, 300, 200] and [sum(c) for c in zip(*matrix, strict=True)] == [180] * 5


def test_pipeline_runs(spark, table):
    import corpus_pipeline

    sf, docs = table
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r.n_tokens == len(r.ids) for r in out) and {r.doc_id for r in out} <= set(docs)
    assert max(sum(r.doc_id == i for r in out) for i in docs) <= 3
