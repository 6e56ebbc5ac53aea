import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import simhash, suffix_dedup


def removed(texts, ids, n):
    """Brute force: the bytes of each text that a smaller id's n-byte strings cover."""
    first = {}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: -10**9 if x[0] is None else x[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], -(10**9) if i is None else i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < (-(10**9) if i is None else i):
                gone[k : k + n] = [True] * n
        out.append((b, gone))
    return out


def check(df, texts, ids, n=50, **kw):
    got = suffix_dedup.remove_repeats(df, n, **kw).select("row.doc_id", "row.text", "spans", "kept").collect()
    want = sorted((repr(i), repr(t), bytes(x for x, g in zip(b, gone, strict=True) if not g)) for (b, gone), i, t in zip(removed(texts, ids, n), ids, texts, strict=True))
    assert sorted((repr(r.doc_id), repr(r.text), bytes(r.kept)) for r in got) == want
    for r in got:
        assert len((r.text or "").encode()) - sum(s.end - s.start for s in r.spans) == len(r.kept)


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 3000}, {"block_bytes": 2000, "hot_blocks": 1}])
def test_repeats_equal_brute_force(make, corpus, kw):
    check(make(corpus), corpus, list(range(len(corpus))), **kw)


@pytest.mark.parametrize("hot_blocks", [2, 256])
def test_repeats_of_a_hot_separator(make, vocabulary, hot_blocks):
    rng = random.Random(3)
    texts = []
    for n in range(30):
        words = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(4)]
        texts.append(f"\n{'-' * (30 + 3 * n)}\n".join(words))
    check(make(texts), texts, list(range(30)), block_bytes=1500, hot_blocks=hot_blocks)


def test_parts_of_a_long_text_lose_no_window(monkeypatch, vocabulary):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(vocabulary, k=900)).encode(), b"", b"-" * 70]
    found = lambda: [suffix_dedup.Windows(t, s, e, 50) for _, _, t, s, e in suffix_dedup._chunks(texts, 50)]
    names = lambda ws: np.unique(np.concatenate([w.strings() for w in ws]))
    whole = found()
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 300)
    parts = found()
    assert len(parts) > 10 and sum(int(w.inside.sum()) for w in parts) == sum(int(w.inside.sum()) for w in whole)
    assert set(names(parts)) <= set(names(whole))
    for some, known in ((whole, names(parts)), (parts, names(whole)), (parts, names(parts))):  # each window holds a string that both know
        assert all((w.holding(known) == w.inside).all() for w in some)


def test_repeats_with_odd_ids(make, corpus):
    texts = corpus[:6] + corpus[3:5] * 3 + corpus[-8:]
    ids = [None, 5, 5, 7, -3, 7, 2, 2, 2, 9, None, 4, 1, 1, 3, 8, 6, 10, 11, 12][: len(texts)]
    check(make(texts, ids), texts, ids, block_bytes=1500)


@pytest.mark.parametrize("n", [3, 8, 20])
def test_other_lengths(make, corpus, n):
    check(make(corpus[:12]), corpus[:12], list(range(12)), n)


def test_repeats_empty_and_extra_columns(make, spark, corpus):
    assert suffix_dedup.remove_repeats(make([])).count() == 0
    df = make(corpus[:3]).withColumns({"spans": F.lit(1), "kept": F.lit("k"), "block": F.lit(2), "row": F.lit(3)})
    assert suffix_dedup.remove_repeats(df).select("row.block", "row.kept").distinct().collect() == [(2, "k")]


def test_whole_characters(make):
    a, b = "é" * 60, "x" + "é" * 60
    out = {r.row.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(make([a, b]), whole_chars=True).collect()}
    assert out == {0: a, 1: "x"}


def test_group_starts_are_common_prefixes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 500).astype(np.uint8)
    for depth in (1, 4, 9):
        order = suffix_dedup.bounded_order(text, depth)
        flags = suffix_dedup.group_starts(text, order, depth)
        ring = [np.resize(np.roll(text, -i), depth).tobytes() for i in order]
        assert flags[1:].tolist() == [x != y for x, y in zip(ring, ring[1:], strict=False)]


def simple_fingerprint(text, n):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def least_reachable(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_equal_brute_force(make, corpus):
    got = {r.doc_id: r for r in simhash.near_duplicates(make(corpus)).collect()}
    codes = [simple_fingerprint(t, 4) for t in corpus]
    assert [got[i].code % 2**64 for i in range(len(corpus))] == codes
    assert [got[i].component_id for i in range(len(corpus))] == least_reachable(len(codes), lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 4)


@pytest.mark.parametrize("n", [2, 40, 700])
def test_index_equals_brute_force(spark, n):
    rng = random.Random(n)
    codes = [rng.getrandbits(64) for _ in range(n // 2)]
    codes = list(dict.fromkeys(codes + [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) for c in codes]))
    df = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)], "doc_id long, code long")
    got = dict(simhash.grouped(df, 4).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(codes))] == least_reachable(len(codes), lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 4)


def test_every_choice_of_blocks_is_complete():
    for n in (10, 10**8, 10**12):
        masks = simhash.block_choices(n, 4)
        rng = random.Random(0)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(m & x == 0 for m in masks)


def test_simhash_nulls_and_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0
    out = simhash.near_duplicates(make([None, "", "a b c"], [4, None, None])).collect()
    assert sorted((r.code, r.component_id) for r in out if r.code == 0) == [(0, 4), (0, 4)]


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(make, vocabulary):
    rng = random.Random(5)
    base = [rng.choices(vocabulary, k=120) for _ in range(25)]
    texts = [" ".join(w) for w in base]
    for w in base[:12]:
        c = list(w)
        c[60] = "altered"
        texts.append(" ".join(c))
    texts += [texts[0].upper(), None, "", " "]
    s = [shingles(t) for t in texts]
    alike = lambda i, j: (len(s[i] & s[j]) / len(s[i] | s[j]) if s[i] | s[j] else 1) >= 0.8
    got = dict(simhash.near_copies(make(texts)).select("id", "component_id").collect())
    want = least_reachable(len(texts), alike)
    assert [got[i] for i in range(len(texts))] == want
    kept = simhash.one_of_each(make(texts + texts[:2], [*range(len(texts)), 0, 1]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.one_of_each(make([])).count() == 0


def test_near_copies_that_repeat_a_line(make, vocabulary):
    rng = random.Random(8)
    texts = []
    for times in (20, 60, 120, 200):
        for _ in range(4):
            words = rng.choices(vocabulary, k=400)
            line = words[200:212]
            texts += [" ".join(words), " ".join(words[:212] + line * times + words[212:])]
    s = [shingles(t) for t in texts]
    want = least_reachable(len(texts), lambda i, j: len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8)
    assert len(set(want)) == 16
    got = dict(simhash.near_copies(make(texts)).select("id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == want


def test_near_copies_around_the_threshold(make, vocabulary):
    rng = random.Random(9)
    texts = []
    for edits in range(2, 11):  # similarity 0.9 to 0.6
        for _ in range(12):
            words = rng.choices(vocabulary, k=200)
            other = list(words)
            for at in rng.sample(range(10, 190, 6), edits):
                other[at] = "altered"
            texts += [" ".join(words), " ".join(other)]
    s = [shingles(t) for t in texts]
    alike = [len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.8 <= x < 0.85 for x in alike) > 10 and sum(0.75 < x < 0.8 for x in alike) > 10
    got = dict(simhash.near_copies(make(texts)).select("id", "component_id").collect())
    want = least_reachable(len(texts), lambda i, j: len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("most", [4, 2048])
def test_near_copies_by_the_index(monkeypatch, make, vocabulary, most):
    """Where no band brings two texts together, the SimHash index still finds every near copy within its bits, and none that isn't alike."""
    real = simhash.signature
    monkeypatch.setattr(simhash, "signature", lambda hashes: (real(hashes)[0], np.frombuffer(random.randbytes(8 * simhash.BANDS), np.uint64)))
    rng = random.Random(14)
    texts = []
    for _ in range(30):
        words = rng.choices(vocabulary, k=250)
        texts.append(" ".join(words))
        for edits in (1, 2, 8, 14):
            other = list(words)
            for at in rng.sample(range(10, 240, 6), edits):
                other[at] = f"altered{len(texts)}"
            texts.append(" ".join(other))
    s = [shingles(t) for t in texts]
    codes = [simhash.fingerprint(np.unique(simhash.shingle_hashes(t.encode(), simhash.WORDS))) for t in texts]
    alike = lambda i, j: len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8
    near = lambda i, j: (codes[i] ^ codes[j]).bit_count() <= simhash.MAX_BITS
    family = least_reachable(len(texts), near)
    want = least_reachable(len(texts), lambda i, j: family[i] == family[j] and alike(i, j))
    assert len(set(want)) < len(texts) - 20
    got = dict(simhash.near_copies(make(texts), most=most).select("id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == want


def test_near_copies_without_or_with_shared_ids(make, vocabulary):
    rng = random.Random(10)
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(6)]
    kept = simhash.one_of_each(make(texts + texts[:2], [None, None, 7, 7, 7, 3, None, 5])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == sorted([(True, 0, texts[0]), (False, 5, texts[1]), *[(False, 7, t) for t in texts[2:5]], (False, 3, texts[5])])


@pytest.mark.parametrize("most", [2, 5])
def test_hot_groups_in_blocks(spark, make, vocabulary, most):
    rng = random.Random(12)
    codes = [0]
    for _ in range(60):
        codes.append(codes[rng.randrange(len(codes))] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3, 7))))
    codes = list(dict.fromkeys(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"), 4, most).collect()
    at = {c: i for i, c in enumerate(signed)}
    pairs = {frozenset((at[r.a], at[r.b])) for r in links}
    near = lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 4
    assert least_reachable(len(codes), lambda i, j: {i, j} in pairs) == least_reachable(len(codes), near)

    words = rng.choices(vocabulary, k=150)
    texts = []
    for edits in [1] * 12 + [4] * 12 + [6] * 12:  # one family: near each other, at the threshold, beyond
        other = list(words)
        for at_ in rng.sample(range(8, 140, 6), edits):
            other[at_] = f"altered{len(texts)}"
        texts.append(" ".join(other))
    s = [shingles(t) for t in texts]
    want = least_reachable(len(texts), lambda i, j: len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8)
    got = dict(simhash.near_copies(make(texts), most=most).select("id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == want


def test_roots_equal_brute_force_without_pairs():
    rng = np.random.default_rng(4)
    codes = np.unique(np.uint64(1 << 40) ^ np.bitwise_or(np.uint64(1) << rng.integers(0, 12, 300, np.uint64), np.uint64(1) << rng.integers(0, 12, 300, np.uint64)))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    got = simhash.local_roots(codes, np.zeros(len(codes), np.int64), 1, step=7)
    assert got.tolist() == least_reachable(len(codes), lambda i, j: int(codes[i] ^ codes[j]).bit_count() <= 1)


def test_query_hash_form(spark, sf):
    r = suffix_dedup.query(spark, sf).where("n_removed = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
