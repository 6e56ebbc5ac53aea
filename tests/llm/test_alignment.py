"""Alignments against plain loops over bytes and tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tilewright.llm import alignment as al


@pytest.fixture(scope="module")
def sides():
    a, b = al._paths(None, None)
    return al.ByteLevel(a), al.Pieces(b)


def tokens(text, sides):
    """Plain tokens of both sides as (id, begin, end), or None."""
    if not text:
        return None
    a, b = sides
    raw, out = b" " + text.encode(), []
    for ids, table in ((a.library.encode(" " + text, add_special_tokens=False).ids, a.bytes), (b.library.encode(text), b.bytes)):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != raw:
            return None
        out.append(side)
    return out


def plain(texts, sides):
    """Contract columns of each text."""
    found, counts = [], Counter()
    for text in texts:
        t = tokens(text, sides)
        if t is None:
            found.append(None)
            continue
        ends_b = {e: i for i, _, e in t[1]}
        pairs = [(i, ends_b[e]) for i, _, e in t[0] if e in ends_b]
        counts.update(pairs)
        cuts = sorted({e for _, _, e in t[0]} & set(ends_b))
        groups = [";".join("|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in t) for lo, hi in zip([0, *cuts], cuts, strict=False))]
        found.append((len(t[0]), len(t[1]), len(cuts), pairs, hashlib.sha256(groups[0].encode()).hexdigest()))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(x[0], x[1], x[2], len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) if x else (0,) * 6 + ("",) for x in found]


ODD = ["x ", " x", " ", "  ", "a  b   c  ", "a\n b", "a\n  b \t c", "tab\there", "\n", "a\x1f b\x1c  c", "▁a ▁▁ b", "a▁b", "<|endoftext|> <s> </s> <0x41> <unk>", "é̂ 漢字 👍🏽 ﷽", "\x00a \x00", "word" * 400, "1234 56 7", "it's we'll\r\n ok;\r", "    indented\n    code  {\r\n}", "﻿bom   nbsp   x", "a ▁"]


def test_products():
    rng = np.random.default_rng(0)
    x, y = (rng.random((7, 9)) < 0.4).astype(int), (rng.random((5, 9)) < 0.4).astype(int)
    sparse = lambda m: al.CSR(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m[np.nonzero(m)], m.shape[1])
    z = sparse(x).times(sparse(y).transposed())
    dense = np.zeros((7, 5), int)
    dense[z.rows, z.indices] = z.data
    assert (dense == x @ y.T).all() and (z.data > 0).all()
    empty = al.CSR.spans(np.zeros(0, np.int64))
    assert len(empty.times(al.CSR.spans(np.array([2, 1])).transposed()).data) == 0


def test_stretches_equal_whole_texts(sides, corpus):
    """Cutting at spaces changes no token on either side."""
    rng = random.Random(2)
    letters = "aáb'sS<|>1½ \t\n\x1f ▁éß漢👍.,;{}\r  "
    texts = [*ODD, *[x for x in corpus if x], *["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(3000)]]
    for text in texts:
        t, parts = tokens(text, sides), al.stretches(text)
        assert "".join(" " + p for p in parts) == " " + text
        alone = [p for p in parts if not p or p[-1].isspace() or "▁" in p]
        if not alone:
            x, y = al.Aligned(parts, *sides, len(parts)), al.Aligned(parts, *sides)
            assert x.a.tolist() == y.a.tolist() and x.n_a.tolist() == y.n_a.tolist() and x.b.tolist() == y.b.tolist() and x.n_b.tolist() == y.n_b.tolist()
        x = al.Aligned(parts, *sides)
        assert x.good.all() == (t is not None), repr(text)
        if t:
            assert x.a.tolist() == [i for i, _, _ in t[0]] and x.b.tolist() == [i for i, _, _ in t[1]], repr(text)
            assert x.end_a.tolist() == [e for _, _, e in t[0]] and x.end_b.tolist() == [e for _, _, e in t[1]]


def test_query(spark, make, corpus, sides, tmp_path):
    texts = [*ODD, *corpus, "x " * 3000, corpus[0], corpus[0]]
    ids = [5 * i - 60 for i in range(len(texts))]
    make(texts, ids).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in al.query(spark, str(tmp_path)).collect()}
    assert got == dict(zip(ids, plain(texts, sides), strict=True))


def test_forgetting_and_odd_rows(spark, make, corpus, sides):
    docs = make(corpus, [None if i % 3 == 0 else 7 for i in range(len(corpus))]).selectExpr("*", "1 AS n_a", "2 AS pairs", "text AS id")
    key = lambda r: tuple(r)
    got = sorted((key(r) for r in al.digest(docs, kept=50).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    assert got == sorted(plain(corpus, sides))
    assert al.digest(docs.limit(0)).count() == 0
    assert al.digest(make([None, "", "▁"])).agg({"n_a": "sum", "count_sum": "sum"}).first()[0] == 0


def test_links(spark, make, sides):
    texts = ["An extraordinary misunderstanding, unquestionably 12345.", None, "", "▁", "naïve façade\n  x"]
    for r, text in zip(al.links(make(texts).coalesce(1)).orderBy("doc_id").collect(), texts, strict=True):
        t = tokens(text, sides)
        if t is None:
            assert r.a_ids == r.b_ids == r.groups == r.overlap == r.shared == r.ended == []
            continue
        a, b = t
        assert r.a_ids == [x[0] for x in a] and r.b_ids == [x[0] for x in b]
        shares = lambda x, y: min(x[2], y[2]) - max(x[1], y[1])
        assert [tuple(p) for p in r.overlap] == [(i, j, shares(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if shares(x, y) > 0]
        assert [tuple(p) for p in r.ended] == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[2] == y[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        of = lambda x: sum(c < x[2] for c in cuts)
        assert [tuple(p) for p in r.shared] == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if of(x) == of(y)]
        assert [(g.a, g.b) for g in r.groups] == [([x[0] for x in a if of(x) == k], [y[0] for y in b if of(y) == k]) for k in range(len(cuts))]


def test_pairs_are_all_that_can_be(sides):
    a, b = al.suffix_pairs([b"ab", b"b", b"c"], [b"b", b"xb", b"b", b"ab"])
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3)]
    a, b = al.suffix_pairs(sides[0].bytes, sides[1].bytes)
    assert len(a) < 1_000_000 and (np.diff(a << 32 | b) > 0).all()
    print(len(a))
