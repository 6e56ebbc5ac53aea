import hashlib
import json
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import byte_bpe, language_id, mixing, mpeg_audio, multiset_hash, sharding, simhash, token_counts, toxicity


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_token_counts(make, corpus):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [*corpus, "a<|endoftext|>b  <|endoftext|>", "  x\x1cy\x85z　w \n\n  q", "it's I'LL 12٣ ½ 👍🏽"]
    out = token_counts.count_tokens(make(odd).withColumn("n_tokens", F.lit("x")), table_size=5, cache_size=20).collect()
    assert {r.row.doc_id: r.n_tokens for r in out} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(odd)}
    assert token_counts.count_tokens(make([])).count() == 0


@pytest.mark.parametrize("words", [0, 3, 1000])
def test_bpe_round_trip(make, corpus, words):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(), special_tokens={})
    texts = [t for t in corpus if t is None or len(t) < 2000] + ["it's  I'LL 12٣ ½ 👍🏽\x85 　 \n\n q", "aaaaaaaaaaaaaaaaaaaaaaaaa"]
    encoded, e = byte_bpe.encode(make(texts).withColumn("ids", F.lit("clash")), words=words or 1)
    out = by_id(encoded.select("doc_id", "ids", e.packed(F.col("ids")).alias("packed"), e.decode(F.col("ids")).alias("back")).collect())
    for i, t in enumerate(texts):
        want = own.encode_ordinary(t or "")
        assert list(out[i].ids) == want
        assert bytes(out[i].packed) == struct.pack(f"<{len(want)}I", *want) and bytes(out[i].back).decode() == (t or "")


def test_bpe_of_an_empty_table(make):
    assert byte_bpe.encode(make([]))[0].count() == 0


@pytest.mark.parametrize("more", [1, 40, 4000])
def test_bpe_words_beyond_the_literal_are_folded_once(make, corpus, more):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(), special_tokens={})
    texts = [t for t in corpus if t is None or len(t) < 2000] + ["\x01\x02!\x01 \x01\x01,[]\"\\ " * 3, " 12,3 \x7f\x80 été 👍🏽" * 3]
    encoded, e = byte_bpe.encode(make(texts), words=5, more=more)
    assert {r.doc_id: r.ids for r in encoded.select("doc_id", "ids").collect()} == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
    known = e.dictionary(make(texts), words=5, more=more)
    lists = [r.entries for r in known.lists.collect()] if known.lists else []
    found = {x.split("\x02")[0]: [int(i) for i in x.split("\x02")[1].split(",")] for entries in lists for x in entries.split("\x01") if x}
    assert len(found) <= more + 5 and all(own.encode_ordinary(w) == ids for w, ids in found.items())
    assert more < 4000 or len(found) > 300 and "été" not in found and " été" in found
    # the plan's text is that of the literals, however many words the lists have; no row carries the lists
    assert len(known.maps) < 3 * byte_bpe.WORD_MAPS + 1000
    spark = encoded.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 30)
    plan = encoded.select("doc_id", "ids")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", byte_bpe.PLAN_TEXT)
    assert f" AS {byte_bpe.LISTS}" not in plan and ("Subquery" in plan) == bool(lists)


def test_multiset_likeness_of_long_repeats(spark):
    line = "one line of boilerplate\n"
    for times, other in ((10_000, 7_500), (20_000, 15_000)):
        rows = spark.createDataFrame([(line * times, line * other + "another line\n" * 5)], "a string, b string")
        sums = rows.select(multiset_hash.lanes(F.col("a")).alias("a"), multiset_hash.lanes(F.col("b")).alias("b")).persist()
        r = sums.select(multiset_hash.likeness(F.col("a"), F.col("b")).alias("near")).first()
        assert r.near > 0.99


def test_multiset_is_a_homomorphism(spark):
    a, b = "the red fox.\nran on\n\nand on", "another line, here\nran on"
    m = spark.range(1).select(*[multiset_hash.lanes(F.lit(t)).alias(n) for n, t in (("a", a), ("b", b), ("ab", a + "\n" + b), ("ba", b + "\n" + a))])
    r = m.select(
        (F.col("ab") == F.col("ba")).alias("order"), (multiset_hash.plus(F.col("a"), F.col("b")) == F.col("ab")).alias("plus"), (multiset_hash.minus(F.col("ab"), F.col("b")) == F.col("a")).alias("minus"), (F.col("a") == F.col("b")).alias("equal"),
        multiset_hash.likeness(F.col("a"), F.col("a")).alias("self"),
    ).first()
    assert tuple(r) == (True, True, True, False, 1.0)


def test_minus_wraps(spark):
    r = spark.range(1).select(multiset_hash.lanes(F.lit("one. two. three. four")).alias("a"), multiset_hash.lanes(F.lit("")).alias("z"))
    r = r.select((multiset_hash.plus(multiset_hash.minus(F.col("z"), F.col("a")), F.col("a")) == F.col("z")).alias("ok")).first()
    assert r.ok


def test_many_phrases(spark):
    text = "one, two, three, " * 12_000
    r = spark.range(1).select(multiset_hash.lanes(F.lit(text)).alias("a"), multiset_hash.lanes(F.lit(text + "four, ")).alias("b"))
    r = r.select((multiset_hash.minus(F.col("b"), F.col("a"))).alias("d"), multiset_hash.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert all(x >= 0 for x in r.d) and r.near > 0.99


def test_edited_texts(make, corpus):
    out = by_id(multiset_hash.fingerprints(make(corpus)).collect())
    for i, t in enumerate(corpus):
        t, nxt = t or "", corpus[(i + 1) % len(corpus)] or ""
        q = len(t) // 4
        assert out[i].edited == t[: len(t) - q] + nxt[:q] and out[i].n_chars == len(t)
    by_text = {}
    for i, t in enumerate(corpus):
        assert by_text.setdefault(t or "", list(out[i].lanes)) == list(out[i].lanes)


def test_edited_texts_with_odd_ids(make):
    rows = [(None, "null id here"), (3, "three three"), (3, "three three"), (3, "other three"), (9, None)]
    out = multiset_hash.fingerprints(make([t for _, t in rows], [i for i, _ in rows])).collect()
    assert len(out) == 5 and len({r.edited for r in out if r.doc_id == 3 and r.n_chars == 11}) <= 2
    assert multiset_hash.fingerprints(make([])).count() == 0
    one = multiset_hash.fingerprints(make(["abcdefgh"])).first()
    assert one.edited == "abcdefab"


def simple_mix(rows):
    """Sizes and repeats of the mix, by sorting all entries in one list."""
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, list(sources)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * total[s]]
        if not full:
            target |= share
            break
        target |= {s: 3 * total[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    entries = []
    for s in sources:
        queue, upto = sorted((i for i, _, x in rows if x == s), key=lambda i: (hashlib.md5(f"mix-1{i}".encode()).hexdigest(), i)), 0
        for epoch in range(3):
            for i in queue:
                upto += size[i]
                if size[i]:
                    entries.append((upto / target[s], s is None, s or "", epoch, upto, i))
    spent, times = 0, Counter()
    for *_, i in sorted(entries):
        spent += size[i]
        if spent > sum(total.values()):
            break
        times[i] += 1
    return {i: (size[i], total[s], target[s], size[i] * times[i]) for i, _, s in rows}


@pytest.mark.parametrize("names", [["a", "b", None], ["only"], ["a", "b", "c", "d", "hot", "hot", "hot", "hot"]])
def test_mix_equals_one_sorted_list(make, corpus, names):
    source = [names[i % len(names)] for i in range(len(corpus))]
    out = by_id(mixing.mix(make(corpus, source=source)).collect())
    want = simple_mix([(i, t, s) for i, (t, s) in enumerate(zip(corpus, source, strict=True))])
    for i, (size, total, target, taken) in want.items():
        assert (out[i]["size"], out[i].source_size, out[i].taken) == (size, total, taken) and out[i].target == pytest.approx(target)
        assert out[i].taken <= 3 * out[i]["size"]


@pytest.mark.parametrize("bins", [2, 7, 1 << 14])
def test_mix_cut_in_rounds(make, corpus, monkeypatch, bins):
    """Histograms of few bins, down to one entry a bin, cut where one sorted list is cut."""
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    source = [("a", "b", None)[i % 3] for i in range(len(corpus))]
    out = by_id(mixing.mix(make(corpus, source=source)).collect())
    want = simple_mix([(i, t, s) for i, (t, s) in enumerate(zip(corpus, source, strict=True))])
    assert {i: out[i].taken for i in want} == {i: w[3] for i, w in want.items()}


@pytest.mark.parametrize("hot", [None, 17])
def test_mix_of_a_hot_id(make, monkeypatch, hot):
    """A third of all rows under one id, or without one, are dealt over ranges of their own; every source comes to its target."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    texts = ["w " * (1 + i % 9) for i in range(600)]
    ids = [hot if i % 3 == 0 else 1000 + i for i in range(600)]
    df = make(texts, ids=ids, source=["ab"[i % 5 == 0] for i in range(600)])
    key = F.md5(F.concat(F.lit("mix-1"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    sizes = df.select("source", key.alias("key"), F.length("text").alias("size"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ranges = mixing._ranges(sizes, 600).groupBy("source", "range").count().agg(F.max("count")).first()[0]
    assert ranges <= 60  # 200 rows under the id
    out = mixing.mix(df).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in out) == sorted((i or -1, len(t.split())) for i, t in zip(ids, texts, strict=True))
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9 and all(r.times <= 3 for r in own)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, out))


@pytest.mark.parametrize("name", ["size", "key", "shard", "code"])
def test_id_columns_with_names_of_the_operators(make, corpus, name):
    df = make(corpus)
    named = df.withColumnRenamed("doc_id", name)
    for plain, other in (
        (mixing.mix(df), mixing.mix(named, id_col=name)),
        (sharding.shard(df), sharding.shard(named, id_col=name)),
        (simhash.near_duplicates(df), simhash.near_duplicates(named, id_col=name)),
    ):
        assert sorted(map(repr, map(tuple, plain.collect()))) == sorted(map(repr, map(tuple, other.collect())))
        assert other.columns[plain.columns.index("doc_id")] == name and len(set(other.columns)) == len(other.columns)


def test_mix_of_nothing(make):
    assert mixing.mix(make([])).count() == 0
    assert [r.taken for r in mixing.mix(make([None, ""])).collect()] == [0, 0]


def test_matrix_has_exact_sums():
    m = sharding.communication_matrix([100, 0, 37, 5000, 3], 16)
    assert [sum(r) for r in m] == [100, 0, 37, 5000, 3]
    cols = [sum(r[k] for r in m) for k in range(16)]
    assert max(cols) - min(cols) <= 1


def test_hypergeometric_moments():
    import random

    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 300, 700, 100) for _ in range(4000)]
    mean = sum(draws) / len(draws)
    var = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - 30) < 0.3 and abs(var - 100 * 0.3 * 0.7 * 900 / 999) < 1.5
    assert sharding.hypergeometric(rng, 10**10, 10**10, 10**9) == pytest.approx(5 * 10**8, rel=1e-3)


@pytest.mark.parametrize("rows_per_task", [7, 20_000])
def test_shards(make, corpus, rows_per_task):
    texts = corpus * 5
    df = make(texts)
    out = sharding.shard(df, rows_per_task=rows_per_task).collect()
    again = sharding.shard(df.repartition(3), rows_per_task=rows_per_task).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == k) == list(range(n))
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(b) + 1, zlib.crc32(b))


def test_shards_of_odd_tables(make):
    assert sharding.shard(make([])).count() == 0
    assert sharding.shard(make(["a", "a", None], [None, None, 3])).count() == 3


@pytest.mark.parametrize("payload", [b"", b"a", bytes(64), bytes(range(256)) * 9, b"\xff\xfb\x90\x00" * 700])
def test_audio_round_trip(payload):
    media = mpeg_audio.mux(payload)
    p = mpeg_audio.parse(media)
    assert p["payload"] == payload and p["bad_crc"] == 0 and p["skipped"] == 0
    assert p["table"]["frames"] == p["frames"] and p["samples"] == 1152 * p["frames"]
    assert all(media[o] == 0xFF for o in p["offsets"])


def test_audio_resynchronises_and_checks():
    media = mpeg_audio.mux(b"some words " * 400)
    p = mpeg_audio.parse(media)
    assert mpeg_audio.parse(b"junk \xff\xe0 junk" + media[p["offsets"][0] :])["frames"] == p["frames"]
    broken = bytearray(media)
    broken[p["offsets"][1] + 10] ^= 1
    assert mpeg_audio.parse(bytes(broken))["bad_crc"] == 1
    assert mpeg_audio.parse(b"")["frames"] == 0 and mpeg_audio.parse(None)["frames"] == 0 and mpeg_audio.parse(b"nothing here")["frames"] == 0


def test_audio_headers():
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0])) == (3, 44100, 1152, 417, False, 32, 128)
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0xF0, 0])) is None and mpeg_audio.header(b"\xff\xfb") is None


def test_audio_columns(make, corpus):
    df = make(corpus).withColumn("payload", F.col("text").cast("binary")).withColumn("media", F.lit(1))
    stored = mpeg_audio.store_media(df)
    back = mpeg_audio.read_media(stored.select("row.doc_id", "media")).collect()
    assert {r.row.doc_id: bytes(r.audio.payload).decode() for r in back} == {i: t or "" for i, t in enumerate(corpus)}
    assert mpeg_audio.store_media(df.limit(0)).count() == 0


def test_languages(spark, make):
    en, de = "the small house and the tree with that thing " * 3, "das kleine Häuschen und der Baum mit dem Ding über " * 3
    texts = [(en if i % 2 else de)[i % 20 :] + str(i) for i in range(120)]
    df = make(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    model = language_id.train(df)
    probe = make([en, de, "", None, "123 !!", "e"])
    out = {r.row.doc_id: r for r in language_id.predict(probe.withColumn("score", F.lit(1)), model).collect()}
    assert (out[0].lang_pred, out[1].lang_pred) == ("en", "de")
    assert [out[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and out[5].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.train(make([])) is None
    assert language_id.predict(probe, None).select("lang_pred").distinct().count() == 1


def test_language_accuracy_on_held_out_rows(spark, sf):
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = language_id.query(spark, sf).where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] > 0.9


def toxic_frame(make, n=600):
    import random

    rng = random.Random(2)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(300)]
    texts, y = [], []
    for i in range(n):
        w = rng.choices(vocab, k=40)
        bad = i % 6 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(40), rng.choice(["zorgle", "zorgling", "blarxt"]))
        texts.append(" ".join(w))
        y.append(int(bad))
    return make(texts), y


def test_toxicity(spark, make):
    df, y = toxic_frame(make)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i % 5 < 3], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = {r.row.doc_id: r.score for r in toxicity.score(df.withColumn("score", F.lit(0)), model).collect()}
    wrong = [i for i, v in enumerate(y) if (out[i] >= 0.5) != bool(v)]
    assert len(wrong) <= 6
    odd = toxicity.score(make(["", None]), model).collect()
    assert len(odd) == 2 and all(0 <= r.score < 0.5 for r in odd)


def test_toxicity_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(make(["a b"]), none)[0] == {}
    assert toxicity.score(make(["a b"]), ({}, -30.0)).first().score < 1e-6


@pytest.mark.parametrize("hot", [None, 7])
def test_toxicity_samples_rows_not_ids(spark, make, hot):
    """One id over most rows brings no more rows to the driver than asked for; copies count once."""
    texts = [f"word{i % 3000} and more" for i in range(4000)]
    df = make(texts, ids=[hot] * 4000)
    of = df.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("hash"))
    assert toxicity._chosen(of, of, 100).count() == 100
    whole = [r.text for r in toxicity._chosen(of, of, 5000).collect()]
    assert sorted(whole) == sorted(set(texts))
    assert [r.text for r in toxicity._chosen(of.limit(0), of.limit(0), 5).collect()] == []


def test_languages_sample_rows_once(spark, make, monkeypatch):
    seen = []
    fit = language_id.ByteCnn.fit
    monkeypatch.setattr(language_id.ByteCnn, "fit", lambda self, x, *a: seen.append(len(x)) or fit(self, x, *a))
    language_id.train(make(["one text of many copies"] * 900 + ["another text"], ids=[3] * 901))
    assert seen == [2]


def test_bpe_constants_of_decoding_are_built_when_used(spark):
    e = byte_bpe.Encoder({bytes([i]): i for i in range(256)}, ".")
    assert not {"pieces", "digits"} & set(vars(e))
    assert [list(r) for r in spark.range(1).select(e.decode(F.array(F.lit(104), F.lit(105))), e.packed(F.array(F.lit(7)))).collect()] == [[b"hi", b"\x07\0\0\0"]]


def test_bpe_frequent_words_come_first_in_their_map(make, monkeypatch):
    """A lookup scans its map, and decoding joins bytes as they are."""
    monkeypatch.setattr(byte_bpe, "WORD_MAPS", 2)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(), special_tokens={})
    times = {f" {chr(97 + 7 * i % 26)}{'é' * (i % 3)}q": 1 << i % 13 for i in range(26)}
    texts = [w * n for w, n in times.items()]
    encoded, e = byte_bpe.encode(make(texts), words=1000)
    maps = json.loads(e.dictionary(make(texts), words=1000).maps)
    assert sum(map(len, maps)) == len(times) and all([times[w] for w in m] == sorted((times[w] for w in m), reverse=True) for m in maps)
    back = e.decode(F.col("ids"))
    assert "unhex" not in str(back)
    assert {r.doc_id: (r.ids, bytes(r.back)) for r in encoded.select("doc_id", "ids", back.alias("back")).collect()} == {i: (own.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)}
