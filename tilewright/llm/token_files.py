"""Token ids as raw binary files with a minimal perfect hash index from document keys to places in them.

A folder of the format holds

* ``ids/``: shards of raw little-endian ids, one document after the other, nothing between
  them, in ascending order of the keys; at most about ``shard_bytes`` each, so a training job can map them;
* ``index/``: buckets of keys. A bucket is a minimal perfect hash function (levels of bits with ranks) and for each of its
  places a fingerprint of the key, the shard, the first id and the number of ids;
* ``catalog/``, ``buckets/``, ``keys/``: Parquet tables of the shards, of the buckets' places in the index files, and of the keys.

A key is found in constant time: its hash names the bucket, the bucket's function the place, the fingerprint tells
strangers, and the ids are one range of one file. Files are written by tasks under names of their own attempt; only those
that the tables name are part of the format, so a task that runs again does no harm.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.token_counts import splitter, vocabulary_path
from tilewright.plans.lineage import shared_dir

SHARD_BYTES = 16 << 20
#: Keys in a bucket of the index, about.
BUCKET_KEYS = 2048
#: Bits of a level for each key that has come to it.
GAMMA = 2.0
LEVELS = 64
#: Most stretches and most words in a worker's cache; longer ones are encoded whenever they occur.
CACHE_SIZE = 1 << 19
LONGEST = 64
#: The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follows 256 in order.
_PLAIN_BYTES = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
BYTE_LETTERS = {**{b: b for b in _PLAIN_BYTES}, **{b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN_BYTES)))}}
#: Below this code point characters neither compose with their neighbours nor change them when lowered.
PLAIN = "ɐ"
MAGIC = b"TWMPH001"
SLOT = np.dtype([("print", "<u8"), ("range", "<i4"), ("part", "<i4"), ("at", "<i8"), ("n", "<i8")])


# ---------------------------------------------------------------- files


def open_store(uri: str):
    """A file system that executors reach, and the path in it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def put(store, path: str, data: bytes) -> None:
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


# ---------------------------------------------------------------- encoding


class Memory(dict):
    """``encode(text)`` of texts seen of late; when half of ``most`` are there, only those asked for again are kept."""

    def __init__(self, encode, most: int):
        self.encode, self.half, self.old = encode, max(1, most // 2), {}

    def __missing__(self, text: str):
        found = self.old.get(text)
        if found is None:
            found = self.encode(text)
        if len(text) <= LONGEST:
            if len(self) >= self.half:
                self.old = self.copy()
                self.clear()
            self[text] = found
        return found


class _Stretches(Memory):
    """Ids of what stands between two spaces, as bytes: its words' ids where it is plain, else by the library."""

    def __init__(self, encode, word, pattern: str, most: int):
        super().__init__(self._split, most)
        self.library, self.words = encode, Memory(word, most)
        self.find = splitter(pattern).findall
        self.find_ascii = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ")).findall

    def _split(self, stretch: str) -> bytes:
        low = stretch.lower()
        if low.isascii():
            if low.isalpha():
                return self.words[low]
            return self.library(stretch) if "<|" in low else b"".join(map(self.words.__getitem__, self.find_ascii(low)))
        if max(stretch) >= PLAIN or "<|" in stretch:
            return self.library(stretch)
        return b"".join(map(self.words.__getitem__, self.find(low)))


class Encoder:
    """``encode(text)``: the ids as little-endian bytes, without special tokens around the text."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            pattern = space_free(json.load(f))
        if pattern is None or sys.byteorder != "little":
            self.encode = self.library
        else:
            stretch = _Stretches(self.library, self.word, pattern, cache_size).__getitem__
            self.encode = lambda text: b"".join(map(stretch, text.split(" ")))
        self.code, self.model = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model

    def word(self, word: str) -> bytes:
        """Of a word that is cut, composed and lowered: the model's merges alone."""
        return array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def space_free(config: dict) -> str | None:
    """The word pattern of a tokenizer that drops white space, so that stretches between spaces are encoded by themselves; else None.

    It has to compose, lower and cut as is known here; any other tokenizer gets whole texts.
    """
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    if (config.get("normalizer") or {}).get("normalizers") != known:
        return None
    cut = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = cut[0].get("pattern", {}).get("Regex", "") if cut[0].get("invert") and cut[0].get("behavior") == "Removed" else ""
    rest = [x.get("type") for x in cut[1:]] == ["ByteLevel"] and not cut[1].get("use_regex") and not cut[1].get("add_prefix_space")
    special = all(t["content"].startswith("<|") and " " not in t["content"] and not t["normalized"] and not t["single_word"] for t in config["added_tokens"])
    drops = r"[^\s\p{L}\p{N}]+" in pattern and r"\s" not in pattern.replace(r"[^\s", "") and "\\" not in re.sub(r"\[[^\]]*\]", "", pattern)
    return pattern if pattern and rest and special and drops and config.get("post_processor") is None else None


# ---------------------------------------------------------------- minimal perfect hash


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of a key for one level, from its two hashes."""
    x = h1 ^ ((h2 << np.uint64(23)) | (h2 >> np.uint64(41)))
    x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Places 0 to n - 1 of n different keys: each level has a bit where exactly one of its keys falls, the others go on to the next."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # 64-bit words
        self.before, n = [], 0  # bits set before each word
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(n + np.cumsum(counts) - counts)
            n += int(counts.sum())
        self.n = n

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            if len(levels) == LEVELS:
                raise ValueError("two keys have the same hashes")
            m = 64 * int(np.ceil(max(1, len(h1) * GAMMA / 64)))
            at = (_mix(h1, h2, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            h1, h2 = h1[~alone[at]], h2[~alone[at]]
        return cls(levels)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each key; -1 or any place for a key that isn't there."""
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for k, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = _mix(h1[open_], h2[open_], k) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = before[word[hit]] + np.bitwise_count(below[hit])
            open_ = open_[~hit]
        return out


def pack_bucket(h1: np.ndarray, h2: np.ndarray, slots: np.ndarray) -> bytes:
    """A bucket's bytes: header, bits of each level, slots in the order of their places."""
    f = PerfectHash.build(h1, h2)
    table = np.zeros(f.n, SLOT)
    table[f.places(h1, h2)] = slots
    head = struct.pack(f"<8sII{len(f.levels)}I", MAGIC, f.n, len(f.levels), *map(len, f.levels))
    return head + b"".join(x.astype("<u8").tobytes() for x in f.levels) + table.tobytes()


def unpack_bucket(data: bytes) -> tuple[PerfectHash, np.ndarray]:
    magic, n, k = struct.unpack_from("<8sII", data)
    if magic != MAGIC:
        raise ValueError("not an index bucket")
    sizes, at, levels = struct.unpack_from(f"<{k}I", data, 16), 16 + 4 * k, []
    for m in sizes:
        levels.append(np.frombuffer(data, "<u8", m, at))
        at += 8 * m
    return PerfectHash(levels), np.frombuffer(data, SLOT, n, at)


def find(bucket: tuple[PerfectHash, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there, and its slot."""
    f, table = bucket
    if not f.n:
        return np.zeros(len(h1), bool), np.zeros(len(h1), SLOT)
    place = f.places(h1, h2)
    slot = table[np.maximum(place, 0)]
    return (place >= 0) & (slot["print"] == h2), slot


# ---------------------------------------------------------------- writing

_ENTRY = [("turn", T.LongType()), ("range", T.IntegerType()), ("part", T.IntegerType()), ("file", T.StringType()), ("at", T.LongType()), ("n", T.LongType())]


def _write_shards(root: str, path: str, end_id: int | None, shard_bytes: int, key_type: pa.DataType):
    """For mapInArrow over (key, text) in order: writes the shards, yields an entry for each document once its shard is there."""
    schema = pa.schema([("key", key_type), ("turn", pa.int64()), ("range", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("n", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, (store, folder) = encoder_of(path), open_store(root)
        width, number = encoder.dtype.itemsize, TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        keys, turns, sizes, data, size, part, last, turn = [], [], [], [], 0, 0, object(), 0

        def flush():
            name = f"ids/{number:06d}-{part:04d}-{uuid.uuid4().hex}.bin"
            put(store, f"{folder}/{name}", b"".join(data))
            n = np.array(sizes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(turns, pa.int64()), pa.array([number] * len(n), pa.int32()), pa.array([part] * len(n), pa.int32()), pa.array([name] * len(n)), pa.array(np.cumsum(n) - n), pa.array(n)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                turn = turn + 1 if key == last else 0
                last = key
                keys.append(key), turns.append(turn), sizes.append(len(ids) // width), data.append(ids)
                size += len(ids)
                if size >= shard_bytes:
                    yield flush()
                    keys, turns, sizes, data, size, part = [], [], [], [], 0, part + 1
        if keys:
            yield flush()

    return run


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    h1, h2 = F.xxhash64(F.lit(1), "key", "turn"), F.xxhash64(F.lit(2), "key", "turn")
    return df.withColumn("h1", h1).withColumn("h2", h2).withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("long"))


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(x).to_numpy(zero_copy_only=False) for x in names]


def _write_index(root: str):
    """For mapInArrow over entries sorted by bucket: an index file for each task, a row for each bucket in it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        data, rows, held, number, written = [], [], [], None, 0
        name = f"index/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.mph"

        def close():
            nonlocal written
            h1, h2, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            slots = np.zeros(len(h1), SLOT)
            slots["print"] = h2.astype(np.int64).view(np.uint64)
            for c, v in zip(("range", "part", "at", "n"), rest, strict=True):
                slots[c] = v
            data.append(pack_bucket(h1.astype(np.int64).view(np.uint64), slots["print"], slots))
            rows.append((number, name, written, len(data[-1])))
            written += len(data[-1])

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            columns = _columns(batch, "h1", "h2", "range", "part", "at", "n")
            for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(part):
                    if held and bucket[part[0]] != number:
                        close()
                        held = []
                    number = int(bucket[part[0]])
                    held.append([c[part] for c in columns])
        if held:
            close()
            store, folder = open_store(root)
            put(store, f"{folder}/{name}", b"".join(data))
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "index_file", "index_at", "index_bytes"), r, strict=True)) for r in rows])

    return run


def write(docs: DataFrame, root: str | None = None, path: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Encode ``docs`` and write the files below ``root`` (a new folder of the shared one if not given).

    Documents go in ascending order of ``id_col``, nulls first; rows that share an id
    follow each other in the order of their text's hash and are told apart by ``turn`` (0, 1, ...).
    A null text is an empty one and has only the end id; ``end_id`` None adds none. An
    empty table gives an empty set of files. Other columns aren't stored. A text is encoded whole, however long.
    """
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    base = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    # ids that share a key, and rows alike, are dealt over ranges, too
    order = ["key", "hash", "row"]
    dealt = base.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    kind = base.schema["key"].dataType
    shards = _write_shards(root, path or vocabulary_path("word_bpe_49k.json"), end_id, shard_bytes, _arrow_type(kind))
    entries = dealt.mapInArrow(shards, T.StructType([T.StructField("key", kind), *[T.StructField(n, t) for n, t in _ENTRY]]))
    entries.write.parquet(f"{root}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{root}/entries")

    shards = entries.groupBy("range", "part", "file").agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_docs"))
    ranges = shards.groupBy(F.col("range").alias("r")).agg(F.sum("n_ids").alias("all"))
    ranges = ranges.select("r", (F.sum("all").over(W.orderBy("r")) - F.col("all")).alias("first"))  # a row for each task of the writer
    inside = F.sum("n_ids").over(W.partitionBy("range").orderBy("part")) - F.col("n_ids")
    shards.withColumn("inside", inside).join(ranges, F.col("range") == F.col("r")).select("range", "part", "file", "n_ids", "n_docs", (F.col("first") + F.col("inside")).alias("start")).write.parquet(f"{root}/catalog")

    # an id whose rows are in several ranges goes on counting its turns
    spans = entries.groupBy(F.col("key").alias("k"), F.col("range").alias("r")).agg(F.count("*").alias("rows"))
    later = spans.withColumn("more", F.sum("rows").over(W.partitionBy("k").orderBy("r")) - F.col("rows")).where("more > 0").select("k", "r", "more")
    entries = entries.join(later, F.col("key").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r")), "left").withColumn("turn", F.col("turn") + F.coalesce("more", F.lit(0)))
    entries.select("key", "turn", "range", "part", "at", "n").write.parquet(f"{root}/keys")
    keys = spark.read.parquet(f"{root}/keys")
    buckets = keys.count() // BUCKET_KEYS + 1
    placed = _hashed(keys, buckets).select("bucket", "h1", "h2", "range", "part", "at", "n").repartition("bucket").sortWithinPartitions("bucket")
    placed.mapInArrow(_write_index(root), "bucket long, index_file string, index_at long, index_bytes long").write.parquet(f"{root}/buckets")
    return TokenFiles(spark, root, buckets, path)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


# ---------------------------------------------------------------- reading


class TokenFiles:
    """A written set of token files."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.root = spark, root
        self.buckets = buckets if buckets is not None else spark.read.parquet(f"{root}/keys").count() // BUCKET_KEYS + 1
        from tokenizers import Tokenizer

        self.dtype = np.dtype("<u2" if Tokenizer.from_file(path or vocabulary_path("word_bpe_49k.json")).get_vocab_size() <= 1 << 16 else "<u4")

    def keys(self) -> DataFrame:
        """``key`` and ``turn`` of every document."""
        return self.spark.read.parquet(f"{self.root}/keys").select("key", "turn")

    def locate(self, keys: DataFrame) -> DataFrame:
        """The asked ``key`` and ``turn`` with ``range, part, at, n``, by the index; keys that aren't there get no row."""
        root, key = self.root, keys.schema["key"]
        directory = self.spark.read.parquet(f"{root}/buckets")
        asked = _hashed(keys.select("key", "turn"), self.buckets).join(directory, "bucket").sortWithinPartitions("index_file", "index_at")

        def run(batches) -> Iterator[pa.RecordBatch]:
            store, folder = open_store(root)
            at, bucket = None, None
            for batch in batches:
                h1, h2 = (x.astype(np.int64).view(np.uint64) for x in _columns(batch, "h1", "h2"))
                number = batch.column("bucket").to_numpy()
                found, slots = np.zeros(len(h1), bool), np.zeros(len(h1), SLOT)
                for part in np.split(np.arange(len(h1)), np.flatnonzero(np.diff(number)) + 1):
                    if not len(part):
                        continue
                    if at != number[part[0]]:
                        at = number[part[0]]
                        with store.open_input_file(f"{folder}/{batch.column('index_file')[part[0]].as_py()}") as f:
                            bucket = unpack_bucket(f.read_at(batch.column("index_bytes")[part[0]].as_py(), batch.column("index_at")[part[0]].as_py()))
                    found[part], slots[part] = find(bucket, h1[part], h2[part])
                rows = batch.select(["key", "turn"]).filter(pa.array(found))
                slots = slots[found]
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(np.ascontiguousarray(slots[c])) for c in ("range", "part", "at", "n")]], names=["key", "turn", "range", "part", "at", "n"])

        return asked.mapInArrow(run, T.StructType([key, *[T.StructField(n, t) for n, t in _ENTRY if n != "file"]]))

    def read(self, keys: DataFrame, of: Callable[[np.ndarray], object], kind: T.DataType) -> DataFrame:
        """``key, turn, start, n_tokens, value``: ``of(ids)`` of each asked document, from its range of a shard; ``start`` counts the ids before it in all shards."""
        root, dtype = self.root, self.dtype
        catalog = self.spark.read.parquet(f"{root}/catalog").select("range", "part", "file", F.col("start").alias("first"))
        located = self.locate(keys).join(catalog, ["range", "part"]).sortWithinPartitions("range", "part", "at")
        schema = T.StructType([keys.schema["key"], *[T.StructField(n, T.LongType()) for n in ("turn", "start", "n_tokens")], T.StructField("value", kind)])

        def run(batches) -> Iterator[pa.RecordBatch]:
            (store, folder), name, f = open_store(root), None, None
            for batch in batches:
                values = []
                at, n, first = _columns(batch, "at", "n", "first")
                for file, a, m in zip(batch.column("file").to_pylist(), at, n, strict=True):
                    if file != name:
                        name, f = file, store.open_input_file(f"{folder}/{file}")
                    values.append(of(np.frombuffer(f.read_at(int(m) * dtype.itemsize, int(a) * dtype.itemsize), dtype)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("turn"), pa.array(first + at), pa.array(n), pa.array(values, _arrow_type(kind))], names=schema.names)

        return located.mapInArrow(run, schema)

    def ids(self, keys: DataFrame) -> DataFrame:
        """``read`` with the ids themselves."""
        return self.read(keys, lambda x: x.astype(np.int32), T.ArrayType(T.IntegerType()))


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every document's place in the token files, and the checksum of the ids read there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write(docs)
    return files.read(files.keys(), crc32, T.LongType()).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.col("value").alias("ids_crc32"))
