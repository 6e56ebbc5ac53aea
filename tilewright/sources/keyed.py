"""Keyed array files as a Spark data source: raw arrays by name, read by key.

A folder has blobs of raw little-endian floats, a file of entries for each blob (key, place, length, JSON lines) and the list ``_files.json`` that a
finished write leaves. ``spark.dataSource.register(KeyedArrays)``, then ``format("keyed_arrays")``, or ``read_arrays``:
reading gives ``key, values``; partitions are stretches of a blob's entries; the option ``values=false`` reads keys alone. Where the session has
``spark.sql.python.filterPushdown.enabled``, the option ``pushdown=true`` lets equality and IN on ``key`` leave out whole partitions and
then single entries before their bytes are read; ``read_arrays`` sets it.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

#: Entries of a partition.
ENTRIES = 4096


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", uri)))


def _read(store, path: str) -> bytes:
    with store.open_input_file(path) as f:
        return f.read()


@dataclass
class Stretch(InputPartition):
    """Entries ``begin`` to ``end`` of a blob."""

    name: str
    begin: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    entries: int
    low: str
    high: str


class KeyedArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_arrays"

    def schema(self) -> str:
        return "key string, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return PushingReader(self.options) if self.options.get("pushdown") == "true" else Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, [f.name for f in schema.fields], overwrite)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.values, self.keys = options["path"], str(options.get("values", "true")).lower() != "false", None

    def partitions(self) -> list[Stretch]:
        store, folder = _store(self.path)
        files = json.loads(_read(store, f"{folder}/_files.json"))
        if self.keys is not None:  # a blob whose keys are all outside has no partition
            files = [f for f in files if any(f["low"] <= k <= f["high"] for k in self.keys if k is not None)]
        return [Stretch(f["name"], i, min(i + ENTRIES, f["entries"])) for f in files for i in range(0, f["entries"], ENTRIES)]

    def read(self, partition: Stretch):
        store, folder = _store(self.path)
        entries = [json.loads(x) for x in _read(store, f"{folder}/{partition.name}.keys").splitlines()[partition.begin : partition.end]]
        if self.keys is not None:
            entries = [e for e in entries if e[0] in self.keys]
        if not self.values:
            yield from ((key, None) for key, _, _ in entries)
        elif entries:
            with store.open_input_file(f"{folder}/{partition.name}.blob") as f:
                for key, at, n in entries:
                    yield key, np.frombuffer(f.read_at(4 * n, at), "<f4").tolist()


class PushingReader(Reader):
    """For sessions in which Spark hands filters to Python sources; it refuses a reader that takes them in others."""

    def pushFilters(self, filters):
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("key",) else set(f.value) if isinstance(f, In) and f.attribute == ("key",) else None
            if wanted is None:
                yield f
            else:
                self.keys = wanted if self.keys is None else self.keys & wanted


class Writer(DataSourceWriter):
    """Each task writes a blob of its own; only blobs that ``_files.json`` names are there, so an attempt that is lost or runs twice does no harm."""

    def __init__(self, options, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite

    def write(self, iterator) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        name, at, entries = uuid.uuid4().hex, 0, []
        with store.open_output_stream(f"{folder}/{name}.blob") as blob:
            for row in iterator:
                key, values = row[self.columns.index("key")], row[self.columns.index("values")]
                if key is None or values is None:
                    raise ValueError("keys and arrays are not NULL")
                data = np.array(values, "<f4").tobytes()
                entries.append((str(key), at, len(values)))
                blob.write(data)
                at += len(data)
        with store.open_output_stream(f"{folder}/{name}.keys") as out:
            out.write("".join(json.dumps(e) + "\n" for e in entries).encode())
        keys = [e[0] for e in entries]
        return Written(name, len(entries), min(keys, default=""), max(keys, default=""))

    def commit(self, messages) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        before = []
        if not self.overwrite:
            from pyarrow.fs import FileType

            if store.get_file_info(f"{folder}/_files.json").type != FileType.NotFound:
                before = json.loads(_read(store, f"{folder}/_files.json"))
        new = [{"name": m.name, "entries": m.entries, "low": m.low, "high": m.high} for m in messages if m is not None and m.entries]
        with store.open_output_stream(f"{folder}/_files.json") as out:
            out.write(json.dumps([*before, *new]).encode())

    def abort(self, messages) -> None:
        """Blobs without an entry in the list are never read."""


def read_arrays(spark: SparkSession, path: str, values: bool = True) -> DataFrame:
    """``key, values`` of a folder, with the filters that the session lets a source have."""
    spark.dataSource.register(KeyedArrays)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("keyed_arrays").option("values", str(values).lower()).option("pushdown", pushed).load(path)


def write_arrays(df: DataFrame, path: str, mode: str = "append") -> None:
    """``key`` and ``values`` of ``df`` as keyed arrays."""
    df.sparkSession.dataSource.register(KeyedArrays)
    df.select("key", "values").write.format("keyed_arrays").mode(mode).save(path)
