"""Keyed arrays: round trip, appending, keys that leave out files and entries, lost attempts."""

from pyspark.sql.datasource import EqualTo, In

from tilewright.sources import keyed


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [(f"slide_{i % 3}/tile_{i:03d}", [i / 4, float(i), -1.5][: i % 4]) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, values array<float>").repartitionByRange(5, "key")
    keyed.write_arrays(df.where("key < 'slide_2'"), path)
    keyed.write_arrays(df.where("key >= 'slide_2'"), path)
    (tmp_path / "a" / "lost.blob").write_bytes(b"\0" * 40)  # of an attempt that was never committed
    assert keyed.read_arrays(spark, path).where("key = 'slide_1/tile_040'").count() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    back = keyed.read_arrays(spark, path)
    assert sorted((r.key, r["values"]) for r in back.collect()) == sorted(rows)
    one = back.where("key = 'slide_1/tile_040'")
    assert [r["values"] for r in one.collect()] == [rows[40][1]]
    assert sorted(r.key for r in back.where("key in ('slide_0/tile_000', 'slide_2/tile_002', 'none')").collect()) == ["slide_0/tile_000", "slide_2/tile_002"]
    assert back.where("key like '%tile_00%' and size(values) = 2").count() == sum("tile_00" in k and len(v) == 2 for k, v in rows)
    alone = keyed.read_arrays(spark, path, values=False)
    assert alone.count() == 100 and alone.where("values is not null").count() == 0
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_pruning(spark, tmp_path, monkeypatch):
    """Files without the keys have no partition, other filters are left to Spark."""
    spark.dataSource.register(keyed.KeyedArrays)
    path = str(tmp_path / "b")
    spark.createDataFrame([(f"{i:03d}", [1.0]) for i in range(90)], "key string, values array<float>").repartitionByRange(6, "key").write.format("keyed_arrays").mode("append").save(path)
    monkeypatch.setattr(keyed, "ENTRIES", 10)
    whole = keyed.PushingReader({"path": path})
    assert len(whole.partitions()) >= 9 and sum(p.end - p.begin for p in whole.partitions()) == 90
    some = keyed.PushingReader({"path": path})
    other = EqualTo(("values",), [1.0])
    assert list(some.pushFilters([In(("key",), ("003", "004")), EqualTo(("key",), "004"), other])) == [other]
    assert 0 < len(some.partitions()) <= 3
    assert [r for p in some.partitions() for r in some.read(p)] == [("004", [1.0])]
    spark.createDataFrame([("x", [2.0])], "key string, values array<float>").write.format("keyed_arrays").mode("overwrite").save(path)
    assert [r.key for r in spark.read.format("keyed_arrays").load(path).collect()] == ["x"]
