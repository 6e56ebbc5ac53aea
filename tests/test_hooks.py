"""One-to-many functions over files and rows, errors as rows, folds of groups."""

from tilewright.functions.hooks import expand, fold_groups


def test_expand_files(spark, tmp_path):
    """Tiles of binary files; a broken file gives the tiles before it breaks, and a row with its error."""
    (tmp_path / "good.bin").write_bytes(bytes([3, 1, 2, 3]))
    (tmp_path / "empty.bin").write_bytes(bytes([0]))
    (tmp_path / "short.bin").write_bytes(bytes([3, 9]))
    files = spark.read.format("binaryFile").load(str(tmp_path))

    def tiles(data):
        for i in range(data[0]):
            yield i, float(data[i + 1])

    got = sorted((r.path.rpartition("/")[2], r.tile, r.value, r.error) for r in expand(files, "content", tiles, "tile int, value double").select("path", "tile", "value", "error").where("tile IS NOT NULL").collect())
    assert got == [("good.bin", 0, 1.0, None), ("good.bin", 1, 2.0, None), ("good.bin", 2, 3.0, None), ("short.bin", 0, 9.0, None)]
    bad = expand(files, "content", tiles, "tile int, value double").where("error IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0].path.endswith("short.bin") and bad[0].tile is None and "IndexError" in bad[0].error


def test_fold_groups(spark):
    rows = [(k, i, (i * 7) % 5) for k in ("a", "b") for i in range(10)] + [(None, 0, 4)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    got = fold_groups(df, ["k"], ["i"], list, lambda s, r: [*s, r["v"]], lambda s: [(len(s), "".join(map(str, s)))], "n int, seen string")
    want = "".join(str((i * 7) % 5) for i in range(10))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 10, want), ("b", 10, want), (None, 1, "4")], key=str)
    assert fold_groups(df.limit(0), ["k"], ["i"], list, lambda s, r: s, lambda s: [(1,)], "n int").count() == 0
