"""Known values, invariants and states that SQL doesn't cover."""

import itertools
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import arrays as A
from tilewright.operators import calibration, contract, dedup, explain, fusion, graph, losses, metrics, models, radiomics, sampling, splits, survival, tiles, trials, vectors
from tilewright.operators.prefix import numbered, percentiles, running, running_sum
from tilewright.sources import tables


def preds(spark, y, s):
    return spark.createDataFrame([(i, int(a), float(b), int(b >= 0.5)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "id long, y_true int, score double, y_pred int")


def test_perfect_separation(spark):
    df = preds(spark, [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8, 0.9])
    assert metrics.auroc(df).first().auroc == 1.0
    assert metrics.auprc(df).first().auprc == pytest.approx(1.0)
    assert metrics.classification(df).first().accuracy == 1.0


def test_auroc_of_negated_scores(spark):
    rng = random.Random(1)
    y, s = [rng.random() < 0.4 for _ in range(200)], [rng.randrange(20) for _ in range(200)]
    a = metrics.auroc(preds(spark, y, s)).first().auroc
    b = metrics.auroc(preds(spark, y, [-x for x in s])).first().auroc
    assert a + b == pytest.approx(1.0)


def test_rates(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (1, 0), (0, 0), (0, 0), (0, 0), (0, 0)], "y_true int, y_pred int")
    r = metrics.binary_rates(df).first()
    assert (r.sensitivity, r.specificity, r.ppv) == (0.75, 1.0, 1.0)
    with pytest.raises(ValueError):
        metrics.binary_rates(df.where("y_true = 1"))


def test_missing_prediction_raises(spark):
    truth, p = spark.range(3).toDF("id"), spark.createDataFrame([(0, 0.1), (1, 0.2)], "id long, score double")
    with pytest.raises(ValueError):
        metrics.join_predictions(truth, p, "id")
    with pytest.raises(ValueError):
        metrics.join_predictions(truth.where("id < 2"), p.union(p), "id")


def test_score_of_one_has_no_bin(spark):
    df = preds(spark, [1, 1], [1.0, 0.95])
    assert calibration.curve(df).agg(F.sum("n")).first()[0] == 1
    assert calibration.curve(df, include_one=True).agg(F.sum("n")).first()[0] == 2


def test_stratified_splits(spark):
    df = spark.createDataFrame([(i, i % 5 == 0, j) for i in range(100) for j in range(5)], "patient long, label boolean, sample int")
    a = splits.stratified(df, "patient", "label", "sample").cache()
    n = dict(a.groupBy("split").count().collect())
    assert n == {"test": 20, "val": 12, "train": 68}
    joined = splits.apply(df, a.select("patient", "split"), "patient")
    assert splits.leak_check(joined, "patient", fail=True).count() == 0
    assert splits.coverage(df, a, "patient").count() == 0
    shares = {r.split: r.s for r in a.groupBy("split").agg(F.avg(F.col("label").cast("int")).alias("s")).collect()}
    assert all(abs(s - 0.2) < 0.15 for s in shares.values())
    assert sorted(a.collect()) == sorted(splits.stratified(df.repartition(7), "patient", "label", "sample").collect())


def test_leak_raises(spark):
    with pytest.raises(ValueError):
        splits.leak_check(spark.createDataFrame([(1, "a"), (1, "b")], "p int, split string"), "p", fail=True)


def test_folds_cover_each_group_once(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(53)], "p int, label int").withColumn("o", F.lit(0))
    f = splits.kfold(df, "p", "label", "o", k=5)
    assert f.where("split = 'val'").groupBy("p").count().where("count <> 1").count() == 0
    sizes = [r[1] for r in f.where("split = 'val'").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_contract(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (3.0, float("nan")), (4.0, float("inf"))], "a double, b double")
    c = contract.Contract().fit_imputation(df, ["a", "b"]).fit_normalization(df, ["a", "b"])
    with pytest.raises(RuntimeError):
        c.apply(df)
    c.freeze()
    with pytest.raises(RuntimeError):
        c.fit_imputation(df, ["a"])
    again = contract.Contract().fit_imputation(df.repartition(3), ["a", "b"]).fit_normalization(df.repartition(3), ["a", "b"])
    assert c.hash() == again.hash() and len(c.hash()) == 16
    c.save(spark, str(tmp_path / "c"))
    assert contract.Contract.load(spark, str(tmp_path / "c")).hash() == c.hash()
    out = c.apply(df).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("b").alias("b")).first()
    assert out.m == pytest.approx(0) and out.s == pytest.approx(1) and out.b == 0
    assert c.drift(df).count() == 0 and c.validate()
    with pytest.warns(UserWarning):
        contract.Contract().freeze()


def test_km_and_median(spark):
    rows = list(zip(range(1, 11), [1, 0, 1, 1, 0, 1, 1, 0, 1, 1], strict=True))
    curve = survival.kaplan_meier(spark.createDataFrame(rows, "t int, e int"), "t", "e")
    s = [r.survival for r in curve.orderBy("time").collect()]
    assert s == sorted(s, reverse=True) and s[0] == pytest.approx(0.9) and s[-1] == 0
    assert survival.median(curve).first()["median"] == 7.0  # 0.9 * 7/8 * 6/7 * 4/5 * 3/4 = 0.405
    assert survival.median(curve.where("survival > 0.9")).first()["median"] == float("inf")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_c_index_equals_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(8), rng.random() < 0.5, rng.randrange(5) / 4) for _ in range(60)]
    good = total = 0.0
    for (t1, e1, r1), (t2, e2, r2) in itertools.product(rows, rows):
        if e1 and (t1 < t2 or t1 == t2 and not e2):
            total += 1
            good += 1.0 if r1 > r2 else 0.5 if r1 == r2 else 0.0
    df = spark.createDataFrame(rows, "t int, e boolean, r double")
    assert survival.c_index(df, "t", "e", "r").first().c_index == pytest.approx(good / total)


def test_c_index_of_continuous_risks(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    t, e, r, g = rng.integers(0, 3000, n), rng.random(n) < 0.4, np.round(rng.normal(size=n), 4), rng.integers(0, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "r": r, "g": g}))
    for keep, by in ((np.ones(n, bool), ()), (g == 1, ("g",))):
        good = total = 0.0
        for i in np.flatnonzero(e & keep):
            later = keep & ((t > t[i]) | ((t == t[i]) & ~e))
            total += later.sum()
            good += (r[later] < r[i]).sum() + (r[later] == r[i]).sum() / 2
        got = survival.c_index(df, "t", "e", "r", by)
        assert (got.where("g = 1") if by else got).first().c_index == pytest.approx(good / total, abs=1e-12)


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k in range(3) for v in rng.integers(0, 40, 50 + k)] + [(0, None)]
    got = {r.k: r for r in percentiles(spark.createDataFrame(rows, "k int, v double"), "v", [0.0, 0.25, 0.5, 0.8, 1.0], ("k",)).collect()}
    for k in range(3):
        want = np.percentile([v for g, v in rows if g == k and v is not None], [0, 25, 50, 80, 100])
        assert [got[k][f"p{i}"] for i in range(5)] == pytest.approx(list(want))


def test_running_products(spark):
    df = spark.createDataFrame([(i, 1 + i / 100) for i in range(60)], "k int, v double").repartition(4)
    for r in running(df, "k", ["v"], fold="product").collect():
        assert r.cum_v == pytest.approx(math.prod(1 + i / 100 for i in range(r.k + 1)))


def test_sized_bootstrap(spark):
    df = spark.createDataFrame([(i, int(i < 20)) for i in range(100)], "id long, y int")
    for size in (10, 250):
        b = sampling.bootstrap_stratified(df, "id", "y", 4, n_samples=size).groupBy("replicate").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
        assert all((r.n, r.p) == (size, size // 5) for r in b.collect())


def test_one_class_folds_raise(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.createDataFrame([(float(i % 2), float(i), i % 2) for i in range(20)], "label double, a double, fold int")
    lr = LogisticRegression(labelCol="label")
    with pytest.raises(ValueError):
        models.cv_search(df, ["a"], [{lr.regParam: 0.1}], lr)


def test_slides_of_a_bucket_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(f"s{i}", [float(i)]) for i in range(12)], "slide_id string, embedding array<float>")
    tables.write_patches(df, path, buckets=2)
    tables.write_patches(df.where("slide_id = 's3'").unionByName(df.where("slide_id = 's3'")), path, buckets=2)
    assert dict(spark.read.parquet(path).groupBy("slide_id").count().collect()) == {f"s{i}": 1 + (i == 3) for i in range(12)}


def test_cluster_members_as_rows(spark):
    comp = spark.createDataFrame([(k, 0 if k < 5 else k) for k in range(8)], "id long, component long")
    assert [tuple(r) for r in dedup.report(comp, "id").orderBy("rank").collect()] == [(0, 5, 0, k, k + 1) for k in range(5)]


@pytest.mark.parametrize("threshold", [0, 2, 3])
def test_more_blocks_find_the_same_pairs(spark, threshold, monkeypatch):
    rng = random.Random(6)
    h = [rng.getrandbits(60) for _ in range(40)]
    h += [x ^ sum(1 << b for b in rng.sample(range(60), rng.randrange(6))) for x in h]
    df = spark.createDataFrame(list(enumerate(h)), "id long, hash long")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(set(h), 2) if (a ^ b).bit_count() <= threshold}
    monkeypatch.setattr(dedup, "ROW", 1e9)
    got = [(r.hash_i, r.hash_j) for r in dedup.hamming_pairs(df, "id", threshold=threshold, bits=60).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("group, label", [("n", "draw"), ("place", "bucket"), ("fold", "l"), ("m", "t")])
def test_splits_with_clashing_names(spark, group, label):
    df = spark.createDataFrame([(i, i % 3, 0) for i in range(40)], f"{group} long, {label} int, o int")
    s = splits.stratified(df, group, label, "o")
    assert s.columns == [group, label, "split"] and s.count() == 40
    assert splits.ratio(df, group).count() == 40
    assert splits.time_aware(df.withColumn("at", F.timestamp_seconds(F.col(group))), group, "at").count() == 40
    if group != "fold":
        assert splits.kfold(df, group, label, "o").where("split = 'val'").count() == 40


@pytest.mark.parametrize("by", ["pos", "neg", "cum_neg"])
def test_curves_with_clashing_names(spark, by):
    df = spark.createDataFrame([(i % 2, i / 10, 1) for i in range(10)], f"y int, value double, {by} int")
    assert metrics.auroc(df, "y", "value", (by,)).columns == [by, "auroc"]
    strata = metrics.by_stratum(df.withColumn("stratum", F.lit("x")), [by], "y", "y", "value")
    assert strata.count() == 2


def test_c_index_without_pairs(spark):
    assert survival.c_index(spark.createDataFrame([(1, False, 0.5)], "t int, e boolean, r double"), "t", "e", "r").first().c_index == 0.5


def test_cox_against_a_solved_case(spark):
    rows = [(1.0, 1, 1.0), (2.0, 1, 0.0), (3.0, 1, 1.0), (4.0, 1, 0.0)]
    c = models.Cox(["x"]).fit(spark.createDataFrame(rows, "time double, event int, x double"))
    import math

    # the score is zero at the estimate
    b = math.exp(c.coef[0])
    score = (1 - 2 * b / (2 * b + 2)) + (0 - b / (b + 2)) + (1 - b / (b + 1)) + 0
    assert abs(score) < 1e-6


def test_running_sum(spark):
    df = spark.createDataFrame([(i % 97, i) for i in range(1000)], "k int, v long")
    out = running_sum(df.repartition(5), "k", ["v"])
    for r in random.Random(0).sample(out.collect(), 20):
        assert r.cum_v == sum(i for i in range(1000) if i % 97 <= r.k)
    back = running_sum(df, "k", ["v"], reverse=True)
    assert back.where("k = 96").first().cum_v == sum(i for i in range(1000) if i % 97 == 96)


@pytest.mark.parametrize("threshold", [1, 3, 8])
def test_banded_join_equals_brute_force(spark, threshold):
    rng = random.Random(5)
    h = [rng.getrandbits(62) for _ in range(60)]
    h += [x ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(12))) for x in h]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(set(h), 2) if (a ^ b).bit_count() <= threshold}
    df = spark.createDataFrame(list(enumerate(h)), "id long, hash long")
    got = {(r.hash_i, r.hash_j) for r in dedup.hamming_pairs(df, "id", threshold=threshold).collect()}
    assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    out = dict(graph.components(spark.createDataFrame(chain, "src long, dst long"), nodes=spark.createDataFrame([(i,) for i in [*range(31), 100, 101, 102, 500]], "id long")).collect())
    assert all(out[i] == 0 for i in range(31)) and out[102] == 100 and out[500] == 500
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_identical_texts(spark):
    df = spark.createDataFrame([(i, "one two three four five") for i in range(3)] + [(9, "something else entirely here")], "id long, text string")
    comp = dedup.clusters(dedup.text_simhash(df, "id"), "id", threshold=3, bits=60)
    s = dedup.stats(comp, "id").first()
    assert (s.total, s.kept, s.removed) == (4, 2, 2)
    assert sorted(r.id for r in dedup.run(df, "id").collect()) == [0, 9]


def test_grid_is_end_exclusive(spark):
    slide = spark.createDataFrame([("s", 512, 512, None), ("t", 128, 400, None)], "slide_id string, width int, height int, objective_power double")
    out = tiles.tile_grid(slide, 128, 0)
    assert out.where("slide_id = 's'").count() == 9 and out.where("slide_id = 't'").count() == 0


def _png(path, pixels):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in pixels)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pixel_metrics(spark, tmp_path):
    _png(tmp_path / "tissue.png", [[(120, 80, 150)] * 16 for _ in range(16)])
    _png(tmp_path / "blank.png", [[(245, 245, 245)] * 16 for _ in range(16)])
    (tmp_path / "broken.png").write_bytes(b"no image")
    images = tables.read_images(spark, str(tmp_path))
    assert tuple(tables.image_errors(images).first()) == (3, 1)
    m = {r.origin.rsplit("/", 1)[-1]: r for r in tiles.pixel_metrics(images.where("image.height > 0")).collect()}
    assert m["tissue.png"].tissue_fraction == 1.0 and m["blank.png"].tissue_fraction == 0.0
    assert m["blank.png"].background_fraction == 1.0 and m["tissue.png"].laplacian_var == 0.0


def _plain_metrics(px):
    """Tissue, sharpness, background and pen marks of rows of (r, g, b), pixel by pixel."""
    h, w, half = len(px), len(px[0]), lambda v: int(np.rint(v))
    gray = [[half(0.299 * r + 0.587 * g + 0.114 * b) for r, g, b in row] for row in px]
    tissue = background = pen = 0
    for row, grays in zip(px, gray, strict=True):
        for (r, g, b), y in zip(row, grays, strict=True):
            top, low = max(r, g, b), min(r, g, b)
            sat = half((top - low) * 255 / top) if top else 0
            hue = 0
            if top > low:
                d = top - low
                degrees = 60 * ((g - b) / d % 6) if top == r else 60 * ((b - r) / d + 2) if top == g else 60 * ((r - g) / d + 4)
                hue = half(degrees / 2)
            tissue += sat > 15
            background += y > 240
            pen += sat > 150 and (100 < hue < 130 or 40 < hue < 80 or hue < 10 or hue > 170)
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    lap = [sum(gray[mirror(y + dy, h)][mirror(x + dx, w)] for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4 * gray[y][x] for y in range(h) for x in range(w)]
    mean = sum(lap) / len(lap)
    return tissue / (h * w), sum((v - mean) ** 2 for v in lap) / len(lap), background / (h * w), pen / (h * w)


def test_pixel_metrics_of_colours(spark, tmp_path):
    """Colour images of several shapes, read from files, against a plain version."""
    rng, want = random.Random(3), {}
    for k, (h, w) in enumerate([(8, 8), (5, 13), (16, 4), (9, 9)]):
        px = [[rng.choice([(rng.randrange(256), rng.randrange(256), rng.randrange(256)), (250, 245, 248), (200, 20, 20), (0, 0, 0)]) for _ in range(w)] for _ in range(h)]
        _png(tmp_path / f"{k}.png", px)
        want[f"{k}.png"] = _plain_metrics(px)
    got = {r.origin.rsplit("/", 1)[-1]: tuple(r)[1:] for r in tiles.pixel_metrics(tables.read_images(spark, str(tmp_path))).collect()}
    assert set(got) == set(want)
    for name, v in want.items():
        assert got[name] == pytest.approx(v, abs=1e-9), name


def test_patches_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(i % 3, i, [float(i), 1.0]) for i in range(9)], "slide_id int, patch int, embedding array<float>")
    tables.write_patches(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 9 and back.where("attention_score = 1").count() == 9
    tables.write_patches(df.where("slide_id = 1").limit(1), path)
    assert spark.read.parquet(path).groupBy("slide_id").count().where("slide_id = 1").first()["count"] == 1
    with pytest.raises(KeyError):
        tables.read_patches(spark.read.parquet(path), slide=77)


def test_pooling_and_fusion(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 1000.0), ("a", [0.0, 1.0], 0.0), ("b", [2.0, 2.0], 5.0)], "k string, embedding array<double>, s double")
    assert {r.k: r.pooled for r in vectors.softmax_pool(df, "k", "s").collect()} == {"a": [1.0, 0.0], "b": [2.0, 2.0]}
    g = fusion.gate(spark.createDataFrame([([1.0], [2.0], [0.0, 0.0])], "m array<double>, n array<double>, g array<double>"), ["m", "n"], "g").first()
    assert g.gate == [0.5, 0.5] and g.fused == [0.5, 1.0]
    w = spark.createDataFrame([("imaging", v) for v in (0.6, 0.5, 0.7)] + [("radiomics", v) for v in (0.3, 0.4, 0.2)] + [("genomic", 0.1)] * 3, "m string, w double")
    got = {r.m: r.importance for r in explain.modality_importance(w, "m", "w").collect()}
    assert got == pytest.approx({"imaging": 0.6, "radiomics": 0.3, "genomic": 0.1})


def test_bootstrap_keeps_class_shares(spark):
    df = spark.createDataFrame([(i, int(i < 20), 0.5) for i in range(100)], "id long, y_true int, score double")
    b = sampling.bootstrap_stratified(df, "id", "y_true", 5).groupBy("replicate").agg(F.count("*").alias("n"), F.sum("y_true").alias("p"))
    assert all((r.n, r.p) == (100, 20) for r in b.collect())


def test_places(spark):
    out = [r.place for r in numbered(spark.range(500).toDF("k"), "k").collect()]
    assert sorted(out) == list(range(500))


def test_trials(spark):
    df = spark.createDataFrame([(0, 0.8), (1, 0.95), (2, 0.82), (3, None)], "trial_id int, metric double")
    assert [r.suspicious for r in trials.suspicious(df, "trial_id").orderBy("trial_id").collect()] == [False, True, True, False]
    a = F.create_map(F.lit("lr"), F.lit(1e-4), F.lit("bs"), F.lit(32.0), F.lit("hd"), F.lit(256.0))
    b = F.create_map(F.lit("lr"), F.lit(2e-4), F.lit("bs"), F.lit(32.0), F.lit("hd"), F.lit(512.0))
    assert set(spark.range(1).select(trials.config_diff(a, b)).first()[0]) == {"lr", "hd"}
    runs = spark.createDataFrame([("r", e, v) for e, v in enumerate([5.0, 3.0, 4.0, 4.0, 2.0])], "run string, epoch int, val_loss double")
    r = trials.early_stop(runs, 2, "run").first()
    assert (r.best_epoch, r.stop_epoch) == (1, 3)


def test_texture(spark):
    v = spark.createDataFrame([("s", x, y, 0, 1 if x < 2 else 2) for x in range(4) for y in range(2)], "sample string, x int, y int, z int, level int")
    assert radiomics.glszm(v, "sample").first().zones == 2
    assert radiomics.shape(v, "sample").first().faces == 2 * (4 + 2) * 1 + 2 * 8
    r = radiomics.first_order(v.withColumn("level", F.lit(5)), "sample").first()
    assert r.variance == 0 and r.skewness == 0 and r.entropy == 0


def test_scalars(spark):
    r = spark.range(1).select(A.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"), A.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"), A.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()
    assert r.a == 1 and r.s == [0.5, 0.5] and r.c is None
    assert losses.class_weights(spark.createDataFrame([(0,), (0,), (1,)], "y int"), "y").where("y = 1").first().weight == pytest.approx(1.5)


def test_models(spark):
    rng = random.Random(3)
    rows = [(float(y), y + rng.gauss(0, 0.2), rng.gauss(0, 1), i // 2 % 2) for i in range(80) for y in [i % 2 if rng.random() < 0.97 else 1 - i % 2]]
    df = spark.createDataFrame(rows, "label double, a double, b double, fold int")
    for fit in (models.fit_lr, models.fit_svm_linear):
        assert fit(df, ["a", "b"]).transform(df).where("prediction = label").count() > 70
    assert models.fit_rf(df, ["a", "b"], trees=5, depth=3).transform(df).where("prediction = label").count() > 70
    assert models.lasso_select(df, ["a", "b"], "label", 0.1) == ["a"]
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.tuning import ParamGridBuilder

    lr = LogisticRegression(labelCol="label")
    out = models.cv_search(df, ["a", "b"], ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build(), lr)
    assert len(out["mean"]) == 2 and max(out["mean"]) > 0.9


def test_stream_ingest(spark, tmp_path):
    from tilewright.streaming.manifests import ingest_manifest, qc_counts, read_manifests

    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "tile_id long, ts timestamp, background_fraction double, laplacian_var double, pen_fraction double"
    rows = spark.range(20).select(F.col("id").alias("tile_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(0.1).alias("background_fraction"), F.when(F.col("id") < 5, 1.0).otherwise(50.0).alias("laplacian_var"), F.lit(0.0).alias("pen_fraction"))
    rows.write.parquet(src)
    ingest_manifest(read_manifests(spark, src, schema), out, check).awaitTermination()
    rows.write.mode("append").parquet(src)  # the same tiles again
    ingest_manifest(read_manifests(spark, src, schema), out, check).awaitTermination()
    got = spark.read.schema(schema).parquet(out)
    assert got.count() == 15 and got.select("tile_id").distinct().count() == 15
    assert tuple(qc_counts(rows).select("kept", "rejected").first()) == (15, 5)
