"""Leak-free splits: assignment, folds, checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.hashing import draw, require_columns
from tilewright.functions.names import own_names
from tilewright.operators.prefix import percentiles
from tilewright.plans.lineage import written


def take(df: DataFrame, name: str, split: str = "split") -> DataFrame:
    return df.where(F.col(split) == name)


def apply(df: DataFrame, assignment: DataFrame, group: str, split: str = "split") -> DataFrame:
    """``df`` with the split of its group; unknown groups have NULL."""
    return df.join(assignment.select(group, split), group, "left")


def fold(df: DataFrame, folds: DataFrame, k: int, group: str, split: str = "val") -> DataFrame:
    """Rows whose group is in a fold's part."""
    return df.join(folds.where((F.col("fold") == k) & (F.col("split") == split)).select(group), group, "left_semi")


@own_names("group", "label", "order")
def patient_labels(df: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """The label of each group's first row in an explicit order."""
    require_columns(df, group, label, order)
    return df.groupBy(group).agg(F.min_by(label, order).alias(label))


@own_names("group", "time")
def first_time(df: DataFrame, group: str, time: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(time).alias("first_time"), F.count_distinct(time).alias("n_times"))


@own_names("group", "split")
def leak_check(df: DataFrame, group: str, split: str = "split", fail: bool = False) -> DataFrame:
    """Groups with rows in two splits or more, or with none; with ``fail``, raises if there is any."""
    found = df.groupBy(group).agg(F.count_distinct(split).alias("n_splits"), F.array_join(F.array_sort(F.collect_set(split)), "|").alias("splits"), F.count_if(F.col(split).isNull()).alias("n_null"))
    bad = found.where("n_splits > 1 OR n_null > 0")
    if fail and not bad.isEmpty():
        raise ValueError("a group's rows are in more than one split")
    return bad


@own_names("group", "time", "split")
def summary(df: DataFrame, group: str, time: str | None = None, split: str = "split") -> DataFrame:
    times = [F.min(time).alias("min_time"), F.max(time).alias("max_time")] if time else []
    return df.groupBy(split).agg(F.count_distinct(group).alias("patients"), F.count("*").alias("samples"), *times)


def class_counts(df: DataFrame, label: str, values: list, split: str = "split") -> DataFrame:
    return df.groupBy(split).pivot(label, values).count().na.fill(0)


def _quota(df: DataFrame, label: str, share: float, name: str, total: str = "n") -> DataFrame:
    """Per label: how many of ``ceil(share * all)`` fall to it, by largest remainder."""
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    want = F.ceil(F.sum(total).over(everything) * F.lit(float(share)) - F.lit(1e-9))
    exact = want * F.col(total) / F.sum(total).over(everything)
    df = df.withColumn("want", want).withColumn("exact", exact).withColumn("low", F.floor("exact"))
    spare = F.col("want") - F.sum("low").over(everything)
    rank = F.row_number().over(W.orderBy(F.desc(F.col("exact") - F.col("low")), F.asc_nulls_last(label)))
    return df.withColumn(name, (F.col("low") + F.when(rank <= spare, 1).otherwise(0)).cast("long")).drop("want", "exact", "low")


@own_names("group", "label", "order")
def stratified(df: DataFrame, group: str, label: str | list[str], order: str, test: float = 0.2, val: float = 0.15, seed: int = 42) -> DataFrame:
    """``group, label, split``: hold out ceil(test * n) groups, then ceil(val * rest), in proportion to the labels.

    A label's table is a row a label, so its windows are small; members are ranked
    by md5 within buckets of it, so no label is ranked in one task. A list of labels is stratified by all of them at once
    (``balanced``): each split has its share of every value of every label.
    """
    if not isinstance(label, str):
        first = df.groupBy(group).agg(*[F.min_by(c, order).alias(c) for c in label])
        shares = [1 - test - (1 - test) * val, (1 - test) * val, test]
        dealt = balanced(first, group, list(label), shares, seed)
        name = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("part") + 1)
        own = dealt.select(F.col(group).alias("_g"), name.alias("split"))
        return first.join(own, F.col(group).eqNullSafe(F.col("_g"))).select(group, *label, "split")
    groups = _labelled(df, group, label, order)
    counts = groups.groupBy("_label").agg(F.count("*").alias("n"))
    counts = _quota(counts, "_label", test, "n_test")
    counts = _quota(counts.withColumn("rest", F.col("n") - F.col("n_test")), "_label", val, "n_val", "rest")
    ranked = _ranked(groups.withColumn("draw", draw(seed, "_group")), "_label", "_group")
    joined = ranked.join(counts.select(F.col("_label").alias("l"), "n_test", "n_val"), F.col("_label").eqNullSafe(F.col("l")))
    split = F.when(F.col("place") <= F.col("n_test"), "test").when(F.col("place") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train")
    return joined.select(F.col("_group").alias(group), F.col("_label").alias(label), split.alias("split"))


def _labelled(df: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """``_group`` and its ``_label``: names of the input can't meet those of the work on them."""
    return patient_labels(df, group, label, order).select(F.col(group).alias("_group"), F.col(label).alias("_label"))


def _ranked(df: DataFrame, label: str, group: str, buckets: int = 256) -> DataFrame:
    """``place``: the rank (from 1) by ``draw`` and group within a label, from buckets of the draw and their offsets."""
    df = df.withColumn("bucket", F.floor(F.col("draw") / F.lit(2**32 // buckets)).cast("int"))
    sizes = df.groupBy(label, "bucket").agg(F.count("*").alias("size"))
    sizes = sizes.select(F.col(label).alias("sl"), F.col("bucket").alias("sb"), (F.sum("size").over(W.partitionBy(label).orderBy("bucket")) - F.col("size")).alias("offset"))
    inside = F.row_number().over(W.partitionBy(label, "bucket").orderBy("draw", group))
    return df.withColumn("inside", inside).join(sizes, F.col(label).eqNullSafe(F.col("sl")) & (F.col("bucket") == F.col("sb"))).withColumn("place", F.col("inside") + F.col("offset")).drop("sl", "sb", "bucket", "inside", "offset")


@own_names("group")
def ratio(df: DataFrame, group: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """``group, split``: int(train * n), int(val * n), the rest test, in md5 order."""
    groups = df.select(F.col(group).alias("_group")).distinct().withColumn("draw", draw(seed, "_group")).withColumn("all", F.lit(0))
    n = groups.count()
    a, b = math.floor(train * n + 1e-9), math.floor(val * n + 1e-9)
    place = F.col("place")
    return _ranked(groups, "all", "_group").select(F.col("_group").alias(group), F.when(place <= a, "train").when(place <= a + b, "val").otherwise("test").alias("split"))


@own_names("group", "time")
def time_aware(df: DataFrame, group: str, time: str, val_cut=None, test_cut=None) -> DataFrame:
    """``group, first_time, split``: by each group's earliest time; cuts default to its 50th and 80th percentile."""
    df = df.select(F.col(group).alias("_group"), F.col(time).alias("_time"))
    first = df.groupBy("_group").agg(F.min(F.col("_time").cast("timestamp")).alias("first_time")).withColumn("at", F.unix_micros("first_time").cast("double"))
    micros = lambda t: F.unix_micros(F.lit(t).cast("timestamp")).cast("double")
    if val_cut is None or test_cut is None:
        cuts = percentiles(first, "at", [0.5, 0.8])  # one row
    else:
        cuts = df.sparkSession.range(1)
    cuts = cuts.select(*[(F.col(p) if given is None else micros(given)).alias(c) for c, p, given in (("c1", "p0", val_cut), ("c2", "p1", test_cut))])
    split = F.when(F.col("at") <= F.col("c1"), "train").when(F.col("at") <= F.col("c2"), "val").otherwise("test")
    return first.join(F.broadcast(cuts)).select(F.col("_group").alias(group), "first_time", split.alias("split"))  # one row


@own_names("group", "label", "order")
def kfold(df: DataFrame, group: str, label: str, order: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``group, fold, split, label``: each group is in ``val`` of one fold; labels are spread and begin at different folds."""
    groups = _labelled(df, group, label, order)
    counts = groups.groupBy("_label").agg(F.count("*").alias("n"))
    begin = (F.sum("n").over(W.orderBy(F.asc_nulls_last("_label"))) - F.col("n")).alias("begin")  # a row for each label
    ranked = _ranked(groups.withColumn("draw", draw(seed, "_group")), "_label", "_group")
    joined = ranked.join(counts.select(F.col("_label").alias("l"), begin), F.col("_label").eqNullSafe(F.col("l"))).withColumn("own", F.pmod(F.col("place") - 1 + F.col("begin"), F.lit(k)).cast("int"))
    joined = joined.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return joined.select(F.col("_group").alias(group), "fold", F.when(F.col("own") == F.col("fold"), "val").otherwise("train").alias("split"), F.col("_label").alias(label))


#: Most label values, and most strata, that are dealt on the driver.
CLASSES, STRATA = 1024, 4096
#: Rounds in which groups move between parts.
MOVES = 20


def deal(strata: list[tuple[int, dict[int, float]]], shares: list[float]) -> list[list[int]]:
    """How many groups of each stratum (size, rows of each class in one group) go to each part.

    Each part has its share of a stratum, rounded down. What is left goes out group by group, strata with the
    rarest class first, to the part that gains most: squares of what it lacks of each class, over what it should have. A part
    gets one left group of a stratum at most. Then left groups move, as long as that lessens the squares.
    """
    total: dict[int, float] = {}
    for m, v in strata:
        for c, x in v.items():
            total[c] = total.get(c, 0.0) + m * x
    want = [{c: max(s, 1e-9) * t for c, t in total.items()} for s in shares]
    lack = [{c: s * t for c, t in total.items()} for s in shares]
    out = [[math.floor(m * s + 1e-9) for s in shares] for m, _ in strata]

    def give(f: int, v: dict[int, float], n: int) -> None:
        for c, x in v.items():
            lack[f][c] -= n * x

    def gain(f: int, v: dict[int, float], sign: int = 1) -> float:
        return sum(x * (2 * sign * lack[f][c] - x) / want[f][c] for c, x in v.items())

    for (_, v), counts in zip(strata, out, strict=True):
        for f, n in enumerate(counts):
            give(f, v, n)
    rarest = [min((total[c], c) for c in v) if v else (0.0, 0) for _, v in strata]
    order = sorted(range(len(strata)), key=lambda i: (rarest[i], -strata[i][1].get(rarest[i][1], 0.0), i))
    left: list[set[int]] = [set() for _ in strata]
    for i in order:
        m, v = strata[i]
        for _ in range(m - sum(out[i])):
            f = max(set(range(len(shares))) - left[i], key=lambda f: (round(gain(f, v), 9), -f))
            left[i].add(f)
            out[i][f] += 1
            give(f, v, 1)
    for _ in range(MOVES):
        moved = False
        for i in order:
            v = strata[i][1]
            for f in sorted(left[i]):
                others = sorted(set(range(len(shares))) - left[i])
                if others:
                    to = max(others, key=lambda g: (round(gain(g, v), 9), -g))
                    if gain(to, v) + gain(f, v, -1) > 1e-9:
                        left[i] = left[i] - {f} | {to}
                        out[i][f], out[i][to], moved = out[i][f] - 1, out[i][to] + 1, True
                        give(f, v, -1)
                        give(to, v, 1)
        if not moved:
            break
    return out


def _coarse(v: Column, level: int) -> Column:
    """Counts of a vector of (class, n, total of the class) kept exactly, to two or to one significant bit, or of the rarest class alone to one bit."""

    def bits(n: Column, keep: int) -> Column:
        unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(n)) - keep))
        return (F.floor(n / unit) * unit).cast("long")

    if level == 0:
        return F.transform(v, lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n")))
    if level < 3:
        return F.transform(v, lambda x: F.struct(x["c"].alias("c"), bits(x["n"], 3 - level).alias("n")))
    least = F.array_min(F.transform(v, lambda x: F.struct(x["total"], x["c"], x["n"])))
    return F.array(F.struct(least["c"].alias("c"), bits(least["n"], 1).alias("n")))


@own_names("group", "labels")
def balanced(df: DataFrame, group: str, labels: list[str], shares: list[float], seed: int = 42) -> DataFrame:
    """``group, part``: whole groups in parts so that each part has its share of the rows of every value of every label.

    A group's vector counts its rows for each value of each label. Groups of one vector are a stratum. Strata are dealt on
    the driver (``deal``), a row for each; the groups of a stratum follow by their rank in md5 order, which buckets of the
    order give. More than ``STRATA`` vectors are made alike by rounding their counts to two bits, then one, then by
    the rarest label value of a group alone. NULL labels are a value; more than ``CLASSES`` label values raise.
    """
    long = df.select(F.col(group).alias("_group"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("value")) for i, c in enumerate(labels)])).alias("x")).select("_group", "x.*")
    per = long.groupBy("_group", "i", "value").agg(F.count("*").alias("n"))
    found = per.groupBy("i", "value").agg(F.sum("n").alias("total")).orderBy("i", F.col("value").asc_nulls_first()).limit(CLASSES + 1).collect()
    if len(found) > CLASSES:
        raise ValueError(f"more than {CLASSES} label values")
    classes = df.sparkSession.createDataFrame([(k, r.i, r.value, r.total) for k, r in enumerate(found)], "c int, ci int, cv string, total long")
    named = per.join(F.broadcast(classes), (F.col("i") == F.col("ci")) & F.col("value").eqNullSafe(F.col("cv")))  # CLASSES rows at most
    vectors = written(named.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("c", "n", "total"))).alias("v")))
    for level in range(4):
        placed = vectors.withColumn("stratum", F.to_json(_coarse(F.col("v"), level)))
        if level == 3 or placed.select("stratum").distinct().limit(STRATA + 1).count() <= STRATA:
            break
    sizes = {r.stratum: r.m for r in placed.groupBy("stratum").agg(F.count("*").alias("m")).collect()}
    rows: dict[str, dict[int, float]] = {s: {} for s in sizes}
    for r in placed.select("stratum", F.explode("v").alias("x")).groupBy("stratum", "x.c").agg(F.sum("x.n").alias("n")).collect():
        rows[r.stratum][r.c] = r.n / sizes[r.stratum]
    names = sorted(sizes)
    counts = deal([(sizes[s], rows[s]) for s in names], shares)
    bounds = [(s, [sum(c[: k + 1]) for k in range(len(shares))]) for s, c in zip(names, counts, strict=True)]
    table = df.sparkSession.createDataFrame(bounds, "s string, upto array<long>")
    ranked = _ranked(placed.select("_group", "stratum", draw(seed, "_group").alias("draw")), "stratum", "_group")
    out = ranked.join(table, F.col("stratum") == F.col("s"))
    return out.select(F.col("_group").alias(group), F.size(F.filter("upto", lambda x: x < F.col("place"))).alias("part"))


def balanced_kfold(df: DataFrame, group: str, labels: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """``group, fold, split``: folds of whole groups, each with its share of the rows of every value of every label (``balanced``)."""
    dealt = balanced(df, group, labels, [1 / k] * k, seed).withColumnRenamed("part", "_own")
    spread = dealt.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return spread.select(F.col(group), F.col("_fold").alias("fold"), F.when(F.col("_own") == F.col("_fold"), "val").otherwise("train").alias("split"))


@own_names("group", "label")
def group_kfold(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds by each group's most frequent label (the least on ties)."""
    return kfold(df.groupBy(group).agg(F.mode(label, True).alias(label)).withColumn("_o", F.lit(0)), group, label, "_o", k, seed)


@own_names("by", "fold", "score", frame="scores")
def cv_summary(scores: DataFrame, by: tuple[str, ...] = (), fold: str = "fold", score: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min_by(fold, F.struct(-F.col(score), F.col(fold))).alias("best_fold"))


def overlap(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    return a.select(group).intersect(b.select(group))


def coverage(df: DataFrame, assignment: DataFrame, group: str) -> DataFrame:
    """Groups on one side only, with the side; no rows if the assignment is complete."""
    all_, got = df.select(group).distinct(), assignment.select(group).distinct()
    return all_.exceptAll(got).withColumn("side", F.lit("unassigned")).union(got.exceptAll(all_).withColumn("side", F.lit("unknown")))
