"""Classification metrics from one aggregate each: histograms and confusion cells, never row lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.names import own_names
from tilewright.operators.prefix import running


def join_predictions(truth: DataFrame, predictions: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Predictions by key; with ``check``, repeated keys or gaps raise."""
    if check:
        n, distinct = predictions.agg(F.count(key), F.count_distinct(key)).first()
        if n != distinct:
            raise ValueError("a key has two predictions")
        if not truth.join(predictions, key, "left_anti").isEmpty():
            raise ValueError("a row has no prediction")
    return truth.join(predictions, key)


@own_names("y", "score", "by")
def histogram(df: DataFrame, y: str = "y_true", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """``pos`` and ``neg`` of each distinct score."""
    return df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


@own_names("y", "score", "by")
def auroc(df: DataFrame, y: str = "y_true", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL where a class is absent."""
    run = running(histogram(df, y, score, by), score, ["neg"], by)
    part = F.col("pos") * (F.col("cum_neg") - F.col("neg") / F.lit(2.0))
    return run.groupBy(*by).agg(F.try_divide(F.sum(part), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


def auroc_ovr(df: DataFrame, proba: str = "proba", y: str = "y_true", average: str = "macro") -> DataFrame:
    """One-vs-rest: ``class, auroc`` rows are averaged over the defined classes, or pooled (``micro``)."""
    long = df.select(F.col(y).alias("_y"), F.posexplode(proba).alias("class", "score")).withColumn("hit", (F.col("_y") == F.col("class")).cast("int"))
    if average == "micro":
        return auroc(long, "hit", "score")
    return auroc(long, "hit", "score", ("class",)).agg(F.avg("auroc").alias("auroc"))


def auroc_by_class(df: DataFrame, proba: str = "proba", y: str = "y_true") -> DataFrame:
    long = df.select(F.col(y).alias("_y"), F.posexplode(proba).alias("class", "score")).withColumn("hit", (F.col("_y") == F.col("class")).cast("int"))
    return auroc(long, "hit", "score", ("class",))


def _descending(df, y, score, by):
    """Counts of each distinct score with those at or above it, and of all (``_P``, ``_N``)."""
    h = running(histogram(df, y, score, by), score, ["pos", "neg"], by, reverse=True)
    whole = h.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    if not by:
        return h.join(F.broadcast(whole))  # one row
    whole = whole.select(*[F.col(c).alias(f"_w_{c}") for c in by], "_P", "_N")
    return h.join(whole, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in by]))


@own_names("y", "score", "by")
def roc_curve(df: DataFrame, y: str = "y_true", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score, descending."""
    h = _descending(df, y, score, by)
    return h.select(*by, F.col(score).alias("threshold"), F.try_divide("cum_neg", "_N").alias("fpr"), F.try_divide("cum_pos", "_P").alias("tpr"))


@own_names("y", "score", "by")
def pr_curve(df: DataFrame, y: str = "y_true", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """``threshold, precision, recall`` per distinct score, and the end point (recall 0, precision 1, threshold NULL)."""
    h = _descending(df, y, score, by)
    curve = h.select(*by, F.col(score).cast("double").alias("threshold"), (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"), F.try_divide("cum_pos", "_P").alias("recall"))
    end = (h.select(*by).distinct() if by else h.sparkSession.range(1).select()).select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


@own_names("y", "score", "by")
def auprc(df: DataFrame, y: str = "y_true", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoids under the precision-recall curve, closed at (0, 1)."""
    pos, neg = F.col("cum_pos"), F.col("cum_neg")
    last_pos, last_neg = pos - F.col("pos"), neg - F.col("neg")  # at the score before
    height = pos / (pos + neg) + F.coalesce(F.try_divide(last_pos, last_pos + last_neg), F.lit(1.0))
    return _descending(df, y, score, by).groupBy(*by).agg(F.sum(F.try_divide("pos", "_P") * height / 2).alias("auprc"))


@own_names("y", "yhat")
def confusion(df: DataFrame, y: str = "y_true", yhat: str = "y_pred", normalize: bool = False) -> DataFrame:
    """``y_true, y_pred, n`` for every pair of labels that occur on either side; ``share`` of the row if normalised."""
    counts = df.groupBy(F.col(y).alias("y_true"), F.col(yhat).alias("y_pred")).agg(F.count("*").alias("n"))
    labels = counts.select(F.col("y_true").alias("label")).union(counts.select("y_pred")).distinct()
    grid = labels.select(F.col("label").alias("y_true")).join(F.broadcast(labels.select(F.col("label").alias("y_pred"))))  # labels x labels
    out = grid.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if not normalize:
        return out
    return out.withColumn("share", F.coalesce(F.try_divide("n", F.sum("n").over(W.partitionBy("y_true"))), F.lit(0.0)))


@own_names("y", "yhat")
def class_scores(df: DataFrame, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """``label, support, predicted, hit, recall, precision, f1`` over the union of labels; 0 where undefined."""
    cells = df.groupBy(F.col(y).alias("t"), F.col(yhat).alias("p")).agg(F.count("*").alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    per = both.groupBy("label").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hit"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumns({"recall": safe(F.col("hit"), F.col("support")), "precision": safe(F.col("hit"), F.col("predicted"))})
    return per.withColumn("f1", safe(2 * F.col("hit"), F.col("support") + F.col("predicted")))


@own_names("y", "yhat")
def classification(df: DataFrame, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """Accuracy, balanced accuracy (mean recall of the true classes present), F1 macro, micro and weighted."""
    c = class_scores(df, y, yhat)
    n = F.sum("support")
    return c.agg(
        (F.sum("hit") / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
        (2 * F.sum("hit") / (F.sum("support") + F.sum("predicted"))).alias("f1_micro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
    )


@own_names("y", "yhat")
def binary_rates(df: DataFrame, y: str = "y_true", yhat: str = "y_pred", check: bool = True) -> DataFrame:
    """Sensitivity, specificity, PPV and NPV, 0 on an empty denominator; other than two true labels raise."""
    if check and df.select(y).distinct().count() != 2:
        raise ValueError("binary rates need exactly two labels")
    n = lambda t, p: F.count_if((F.col(y) == t) & (F.col(yhat) == p))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fn, fp, tn = n(1, 1), n(1, 0), n(0, 1), n(0, 0)
    return df.agg(safe(tp, tp + fn).alias("sensitivity"), safe(tn, tn + fp).alias("specificity"), safe(tp, tp + fp).alias("ppv"), safe(tn, tn + fn).alias("npv"))


@own_names("y", "score")
def validate(df: DataFrame, y: str = "y_true", score: str = "score") -> DataFrame:
    """Warnings as one row of flags."""
    sizes = df.groupBy(y).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(F.col(score) * F.col(score)).alias("q"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    n = F.sum("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / n - (F.sum("s") / n) * (F.sum("s") / n)))
    return sizes.agg((F.count("*") == 1).alias("one_class"), (F.min("n") < 5).alias("small_class"), (spread < 1e-8).alias("constant_score"), ((F.min("lo") < 0) | (F.max("hi") > 1)).alias("outside_unit"))


def by_stratum(df: DataFrame, strata: list[str], y: str = "y_true", yhat: str = "y_pred", score: str = "score") -> DataFrame:
    """AUROC and accuracy overall and for each value of each stratum column (grouping sets, one expansion)."""
    tags = F.array(F.struct(F.lit("all").alias("stratum"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("stratum"), F.col(c).cast("string").alias("value")) for c in strata])
    long = df.withColumn("_t", F.explode(tags)).select("_t.*", F.col(y).alias("_y"), F.col(yhat).alias("_yhat"), F.col(score).alias("_score"))
    by = ("stratum", "value")
    acc = long.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("_y") == F.col("_yhat")).cast("double")).alias("accuracy"))
    return acc.join(auroc(long, "_y", "_score", by), list(by))
