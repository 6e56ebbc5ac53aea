"""Models on Spark's own estimators, and Cox regression by Newton steps."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import metrics, survival
from tilewright.operators.prefix import running
from tilewright.plans.lineage import written


def _pipeline(features: list[str], estimator):
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="features"), estimator])


def fit_lr(train: DataFrame, features: list[str], label: str = "label", **kw):
    return _pipeline(features, LogisticRegression(labelCol=label, maxIter=100, **kw)).fit(train)


def fit_rf(train: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 10, seed: int = 42):
    return _pipeline(features, RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)).fit(train)


def fit_svm_linear(train: DataFrame, features: list[str], label: str = "label", **kw):
    return _pipeline(features, LinearSVC(labelCol=label, **kw)).fit(train)


def predict_proba(model, df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with ``score``, the probability of class 1 (of a linear SVM: the margin's logistic), and ``y_true``, ``y_pred``."""
    out = model.transform(df)
    score = F.element_at(vector_to_array("probability"), 2) if "probability" in out.columns else 1 / (1 + F.exp(-F.element_at(vector_to_array("rawPrediction"), 2)))
    return out.select(*df.columns, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), score.alias("score"))


def evaluate(model, df: DataFrame, label: str = "label") -> DataFrame:
    """AUROC, accuracy and macro F1 of a fitted model, one row."""
    scored = written(predict_proba(model, df, label).select("y_true", "y_pred", "score"))
    return metrics.auroc(scored).join(metrics.classification(scored).select("accuracy", "f1_macro"))  # one row each


def importance(model, features: list[str], spark) -> DataFrame:
    """``feature, importance``: absolute coefficients of a linear model, impurity decrease of a forest; the largest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    rows = sorted(zip(features, map(float, values), strict=True), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def lasso_select(train: DataFrame, features: list[str], label: str, alpha: float = 0.01) -> list[str]:
    """Features with a coefficient other than zero under an L1 penalty on scaled features."""
    model = _pipeline(features, LinearRegression(labelCol=label, regParam=alpha, elasticNetParam=1.0)).fit(train)
    return [f for f, c in zip(features, model.stages[-1].coefficients, strict=True) if c != 0]


def fit_aft(train: DataFrame, features: list[str], time: str = "time", event: str = "event"):
    """A Weibull accelerated failure time model."""
    rows = train.withColumn("_censor", F.col(event).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), AFTSurvivalRegression(labelCol=time, censorCol="_censor")]).fit(rows)


def cv_search(df: DataFrame, features: list[str], grid, estimator, fold: str = "fold", label: str = "label") -> dict:
    """The same parameters scored on every fold: best parameters, mean and deviation of each candidate. A fold whose other folds have one class raises."""
    cell = [tuple(r) for r in df.select(fold, label).distinct().collect()]  # folds x classes
    names = {f for f, _ in cell}
    if any(len({y for g, y in cell if g != f}) < 2 for f in names):
        raise ValueError("a fold's training rows have one class only")
    folds = len(names)
    cv = CrossValidator(estimator=_pipeline(features, estimator), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, foldCol=fold)
    model = cv.fit(df)
    best = int(np.argmax(model.avgMetrics))
    return {"best": {p.name: v for p, v in grid[best].items()}, "mean": model.avgMetrics, "std": model.stdMetrics, "model": model.bestModel}


def random_grid(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` parameter maps for ``cv_search``. ``space``: a list to choose from, or (low, high) or (low, high, "log") to draw from, for each parameter."""
    rng = np.random.default_rng(seed)

    def drawn(v):
        if isinstance(v, list):
            return v[int(rng.integers(len(v)))]
        if len(v) == 3:
            return float(np.exp(rng.uniform(np.log(v[0]), np.log(v[1]))))
        return float(rng.uniform(v[0], v[1]))

    return [{p: drawn(v) for p, v in space.items()} for _ in range(n)]


class Cox:
    """Proportional hazards with Breslow ties: each Newton step is one aggregate by time and its suffix sums."""

    def __init__(self, features: list[str], l2: float = 0.0, steps: int = 20):
        self.features, self.l2, self.steps = features, l2, steps
        self.coef = np.zeros(len(features))

    def _risk(self):
        return sum((F.col(f) * F.lit(float(b)) for f, b in zip(self.features, self.coef, strict=True)), F.lit(0.0))

    def fit(self, df: DataFrame, time: str = "time", event: str = "event") -> Cox:
        p = len(self.features)
        own = F.col(event).cast("boolean")
        df = written(df.select(time, event, *self.features))  # read once a step
        for _ in range(self.steps):
            e = F.exp(self._risk())
            pairs = [(i, j) for i in range(p) for j in range(i, p)]
            aggs = [F.sum(e).alias("s0"), F.count_if(own).alias("d"), *[F.sum(e * F.col(f)).alias(f"s1_{i}") for i, f in enumerate(self.features)]]
            aggs += [F.sum(F.when(own, F.col(f)).otherwise(0.0)).alias(f"x_{i}") for i, f in enumerate(self.features)]
            aggs += [F.sum(e * F.col(self.features[i]) * F.col(self.features[j])).alias(f"s2_{i}_{j}") for i, j in pairs]
            t = df.groupBy(F.col(time).alias("t")).agg(*aggs)
            sums = ["s0", *[f"s1_{i}" for i in range(p)], *[f"s2_{i}_{j}" for i, j in pairs]]
            t = running(t, "t", sums, reverse=True).where("d > 0").select("d", *[f"x_{i}" for i in range(p)], *[F.col(f"cum_{c}").alias(c) for c in sums])
            r = t.agg(
                *[F.sum(F.col(f"x_{i}") - F.col("d") * F.col(f"s1_{i}") / F.col("s0")).alias(f"g{i}") for i in range(p)],
                *[F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - F.col(f"s1_{i}") * F.col(f"s1_{j}") / (F.col("s0") * F.col("s0")))).alias(f"h{i}_{j}") for i, j in pairs],
            ).first()  # p gradients and p * (p + 1) / 2 curvatures
            g = np.array([r[f"g{i}"] or 0.0 for i in range(p)]) - self.l2 * self.coef
            h = np.zeros((p, p))
            for i, j in pairs:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"] or 0.0
            step = np.linalg.solve(h + (self.l2 + 1e-12) * np.eye(p), g)
            self.coef = self.coef + step
            if np.abs(step).max() < 1e-8:
                break
        return self

    def predict(self, df: DataFrame, name: str = "hazard") -> DataFrame:
        return df.withColumn(name, F.exp(self._risk()))

    def baseline(self, df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
        """``time, hazard, survival``: Breslow's cumulative baseline."""
        t = df.groupBy(F.col(time).alias("time")).agg(F.sum(F.exp(self._risk())).alias("e"), F.count_if(F.col(event).cast("boolean")).alias("d"))
        t = running(t, "time", ["e"], reverse=True).where("d > 0").withColumn("hazard", F.col("d") / F.col("cum_e"))
        t = running(t, "time", ["hazard"])
        return t.select("time", F.col("cum_hazard").alias("hazard"), F.exp(-F.col("cum_hazard")).alias("survival"))

    def survival_at(self, df: DataFrame, baseline: DataFrame, times: list[float], key: str) -> DataFrame:
        """``key, time, survival`` of each row at each time: the baseline's survival to the power of the row's hazard."""
        asked = df.sparkSession.createDataFrame([(float(t),) for t in times], "time double")
        base = survival.at(baseline, asked)  # a row for each asked time
        return self.predict(df, "_hazard").select(key, "_hazard").join(F.broadcast(base)).select(key, "time", F.pow("survival", "_hazard").alias("survival"))

    def c_index(self, df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
        """Concordance of the fitted risk."""
        return survival.c_index(df.withColumn("_risk", self._risk()), time, event, "_risk")
