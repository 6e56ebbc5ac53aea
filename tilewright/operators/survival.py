"""Survival analysis on rows collapsed to distinct times."""

from __future__ import annotations

from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.names import own_names
from tilewright.operators.prefix import numbered, ranged, running
from tilewright.plans.lineage import written

#: Most cells of time, event and risk that a task counts by itself.
FEW = 1 << 18
#: Parts into which each step of the concordance cuts the order of times.
FAN = 12


@own_names("time", "event", "risk", "by")
def cells(df: DataFrame, time: str, event: str, risk: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    keys = [F.col(time).alias("time"), F.col(event).cast("boolean").alias("event")] + ([F.col(risk).alias("risk")] if risk else [])
    return df.groupBy(*by, *keys).agg(F.count("*").alias("n"))


@own_names("time", "event", "risk")
def comparable_pairs(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Pairs of distinct (time, event, risk) cells that can be compared: the first has the event and the shorter time, or the same time against a censored one.

    All pairs by definition, so for tables with few distinct cells; ``c_index`` counts them without listing them.
    """
    c = cells(df, time, event, risk)
    a, b = c.where("event").alias("a"), c.alias("b")
    later = (F.col("a.time") < F.col("b.time")) | ((F.col("a.time") == F.col("b.time")) & ~F.col("b.event"))
    return a.join(b, later).select(F.col("a.risk").alias("risk_i"), F.col("b.risk").alias("risk_j"), (F.col("a.n") * F.col("b.n")).alias("pairs"))


def concordance(time: np.ndarray, event: np.ndarray, risk: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Concordant pairs (ties in risk half) and comparable pairs of cells.

    Times in order, of one time events first, have places. Two places part at one bit of their
    numbers, so for each bit the rows of lower and equal risk on the far side are sums over the rows
    sorted by (bits above, risk).
    """
    _, place = np.unique(np.stack([np.unique(time, return_inverse=True)[1], ~event], axis=1), axis=0, return_inverse=True)
    place, risk = place.reshape(-1), np.unique(risk, return_inverse=True)[1]
    n, good = n.astype(np.float64), 0.0
    for bit in range(int(place.max(initial=0)).bit_length()):
        node = place >> (bit + 1)
        order = np.lexsort((risk, node))
        node, level, far = node[order], risk[order], (place[order] >> bit & 1).astype(bool)
        upto = np.cumsum(np.where(far, n[order], 0.0))
        begins = lambda *keys: np.maximum.accumulate(np.where(np.any([np.diff(k, prepend=k[:1] - 1) != 0 for k in keys], axis=0), np.arange(len(order)), 0))
        before = np.concatenate([[0.0], upto])
        tie = begins(node, level)
        last = np.concatenate([np.flatnonzero(np.diff(tie)), [len(tie) - 1]])
        until = np.repeat(upto[last], np.diff(np.concatenate([[-1], last])))
        lower, tied = before[tie] - before[begins(node)], until - before[tie]
        good += float(((lower + tied / 2) * np.where(event[order] & ~far, n[order], 0.0)).sum())
    size = np.bincount(place, weights=n)
    later = size.sum() - np.cumsum(size)
    return good, float((later[place] * np.where(event, n, 0.0)).sum())


@own_names("time", "event", "risk", "by")
def c_index(df: DataFrame, time: str, event: str, risk: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Harrell's C, exact, ties in risk counted half; 0.5 without comparable pairs. Rows with a NULL don't count.

    Rows become cells of one time, event and risk first. Up to ``FEW`` cells are counted in a task for each group
    (``concordance``). More: times in order (of one time, events before censored) get places. Each step cuts
    the order, or the parts of the step before, into FAN parts. A pair of places is in
    different parts of one part at just one step, and there the rows of lower and of equal
    risk are sums over the risks in order, a column for each part. log(places) / log(FAN)
    steps, each a running sum by ranges; no table of times and risks, no pairs.
    """
    c = cells(df.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(risk).isNotNull()), time, event, risk, by)
    c = written(c.select(*by, "time", "event", "risk", "n"))
    both = _by_ranges(c, by) if c.count() > FEW else _at_once(c, by)
    return both.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("all")), F.lit(0.5)).alias("c_index"))


def _at_once(c: DataFrame, by: tuple[str, ...]) -> DataFrame:
    def run(key, table):
        import pyarrow as pa

        time, event, risk, n = (table.column(x).to_numpy(zero_copy_only=False) for x in ("time", "event", "risk", "n"))
        good, every = concordance(time, event.astype(bool), risk, n)
        return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip(by, key, strict=True)}, "good": [good], "all": [every]})

    return c.groupBy(*by).applyInArrow(run, T.StructType([*[c.schema[x] for x in by], T.StructField("good", T.DoubleType()), T.StructField("all", T.DoubleType())]))


def _by_ranges(c: DataFrame, by: tuple[str, ...]) -> DataFrame:
    c = c.withColumn("_at", F.struct("time", (~F.col("event")).alias("late")))
    places = numbered(c.select("_at").distinct(), "_at", name="_rank")
    ranked = written(c.join(places, "_at").select(*by, "_rank", "event", "risk", F.col("n").cast("double").alias("n")))
    steps = max(1, ceil(log(max(2, (ranked.agg(F.max("_rank")).first()[0] or 0) + 1)) / log(FAN) - 1e-9))
    parts = range(FAN)
    found = None
    for step in range(steps):
        width = FAN ** (steps - step - 1)
        node, part = F.expr(f"_rank div {width * FAN}").alias("_node"), F.expr(f"(_rank div {width}) % {FAN}")
        own = [F.sum(F.when(part == d, F.col("n")).otherwise(0.0)).alias(f"n{d}") for d in parts]
        events = [F.sum(F.when((part == d) & F.col("event"), F.col("n")).otherwise(0.0)).alias(f"e{d}") for d in parts]
        h = ranked.groupBy(*by, node, "risk").agg(*own, *events)
        h = running(h, "risk", [f"n{d}" for d in parts[1:]], (*by, "_node"))
        good = sum((F.col(f"e{d}") * sum((F.col(f"cum_n{o}") - F.col(f"n{o}") / 2 for o in parts[d + 1 :]), F.lit(0.0)) for d in parts), F.lit(0.0))
        one = h.groupBy(*by).agg(F.sum(good).alias("good"))
        found = one if found is None else found.unionByName(one)
    # all comparable pairs: the rows at later places
    per = ranked.groupBy(*by, "_rank").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("event"), F.col("n")).otherwise(0.0)).alias("e"))
    every = running(per, "_rank", ["n"], by, reverse=True).groupBy(*by).agg(F.sum(F.col("e") * (F.col("cum_n") - F.col("n"))).alias("all"))
    return found.withColumn("all", F.lit(0.0)).unionByName(every.withColumn("good", F.lit(0.0)))


@own_names("time", "event", "by")
def kaplan_meier(df: DataFrame, time: str, event: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``time, at_risk, events, survival``: the product-limit estimate at each event time."""
    t = df.groupBy(*by, F.col(time).alias("time")).agg(F.count("*").alias("at"), F.count_if(F.col(event).cast("boolean")).alias("events"))
    t = running(ranged(t, "time", "_range"), "time", ["at"], by, reverse=True, prefix="risk_", part="_range").where("events > 0")
    t = running(t.withColumn("step", (F.col("risk_at") - F.col("events")) / F.col("risk_at")), "time", ["step"], by, fold="product", part="_range")
    return t.select(*by, "time", F.col("risk_at").alias("at_risk"), "events", F.col("cum_step").alias("survival"))


@own_names("by", frame="curve", fixed=("time", "survival"))
def median(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first time with survival at most one half; infinity if there is none."""
    return curve.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time").cast("double"))), F.lit(float("inf"))).alias("median"))


def at(curve: DataFrame, times: DataFrame, time: str = "time") -> DataFrame:
    """Survival at the last event time not after each asked time; 1 before the first. An as-of join: survival falls, so the least so far is the last."""
    asked = times.select(F.col(time).cast("double").alias("time")).distinct()
    both = curve.select(F.col("time").cast("double").alias("time"), "survival", F.lit(0).alias("ask")).union(asked.select("time", F.lit(None).cast("double"), F.lit(1)))
    return running(both, "time", ["survival"], fold="min").where("ask = 1").select("time", F.least("cum_survival", F.lit(1.0)).alias("survival"))


@own_names("time", "event", "risk")
def brier(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Mean over event times t of the mean over rows at risk of ``((1 - r) - [time = t and event])^2``, risk clipped to [0, 1]; 0 without events."""
    s = 1 - F.least(F.greatest(F.col(risk).cast("double"), F.lit(0.0)), F.lit(1.0))
    own = F.col(event).cast("boolean")
    t = df.groupBy(F.col(time).alias("time")).agg(F.count("*").alias("n"), F.sum(s * s).alias("q"), F.sum(F.when(own, 1 - 2 * s).otherwise(0.0)).alias("d"), F.count_if(own).alias("events"))
    t = running(t, "time", ["n", "q"], reverse=True).where("events > 0")
    return t.agg(F.coalesce(F.avg((F.col("cum_q") + F.col("d")) / F.col("cum_n")), F.lit(0.0)).alias("brier"))


@own_names("time", "event", "risk")
def cox_partial(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Mean over events of ``log(sum of exp(r) over rows still at risk + 1e-8) - r``."""
    own = F.col(event).cast("boolean")
    t = df.groupBy(F.col(time).alias("time")).agg(F.sum(F.exp(risk)).alias("e"), F.count_if(own).alias("events"), F.sum(F.when(own, F.col(risk).cast("double"))).alias("r"))
    t = running(t, "time", ["e"], reverse=True).where("events > 0")
    return t.agg(F.coalesce(F.try_divide(F.sum(F.col("events") * F.log(F.col("cum_e") + 1e-8) - F.col("r")), F.sum("events").cast("double")), F.lit(0.0)).alias("cox_loss"))
