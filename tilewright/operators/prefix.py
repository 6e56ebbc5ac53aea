"""Running folds, places, last values and percentiles over a global order without a single partition.

An order is cut into ranges at bounds that come from the rows themselves, by a sample that a hash chooses. A row's range
is an expression of its values, so rows need no writing and plans stay lazy. Each range folds its own rows; the folds of the
ranges before, a row for each range, are joined to it.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.names import own_names

#: The fold of a range's rows, how two folds combine, and the fold of nothing.
FOLDS = {"sum": (F.sum, lambda a, b: a + b, 0), "product": (F.product, lambda a, b: a * b, 1.0), "min": (F.min, F.least, float("inf")), "max": (F.max, F.greatest, float("-inf"))}
#: Least and most groups of bounds, and bounds in a group: the square is about how many ranges there are, twice the shuffle partitions.
SIDES = (12, 256)


def _bounds(df: DataFrame, order: str, side: int) -> DataFrame:
    """One row: ``_b``, the bounds as a few lists of a few values, each list in order and all lists in order.

    Of each bucket of a hash of the order's values the one with the least other hash, so any
    type that can be sorted has bounds, equal values count once and the sample is bounded.
    """
    h = lambda seed: F.xxhash64(F.lit(seed), F.col(order))
    one = df.where(F.col(order).isNotNull()).groupBy(F.pmod(h(1), F.lit(side * side)).alias("_h")).agg(F.min_by(order, h(2)).alias("_v"))
    every = one.agg(F.sort_array(F.collect_list("_v")).alias("_v"))
    lists = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice("_v", i * side + 1, F.lit(side)))
    return every.select(lists.alias("_b"))


def _range_of(value: Column, bounds: Column, side: int) -> Column:
    """How many bounds are below a value: first the list, then the place in it. NULL comes first."""
    row = F.size(F.filter(bounds, lambda b: (F.size(b) > 0) & (F.get(b, F.lit(0)) < value)))
    inside = F.size(F.filter(F.get(bounds, row - 1), lambda x: x < value))
    return F.when(value.isNull(), -1).when(row == 0, 0).otherwise((row - 1) * side + inside)


def ranged(df: DataFrame, order: str, name: str = "_part") -> DataFrame:
    """``df`` with the number of each row's range; ranges are in the order of ``order``, equal values in one, NULL before all."""
    wanted = ceil(sqrt(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    side = min(max(wanted, SIDES[0]), SIDES[1])
    return df.join(F.broadcast(_bounds(df, order, side))).withColumn(name, _range_of(F.col(order), F.col("_b"), side)).drop("_b")  # one row


def _offsets(dealt: DataFrame, by: tuple[str, ...], folds: list, reverse: bool = False) -> DataFrame:
    """``dealt`` with ``_o_<name>``: the fold of the ranges before, of the same ``by``. A row for each range and ``by`` value is joined."""
    totals = dealt.groupBy(*by, "_part").agg(*[fold(value).alias(f"_t_{name}") for name, value, fold, _, _ in folds])
    before = W.partitionBy(*by).orderBy(F.desc("_part") if reverse else F.asc("_part")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_part").alias("_p"), *[F.coalesce(fold(f"_t_{name}").over(before), F.lit(empty)).alias(f"_o_{name}") for name, _, fold, _, empty in folds])
    return dealt.join(offsets, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_b_{c}")), by, F.col("_part") == F.col("_p")))


def running(df: DataFrame, order: str, values: list[str], by: tuple[str, ...] = (), reverse: bool = False, prefix: str = "cum_", fold: str = "sum", part: str | None = None) -> DataFrame:
    """``cum_<value>`` of each row: the fold of the rows up to and with its order value, within ``by``.

    Each range folds its own rows and combines the folds of the ranges before it, so
    neither an order without ``by`` nor a ``by`` value with most rows is in one task. ``part`` names a column that has
    the ranges already, from ``ranged``.
    """
    at = {c: f"in__{i}" for i, c in enumerate(df.columns)}
    make, combine, empty = FOLDS[fold]
    key = F.col(at[order]).desc() if reverse else F.col(at[order]).asc()
    groups = tuple(at[c] for c in by)
    own = W.partitionBy(*groups, "_part").orderBy(key).rangeBetween(W.unboundedPreceding, W.currentRow)
    folds = [(at[v], F.col(at[v]), make, combine, empty) for v in values]
    inside = df.toDF(*at.values())
    inside = ranged(inside, at[order]) if part is None else inside.withColumn("_part", F.col(at[part]))
    out = _offsets(inside, groups, folds, reverse)
    out = out.withColumns({f"_s_{at[v]}": make(at[v]).over(own) for v in values})
    return out.select(*[F.col(n).alias(c) for c, n in at.items()], *[combine(F.col(f"_s_{at[v]}"), F.col(f"_o_{at[v]}")).alias(prefix + v) for v in values])


def running_sum(df: DataFrame, order: str, values: list[str], by: tuple[str, ...] = (), reverse: bool = False, prefix: str = "cum_") -> DataFrame:
    """``running`` with sums."""
    return running(df, order, values, by, reverse, prefix)


def numbered(df: DataFrame, key: str, by: tuple[str, ...] = (), name: str = "place", ties: list[Column] | None = None) -> DataFrame:
    """``place`` from 0 in the order of ``key``, within ``by``. Keys are unique, or ``ties`` orders those that are equal."""
    at = {c: f"in__{i}" for i, c in enumerate(df.columns)}
    groups = tuple(at[c] for c in by)
    out = ranged(df.toDF(*at.values()), at[key]) if ties is None else ranged(df.withColumns({f"_tie{i}": t for i, t in enumerate(ties)}).toDF(*at.values(), *[f"_tie{i}" for i in range(len(ties))]), at[key])
    out = _offsets(out, groups, [("rows", F.lit(1), *FOLDS["sum"])])
    inside = F.row_number().over(W.partitionBy(*groups, "_part").orderBy(at[key], *[f"_tie{i}" for i in range(len(ties or ()))])) - 1
    return out.withColumn("_i", inside).select(*[F.col(n).alias(c) for c, n in at.items()], (F.col("_i") + F.col("_o_rows")).alias(name))


@own_names("value", "by")
def percentiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` and ``p0``, ``p1`` ...: exact percentiles with linear interpolation, from the counts of distinct values. NULL doesn't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    run = running(counts, "_v", ["_n"], by)
    total = run.groupBy(*by).agg(F.max("cum__n").alias("_all"))
    run = run.join(total, list(by)) if by else run.join(F.broadcast(total))  # one row
    out = []
    for i, share in enumerate(shares):
        at = (F.col("_all") - 1) * F.lit(float(share))
        first = F.col("cum__n") - F.col("_n")
        holds = lambda p, first=first: (first <= p) & (p < F.col("cum__n"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col("_v"))), F.max(F.when(holds(F.ceil(at)), F.col("_v")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"p{i}"))
    return run.groupBy(*by).agg(*out)


def asof(left: DataFrame, right: DataFrame, time: str, values: list[str], by: tuple[str, ...] = (), tolerance: float | None = None, exact: bool = True, order: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with the right side's ``values`` at the last right time not after its own (before it, if not ``exact``), and that time as ``<time>_right``.

    Within ``by``; both sides have ``time`` and ``by``. With ``tolerance`` (seconds for timestamps, else in the unit of the time) an older right row
    doesn't count. Of right rows at one time the last by ``order``, then by all values, counts. Left rows without one have NULLs; a
    NULL time has none and is none; NULL in ``by`` matches NULL. A last-value fold: ranges of time hold their own last right row and take
    over the last of the ranges before, so neither a hot key nor all rows are in one task; there is no join of rows with rows.
    """
    of_left = {c: f"in__{i}" for i, c in enumerate(left.columns)}
    keys = [f"_by{i}" for i in range(len(by))]
    kind = left.schema[time].dataType
    found = F.struct(F.col(time).cast(kind).alias("_time"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)])
    tie = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values])
    r = right.where(F.col(time).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(time).cast(kind).alias("_t"), F.lit(0 if exact else 1).alias("_side"), tie.alias("_tie"), found.alias("_found"))
    r = r.groupBy(*keys, "_t", "_side").agg(F.max_by("_found", "_tie").alias("_found"))
    row = F.struct(*[F.col(c).alias(n) for c, n in of_left.items()])
    a = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(time).alias("_t"), F.lit(1 if exact else 0).alias("_side"), row.alias("_row"))
    both = ranged(a.unionByName(r, allowMissingColumns=True).withColumn("_o", F.struct("_t", "_side")), "_o")
    last = both.groupBy(*keys, "_part").agg(F.max_by("_found", F.when(F.col("_found").isNotNull(), F.col("_o"))).alias("_last"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    carried = last.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("_part").alias("_p"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_c{k}")), keys, F.col("_part") == F.col("_p"))
    inside = W.partitionBy(*keys, "_part").orderBy("_o").rangeBetween(W.unboundedPreceding, W.currentRow)
    out = both.join(carried, same).withColumn("_hit", F.coalesce(F.last("_found", ignorenulls=True).over(inside), F.col("_carried"))).where("_row IS NOT NULL")
    hit = F.col("_t").isNotNull()
    if tolerance is not None:
        number = (lambda c: F.unix_micros(c.cast("timestamp")) / 1e6) if kind.typeName() in ("timestamp", "timestamp_ntz", "date") else (lambda c: c.cast("double"))
        hit = hit & (number(F.col("_t")) - number(F.col("_hit._time")) <= tolerance)
    pick = lambda c: F.when(hit, F.col(f"_hit.{c}"))
    return out.select(*[F.col(f"_row.{n}").alias(c) for c, n in of_left.items()], *[pick(f"_v{i}").alias(c) for i, c in enumerate(values)], pick("_time").alias(f"{time}_right"))
