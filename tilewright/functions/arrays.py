"""Vector functions on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """NULL if one of the vectors is zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum, so large scores don't overflow."""
    e = F.transform(v, lambda x: F.exp((x.cast("double") - F.array_max(v).cast("double")) / F.lit(temperature)))
    return F.transform(e, lambda x: x / total(e))


def argmax(v: Column) -> Column:
    """Place (from 0) of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(i: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v).cast("double"))


def zeros(n: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, int) else n)


def bits(flags: Column) -> Column:
    """A long whose bit i is set where flag i is true (up to 63 flags)."""
    return F.aggregate(F.transform(flags, lambda f, i: F.when(f, F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
