"""Deterministic draws and the missing-value rule that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def require_columns(df, *names: str) -> None:
    """Raise before any job runs if a column is absent."""
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"missing columns {gone}; there are {df.columns}")


def draw(seed: str | int, *keys: str | Column) -> Column:
    """A number from 0 to 2**32 - 1 that depends on seed and keys alone: the first 8 digits of an md5."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def is_missing(c: Column) -> Column:
    """NULL, NaN and infinities are missing."""
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))


def present(c: Column) -> Column:
    """The value as a double, or NULL where it is missing."""
    return F.when(~is_missing(c), c.cast("double"))
