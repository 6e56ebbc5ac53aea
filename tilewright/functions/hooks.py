"""User functions over batches or groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeResult


def map_batches(df: DataFrame, fn: Callable, schema, setup: Callable | None = None) -> DataFrame:
    """``fn(frame)`` or ``fn(state, frame)`` on Arrow batches as pandas frames; ``setup`` runs once in each task."""

    def run(batches):
        state = setup() if setup else None
        for pdf in batches:
            yield fn(state, pdf) if setup else fn(pdf)

    return df.mapInPandas(run, schema)


def per_group(df: DataFrame, keys: list[str], fn: Callable, schema) -> DataFrame:
    """``fn(frame)`` for each group; a group has to fit in memory."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def expand(df: DataFrame, column: str, fn: Callable, schema: str, error: str = "error") -> DataFrame:
    """``df`` with the rows that ``fn(value)`` yields for each value of ``column``, one to many, as a lateral join with a table function.

    ``schema`` names the columns of what it yields, tuples of that length. Where it raises, the rows it has yielded stay and one more has NULLs
    and the message in ``error``; elsewhere that is NULL. A value without rows has none. Rows leave as they are made, so a file of many tiles needs no list.
    """
    fields = T.StructType.fromDDL(schema).fields
    full = T.StructType([*fields, T.StructField(error, T.StringType())])

    class Expand:
        @staticmethod
        def analyze(value) -> AnalyzeResult:
            return AnalyzeResult(full)

        def eval(self, value):
            try:
                for row in fn(value):
                    yield (*row, None)
            except Exception as e:  # noqa: BLE001  it becomes a row
                yield (*[None] * len(fields), f"{type(e).__name__}: {e}")

    return df.lateralJoin(udtf(Expand)(F.col(column).outer()))


def fold_groups(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """``keys`` and the rows that ``end(state)`` yields for each group, after ``state = step(state, row)`` over its rows in ``order`` from ``start()``.

    A table function over the table partitioned by the keys: a group passes row by row, so it needn't fit in memory; its state has to.
    """
    full = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(schema).fields])

    class Fold:
        def __init__(self):
            self.key, self.state = None, None

        @staticmethod
        def analyze(table) -> AnalyzeResult:
            return AnalyzeResult(full)

        def eval(self, row):
            if self.key is None:
                self.key, self.state = tuple(row[k] for k in keys), start()
            self.state = step(self.state, row)

        def terminate(self):
            if self.key is not None:
                for out in end(self.state):
                    yield (*self.key, *out)

    return udtf(Fold)(df.asTable().partitionBy(*keys).orderBy(*order))
