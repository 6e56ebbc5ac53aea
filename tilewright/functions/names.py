"""Keeping an operator's own column names apart from those of its input."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Names of the input's columns inside an operator.
INSIDE = "in__"
#: Operators that are safe from their input's names, by module and name.
SAFE: dict[str, Callable] = {}


def own_names(*columns: str, frame: str = "df", fixed: tuple[str, ...] = ()):
    """Decorates ``fn(frame, ...)`` whose parameters ``columns`` name columns of the frame (a name, a list or tuple of names, or a dict by name).

    Inside, the input's columns have reserved names, and so have the parameters; outside,
    the result has the input's names again. Columns that the operator reads by a name of its own (``fixed``) keep
    it. A result column of the operator that is named like a column of the input beside it gets ``_`` at its end.
    """

    def wrap(fn):
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def safe(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            df = bound.arguments[frame]
            inside = [c if c in fixed else f"{INSIDE}{i}" for i, c in enumerate(df.columns)]
            of = dict(zip(df.columns, inside, strict=True))
            lower = {c.lower(): n for c, n in of.items()}

            def name(c):
                found = of.get(c) or lower.get(c.lower())
                if found is None:
                    raise ValueError(f"missing columns {[c]}; there are {df.columns}")
                return found

            for p in columns:
                v = bound.arguments[p]
                if isinstance(v, dict):
                    bound.arguments[p] = {name(c): x for c, x in v.items()}
                elif v is not None:
                    bound.arguments[p] = name(v) if isinstance(v, str) else type(v)(name(c) for c in v)
            bound.arguments[frame] = df.toDF(*inside)
            out = fn(*bound.args, **bound.kwargs)
            return out.toDF(*_outside(out.columns, {n: c for c, n in of.items()})) if isinstance(out, DataFrame) else out

        SAFE[f"{fn.__module__.rpartition('.')[2]}.{fn.__name__}"] = safe
        return safe

    return wrap


def _outside(found: list[str], back: dict[str, str]) -> list[str]:
    taken = {back[c].lower() for c in found if c.startswith(INSIDE)}
    out = []
    for c in found:
        if c.startswith(INSIDE):
            out.append(back[c])
            continue
        if c not in back:  # the operator's own
            while c.lower() in taken:
                c += "_"
        out.append(c)
    return out
