"""Every operator gives the same rows whatever its input's columns are called, its own internal names included."""

import ast
import importlib
import inspect
import re
import textwrap

import pytest

from tilewright.functions import names
from tilewright.operators import calibration, dedup, explain, losses, metrics, prefix, radiomics, report, sampling, splits, survival, trials, vectors

ROLES = {
    "key": "slide", "slide": "slide", "group": "slide", "run": "slide", "sample": "slide", "line": "slide", "modality": "slide", "trial": "id",
    "time": "when", "event": "happened", "risk": "danger", "y": "truth", "yhat": "guess", "score": "danger", "label": "truth", "order": "id", "tie": "id",
    "weight": "danger", "value": "danger", "metric": "danger", "loss": "danger", "epoch": "id", "name": "id", "fold": "truth", "split": "part", "vector": "bag", "proba": "bag", "coords": ["id"],
    "x": "when", "y_": "level", "feature": "id", "coef": "danger", "level": "level", "p": "danger", "t": "when", "diff": "note", "text": "note", "hash_col": "id", "columns": ["danger", "when"], "labels": ["truth", "guess"], "by": ("part",),
}
OTHER = {"splits.balanced": {"shares": [0.5, 0.5]}, "explain.heatmap": {"height": 40, "width": 30, "y": "level"}, "sampling.bootstrap_simple": {"n": 3, "key": "id"}, "sampling.bootstrap_stratified": {"n": 3, "key": "id"}, "sampling.poisson": {"n": 3, "key": "id"}, "sampling.bootstrap_group": {"n": 3}, "sampling.replicates": {"n": 3}, "trials.early_stop": {"patience": 2}, "trials.retain": {"max_keep": 2}, "vectors.top_k_norm": {"k": 2}, "vectors.sample_k": {"k": 2}, "vectors.two_tier_pool": {"centres": [[1.0, 0.0], [0.0, 1.0]]}, "vectors.moment_match": {"reference": "s0"}, "dedup.text_simhash": {"key": "id"}, "dedup.hamming_pairs": {"key": "id", "threshold": 2}, "dedup.clusters": {"key": "id", "threshold": 2}, "radiomics.runs": {}, "prefix.percentiles": {"shares": [0.3, 0.5]}}
MODULES = [calibration, dedup, explain, losses, metrics, prefix, radiomics, report, sampling, splits, survival, trials, vectors]
COLUMNS = ["id", "slide", "part", "when", "happened", "danger", "truth", "guess", "level", "note", "bag", *[f"more{i}" for i in range(14)]]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, f"s{i % 3}", f"p{i % 2}", float((i * 7) % 12), i % 3 != 0, ((i * 5) % 11) / 11, i % 2, (i // 2) % 2, float(i % 4), f"word{i % 5} and", [float(i % 3), float(i % 5) / 4], *range(14)) for i in range(24)]
    quick = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}  # many small plans
    before = {k: spark.conf.get(k) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield spark.createDataFrame(rows, "id long, slide string, part string, when double, happened boolean, danger double, truth int, guess int, level double, note string, bag array<double>, " + ", ".join(f"more{i} int" for i in range(14))).coalesce(1).cache()
    for k, v in before.items():
        spark.conf.set(k, v)


def internal(fn) -> list[str]:
    """Names that may be columns in an operator's code and in the code of what it calls."""
    module, seen, todo, found = inspect.getmodule(fn), set(), [fn], set()
    while todo:
        f = inspect.unwrap(todo.pop())
        if f in seen:
            continue
        seen.add(f)
        source = textwrap.dedent(inspect.getsource(f))
        found.update(n.value for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Constant) and isinstance(n.value, str) and re.fullmatch(r"[A-Za-z_]\w{0,14}", n.value))
        for name in set(re.findall(r"\b([a-z_]+)\(", source)):
            other = getattr(module, name, None)
            if inspect.isfunction(other):
                todo.append(other)
    return sorted(found)


def call(name, fn, df, called):
    given = {}
    for p in inspect.signature(fn).parameters.values():
        role = ROLES.get("y_" if name == "explain.heatmap" and p.name == "y" else p.name)
        if role is not None:
            given[p.name] = role
    given |= OTHER.get(name, {})
    to = lambda v: called.get(v, v) if isinstance(v, str) else type(v)(called.get(x, x) for x in v) if isinstance(v, (list, tuple)) and v and isinstance(v[0], str) else v
    columns = {p for p in given if p in ROLES or p == "y"}
    return fn(df, **{p: to(v) if p in columns else v for p, v in given.items()})


CHECKED = sorted(n for n in names.SAFE if n not in ("survival.median",))


@pytest.mark.parametrize("name", CHECKED)
def test_any_names(spark, table, name):
    fn = names.SAFE[name]
    short = lambda v: round(v, 9) if isinstance(v, float) else [short(x) for x in v] if isinstance(v, list) else v
    rows = lambda df: sorted(repr([short(v) for v in r]) for r in df.collect())
    want = rows(call(name, fn, table, {}))
    own = internal(fn)
    spread = [own[i :: max(1, -(-len(own) // len(COLUMNS)))] for i in range(max(1, -(-len(own) // len(COLUMNS))))]
    for k, part in enumerate(spread):
        part = list({x.lower(): x for x in part[k:] + part[:k]}.values())
        called = dict(zip(COLUMNS, [*part, *COLUMNS[len(part) :]], strict=False))
        if len({c.lower() for c in called.values()}) < len(COLUMNS):  # a name that is also one of the others
            called = {c: n if n == called[c] and n in part else f"other_{c}" for c, n in called.items()} | {c: n for c, n in called.items() if n in part}
        assert rows(call(name, fn, table.toDF(*[called[c] for c in COLUMNS]), called)) == want, called


def test_all_modules_are_covered():
    assert {n.partition(".")[0] for n in names.SAFE} == {m.__name__.rpartition(".")[2] for m in MODULES}
    assert all(importlib.import_module(m.__name__) for m in MODULES)


def test_cases_that_were_wrong(spark, table):
    """Groups named like columns of the operator: the same curves."""
    plain = survival.kaplan_meier(table, "when", "happened", ("slide",))
    for group in ("step", "at", "events", "time", "_part", "survival"):
        got = survival.kaplan_meier(table.withColumnRenamed("slide", group), "when", "happened", (group,))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
        assert got.columns[0] == group and len({c.lower() for c in got.columns}) == len(got.columns)
    plain = survival.c_index(table, "when", "happened", "danger", ("slide",)).collect()
    for group in ("_at", "n", "good", "all"):
        got = survival.c_index(table.withColumnRenamed("slide", group), "when", "happened", "danger", (group,)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, plain))
    curve = survival.kaplan_meier(table, "when", "happened", ("slide",))
    assert sorted(map(tuple, survival.median(curve, ("slide",)).collect())) == sorted(map(tuple, survival.median(curve.withColumnRenamed("slide", "median"), ("median",)).collect()))


def test_concordance_both_ways(spark, table, monkeypatch):
    """Few cells in a task and many by ranges count the same pairs."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(60) / 4, rng.random() < 0.6, rng.randrange(15)) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, t double, e boolean, r int")
    once = {r.g: r.c_index for r in survival.c_index(df, "t", "e", "r", ("g",)).collect()}
    monkeypatch.setattr(survival, "FEW", 10)
    ranges = {r.g: r.c_index for r in survival.c_index(df, "t", "e", "r", ("g",)).collect()}
    for g in "ab":
        own = [x[1:] for x in rows if x[0] == g]
        pairs = [(a[2], b[2]) for a in own for b in own if a[1] and (a[0] < b[0] or a[0] == b[0] and not b[1])]
        slow = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x, y in pairs) / len(pairs)
        assert once[g] == pytest.approx(slow, abs=1e-12) and ranges[g] == pytest.approx(slow, abs=1e-12)
