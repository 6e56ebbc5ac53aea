import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None, lang="en", source=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, lang, source[i] if source else f"s{i % 3}", None if t is None else len(t)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda *a, **k: frame(spark, *a, **k)


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(800)]


@pytest.fixture(scope="session")
def corpus(vocabulary):
    """Texts with copies, near copies, shared passages, odd characters, nulls and empty ones."""
    rng = random.Random(7)
    out = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 160))) for _ in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out += [f"{x} {passage} {y}" for x, y in zip(out[:6], out[6:12], strict=True)]
    out += [out[3], out[3], out[3]]
    out += [out[5][:200] + " changed é👍 " + out[5][200:]]
    out += ["", None, "x", " \n\t ", "é" * 120, "é" * 120 + "z", "ab" * 5000, "!!!", None, "\x00\x1f<|endoftext|>  two"]
    return out
