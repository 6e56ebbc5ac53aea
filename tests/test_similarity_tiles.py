"""Structural similarity by tiles: against numpy's all pairs, and in time where pivots tell nothing apart."""

import time

import numpy as np
import pytest

from tilewright.operators import similarity


def all_pairs(x, threshold, high=255.0):
    """The same pairs from dense matrices."""
    m, v = x.mean(1), x.var(1)
    c1, c2 = (0.01 * high) ** 2, (0.03 * high) ** 2
    s1 = (2 * np.outer(m, m) + c1) / (m[:, None] ** 2 + m[None, :] ** 2 + c1)
    s = s1 * (2 * (x @ x.T / x.shape[1] - np.outer(m, m)) + c2) / (v[:, None] + v[None, :] + c2)
    i, j = np.nonzero(np.triu(s, 1) >= threshold)
    return {(int(a), int(b)): s[a, b] for a, b in zip(i, j, strict=True)}


def compared(spark, x, threshold):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(4)
    began = time.time()
    got = [tuple(r) for r in similarity.ssim_pairs(df, "id", "v", threshold).collect()]
    took, want = time.time() - began, all_pairs(x, threshold)
    assert len(got) == len(want) and {r[:2]: r[2] for r in got} == pytest.approx(want)
    return took, len(want)


@pytest.mark.parametrize("threshold", [0.95, 0.6, 0.2])
@pytest.mark.parametrize("values", [1 << 22, 400])
def test_small_tiles(spark, monkeypatch, threshold, values):
    """Families, brighter copies, flat vectors of many means and spreads from a tenth to a hundred; blocks also bounded by their values."""
    for name, n in (("HOT", 20), ("TILE", 7), ("BATCH", 16), ("VALUES", values)):
        monkeypatch.setattr(similarity, name, n)
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 255, (120, 40))
    near = x[:60] + rng.normal(0, 8, (60, 40))
    flat = rng.uniform(1, 255, (60, 1)) + rng.normal(0, 1, (60, 40)) * 10 ** rng.uniform(-1, 1, (60, 1))
    assert compared(spark, np.vstack([x, near, x[:30] * 1.03, np.abs(flat)]), threshold)[1] > 60


def test_vectors_that_no_pivot_tells_apart(spark):
    """12,000 vectors in all directions of 64 dimensions lie at much the same distance from each pivot; 72 million pairs are not listed."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12_000, 64))
    x[6_000:6_400] = x[:400] + rng.normal(0, 0.1, (400, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) + 1) * 127.5
    took, pairs = compared(spark, x, 0.95)
    assert pairs == 400 and took < 60
