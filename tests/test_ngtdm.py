"""Grey tone differences against a plain version, over several blocks and negative coordinates."""

import random

import pytest

from tilewright.operators import radiomics


def plain(voxels):
    """Features of one sample's {(x, y, z): level}."""
    n, s, total = {}, {}, 0
    for (x, y, z), level in voxels.items():
        near = [voxels[p] for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (p := (x + dx, y + dy, z + dz)) != (x, y, z) and p in voxels]
        if near:
            n[level] = n.get(level, 0) + 1
            s[level] = s.get(level, 0.0) + abs(level - sum(near) / len(near))
            total += 1
    if not total:
        return None
    p = {i: c / total for i, c in n.items()}
    ps, all_s, pairs = sum(p[i] * s[i] for i in p), sum(s.values()), [(i, j) for i in p for j in p]
    busy = sum(abs(i * p[i] - j * p[j]) for i, j in pairs)
    return (
        min(1e6, 1 / ps) if ps else 1e6,
        sum(p[i] * p[j] * (i - j) ** 2 for i, j in pairs) / (len(p) * (len(p) - 1)) * all_s / total if len(p) > 1 else 0.0,
        ps / busy if busy else 0.0,
        sum(abs(i - j) * (p[i] * s[i] + p[j] * s[j]) / (p[i] + p[j]) for i, j in pairs) / total,
        sum((p[i] + p[j]) * (i - j) ** 2 for i, j in pairs) / all_s if all_s else 0.0,
    )


def test_ngtdm(spark):
    rng = random.Random(1)
    samples = {
        "noise": {(x, y, z): rng.randrange(1, 6) for x in range(-20, 20) for y in range(0, 18) for z in range(-3, 4) if rng.random() < 0.8},
        "flat": {(x, y, 0): 3 for x in range(20) for y in range(3)},
        "alone": {(0, 0, 0): 1, (5, 5, 5): 2},
        "slope": {(x, 0, 0): x // 4 for x in range(40)},
    }
    rows = [(name, *p, level, 7) for name, v in samples.items() for p, level in v.items()]
    df = spark.createDataFrame([*rows, ("noise", None, 1, 1, 1, 7)], "name string, x int, y int, z int, level int, n int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in radiomics.ngtdm(df, "name").collect()}
    assert set(got) == {"noise", "flat", "slope"}
    for name in got:
        assert got[name] == pytest.approx(plain(samples[name]), rel=1e-9)
    assert radiomics.ngtdm(df.limit(0), "name").count() == 0
