"""Drift of distributions: found where mean and deviation are equal, and in ranges and missing values."""

import random

import pytest

from tilewright.operators.contract import Contract


def test_planted_drift(spark, tmp_path):
    rng = random.Random(2)
    n = 4000
    train = [(rng.gauss(0, 1), rng.random(), rng.random(), rng.random(), rng.gauss(0, 1)) for _ in range(n)]
    # two humps with the mean 0 and the deviation 1 of the training rows; a wider range; missing values; the same again
    now = [(rng.choice((-1, 1)) * rng.gauss(0.95, 0.312), rng.random(), rng.random() * 1.2, rng.random() if i % 5 else None, rng.gauss(0, 1)) for i in range(n)]
    schema = "humps double, same double, wide double, gaps double, steady double"
    a, b = spark.createDataFrame(train, schema), spark.createDataFrame(now, schema)
    names = ["humps", "same", "wide", "gaps", "steady"]
    contract = Contract().fit_normalization(a, names).fit_distribution(a, names).freeze()
    assert {r.feature for r in contract.drift(b.select("humps", *names[1:]), tolerance=0.05).collect()}.isdisjoint({"humps", "same", "steady"})
    contract.save(spark, str(tmp_path / "c"))
    found = {r.feature: r for r in Contract.load(spark, str(tmp_path / "c")).distribution_drift(b).collect()}
    assert {f for f, r in found.items() if r.drifted} == {"humps", "wide", "gaps"}
    assert found["humps"].ks > 0.1 and found["wide"].above > 0.1 and found["gaps"].missing == pytest.approx(0.2)

    import math

    for f, i in (("humps", 0), ("wide", 2)):  # a plain version
        x, y = sorted(r[i] for r in train), [r[i] for r in now]
        edges = contract.parts["distribution"][f]["edges"]
        assert edges[5] == pytest.approx((x[n // 2 - 1] + x[n // 2]) / 2)
        shares = [[sum((k == 0 or v > edges[k]) and (k == 9 or v <= edges[k + 1]) for v in side) / n for k in range(10)] for side in (x, y)]
        psi = sum((max(q, 1e-4) - max(p, 1e-4)) * math.log(max(q, 1e-4) / max(p, 1e-4)) for p, q in zip(*shares, strict=True))
        ks = max(abs(sum(shares[1][: k + 1]) - sum(shares[0][: k + 1])) for k in range(10))
        assert found[f].psi == pytest.approx(psi) and found[f].ks == pytest.approx(ks)


def test_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    contract = Contract().fit_distribution(df, ["a", "b"]).freeze()
    assert [r.feature for r in contract.distribution_drift(df).collect()] == ["b"]
    assert contract.distribution_drift(df.limit(0)).count() == 0
    assert Contract().fit_distribution(df.limit(0), ["a"]).freeze().distribution_drift(df).count() == 0
