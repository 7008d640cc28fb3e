import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import drift

RNG = np.random.default_rng(3)
BASE = RNG.normal(size=3000)


def frame(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def plain_psi(ref, cur, bins=10, eps=1e-4):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))[1:-1]
    share = lambda v: np.bincount(np.searchsorted(edges, v, "right"), minlength=len(edges) + 1) / len(v)
    r, c = (np.where(p == 0, eps, p) for p in (share(ref), share(cur)))
    return float(((c - r) * np.log(c / r)).sum())


@pytest.mark.parametrize(("current", "low", "high"), [(BASE, 0, 1e-6), (BASE + 3, 0.25, 99), (RNG.normal(size=3000), 0, 0.05)])
def test_numeric(spark, current, low, high):
    ranks = drift.value_ranks(drift.long_numeric(frame(spark, BASE), frame(spark, current), ["x"]))
    psi = drift.psi_numeric(ranks).first().psi
    assert low <= psi + 1e-12 and psi < high
    assert psi == pytest.approx(plain_psi(BASE, current), abs=1e-9)
    pooled = np.sort(np.concatenate([BASE, current]))
    wanted = np.abs(np.searchsorted(np.sort(BASE), pooled, "right") / len(BASE) - np.searchsorted(np.sort(current), pooled, "right") / len(current)).max()
    assert drift.ks(ranks).first().ks == pytest.approx(wanted)


def test_categories(spark):
    before = spark.createDataFrame([(x,) for x, n in {"red": 30, "blue": 45, "green": 25}.items() for _ in range(n)], "c string")
    after = spark.createDataFrame([(x,) for x, n in {"red": 9, "blue": 70, "plum": 2, "ash": 1, None: 3}.items() for _ in range(n)], "c string")
    counts = drift.value_counts(drift.long_categorical(before, after, ["c"]))
    table = np.array([[30, 9], [45, 70], [25, 0], [0, 2], [0, 1]])
    wanted = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert drift.chi_square(counts).first().chi_square == pytest.approx(((table - wanted) ** 2 / wanted).sum())
    share = np.where(table == 0, 1e-4, table / table.sum(0))
    assert drift.psi_categorical(counts).first().psi == pytest.approx(((share[:, 1] - share[:, 0]) * np.log(share[:, 1] / share[:, 0])).sum())
    assert drift.new_categories(counts).first().first_new == "ash,plum"
    same = drift.value_counts(drift.long_categorical(before, before, ["c"]))
    assert drift.chi_square(same).first().chi_square == 0 and drift.new_categories(same).collect() == []


def test_missing_feature_and_empty_side(spark):
    config = drift.DriftConfig({"x": {"psi_fail": 0.25, "ks_fail": 0.1}, "gone": {}}, {})
    got = {r.feature: r for r in drift.detect(frame(spark, BASE), frame(spark, BASE).where(F.lit(False)), config).collect()}
    assert got["gone"].status == "fail" and got["x"].status == "ok" and np.isnan(got["x"].psi) and np.isnan(got["x"].ks)
    assert drift.summary(drift.detect(frame(spark, BASE), frame(spark, BASE + 2), config)).first().n_failures == 2
