"""Tail probabilities against known values, and the tests of errors against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.operators import pooled, scores


def value(spark, column):
    return spark.range(1).select(column.alias("p")).first()["p"]


@pytest.mark.parametrize("t,freedom,p", [(1.0, 1, 0.5), (2.0, 10, 0.0733880), (-2.228139, 10, 0.05), (0.0, 5, 1.0), (12.706205, 1, 0.05), (1.984467455, 98, 0.05), (50.0, 3, 1 - 2 / math.pi * (math.atan(50 / 3**0.5) + (50 / 3**0.5) / (1 + 2500 / 3)))])
def test_student(spark, t, freedom, p):
    assert value(spark, tails.student_two_sided(F.lit(t), F.lit(freedom))) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("z,p", [(0.0, 1.0), (1.959963985, 0.05), (-2.575829304, 0.01), (6.0, 1.973175e-09), (0.1, 0.9203443)])
def test_normal(spark, z, p):
    assert value(spark, tails.normal_two_sided(F.lit(z))) == pytest.approx(p, rel=1e-6)
    assert value(spark, tails.normal_above(F.lit(z))) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("q,k,p", [(11.070498, 5, 0.05), (3.841459, 1, 0.05), (0.0, 4, 1.0), (40.0, 2, math.exp(-20)), (5.0, 10, 0.8911780)])
def test_chi_square(spark, q, k, p):
    assert value(spark, tails.chi_square_above(F.lit(q), F.lit(k))) == pytest.approx(p, rel=2e-6)


@pytest.mark.parametrize("k,n", [(8, 10), (0, 10), (10, 10), (526, 1000), (5100, 10_000), (11, 10), (1, 1)])
def test_binomial_is_exact(spark, k, n):
    exact = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
    assert value(spark, tails.binomial_at_least(F.lit(k), F.lit(n))) == pytest.approx(exact, rel=1e-9)


def test_large_samples_converge(spark):
    assert value(spark, tails.student_two_sided(F.lit(1.959963985), F.lit(10_000_000))) == pytest.approx(0.05, abs=1e-6)
    assert value(spark, tails.binomial_at_least(F.lit(500_980), F.lit(1_000_000))) == pytest.approx(0.5 * math.erfc((979.5 / 500) / math.sqrt(2)), rel=1e-4)


def test_null_and_undefined_arguments(spark):
    none = F.lit(None).cast("double")
    assert value(spark, tails.student_two_sided(none, F.lit(3))) is None and value(spark, tails.normal_two_sided(none)) is None
    assert value(spark, tails.binomial_at_least(F.lit(None).cast("int"), F.lit(3))) is None


@pytest.mark.parametrize("parts", [1, 30])
def test_mann_whitney_counts_pairs(spark, parts):
    r = random.Random(2)
    rows = [("a", r.random() < 0.4, float(r.randrange(25))) for _ in range(300)] + [("b", True, 1.0), ("b", True, 2.0), ("c", True, 5.0), ("c", False, 5.0), ("a", None, 3.0), ("a", True, None)]
    got = {x["g"]: x for x in scores.mann_whitney(spark.createDataFrame(rows, "g string, f boolean, v double"), ["g"], "f", "v", parts).collect()}
    one = [v for g, f, v in rows if g == "a" and f is True and v is not None]
    two = [v for g, f, v in rows if g == "a" and f is False]
    u = sum((a > b) + 0.5 * (a == b) for a in one for b in two)
    n, m = len(one), len(two)
    ties = sum(t**3 - t for t in np.unique(one + two, return_counts=True)[1].tolist())
    z = (u - n * m / 2 - 0.5) / math.sqrt(n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1))))
    assert (got["a"]["n1"], got["a"]["n2"], got["a"]["u_statistic"]) == (n, m, u)
    assert got["a"]["z_score"] == pytest.approx(z, abs=1e-4) and got["a"]["p_value"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-6)
    for g in ("b", "c"):
        assert got[g]["p_value"] is None and got[g]["is_significant"] is False


def test_retrain_alert(spark):
    rows = [(True, 30.0), (True, 12.0), (True, 5.0), (False, 90.0), (None, None)]
    got = scores.retrain_alert(spark.createDataFrame(rows, "is_significant boolean, shift_pct double")).collect()
    assert [(r["level"], r["status"]) for r in got] == [("critical", "RETRAIN_NEEDED"), ("warning", "RETRAIN_NEEDED"), ("ok", "OK"), ("ok", "OK"), ("ok", "OK")]


def test_windows_equal_models_fitted_one_by_one(spark, sf_dir):
    """Every training window's weights are those of a ridge regression on the rows known before it; early windows say why they have none."""
    from tidemark.plans.bindings import Frames

    own = pooled.samples(Frames(spark, sf_dir).market, "close", ["commodity"], 7).cache()
    data = own.toPandas()
    got = {r["window_start"]: r for r in pooled.fitted(pooled.grams(own, 12, "label_date")).collect()}
    states = [got[k]["status"] for k in sorted(got)]
    assert states[0] == "no data" and states[-1] == "fitted" and len(got) > 4
    for start, r in got.items():
        past = data[data["label_date"] < start]
        assert len(past) == r["n_rows"]
        if r["status"] == "fitted":
            x = np.column_stack([np.ones(len(past)), past[pooled.FEATURES]])
            g = x.T @ x + np.diag([0] + [pooled.RIDGE * len(past)] * 3)
            assert [r[c] for c in pooled.WEIGHTS] == pytest.approx(np.linalg.solve(g, x.T @ past["label"]).tolist(), rel=1e-6, abs=1e-9)


def test_state_too_large_is_joined_by_shuffle(spark, monkeypatch):
    state = spark.range(10)
    assert "broadcast" in pooled.shipped(state)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(pooled, "BROADCAST_BYTES", 100)
    assert "broadcast" not in pooled.shipped(state)._jdf.queryExecution().logical().toString().lower()


def test_singular_windows_have_a_status(spark):
    sums = {f"g{min(a, b)}{max(a, b)}": 0.0 for a in range(4) for b in range(4)} | {f"g{a}y": 0.0 for a in range(4)}
    row = spark.range(1).select(F.lit(1).cast("long").alias("w"), F.lit("2000-01-01").cast("date").alias("window_start"), F.lit(500).cast("long").alias("n_rows"), *(F.lit(v).alias(n) for n, v in sums.items()))
    found = pooled.fitted(row, ridge=0.0).first()
    assert found["status"] == "singular" and found["intercept"] is None
