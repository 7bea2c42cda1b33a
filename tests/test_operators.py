"""Golden values, empty inputs and properties that the tables do not show."""

from __future__ import annotations

import pytest

import datetime

from pyspark.sql import functions as F

from tidemark.operators import aggregates, baseline, clean, features, learners, news, paths, scores, spine

D = datetime.date


def climate(spark):
    rows = [(D(2024, 1, d), "Coffee", r, 25.0 + d * 0.1 + off, 75.0 + d) for d in range(1, 11) for r, off in (("colombia", 0.0), ("vietnam", 5.0))]
    return spark.createDataFrame(rows, "date date, commodity string, region string, temp_c double, humidity_pct double")


def test_region_means(spark):
    row = aggregates.region_mean(climate(spark), ["temp_c"], []).where("date = '2024-01-01'").first()
    assert row["temp_c"] == 27.6


def test_weights_ignore_missing_values_and_unknown_regions(spark):
    df = climate(spark).withColumn("temp_c", F.when((F.col("region") == "colombia") & (F.col("date") == "2024-01-02"), None).otherwise(F.col("temp_c")))
    weights = spark.createDataFrame([("colombia", 0.6), ("vietnam", 0.4)], "region string, weight double")
    got = {r["date"].day: r["temp_c"] for r in aggregates.region_weighted(df, weights, ["temp_c"]).collect()}
    assert got[1] == round(25.1 * 0.6 + 30.1 * 0.4, 4)
    assert got[2] == 30.2


def test_cutoff_and_unknown_commodity(spark):
    df = climate(spark)
    assert clean.as_of_slice(df, "Coffee", "2024-01-05").count() == 10
    assert clean.as_of_slice(df, "Tea", "2024-01-05").count() == 0


def test_empty_input(spark):
    empty = climate(spark).limit(0)
    assert aggregates.region_mean(empty, ["temp_c"], []).count() == 0
    assert features.rolling(empty, ["temp_c"], [7], ["region"]).count() == 0
    assert spine.ffill(empty, ["temp_c"], ["region"]).count() == 0


def test_fill_starts_empty_and_never_looks_ahead(spark):
    rows = [(D(2024, 1, d), "x", v) for d, v in ((1, None), (2, 5.0), (3, None), (4, 7.0))]
    df = spark.createDataFrame(rows, "date date, k string, v double")
    assert [r["v"] for r in spine.ffill(df, ["v"], ["k"]).orderBy("date").collect()] == [None, 5.0, 5.0, 7.0]


def test_as_of_takes_the_same_day(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2024, 1, 1))], "k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2024, 1, 3))], "k string, t date")
    got = {r["d"].day: r["t"] and r["t"].day for r in spine.as_of_join(left, right, "d", "t", ["k"]).collect()}
    assert got == {5: 5, 1: None}


def test_seasonal_falls_back_to_the_last_value(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), 3.0), ("a", D(2023, 1, 2), 9.0)], "k string, date date, v double")
    got = {r["day_ahead"]: r["v"] for r in baseline.seasonal(df, ["v"], 3, ["k"]).collect()}
    assert got == {1: 9.0, 2: 9.0, 3: 3.0}


def test_paths_do_not_depend_on_partitioning(spark):
    points = spark.createDataFrame([("a", h, 100.0, 1.0) for h in range(1, 4)], "k string, day_ahead int, forecast double, daily_std double")
    one, many = (sorted(map(tuple, baseline.expand_paths(points.repartition(n), 50, ["k"], 3).collect())) for n in (1, 5))
    assert one == many
    values = [r[3] for r in one if r[2] == 1]
    assert abs(sum(values) / len(values) - 100) < 0.5


def test_bootstrap_brackets_the_total(spark):
    df = spark.createDataFrame([("a", k, float(k % 10)) for k in range(500)], "k string, id long, v double")
    r = scores.bootstrap_totals(df, ["k"], "v", "id", 200, 1).first()
    assert r["lower_95"] < 2250 < r["upper_95"] and abs(r["mean_total"] - 2250) < 60


def test_crps_of_one_sample_is_the_distance(spark):
    long_df = spark.createDataFrame([("m", 1, 1, 5.0)], "model string, path_id int, day int, value double")
    actual = spark.createDataFrame([("m", 1, 7.5)], "model string, day int, actual double")
    assert paths.crps(long_df, actual, ["model"], ["model"]).first()["crps"] == 2.5


def test_broken_tones_and_days_are_dropped(spark):
    df = spark.createDataFrame([("20240101x", "1.5,z"), ("nonsense", "1"), (None, None)], "day string, tone string")
    got = news.parse_day(news.parse_tone(df), "day").collect()
    assert [(r["tone_avg"], r["tone_positive"], r["tone_negative"]) for r in got] == [(1.5, None, None)]


def test_quantiles_are_exact_for_wide_and_narrow_brackets(spark, monkeypatch):
    rows = spark.range(30_000).selectExpr("id % 3 AS g", "IF(id % 3 = 2, NULL, double(pmod(xxhash64(id), 700)))  AS a", "double(id * id % 10007) AS b").unionAll(spark.createDataFrame([(None, 1.0, 2.0), (None, 4.0, None)], "g long, a double, b double"))
    levels = [0.0, 0.05, 0.5, 0.9, 1.0]
    plain = {r["g"]: (r["a"], r["b"]) for r in rows.groupBy("g").agg(*(F.percentile(c, F.array(*map(F.lit, levels))).alias(c) for c in ("a", "b"))).collect()}
    for most, accuracy in ((250_000, 1000), (9_999, 1000), (0, 1000), (0, 100), (0, 100_000)):  # all in arrays, some, none
        monkeypatch.setattr(paths, "GROUP_ROWS", most)
        monkeypatch.setattr(paths, "ACCURACY", accuracy)
        found = {r["g"]: (r["a"], r["b"]) for r in paths.exact_quantiles(rows, ["g"], ["a", "b"], levels).collect()}
        assert len(found) == 4
        for g, (a, b) in plain.items():
            assert found[g][1] == pytest.approx(b)
            assert (found[g][0] == pytest.approx(a)) if a is not None else all(x is None for x in found[g][0])


def test_quantiles_outside_their_bracket_fail(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("1 AS g", "double(pmod(xxhash64(id), 4999)) AS a")
    real = F.percentile_approx
    monkeypatch.setattr(paths.F, "percentile_approx", lambda c, levels, accuracy: real(c, [x / 2 for x in levels], accuracy))
    with pytest.raises(Exception, match="outside its bracket"):
        paths.bracketed_quantiles(rows, ["g"], ["a"], [0.9]).collect()


def test_importances_repeat_and_find_the_cause(spark):
    rows = spark.range(400).selectExpr("double(pmod(xxhash64(id), 100)) AS a", "double(pmod(xxhash64(id, 1), 100)) AS b", "double(pmod(xxhash64(id), 100)) * 3 + 1 AS label")
    one, two = ({r["feature"]: r["importance"] for r in learners.importance(spark, rows.repartition(n), ["a", "b"], "label").collect()} for n in (2, 2))
    assert one == two and one["a"] > 0.9 and sum(one.values()) == pytest.approx(1.0)
