"""Order statistics from sorted runs: right for every cut into runs and bins, and with little to shuffle."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import paths, runs


def shuffled(spark, action) -> int:
    """Bytes that the action's stages write for other stages."""

    def total():
        time.sleep(0.5)  # the store follows the tasks' ends
        found = spark._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = total()
    action()
    return total() - before


def wide(spark, n):
    """n paths of one model."""
    return spark.range(0, n, 1, 4).selectExpr("'m' AS model", *(f"double(pmod(xxhash64(id, {h}), 1000003)) / 7 AS day_{h}" for h in range(1, 15)))


def actuals(spark):
    return spark.range(1, 15).selectExpr("'m' AS model", "int(id) AS day", "70000.0 AS actual")


def test_crps_shuffles_packed_values(spark):
    n = 40_000
    moved = shuffled(spark, lambda: paths.path_crps(wide(spark, n), actuals(spark), ["model"], ["model"]).collect())
    assert moved < 11 * 14 * n  # eight bytes a value, and samples


@pytest.mark.parametrize("rows,most", [(500_000, 1 << 16), (900, 64), (1, 5)])
def test_crps_is_the_same_for_every_run_and_bin(spark, monkeypatch, rows, most):
    monkeypatch.setattr(paths, "GROUP_ROWS", rows)
    monkeypatch.setattr(runs, "BIN_ROWS", most)
    own = wide(spark, 3000).withColumn("day_2", F.when(F.col("day_2") > 90_000, None).otherwise(F.floor(F.col("day_2") / 30_000).cast("double")))
    got = {r["day"]: r["crps"] for r in paths.path_crps(own, actuals(spark).where("day < 14"), ["model"], ["model", "day"]).collect()}
    assert sorted(got) == list(range(1, 14))
    for h in (1, 2, 13):
        v = np.array([r[0] for r in own.select(f"day_{h}").where(f"day_{h} IS NOT NULL").collect()])
        assert got[h] == pytest.approx(np.abs(v - 70000).mean() - np.abs(v[:, None] - v).mean() / 2, abs=1e-3)


def test_quantiles_shuffle_what_their_bounds_leave_open(spark):
    n = 200_000
    moved = shuffled(spark, lambda: paths.exact_quantiles(wide(spark, n), ["model"], paths.day_columns(list(range(1, 15))), [0.05, 0.95]).collect())
    assert moved < 8 * 14 * n / 10


@pytest.mark.parametrize("rows", [500_000, 700, 1])
def test_quantiles_of_infinite_missing_and_equal_values(spark, monkeypatch, rows):
    monkeypatch.setattr(paths, "GROUP_ROWS", rows)
    own = spark.range(2000).selectExpr("IF(id % 5 = 0, NULL, id % 5) AS g", "CASE WHEN id % 7 = 0 THEN double('-Infinity') WHEN id % 11 = 0 THEN double('NaN') WHEN id % 3 = 0 THEN NULL WHEN id % 2 = 0 THEN 5.0 ELSE double(id) END AS a")
    got = {r["g"]: r["a"] for r in paths.exact_quantiles(own, ["g"], ["a"], [0.0, 0.3, 0.5, 1.0]).collect()}
    assert len(got) == 5
    for g, found in got.items():
        v = np.sort(np.array([r["a"] for r in own.where(F.col("g").eqNullSafe(F.lit(g))).where("a IS NOT NULL").collect()]))
        for level, x in zip([0.0, 0.3, 0.5, 1.0], found, strict=True):
            at = (len(v) - 1) * level
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            assert np.array_equal(x, low + (high - low) * (at - np.floor(at)), equal_nan=True)


def test_risk_of_large_groups_is_not_read_by_one_task(spark):
    n = 100_000
    moved = shuffled(spark, lambda: paths.var_cvar(wide(spark, n), ["model"], 0.05).collect())
    assert moved < 8 * 14 * n / 10


def test_counting_paths_does_not_shuffle_their_aggregates(spark):
    n = 50_000
    own = wide(spark, n).withColumn("path_id", F.xxhash64("day_1"))
    found = []
    moved = shuffled(spark, lambda: found.extend(paths.validate_paths(own, ["model"]).collect()))
    assert [tuple(r) for r in found] == [("m", n, own.select("path_id").distinct().count(), 0, 0)]
    assert moved < 16 * n


@pytest.mark.parametrize("size", [3, 1000])
def test_parts_hold_what_days_follow_from(spark, size):
    own = spark.range(50).selectExpr("IF(id < 3, 'a', 'b') AS model", "int(IF(id < 3, id, id - 3) + 1) AS path_id", "double(id) AS base")
    days = lambda of: [(of("base") * h).alias(f"day_{h}") for h in range(1, 15)]
    got = paths.path_parts(own, ["model"], size, held=["base"], days=days)
    expected = paths.path_parts(own.select("*", *days(F.col)), ["model"], size)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_ranks_leave_the_rows_where_they_are(spark):
    from tidemark.operators import carry

    n = 100_000
    own = spark.range(0, n, 1, 4).selectExpr("id % 3 AS k", "xxhash64(id) AS v", "xxhash64(id, 1) AS w")
    once = shuffled(spark, lambda: carry.cut(own, ["k"], ["v"]).write.format("noop").mode("overwrite").save())
    moved = shuffled(spark, lambda: carry.ranked(own, ["k"], ["v"]).write.format("noop").mode("overwrite").save())
    assert moved < 1.2 * once


def test_ranks_write_only_what_is_kept(spark):
    from tidemark.operators import carry

    own = spark.range(0, 5000, 1, 4).selectExpr("id % 3 AS k", "xxhash64(id) AS v", "id * 2 AS w")
    got = carry.ranked(own, ["k"], ["v"], "n", keep=["w"])
    assert got.columns == ["k", "w", "n"]
    whole = carry.ranked(own, ["k"], ["v"], "n").select("k", "w", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    size = lambda df: sum(os.path.getsize(p.removeprefix("file://")) for p in df.inputFiles() if "/ranked-" in p)
    assert size(got) < size(carry.ranked(own, ["k"], ["v"], "n")) * 0.8


def test_stored_paths_are_compressed(spark, sf_dir):
    from tidemark.plans import reshape
    from tidemark.plans.bindings import Frames

    files = reshape.read_parts(Frames(spark, sf_dir)).inputFiles()
    assert files and all(".zstd." in p for p in files)
