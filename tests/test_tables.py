"""Versioned tables, new files, path parts and streams that stop and go on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, ledger, paths
from tidemark.plans import jobs
from tidemark.plans.bindings import Frames
from tidemark.sources import files, tables
from tidemark.streaming import jobs as st


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_reader_sees_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_current(spark, path) is None
    first = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, name string, v double")
    tables.upsert(first, path, ["k"], ["v"])
    open_before = tables.read_current(spark, path)
    updates = spark.createDataFrame([(2, 20.0), (3, 30.0), (1, None)], "k long, v double")
    new = tables.upsert(updates, path, ["k"], ["v"])
    # what was opened before the swap still reads whole, and a version without a pointer is not seen
    assert rows(open_before) == [(1, "a", 1.0), (2, "b", 2.0)]
    expected = [(1, "a", 1.0), (2, "b", 20.0), (3, None, 30.0)]
    assert rows(tables.read_current(spark, path)) == expected and tables.current(spark, path) == new
    first.write.parquet(f"{path}/version-half")
    assert rows(tables.read_current(spark, path)) == expected
    tables.upsert(updates, path, ["k"], ["v"])
    assert rows(tables.read_current(spark, path)) == expected


def test_files_are_loaded_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    control = spark.createDataFrame([], "path string")
    seen = []
    for run in range(3):
        if run < 2:
            spark.range(run * 10, run * 10 + 10).write.mode("append").parquet(folder)
        loaded = files.load_new_files(spark, folder, control, spark.range(0).schema)
        seen.append(sorted(r["id"] for r in loaded.collect()))
        control = spark.createDataFrame(control.unionByName(files.new_paths(loaded)).collect(), "path string")
    assert seen == [list(range(10)), list(range(10, 20)), []]


@pytest.mark.parametrize("size", [1, 7])
def test_path_parts_are_bounded_and_read_back(spark, size):
    own = spark.range(50).selectExpr("IF(id < 3, 'a', 'b') AS model", "int(IF(id < 3, id, id - 3) + 1) AS path_id", *(f"double(id * {h}) AS day_{h}" for h in range(1, 15)))
    parts = paths.path_parts(own, ["model"], size)
    assert parts.agg(F.max("n_paths")).first()[0] <= size and parts.where("size(paths) <> n_paths").count() == 0
    assert rows(paths.path_rows(parts, ["model"]).select(own.columns)) == rows(own)


def test_units_of_any_number_of_series(spark):
    prices = spark.createDataFrame([("2024-01-01", "x", 2.0)], "date string, commodity string, close double")
    rates = spark.range(50).selectExpr("concat('s', id) AS series", "date'2024-01-01' AS date", "double(id) AS value").unionAll(spark.createDataFrame([("s3", "2023-01-01", 99.0)], "series string, date string, value double").selectExpr("series", "date(date)", "value"))
    for chunk in (7, 1000):
        got = {r["series"]: r["local_price"] for r in clean.convert_units(prices, rates, 10.0, chunk).collect()}
        assert got == {f"s{k}": 20.0 * k for k in range(50)}


def test_reasons_and_foresight(spark):
    trades = spark.createDataFrame([("a", "2024-01-01", 1.0, "forced sale"), ("a", "2024-01-02", 3.0, None), ("b", "2024-01-01", 2.0, "ev")], "strategy string, date string, amount double, reason string")
    got = {(r["strategy"], r["reason"]): (r["n"], r["amount_pct"], r["is_forced"]) for r in ledger.reason_counts(trades, ["strategy"], "forced").collect()}
    assert got == {("a", "forced sale"): (1, 25.0, True), ("a", "UNKNOWN"): (1, 75.0, False), ("b", "ev"): (1, 100.0, False)}
    bounds = spark.createDataFrame([("a", "2024-01-01", 10.0), ("a", "2024-01-02", 20.0)], "strategy string, date string, bound double")
    assert rows(ledger.foresight_value(trades, bounds, ["strategy"], ["strategy"])) == [("a", 70.0)]


def test_bursts_are_the_same_with_and_without_a_restart(spark, sf_dir):
    f = Frames(spark, sf_dir)
    assert rows(jobs.stream_bursts(f, stops=())) == rows(jobs.stream_bursts(f, stops=(0, 2)))


def test_late_rows_are_dropped_between_batches(spark, sf_dir):
    f = Frames(spark, sf_dir)
    source, kept = jobs.shared(f, "late-in"), {}
    weeks = jobs.weekly_feed(f, source, 50)
    assert weeks > 3
    for files_a_batch in (1, None):  # in one batch the watermark never moves before the last row
        sdf = st.tone_windows(st.ingest_stream(spark, f"{source}/*", spark.read.parquet(f"{source}/*").schema, files=files_a_batch), "ts", ["event_type"], "7 days", "1 day", "1 day")
        out = jobs.shared(f, "late-out")
        query = st.run_to_table(sdf, out, jobs.shared(f, "late-mark"))
        query.awaitTermination()
        kept[files_a_batch] = (spark.read.schema(sdf.schema).parquet(out).agg(F.sum("n")).first()[0], st.dropped(query))
    assert kept[1][1] > 0 == kept[None][1] and kept[1][0] < kept[None][0]
