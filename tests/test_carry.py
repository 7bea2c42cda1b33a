"""State over blocks: a key cut into many blocks gives what one window over it gives."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import carry, paths, spine

D = datetime.date(2024, 1, 1)
PARTS = [1, 60]


def day(k):
    return D + datetime.timedelta(days=k)


@pytest.fixture(scope="module")
def rows(spark):
    """One key of 420 rows, small ones and a null one; values with holes and ties."""
    r = random.Random(3)
    own = [(k, d, r.choice([None, r.uniform(50, 150), 7.0]), d) for k, n in (("hot", 420), ("b", 5), (None, 9), ("c", 1)) for d in range(n)]
    r.shuffle(own)
    return spark.createDataFrame([(k, day(d), v, i) for k, d, v, i in own], "k string, date date, v double, id long").cache()


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", PARTS)
def test_ranks_and_running_sums(rows, parts):
    w = Window.partitionBy("k").orderBy("v", "id")
    expected = plain(rows.withColumn("rank", F.row_number().over(w).cast("long")), "k", "id", "rank")
    assert plain(carry.ranked(rows, ["k"], ["v", "id"], parts=parts), "k", "id", "rank") == expected
    sums = rows.withColumn("s", F.coalesce(F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert plain(carry.running(rows, ["k"], ["v", "id"], {"s": F.col("id")}, parts), "k", "id", "s") == plain(sums, "k", "id", "s")


@pytest.mark.parametrize("parts", PARTS)
def test_fills_and_as_of_values(rows, parts):
    assert plain(carry.filled(rows, ["v"], ["k"], ["date"], parts), "k", "date", "v") == plain(spine.ffill(rows, ["v"], ["k"]), "k", "date", "v")
    right = rows.where("k IS NOT NULL AND id % 13 = 3").select("k", F.date_add("date", 2).alias("t"))
    left = rows.where("k IS NOT NULL").select("k", "date").unionByName(rows.where("id = 5").select("k", "date"))
    pairs = left.withColumn("id", F.monotonically_increasing_id()).join(right, "k", "left").groupBy("id", "k", "date").agg(F.max(F.when(F.col("t") <= F.col("date"), F.col("t"))).alias("t"))
    assert plain(carry.as_of(left, right, "date", "t", ["k"], parts), "k", "date", "t") == plain(pairs, "k", "date", "t")


def recursion(values, n):
    decay, out, state = 1 - 2 / (n + 1), [], None
    for v in values:
        if v is not None:
            state = v if state is None else decay * state + (1 - decay) * v
        out.append(state)
    return out


@pytest.mark.parametrize("parts", PARTS)
def test_macd_is_the_same_for_every_block_size(rows, parts):
    expected = []
    held = {}
    for r in rows.collect():
        held.setdefault(r["k"], []).append((r["date"], r["v"]))
    for k, own in held.items():
        own.sort()
        fast, slow = (recursion([v for _, v in own], n) for n in (12, 26))
        line = [None if f is None else f - g for f, g in zip(fast, slow, strict=True)]
        # the signal line moves with values alone
        has = [v is not None for _, v in own]
        mark, state = [], None
        for x, h in zip(line, has, strict=True):
            if h:
                state = x if state is None else 0.8 * state + 0.2 * x
            mark.append(state)
        expected += [(k, d, *((None,) * 3 if x is None else (x, m, x - m))) for (d, _), x, m in zip(own, line, mark, strict=True)]
    got = plain(carry.macd(rows, "v", ["k"], parts=parts), "k", "date", "macd", "macd_signal", "macd_hist")
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=str), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
        assert a[2] is None or a[2:] == pytest.approx(b[2:], abs=2e-4)


def test_macd_without_holes_is_the_usual_one(spark):
    r = random.Random(8)
    values = [r.uniform(90, 110) for _ in range(5000)]
    df = spark.createDataFrame([("a", day(k), v) for k, v in enumerate(values)], "k string, date date, v double")
    s = pd.Series(values)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    mark = line.ewm(span=9, adjust=False).mean()
    for parts in (40,):
        got = carry.macd(df, "v", ["k"], parts=parts).orderBy("date").toPandas()
        assert (got["macd"] - line).abs().max() < 1e-4 and (got["macd_signal"] - mark).abs().max() < 1e-4


def test_decays_stay_in_range_over_long_blocks():
    import numpy as np

    values = np.random.default_rng(1).uniform(1, 2, 20_000)
    for n in (2, 9, 26, 400):
        decay = 1 - 2 / (n + 1)
        assert np.allclose(carry.smooth(values, decay, 5.0), pd.Series([5.0, *values]).ewm(span=n, adjust=False).mean()[1:])


def test_empty_tables(rows, spark):
    none = rows.limit(0)
    assert carry.ranked(none, ["k"], ["id"]).count() == 0
    assert carry.filled(none, ["v"], ["k"], ["date"]).count() == 0
    assert carry.macd(none, "v", ["k"]).count() == 0


@pytest.mark.parametrize("parts", ["1", "50"])
def test_crps_of_one_group_over_many_partitions(spark, parts):
    r = random.Random(5)
    values = [r.choice([1.0, 2.0, r.uniform(0, 9)]) for _ in range(700)]
    long_df = spark.createDataFrame([("m", k, 1, v) for k, v in enumerate(values)] + [("m", 0, 2, 4.0), ("m", 1, 2, None)], "model string, path_id int, day int, value double")
    actual = spark.createDataFrame([("m", 1, 7.5), ("m", 2, 5.0)], "model string, day int, actual double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {x["day"]: x["crps"] for x in paths.crps(long_df, actual, ["model"], ["model", "day"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    n = len(values)
    expected = sum(abs(v - 7.5) for v in values) / n - sum(abs(a - b) for a in values for b in values) / (2 * n * n)
    assert got == {1: pytest.approx(expected, abs=1e-4), 2: 1.0}
