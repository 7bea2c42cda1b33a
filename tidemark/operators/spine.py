"""Date spines, forward fills and multi-source joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import carry


def date_spine(df: DataFrame, on: str = "date") -> DataFrame:
    """Every day from the first to the last date of df."""
    return df.agg(F.min(on).alias("a"), F.max(on).alias("b")).select(F.explode(F.sequence("a", "b")).alias(on))


def grid(spine: DataFrame, members: DataFrame) -> DataFrame:
    """Each member on each day: the days are exploded under every member, which are few."""
    days = spine.agg(F.collect_set("date").alias("days"))  # a set of calendar days, 366 a year
    return members.join(days).select(*members.columns, F.explode("days").alias("date"))


def onto_spine(spine: DataFrame, observations: DataFrame, key: list[str]) -> DataFrame:
    return spine.join(observations, key, "left")


def ffill(df: DataFrame, columns: list[str], key: list[str], on: str = "date") -> DataFrame:
    """Each column's last value up to the row, within the key: for grids of one row a day and key; `carry.filled` is for keys of any size."""
    w = Window.partitionBy(*key).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def ffill_series(long_df: DataFrame, spine: DataFrame, series: str = "series", value: str = "value", on: str = "date") -> DataFrame:
    """Forward fill of series without a common key: in long form each series is a partition of its own."""
    names = long_df.select(series).distinct()
    return ffill(onto_spine(grid(spine, names), long_df.select(series, on, value), [series, on]), [value], [series], on)


def unify(weather: DataFrame, market: DataFrame, vix: DataFrame, macro: DataFrame, trading: DataFrame) -> DataFrame:
    """Weather rows with their market, volatility and exchange-rate values; the trading flag is 0 where there is none."""
    out = weather.join(market, ["date", "commodity"]).join(vix, "date").join(macro, "date").join(trading, ["date", "commodity"], "left")
    return out.withColumn("is_trading_day", F.coalesce("is_trading_day", F.lit(0)))


def missing(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right.select(*key).distinct(), key, "left_anti")


def as_of_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, key: list[str], required: bool = False) -> DataFrame:
    """left with the latest right_on at or before left_on, per key of any size: one union, filled over blocks, no range join.

    Where there is none the result is null or, if required, the job fails and names the date.
    """
    out = carry.as_of(left, right, left_on, right_on, key)
    if required:
        none = F.raise_error(F.concat(F.lit(f"no {right_on} at or before "), F.col(left_on).cast("string")))
        out = out.withColumn(right_on, F.when(F.col(right_on).isNull(), none).otherwise(F.col(right_on)))
    return out


def merge_series(long_df: DataFrame, names: list[str], series: str = "series", value: str = "value") -> DataFrame:
    """Many series side by side by date: one shuffle instead of an outer join for each."""
    return long_df.groupBy("date").pivot(series, names).agg(F.max(value))


def join_ffill(left: DataFrame, right: DataFrame, key: list[str], columns: list[str], by: list[str]) -> DataFrame:
    """left with right's columns, and their last value where right has none, for keys of any size."""
    return carry.filled(left.join(right, key, "left"), columns, by, ["date"])


def join_zero(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    return left.join(right, key, "left").fillna(0, columns)


def version_diff(a: DataFrame, b: DataFrame, key: list[str], column: str) -> DataFrame:
    """Both versions' values and their absolute difference."""
    x, y = (d.select(*key, F.col(column).alias(n)) for d, n in ((a, "v1"), (b, "v2")))
    return x.join(y, key).withColumn("difference", F.round(F.abs(F.col("v1") - F.col("v2")), 4))


def latest_only(df: DataFrame, key: list[str], on: str) -> DataFrame:
    latest = df.groupBy(*key).agg(F.max(on).alias(on))
    return df.join(latest, [*key, on], "left_semi")


def with_trading_flag(days: DataFrame, trading: DataFrame, on: str = "date") -> DataFrame:
    """days with is_trading_day: 1 where `trading` has the date, else 0."""
    own = trading.select(on).distinct().withColumn("is_trading_day", F.lit(1))
    return days.join(own, on, "left").withColumn("is_trading_day", F.coalesce("is_trading_day", F.lit(0)))
