"""Aggregations over series, rows and layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .clean import band


def region_mean(df: DataFrame, weather: list[str], market: list[str]) -> DataFrame:
    """Mean weather over regions; market columns are the same in every region."""
    return df.groupBy("date", "commodity").agg(*(F.round(F.avg(c), 4).alias(c) for c in weather), *(F.max(c).alias(c) for c in market))


def region_weighted(df: DataFrame, weights: DataFrame, columns: list[str]) -> DataFrame:
    """Weighted means over regions; a row without a value carries no weight, an unknown region weighs 0."""
    own = df.join(weights, "region", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    means = [F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))), F.avg(c)) for c in columns]
    return own.groupBy("date", "commodity").agg(*(F.round(m, 4).alias(c) for m, c in zip(means, columns, strict=True)))


def numeric_mean(df: DataFrame, by: list[str]) -> DataFrame:
    numeric = [c for c, t in df.dtypes if c not in by and t in ("double", "float", "bigint", "int")]
    return df.groupBy(*by).agg(*(F.round(F.avg(c), 4).alias(c) for c in numeric))


def null_report(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Nulls per column and their share in per cent, one pass, in long form."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot([*by, "n_rows"], columns, "column", "n_null").withColumn("null_pct", F.round(100 * F.col("n_null") / F.col("n_rows"), 2))


def duplicate_report(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row and how many."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def completeness(df: DataFrame, key: list[str], on: str = "date") -> DataFrame:
    expected = F.datediff(F.max(on), F.min(on)) + 1
    out = df.groupBy(*key).agg(F.count_distinct(on).alias("n_days"), expected.cast("long").alias("n_expected"), F.min(on).alias("first_day"), F.max(on).alias("last_day"))
    return out.withColumn("missing_days", F.col("n_expected") - F.col("n_days")).withColumn("completeness_pct", F.round(100 * F.col("n_days") / F.col("n_expected"), 2))


def retention(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of each layer and their share of the first layer's."""
    counts = [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("step"), F.lit(name).alias("layer"), "n_rows") for k, (name, d) in enumerate(frames.items())]
    both = reduce(DataFrame.unionByName, counts)
    first = F.max(F.when(F.col("step") == 0, F.col("n_rows"))).over(Window.partitionBy(F.lit(1)))  # one row for each layer
    return both.withColumn("retention_pct", F.round(100 * F.col("n_rows") / first, 2)).drop("step")


def freshness(df: DataFrame, key: list[str], as_of: str, warn: int, critical: int, on: str = "date") -> DataFrame:
    age = F.datediff(F.lit(as_of).cast("date"), F.max(on)).cast("long")
    out = df.groupBy(*key).agg(F.max(on).alias("latest"), age.alias("age_days"))
    return out.withColumn("status", F.when(F.col("age_days") > critical, "CRITICAL").when(F.col("age_days") > warn, "WARNING").otherwise("OK"))


def presence(frames: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Rows of each layer by key."""
    both = reduce(DataFrame.unionByName, [d.select(*key, F.lit(n).alias("layer")) for n, d in frames.items()])
    return both.groupBy(*key).agg(*(F.count_if(F.col("layer") == n).alias(f"n_{n}") for n in frames))


def stability(scores: DataFrame, by: list[str], value: str, on: str = "date") -> DataFrame:
    """Monthly mean, deviation, its ratio to the mean, and the share of positive values."""
    month = F.date_format(on, "yyyy-MM").alias("month")
    return scores.groupBy(*by, month).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"), F.round(F.try_divide(F.stddev_samp(value), F.avg(value)), 4).alias("stability"), F.round(F.avg((F.col(value) > 0).cast("double")), 4).alias("win_rate"))


def availability(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count(c).alias(f"n_{c}") for c in columns))


def walk_summary(scores: DataFrame, by: list[str], metric: str) -> DataFrame:
    std = F.stddev_pop(metric)
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), F.round(F.avg(metric), 4).alias("mean"), F.round(std, 4).alias("std"), F.round(F.min(metric), 4).alias("best"), F.round(F.max(metric), 4).alias("worst"), F.round(1 / (1 + std), 4).alias("stability"))


def residual_moments(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean, sample deviation, population skewness, excess kurtosis, extremes and the Jarque-Bera statistic."""
    mean = df.groupBy(*by).agg(F.avg(column).alias("__m"))
    d = F.col(column) - F.col("__m")
    out = df.join(mean, by).groupBy(*by).agg(F.count(column).alias("n"), F.first("__m").alias("mean"), F.stddev_samp(column).alias("std"), F.avg(d * d).alias("__2"), F.avg(d * d * d).alias("__3"), F.avg(d * d * d * d).alias("__4"), F.min(column).alias("lowest"), F.max(column).alias("highest"))
    skew, kurt = F.try_divide(F.col("__3"), F.pow("__2", F.lit(1.5))), F.try_divide(F.col("__4"), F.pow("__2", F.lit(2))) - 3
    jb = F.col("n") / 6 * (skew * skew + kurt * kurt / 4)
    return out.select(*by, "n", *(F.round(x, 4).alias(n) for x, n in ((F.col("mean"), "mean"), (F.col("std"), "std"), (skew, "skewness"), (kurt, "kurtosis"), (F.col("lowest"), "lowest"), (F.col("highest"), "highest"), (jb, "jarque_bera"))))


def correlations(df: DataFrame, key: list[str], x: str, ys: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(*(F.round(F.corr(x, y), 4).alias(f"corr_{y}") for y in ys))


def covariate_correlations(prices: DataFrame, tone: DataFrame, key: list[str], column: str = "close", span: int = 7) -> DataFrame:
    """Correlation of prices with a day's tone, its number of events and the tone's momentum over `span` days, for each key.

    `tone` has a row a day (date, tone, n_events); days without news take no part, pairs with a null neither.
    """
    own = tone.withColumn("momentum", F.col("tone") - F.lag("tone", span).over(Window.orderBy("date")))  # a row for each day of the calendar
    rows = prices.join(own, "date")
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.corr(column, c), 4).alias(f"corr_{c}") for c in ("tone", "n_events", "momentum")))


def qualify_series(forecasts: DataFrame, key: list[str], min_span: int = 730, min_coverage: float = 0.9, on: str = "date") -> DataFrame:
    """Which forecast series span enough days and cover enough of them."""
    out = forecasts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_runs"), F.count_distinct(on).alias("n_days"), (F.datediff(F.max(on), F.min(on)) + 1).cast("long").alias("span_days"))
    out = out.withColumn("coverage", F.round(F.col("n_days") / F.col("span_days"), 4)).withColumn("runs_per_day", F.round(F.col("n_runs") / F.col("n_days"), 4))
    out = out.withColumn("qualified", (F.col("span_days") >= min_span) & (F.col("coverage") >= min_coverage))
    return out.withColumn("rating", band(F.col("coverage"), [(0.5, "sparse"), (min_coverage, "partial")], "dense"))


def health_score(parts: Column, weights: list[float]) -> Column:
    """Weighted 0 to 100 score of an array of shares."""
    total = sum(weights)
    return F.round(sum((parts[k] * w for k, w in enumerate(weights)), F.lit(0.0)) * 100 / total, 2)


def duplicate_totals(df: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows of each group."""
    n, keys = F.count(F.lit(1)), F.count_distinct(F.struct(*key))
    return df.groupBy(*by).agg(n.alias("n_rows"), keys.alias("n_keys"), (n - keys).alias("n_duplicates"))


HEALTH_BANDS = [(90.0, "EXCELLENT"), (75.0, "GOOD"), (50.0, "WARNING")]


def health_band(score: Column) -> Column:
    """The severity band of a 0 to 100 score."""
    out = F.lit("CRITICAL")
    for least, name in reversed(HEALTH_BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def with_group_stats(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Every row beside its group's mean and deviation."""
    stats = df.groupBy(*key).agg(F.round(F.avg(column), 2).alias("mean"), F.round(F.stddev_samp(column), 2).alias("std"))
    return df.join(stats, key).select("date", *key, column, "mean", "std")


def day_ahead_accuracy(df: DataFrame, region: str, column: str) -> DataFrame:
    """How well a day's regional mean foretells the next day's: pairs of days and mean absolute error."""
    daily = df.groupBy("date", region).agg(F.round(F.avg(column), 6).alias("forecast"))
    actual = daily.select(F.expr("date_sub(date, 1)").alias("date"), region, F.col("forecast").alias("actual"))
    return daily.join(actual, ["date", region]).groupBy(region).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("forecast") - F.col("actual"))), 4).alias("mae"))


def pivot_groups(df: DataFrame, by: list[str], group: str, names: list[str], column: str) -> DataFrame:
    """A column for each named group's value: one aggregation, no pivot over unknown names."""
    return df.groupBy(*by).agg(*(F.max(F.when(F.col(group) == n, F.col(column))).alias(f"{column}_{n.lower()}") for n in names))
