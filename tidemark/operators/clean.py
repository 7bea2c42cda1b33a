"""Deduplication, set operations, predicates and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_by(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; equal rows in `order` are told apart arbitrarily, so order by something distinct."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def latest_wins(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    return first_by(df, key, [F.desc(ts)])


def most_complete(df: DataFrame, key: list[str], columns: list[str], tie: str) -> DataFrame:
    """Per key the row with the most values; on ties the latest by `tie`."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return first_by(df, key, [filled.desc(), F.desc(tie)])


def last_n(df: DataFrame, key: list[str], on: str, n: int) -> DataFrame:
    return first_by(df, key, [F.desc(on)], n)


def as_of_slice(df: DataFrame, commodity: str, cutoff: str, trading_only: bool = False) -> DataFrame:
    out = df.where((F.col("commodity") == commodity) & (F.col("date") <= F.lit(cutoff).cast("date")))
    return out.where("is_trading_day = 1") if trading_only else out


def matching_newer(df: DataFrame, column: str, pattern: str, since: str, on: str = "date") -> DataFrame:
    """Rows whose column matches without regard to case and that are strictly newer."""
    return df.where(F.upper(column).rlike(pattern.upper()) & (F.col(on) > F.lit(since).cast("date")))


def leakage_flag(df: DataFrame, forecast: str, cutoff: str) -> DataFrame:
    return df.withColumn("has_data_leakage", F.col(forecast) <= F.col(cutoff))


def select_prefix(df: DataFrame, keep: list[str], prefixes: list[str]) -> DataFrame:
    return df.select([c for c in df.columns if c in keep or any(c.startswith(p) for p in prefixes)])


def ohlc_violations(df: DataFrame) -> DataFrame:
    """Rows whose prices contradict each other or are not positive."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = (F.least(o, h, low, c) <= 0) | (h < low) | (h < F.greatest(o, c)) | (low > F.least(o, c)) | (F.col("volume") < 0)
    return df.where(bad)


def range_anomalies(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values out of range per column, counted in one pass."""
    counts = [F.sum((~F.col(c).between(*r)).cast("long")).alias(c) for c, r in ranges.items()]
    return df.agg(*counts).unpivot([], list(ranges), "column", "n_out").select("column", F.coalesce("n_out", F.lit(0)).alias("n_out"))


def band(column: Column, edges: list[tuple[float, str]], default: str) -> Column:
    """The label of the first edge that the value lies below."""
    out = None
    for edge, label in edges:
        test = column < edge
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(column.isNull(), None).otherwise(out.otherwise(default))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def set_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.distinct(), a.columns, "left_anti")


def set_plus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Distinct values of each side, common ones, and the share of a's that b has."""
    sides = a.select(F.col(on).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(on).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    flags = sides.groupBy("v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.sum(F.col("a") * F.col("b"))
    return flags.agg(F.sum("a").cast("long").alias("n_left"), F.sum("b").cast("long").alias("n_right"), both.cast("long").alias("n_common"), F.round(both / F.sum("a"), 4).alias("match_rate"))


def key_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, and which."""
    left = a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti").withColumn("missing_in", F.lit("right"))
    right = b.select(*key).distinct().join(a.select(*key).distinct(), key, "left_anti").withColumn("missing_in", F.lit("left"))
    return left.unionByName(right)


def range_examples(df: DataFrame, limits: dict[str, tuple[float, float]], order: list[str], k: int = 5) -> DataFrame:
    """The first k rows by `order` of each column that lie outside its limits, one row for each such value."""
    cells = [F.when(~F.col(c).between(low, high), F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))) for c, (low, high) in limits.items()]
    out = df.select(*order, F.explode(F.array_compact(F.array(*cells))).alias("__x")).select(*order, "__x.*")
    w = Window.partitionBy("column").orderBy(*order)
    return out.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def convert_units(prices: DataFrame, rates: DataFrame, factor: float, chunk: int = 1000) -> DataFrame:
    """Every price in the units of each series' latest rate, rounded half up.

    The result has a row for each price and series. Latest rates are packed into rows of `chunk` of them, which prices are joined
    with and unpacked from, for any number of series; none comes to the driver.
    """
    latest = rates.groupBy("series").agg(F.max_by("value", "date").alias("value"))
    packed = latest.groupBy(F.pmod(F.xxhash64("series"), F.greatest(F.lit(1), F.ceil(latest_count(latest) / chunk))).alias("__c")).agg(F.collect_list(F.struct("series", "value")).alias("__r"))
    own = prices.select("date", "commodity", "close").join(packed.select("__r")).select("date", "commodity", "close", F.explode("__r").alias("__r"))
    return own.select("date", "commodity", "__r.series", (F.floor(F.col("close") * factor * F.col("__r.value") * 100 + 0.5) / 100).alias("local_price"))


def latest_count(latest: DataFrame) -> Column:
    return F.lit(latest.count())
