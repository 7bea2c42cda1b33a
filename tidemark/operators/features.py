"""Lag, rolling, technical and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def ordered(key: list[str], on: str) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(on)


def trailing(key: list[str], on: str, n: int) -> WindowSpec:
    return ordered(key, on).rowsBetween(1 - n, 0)


def lags(df: DataFrame, columns: list[str], periods: list[int], key: list[str], on: str = "date") -> DataFrame:
    w = ordered(key, on)
    return df.withColumns({f"{c}_lag_{p}": F.lag(c, p).over(w) for c in columns for p in periods})


def diffs(df: DataFrame, columns: list[str], periods: list[int], key: list[str], on: str = "date") -> DataFrame:
    w = ordered(key, on)
    return df.withColumns({f"{c}_diff_{p}": F.round(F.col(c) - F.lag(c, p).over(w), 4) for c in columns for p in periods})


def rolling(df: DataFrame, columns: list[str], sizes: list[int], key: list[str], on: str = "date", full: bool = False) -> DataFrame:
    """Trailing mean and sample deviation over n rows; with `full` null until there are n rows."""
    out = {}
    for n in sizes:
        w = trailing(key, on, n)
        for c in columns:
            for name, fn in (("mean", F.avg), ("std", F.stddev_samp)):
                x = F.round(fn(c).over(w), 4)
                out[f"{c}_{name}_{n}"] = F.when(F.count(F.lit(1)).over(w) == n, x) if full else x
    return df.withColumns(out)


def returns(column: str, w: WindowSpec) -> Column:
    return F.col(column) / F.lag(column, 1).over(w) - 1


def rsi_momentum_vol(df: DataFrame, column: str, periods: list[int], key: list[str], on: str = "date") -> DataFrame:
    """Relative strength from simple means of gains and losses, momentum over n rows and deviation of returns; null until full."""
    w = ordered(key, on)
    base = df.withColumn("__d", F.col(column) - F.lag(column, 1).over(w)).withColumn("__r", returns(column, w))
    out = {}
    for n in periods:
        span = trailing(key, on, n)
        full = F.count("__d").over(span) == n
        gain, loss = (F.avg(F.greatest(s * F.col("__d"), F.lit(0.0))).over(span) for s in (F.lit(1), F.lit(-1)))
        out[f"rsi_{n}"] = F.when(full, F.when(loss == 0, 100.0).otherwise(F.round(100 - 100 / (1 + gain / loss), 4)))
        out[f"momentum_{n}"] = F.round(F.col(column) / F.lag(column, n).over(w) - 1, 4)
        out[f"volatility_{n}"] = F.when(full, F.round(F.stddev_samp("__r").over(span), 4))
    return base.withColumns(out).drop("__d", "__r")


def bollinger(df: DataFrame, column: str, key: list[str], on: str = "date", n: int = 20, k: float = 2.0) -> DataFrame:
    w = trailing(key, on, n)
    mid, std = F.avg(column).over(w), F.stddev_samp(column).over(w)
    full = F.count(F.lit(1)).over(w) == n
    base = df.withColumn("__m", F.when(full, mid)).withColumn("__s", F.when(full, std))
    upper, lower = F.col("__m") + k * F.col("__s"), F.col("__m") - k * F.col("__s")
    out = {"bb_mid": F.round("__m", 4), "bb_upper": F.round(upper, 4), "bb_lower": F.round(lower, 4), "bb_width": F.round((upper - lower) / F.col("__m"), 4), "bb_position": F.round(F.try_divide(F.col(column) - lower, upper - lower), 4)}
    return base.withColumns(out).drop("__m", "__s")


def channel(df: DataFrame, column: str, sizes: list[int], key: list[str], on: str = "date") -> DataFrame:
    """Distance from the trailing mean and place between trailing low and high."""
    out = {}
    for n in sizes:
        w = trailing(key, on, n)
        low, high = F.min(column).over(w), F.max(column).over(w)
        out[f"ma_distance_{n}"] = F.round(F.col(column) / F.avg(column).over(w) - 1, 4)
        out[f"channel_{n}"] = F.round(F.try_divide(F.col(column) - low, high - low), 4)
    return df.withColumns(out)


def trend_slope(df: DataFrame, column: str, sizes: list[int], key: list[str], on: str = "date") -> DataFrame:
    """Least-squares slope by row number over full trailing windows."""
    base = df.withColumn("__i", F.row_number().over(ordered(key, on)).cast("double"))
    out = {}
    for n in sizes:
        w = trailing(key, on, n)
        out[f"slope_{n}"] = F.when(F.count(F.lit(1)).over(w) == n, F.round(F.regr_slope(F.col(column), F.col("__i")).over(w), 4))
    return base.withColumns(out).drop("__i")


def gaps(df: DataFrame, key: list[str], max_gap: int, on: str = "date") -> DataFrame:
    """Consecutive dates of a key that lie more than max_gap days apart."""
    before = F.lag(on, 1).over(ordered(key, on))
    return df.withColumn("previous", before).withColumn("gap_days", F.datediff(on, "previous").cast("long")).where(F.col("gap_days") > max_gap).select(*key, on, "previous", "gap_days")


def outliers(df: DataFrame, key: list[str], column: str, z: float) -> DataFrame:
    """Rows more than z deviations from their key's mean; the statistics are aggregated and joined, not windowed."""
    stats = df.groupBy(*key).agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    score = F.round(F.try_divide(F.col(column) - F.col("__m"), F.col("__s")), 4)
    return df.join(stats, key).withColumn("z_score", score).where(F.abs("z_score") > z).drop("__m", "__s")


def change_high_low(df: DataFrame, column: str, n: int, span: int, key: list[str], on: str = "date") -> DataFrame:
    """Per key's last row: change over n rows in per cent, high and low of the last `span` rows."""
    w, back = ordered(key, on), trailing(key, on, span)
    out = df.withColumns({"change_pct": F.round((F.col(column) / F.lag(column, n).over(w) - 1) * 100, 4), "span_high": F.max(column).over(back), "span_low": F.min(column).over(back), "__n": F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(on)))})
    return out.where("__n = 1").select(*key, on, column, "change_pct", "span_high", "span_low")


def rsi_dx(df: DataFrame, n: int, key: list[str], on: str = "date", column: str = "close") -> DataFrame:
    """rsi_n (50 when short, 100 without losses) and dx_n (20 when short), unsmoothed, from high, low and close."""
    w, span = ordered(key, on), trailing(key, on, n)
    up, down = F.col("high") - F.lag("high", 1).over(w), F.lag("low", 1).over(w) - F.col("low")
    before = F.lag(column, 1).over(w)
    base = df.withColumns({"__d": F.col(column) - before, "__up": F.when((up > down) & (up > 0), up).otherwise(0.0), "__dn": F.when((down > up) & (down > 0), down).otherwise(0.0), "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))})
    full = F.count("__d").over(span) == n
    gain, loss = (F.avg(F.greatest(s * F.col("__d"), F.lit(0.0))).over(span) for s in (F.lit(1), F.lit(-1)))
    tr, plus, minus = (F.avg(c).over(span) for c in ("__tr", "__up", "__dn"))
    dx = 100 * F.abs(F.try_divide(plus, tr) - F.try_divide(minus, tr)) / (F.try_divide(plus, tr) + F.try_divide(minus, tr))
    base = base.withColumns({f"rsi_{n}": F.when(~full, 50.0).when(loss == 0, 100.0).otherwise(F.round(100 - 100 / (1 + gain / loss), 4)), f"dx_{n}": F.when(~full | (plus + minus == 0), 20.0).otherwise(F.round(dx, 4))})
    return base.drop("__d", "__up", "__dn", "__tr")


def hist_vol(df: DataFrame, n: int, key: list[str], on: str = "date", column: str = "close") -> DataFrame:
    base = df.withColumn("__r", returns(column, ordered(key, on)))
    return base.withColumn(f"hist_vol_{n}", F.round(F.stddev_pop("__r").over(trailing(key, on, n)), 4)).drop("__r")


def crossings(df: DataFrame, n: int, threshold_pct: float, key: list[str], on: str = "date", column: str = "close") -> DataFrame:
    """Crossings of price and trailing mean, up and down, and whether the price is threshold_pct above the mean."""
    w, span = ordered(key, on), trailing(key, on, n)
    base = df.withColumn("ma", F.when(F.count(F.lit(1)).over(span) == n, F.avg(column).over(span)))
    above, was = F.col(column) > F.col("ma"), F.lag(column, 1).over(w) > F.lag("ma", 1).over(w)
    out = base.withColumns({"cross_up": F.coalesce(above & ~was, F.lit(False)), "cross_down": F.coalesce(~above & was, F.lit(False)), "over_threshold": F.coalesce(F.col(column) > F.col("ma") * (1 + threshold_pct / 100), F.lit(False))})
    return out.withColumn("ma", F.round("ma", 4))


def calendar(df: DataFrame, on: str = "date") -> DataFrame:
    return df.withColumns({"day_of_week": F.dayofweek(on), "month": F.month(on), "quarter": F.quarter(on), "day_of_year": F.dayofyear(on)})


def cyclic(df: DataFrame, on: str = "date") -> DataFrame:
    parts = {"dow": ((F.dayofweek(on) + 5) % 7, 7), "dom": (F.dayofmonth(on), 31), "doy": (F.dayofyear(on), 365), "week": (F.weekofyear(on), 52)}
    return df.withColumns({f"{name}_{fn}": F.round(f(2 * math.pi * x / period), 4) for name, (x, period) in parts.items() for fn, f in (("sin", F.sin), ("cos", F.cos))})


def fourier(df: DataFrame, n: int, period: float, on: str = "date") -> DataFrame:
    x = F.dayofyear(on)
    return df.withColumns({f"{name}_{k}": F.round(f(2 * math.pi * k * x / period), 4) for k in range(1, n + 1) for name, f in (("fourier_sin", F.sin), ("fourier_cos", F.cos))})


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.round(F.col(a) * F.col(b), 4) for a, b in pairs})


def regime(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """The band of a value (bands closed on the right) and a flag for each band."""
    n = sum((F.col(column) > e).cast("int") for e in edges)
    return df.withColumn("regime", n).withColumns({f"regime_{k}": (n == k).cast("int") for k in range(len(edges) + 1)})


def scale(df: DataFrame, columns: list[str], method: str, cutoff: str, on: str = "date") -> tuple[DataFrame, DataFrame]:
    """(scaled rows, parameters): fitted on rows up to the cutoff only; a constant column is divided by 1."""
    fit = df.where(F.col(on) <= F.lit(cutoff).cast("date"))
    if method == "standard":
        stats = {c: (F.avg(c), F.stddev_pop(c)) for c in columns}
    else:
        stats = {c: (F.min(c), F.max(c) - F.min(c)) for c in columns}
    params = fit.agg(*(x.alias(f"{c}_{n}") for c, both in stats.items() for n, x in zip(("shift", "factor"), both, strict=True)))
    row = params.first().asDict()
    out = {}
    for c in columns:
        factor = row[f"{c}_factor"] or 1.0
        out[f"{c}_scaled"] = F.round((F.col(c) - F.lit(row[f"{c}_shift"])) / F.lit(factor), 4)
    return df.withColumns(out), params


def row_mean_by_suffix(df: DataFrame, prefix: str, suffixes: list[str]) -> DataFrame:
    """For each suffix the mean of a row's prefixed columns that end with it, nulls left out."""
    out = {}
    for s in suffixes:
        own = [F.col(c) for c in df.columns if c.startswith(prefix) and c.endswith(s)]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in own), F.lit(0.0))
        out[f"{prefix}{s}_all"] = F.round(F.try_divide(total, sum((c.isNotNull().cast("int") for c in own), F.lit(0))), 4)
    return df.withColumns(out)


def sentiment_spans(df: DataFrame, key: list[str], column: str, spans: list[int], on: str = "date") -> DataFrame:
    """Mean, deviation and extremes of a tone over each full span of rows, its momentum over the span, and that one's change."""
    w, out = ordered(key, on), df
    for n in spans:
        span = trailing(key, on, n)
        full = F.count(F.lit(1)).over(span) == n
        out = out.withColumns({f"{column}_{name}_{n}": F.when(full, F.round(fn(column).over(span), 6)) for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))})
        out = out.withColumn(f"momentum_{n}", F.round(F.col(column) - F.lag(column, n).over(w), 6))
        out = out.withColumn(f"acceleration_{n}", F.round(F.col(f"momentum_{n}") - F.lag(f"momentum_{n}", n).over(w), 6))
    return out


def unscale(df: DataFrame, columns: list[str], params: DataFrame) -> DataFrame:
    """The values behind `<column>_scaled`, by the one row of parameters that `scale` has fitted, as `<column>_restored`."""
    row = params.first().asDict()
    return df.withColumns({f"{c}_restored": F.round(F.col(f"{c}_scaled") * F.lit(row[f"{c}_factor"] or 1.0) + F.lit(row[f"{c}_shift"]), 2) for c in columns})


def week_trend(df: DataFrame, key: list[str], column: str = "close", n: int = 7, on: str = "date") -> DataFrame:
    """Change in per cent from the first to the last of the last n rows, as trend_pct."""
    return df.select(on, *key, F.round((F.col(column) / F.first(column).over(trailing(key, on, n)) - 1) * 100, 4).alias("trend_pct"))
