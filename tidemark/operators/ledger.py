"""Trade ledgers, harvest schedules and strategy comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ledger_metrics(trades: DataFrame, by: list[str], fee_pct: float) -> DataFrame:
    """Revenue, fees, net, mean price by amount, first and last price, days to the last trade and mean gap between trades."""
    revenue = F.sum(F.col("amount") * F.col("price"))
    n = F.count(F.lit(1))
    days = F.datediff(F.max("date"), F.min("date"))
    return trades.groupBy(*by).agg(n.alias("n_trades"), F.round(revenue, 2).alias("revenue"), F.round(revenue * fee_pct / 100, 2).alias("fees"), F.round(revenue * (1 - fee_pct / 100), 2).alias("net"), F.round(revenue / F.sum("amount"), 4).alias("mean_price"), F.min_by("price", F.struct("date", "trade_id")).alias("first_price"), F.max_by("price", F.struct("date", "trade_id")).alias("last_price"), days.cast("long").alias("days"), F.round(F.try_divide(days, n - 1), 4).alias("mean_gap"))


def ledger_metrics_by_year(trades: DataFrame, by: list[str], fee_pct: float) -> DataFrame:
    return ledger_metrics(trades.withColumn("year", F.year("date")), [*by, "year"], fee_pct)


def leaderboard(metrics: DataFrame, baselines: list[str], name: str = "strategy", value: str = "net") -> DataFrame:
    """The best baseline, the best of the others, their difference and per cent."""
    is_base = F.col(name).isin(baselines)
    best = metrics.agg(F.max(F.when(is_base, F.struct(value, name))).alias("b"), F.max(F.when(~is_base, F.struct(value, name))).alias("p"))
    b, p = F.col(f"b.{value}"), F.col(f"p.{value}")
    return best.select(F.col(f"b.{name}").alias("best_baseline"), F.col(f"p.{name}").alias("best_prediction"), F.round(p - b, 2).alias("difference"), F.round((p / b - 1) * 100, 4).alias("difference_pct"))


def reason_share(trades: DataFrame, by: list[str], forced: str) -> DataFrame:
    """Trades and share of the amount sold for a reason that matches `forced`, and how often that is; `reason_counts` has every reason."""
    hit = F.lower("reason").rlike(forced)
    share = F.sum(F.when(hit, F.col("amount")).otherwise(0.0)) / F.sum("amount") * 100
    out = trades.groupBy(*by).agg(F.count_if(hit).alias("n_forced"), F.round(share, 4).alias("forced_pct"))
    return out.withColumn("scenario", F.when(F.col("forced_pct") < 5, "rare").when(F.col("forced_pct") < 25, "some").otherwise("frequent"))


def reason_counts(trades: DataFrame, by: list[str], forced: str) -> DataFrame:
    """Trades, amount and share of the amount by reason, and whether the reason is a forced one; a missing reason is UNKNOWN.

    Shares come from the totals, which are sums of the rows per reason (a few a strategy), not of the trades.
    """
    reason = F.coalesce(F.col("reason"), F.lit("UNKNOWN"))
    own = trades.groupBy(*by, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("__a"))
    whole = Window.partitionBy(*by)
    share = F.round(F.try_divide(F.col("__a"), F.sum("__a").over(whole)) * 100, 4).alias("amount_pct")
    return own.select(*by, "reason", "n", F.round("__a", 2).alias("amount"), share, F.lower("reason").rlike(forced).alias("is_forced"))


def foresight_value(trades: DataFrame, bounds: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """What the amounts of the trades were worth on their days with perfect foresight: the bound by which efficiency is measured."""
    return trades.join(bounds.select(*key, "date", "bound"), [*key, "date"]).groupBy(*by).agg(F.round(F.sum(F.col("amount") * F.col("bound")), 0).alias("bound_value"))


def efficiency_summary(rated: DataFrame) -> DataFrame:
    """Number, mean, deviation and extremes of efficiencies, and how many are in each category."""
    e = F.col("efficiency")
    bands = [F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ("excellent", "good", "fair", "poor")]
    return rated.agg(F.count(e).alias("n"), F.round(F.avg(e), 4).alias("mean"), F.round(F.stddev_samp(e), 4).alias("std"), F.min(e).alias("lowest"), F.max(e).alias("highest"), *bands)


def efficiency(metrics: DataFrame, bound: Column, value: str = "net") -> DataFrame:
    ratio = F.col(value) / bound
    return metrics.withColumns({"efficiency": F.round(ratio, 4), "gap": F.round(bound - F.col(value), 2), "category": F.when(ratio >= 0.95, "excellent").when(ratio >= 0.85, "good").when(ratio >= 0.7, "fair").otherwise("poor")})


def portfolio_value(trades: DataFrame, by: list[str], fee_pct: float) -> DataFrame:
    """Daily and cumulative net proceeds and the day's change of the total in per cent."""
    day = trades.groupBy(*by, "date").agg(F.round(F.sum(F.col("amount") * F.col("price")) * (1 - fee_pct / 100), 2).alias("proceeds"))
    w = Window.partitionBy(*by).orderBy("date")
    out = day.withColumn("total", F.round(F.sum("proceeds").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2))
    return out.withColumn("change_pct", F.round((F.col("total") / F.lag("total", 1).over(w) - 1) * 100, 4))


def harvest_schedule(dates: DataFrame, first_month: int, last_month: int, volume: float, on: str = "date") -> DataFrame:
    """Whether a day lies in the harvest months (which may wrap the year), whether it opens them, and the day's volume."""
    m = F.month(on)
    inside = m.between(first_month, last_month) if first_month <= last_month else (m >= first_month) | (m <= last_month)
    months = (last_month - first_month) % 12 + 1
    w = Window.partitionBy(F.lit(1)).orderBy(on)  # a calendar, 366 rows a year
    out = dates.withColumn("in_harvest", inside)
    return out.withColumn("opens", F.col("in_harvest") & ~F.coalesce(F.lag("in_harvest", 1).over(w), F.lit(False))).withColumn("daily_volume", F.when(F.col("in_harvest"), F.lit(round(volume / (30 * months), 6))).otherwise(0.0))


def foresight_bound(prices: DataFrame, key: list[str], storage: float, fee_pct: float, on: str = "date", column: str = "close") -> DataFrame:
    """What a unit held from a day is worth with perfect foresight: the best later net price less storage for each row waited."""
    w = Window.partitionBy(*key).orderBy(on)
    i = F.row_number().over(w)
    own = prices.withColumn("__n", F.col(column) * (1 - fee_pct / 100)).withColumn("__c", (i - 1) * storage)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return own.withColumn("bound", F.round(F.max(F.col("__n") - F.col("__c")).over(ahead) + F.col("__c"), 4)).drop("__n", "__c")


def pair(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Two strategies' values on the days that both have."""
    return a.select(*on, F.col(value).alias("a")).join(b.select(*on, F.col(value).alias("b")), on)


def decision_diff(optimal: DataFrame, actual: DataFrame, key: list[str], value: str, least: float = 0.1) -> DataFrame:
    both = optimal.select(*key, F.col(value).alias("optimal")).join(actual.select(*key, F.col(value).alias("actual")), key, "left")
    d = F.coalesce("actual", F.lit(0.0)) - F.col("optimal")
    return both.withColumn("difference", F.round(d, 4)).withColumn("differs", F.abs(d) > least)
