"""Decision signals, each stateless per key and date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def batch_ladder(rsi: Column, dx: Column) -> Column:
    """Share to sell: overbought and trending most, otherwise in steps."""
    return F.when((rsi > 70) & (dx > 25), 0.35).when(rsi > 70, 0.30).when((rsi < 30) & (dx > 25), 0.10).when(rsi < 30, 0.15).otherwise(0.25)


def threshold_signal(df: DataFrame, over: str = "over_threshold", rsi: str = "rsi_14", dx: str = "dx_14") -> DataFrame:
    """Sells a ladder's share where the price stands over its threshold."""
    return df.withColumns({"action": F.when(F.col(over), "SELL").otherwise("HOLD"), "share": F.when(F.col(over), batch_ladder(F.col(rsi), F.col(dx))).otherwise(0.0)})


def crossover_signal(df: DataFrame, rsi: str = "rsi_14", dx: str = "dx_14") -> DataFrame:
    """Sells where the price crosses its mean downwards."""
    return threshold_signal(df, "cross_down", rsi, dx)


def prediction_override(base: DataFrame, expected: DataFrame, key: list[str], min_gain: float) -> DataFrame:
    """High confidence overrides the base signal, medium confidence is averaged with it, low confidence leaves it."""
    own = base.join(expected, key, "left")
    wait = F.col("net_benefit_pct") > min_gain
    told = F.when(wait, 0.0).otherwise(0.4)
    share = F.when(F.col("tier") == "high", told).when(F.col("tier") == "medium", (F.col("share") + told) / 2).otherwise(F.col("share"))
    return own.withColumn("share", F.round(F.coalesce(share, "share"), 4))


def ev_signal(df: DataFrame, min_gain: float) -> DataFrame:
    """Share by expected gain of waiting and dispersion tier."""
    gain = F.col("net_benefit_pct")
    share = F.when((gain > 2 * min_gain) & (F.col("tier") != "low"), 0.0).when(gain > min_gain, F.when(F.col("tier") == "low", 0.15).otherwise(0.10)).when(gain > 0, 0.20).otherwise(F.when(F.col("tier") == "high", 0.40).otherwise(0.30))
    return df.withColumn("share", share)


def consensus_signal(df: DataFrame, strong: float = 0.7, weak: float = 0.6, min_gain: float = 0.5) -> DataFrame:
    """Share by how many paths rise and whether waiting pays."""
    bull, gain = F.col("consensus"), F.col("net_benefit_pct")
    share = F.when((bull >= strong) & (gain > min_gain), 0.0).when((bull >= weak) & (gain > min_gain), 0.10).when(bull <= 1 - strong, 0.40).when(bull <= 1 - weak, 0.30).otherwise(0.20)
    return df.withColumn("share", share)


def risk_signal(df: DataFrame, low: float, high: float, min_gain: float = 0.5) -> DataFrame:
    """Share by dispersion: certain gains are waited for, uncertain paths are sold in small lots."""
    d, gain = F.col("dispersion"), F.col("net_benefit_pct")
    share = F.when((d < low) & (gain > min_gain), 0.0).when((d < high) & (gain > min_gain), 0.10).when(d < low, 0.40).when(d < high, 0.30).otherwise(0.25)
    return df.withColumn("share", share)


def horizon_signal(points: DataFrame, by: list[str], storage: float, fee_pct: float, decay: float) -> DataFrame:
    """Sell today if today's net value is at least that of every later day, discounted and less storage."""
    net = F.col("forecast") * (1 - fee_pct / 100) * F.pow(F.lit(1 - decay), F.col("day") - 1) - storage * (F.col("day") - 1)
    own = points.withColumn("__n", F.round(net, 6)).groupBy(*by).agg(F.max(F.when(F.col("day") == 1, F.col("__n"))).alias("now"), F.max(F.when(F.col("day") > 1, F.col("__n"))).alias("later"))
    return own.select(*by, F.round("now", 2).alias("now"), F.round("later", 2).alias("later"), (F.col("now") >= F.col("later")).alias("sell_now"))


def hold_or_sell(expected: DataFrame, min_gain: float) -> DataFrame:
    gain = F.col("best_value") - F.col("now_value")
    return expected.withColumn("gain", F.round(gain, 4)).withColumn("recommendation", F.when(F.col("gain") >= min_gain, "HOLD").otherwise("SELL"))


def parameter_grid(df: DataFrame, params: list[dict], signal) -> DataFrame:
    """The same signal under each of a few parameter sets, whose number is its `variant`."""
    return reduce(DataFrame.unionByName, [signal(df, **p).withColumn("variant", F.lit(k)) for k, p in enumerate(params)])


def vote(signals: DataFrame, by: list[str]) -> DataFrame:
    """Rows (strategy, share) of several signals: the majority's action, the mean share and the share of sellers."""
    out = signals.groupBy(*by).agg(F.count_if(F.col("share") > 0).alias("n_sell"), F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 4).alias("mean_share"))
    return out.withColumn("action", F.when(F.col("n_sell") * 2 > F.col("n"), "SELL").otherwise("HOLD")).withColumn("sell_pct", F.round(100 * F.col("n_sell") / F.col("n"), 2))


def primary_vote(signals: DataFrame, by: list[str], trend: DataFrame) -> DataFrame:
    """Rows (strategy, share) of several signals: the action of the majority (HOLD on ties), the mean share of those that sell
    (0 unless it is SELL), and the price's trend (columns `by` and trend_pct) with its direction.
    """
    n_sell = F.count_if(F.col("share") > 0)
    out = signals.groupBy(*by).agg(n_sell.alias("n_sell"), F.count_if(F.col("share") <= 0).alias("n_hold"), F.avg(F.when(F.col("share") > 0, F.col("share"))).alias("__q"))
    sell = F.col("n_sell") > F.col("n_hold")
    out = out.withColumns({"action": F.when(sell, "SELL").otherwise("HOLD"), "quantity": F.when(sell, F.round("__q", 4)).otherwise(0.0)}).drop("__q")
    return out.join(trend, by, "left").withColumn("direction", F.when(F.col("trend_pct") > 0, "up").otherwise("down"))
