"""Statistics of forecast errors and rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tails
from .carry import running

ALPHA = 0.05


def verdict(p: Column, alpha: float = ALPHA) -> list[Column]:
    """p_value, and whether it is below alpha."""
    return [F.round(p, 6).alias("p_value"), F.coalesce(p < alpha, F.lit(False)).alias("is_significant")]


def paired_t(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Mean difference, t statistic, Cohen's d and 95 per cent normal interval of paired values, Student's two-sided p and the lower one of the two.

    Pairs with a null are left out; fewer than two pairs or equal differences have no statistic and are not significant.
    """
    d = F.col(a) - F.col(b)
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("__m"), F.stddev_samp(d).alias("__s"))
    half, t = 1.96 * F.col("__s") / F.sqrt("n"), F.try_divide(F.col("__m"), F.col("__s") / F.sqrt("n"))
    shown = [F.round("__m", 4).alias("mean_difference"), F.round(t, 4).alias("t_statistic"), F.round(F.try_divide(F.col("__m"), F.col("__s")), 4).alias("cohens_d"), F.round(F.col("__m") - half, 4).alias("lower_95"), F.round(F.col("__m") + half, 4).alias("upper_95")]
    return out.select(*by, "n", *shown, *verdict(tails.student_two_sided(t, F.col("n") - 1)), F.when(F.col("__m") < 0, a).when(F.col("__m") > 0, b).alias("lower"))


def two_sample_t(df: DataFrame, by: list[str], group: str, first: str, value: str) -> DataFrame:
    """Equal-variance t statistic with Student's two-sided p, and pooled d of group `first` against the rest, with a verbal band."""
    one, two = (F.when(c, F.col(value)) for c in (F.col(group) == first, F.col(group) != first))
    s = df.groupBy(*by).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    d = F.try_divide(F.col("m1") - F.col("m2"), pooled)
    band = F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")
    t = d / F.sqrt(F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2")))
    return s.select(*by, "n1", "n2", F.round(t, 4).alias("t_statistic"), F.round(d, 4).alias("pooled_d"), band.alias("effect"), *verdict(tails.student_two_sided(t, F.col("n1") + F.col("n2") - 2)))


def autocovariances(df: DataFrame, by: list[str], column: str, on: str, lags: int) -> DataFrame:
    """n, mean and autocovariances g0..g<lags> (divided by n) of a series."""
    mean = df.groupBy(*by).agg(F.avg(column).alias("__m"), F.count(column).alias("n"))
    w = Window.partitionBy(*by).orderBy(on)
    own = df.join(mean, by).withColumn("__c", F.col(column) - F.col("__m"))
    own = own.withColumns({f"__p{k}": F.col("__c") * F.lag("__c", k).over(w) for k in range(1, lags + 1)})
    return own.groupBy(*by).agg(F.first("n").alias("n"), F.first("__m").alias("mean"), F.avg(F.col("__c") * F.col("__c")).alias("g0"), *((F.sum(f"__p{k}") / F.first("n")).alias(f"g{k}") for k in range(1, lags + 1)))


def diebold_mariano(df: DataFrame, by: list[str], e1: str, e2: str, h: int, on: str = "date") -> DataFrame:
    """Statistic of squared-loss differences with autocovariances up to h-1, and its small-sample form; p by the normal and Student's distribution.

    `lower_loss` names the errors with the lower mean squared loss.
    """
    own = df.withColumn("__l", F.col(e1) * F.col(e1) - F.col(e2) * F.col(e2))
    g = autocovariances(own, by, "__l", on, h - 1)
    spread = F.col("g0") + 2 * sum((F.col(f"g{k}") for k in range(1, h)), F.lit(0.0))
    dm = F.try_divide(F.col("mean"), F.sqrt(F.when(spread > 0, spread) / F.col("n")))
    n = F.col("n")
    corrected = dm * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    by_student = F.round(tails.student_two_sided(corrected, n - 1), 6).alias("p_corrected")
    return g.select(*by, "n", F.round(dm, 4).alias("dm_statistic"), F.round(corrected, 4).alias("dm_corrected"), *verdict(tails.normal_two_sided(dm)), by_student, F.when(F.col("mean") < 0, e1).when(F.col("mean") > 0, e2).alias("lower_loss"))


def ljung_box(df: DataFrame, by: list[str], column: str, lags: int, on: str = "date") -> DataFrame:
    """Q statistic of the autocorrelations up to `lags` and its chi-square p; significant means that the series is no white noise."""
    g = autocovariances(df, by, column, on, lags)
    n = F.col("n")
    q = n * (n + 2) * sum((F.try_divide(F.pow(F.try_divide(F.col(f"g{k}"), F.col("g0")), F.lit(2)), n - k) for k in range(1, lags + 1)), F.lit(0.0))
    return g.select(*by, "n", F.round(q, 4).alias("q_statistic"), *verdict(tails.chi_square_above(q, F.lit(lags))))


def direction_counts(df: DataFrame, by: list[str], right: str) -> DataFrame:
    """Right directions, trials, accuracy, the normal score against one half, and the exact probability of as many or more by chance."""
    out = df.groupBy(*by).agg(F.count_if(F.col(right)).alias("n_right"), F.count(right).alias("n"))
    accuracy = F.round(F.try_divide(F.col("n_right"), F.col("n")) * 100, 4).alias("accuracy")
    z = F.round(F.try_divide(F.col("n_right") - F.col("n") / 2, F.sqrt(F.col("n") / 4)), 4).alias("z_score")
    return out.select(*by, "n_right", "n", accuracy, z, *verdict(tails.binomial_at_least(F.col("n_right"), F.col("n"))))


def mann_whitney(df: DataFrame, by: list[str], first: str, value: str, parts: int | None = None) -> DataFrame:
    """U of the values where `first` is true against those where it is false, and whether they tend to be larger.

    Values are counted by sample first; mid-ranks come from running counts over blocks of the distinct values, so no task holds
    a sample. p is the one-sided normal one with correction for ties and continuity. `shift_pct` compares the means; rows with
    a null value or flag are left out. A group with one sample alone, or one distinct value, has no p and is not significant.
    """
    own = df.where(F.col(value).isNotNull() & F.col(first).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count_if(F.col(first)).alias("__a"), F.count_if(~F.col(first)).alias("__b"))
    ranked = running(own, by, ["__v"], {"__below": F.col("__b")}, parts)
    t = (F.col("__a") + F.col("__b")).cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("__a").alias("n1"), F.sum("__b").alias("n2"), F.sum(F.col("__a") * (F.col("__below") + F.col("__b") / 2)).alias("u_statistic"), F.sum(t * t * t - t).alias("__t"),
        F.sum(F.col("__v") * F.col("__a")).alias("__s1"), F.sum(F.col("__v") * F.col("__b")).alias("__s2"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("__t"), n * (n - 1))))
    z = F.when((n1 > 0) & (n2 > 0) & (spread > 0), (F.col("u_statistic") - n1 * n2 / 2 - 0.5) / spread)
    mean1, mean2 = F.try_divide(F.col("__s1"), n1), F.try_divide(F.col("__s2"), n2)
    return sums.select(*by, "n1", "n2", F.round("u_statistic", 1).alias("u_statistic"), F.round(z, 4).alias("z_score"), *verdict(tails.normal_above(z)), F.round((F.try_divide(mean1, mean2) - 1) * 100, 4).alias("shift_pct"))


def retrain_alert(tested: DataFrame, warning: float = 10.0, critical: float = 25.0) -> DataFrame:
    """Level of a significant shift in per cent: warning, critical, or ok; both of the first ask for training."""
    bad = F.col("is_significant") & (F.col("shift_pct") > warning)
    level = F.when(bad & (F.col("shift_pct") > critical), "critical").when(bad, "warning").otherwise("ok")
    return tested.withColumns({"level": level, "status": F.when(bad, "RETRAIN_NEEDED").otherwise("OK")})


def regression_alert(scores: DataFrame, key: list[str], metric: str, as_of: str, on: str = "date") -> DataFrame:
    """Last 30 days against the 30 before: change in per cent with levels, and z score of the recent mean against all history before."""
    age = F.datediff(F.lit(as_of).cast("date"), on)
    recent, prior, past = (F.when(c, F.col(metric)) for c in (age.between(0, 29), age.between(30, 59), age >= 30))
    out = scores.groupBy(*key).agg(F.avg(recent).alias("__r"), F.avg(prior).alias("__p"), F.avg(past).alias("__m"), F.stddev_samp(past).alias("__s"))
    pct = (F.try_divide(F.col("__r"), F.col("__p")) - 1) * 100
    return out.select(*key, F.round("__r", 4).alias("recent"), F.round("__p", 4).alias("prior"), F.round(pct, 4).alias("change_pct"), F.round(F.try_divide(F.col("__r") - F.col("__m"), F.col("__s")), 4).alias("z_score"), F.when(pct > 50, "critical").when(pct > 20, "warning").otherwise("ok").alias("level"))


def bootstrap_totals(df: DataFrame, by: list[str], value: str, row_id: str, n: int, seed: int) -> DataFrame:
    """95 per cent interval of a total by a Poisson bootstrap: each row weighs a hash-drawn Poisson(1) count in each replicate.

    A draw is the first 28 bits of the MD5 of seed, row and replicate, so that any engine can replay it. No index join and no
    order: draws depend on row and replicate alone, and a replicate's total is summed where its rows lie. The interval's ends are
    interpolated between the n totals of a group, which one task holds (n is the parameter).
    """
    cuts = [round(x * (1 << 28)) for x in poisson_steps()]
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"), F.col("replicate").cast("string"))), 1, 7), 16, 10).cast("long")
    rows = df.select(*by, value, row_id, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate"))
    weight = sum(((F.col("__u") >= c).cast("int") for c in cuts), F.lit(0))
    sums = rows.withColumn("__u", draw).groupBy(*by, "replicate").agg(F.sum(F.col(value) * weight).alias("total"))
    q = F.percentile("total", F.array(F.lit(0.025), F.lit(0.975)))
    return sums.groupBy(*by).agg(F.round(q[0], 2).alias("lower_95"), F.round(q[1], 2).alias("upper_95"), F.round(F.avg("total"), 2).alias("mean_total"))


def poisson_steps(n: int = 8) -> list[float]:
    """P(X <= k) of a Poisson variable of mean 1, for k below n."""
    total, factor, steps = 0.0, 1.0, []
    for k in range(n):
        total += math.exp(-1) / factor
        factor *= k + 1
        steps.append(total)
    return steps


def best_model(scores: DataFrame, key: list[str], model: str, metric: str, fallback_on: str) -> DataFrame:
    """Per key the model with the lowest mean metric; without any metric the most recent model."""
    means = scores.groupBy(*key, model).agg(F.avg(metric).alias("__m"), F.max(fallback_on).alias("__t"))
    best, recent = F.min(F.when(F.col("__m").isNotNull(), F.struct("__m", model))), F.max(F.struct("__t", model))
    out = means.groupBy(*key).agg(best.alias("__b"), recent.alias("__r"))
    return out.select(*key, F.coalesce(F.col("__b")[model], F.col("__r")[model]).alias("model"), F.round(F.col("__b.__m"), 4).alias("mean_metric"))


def best_flag(df: DataFrame, by: list[str], metric: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(metric, tie)
    return df.withColumn("is_best", F.row_number().over(w) == 1)


def retain(df: DataFrame, key: list[str], on: str, n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(on))
    return df.withColumn("status", F.when(F.row_number().over(w) <= n, "active").otherwise("archived"))


def signal_sharpe(df: DataFrame, by: list[str], forecast: str, actual: str, on: str) -> DataFrame:
    """Annualised ratio of mean to deviation of returns taken in the forecast's direction."""
    w = Window.partitionBy(*by).orderBy(on)
    r = F.signum(F.col(forecast) - F.lag(actual, 1).over(w)) * (F.col(actual) / F.lag(actual, 1).over(w) - 1)
    return df.withColumn("__r", r).groupBy(*by).agg(F.round(F.try_divide(F.avg("__r"), F.stddev_pop("__r")) * math.sqrt(252), 4).alias("sharpe"))
