"""Baseline forecasts for many series and cut-off dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

Z80, Z95 = 1.28, 1.96


def with_horizon(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("day_ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def naive(df: DataFrame, horizon: int, key: list[str], column: str = "close") -> DataFrame:
    """The last value with 80 and 95 per cent bands that widen with the root of the horizon."""
    w = Window.partitionBy(*key).orderBy("date")
    own = df.withColumn("__r", F.col(column) / F.lag(column, 1).over(w) - 1)
    fit = own.groupBy(*key).agg(F.max_by(column, "date").alias("forecast"), F.stddev_samp("__r").alias("sigma"), F.max("date").alias("data_cutoff_date"))
    out = with_horizon(fit, horizon).withColumn("forecast_date", F.expr("date_add(data_cutoff_date, day_ahead)"))
    half = F.col("forecast") * F.col("sigma") * F.sqrt("day_ahead")
    bands = {f"{side}_{level}": F.round(F.col("forecast") + s * z * half, 4) for level, z in ((80, Z80), (95, Z95)) for side, s in (("lower", -1), ("upper", 1))}
    return out.withColumns(bands).withColumn("forecast", F.round("forecast", 4)).drop("sigma")


def drift(df: DataFrame, horizon: int, key: list[str], lookback: int = 30, column: str = "close") -> DataFrame:
    """Random walk with the mean daily change of the last `lookback` changes."""
    w, back = Window.partitionBy(*key).orderBy("date"), Window.partitionBy(*key).orderBy(F.desc("date"))
    own = df.withColumn("__d", F.col(column) - F.lag(column, 1).over(w)).withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= lookback)
    fit = own.groupBy(*key).agg(F.max_by(column, "date").alias("last"), F.avg("__d").alias("mu"), F.stddev_samp("__d").alias("sigma"))
    out = with_horizon(fit, horizon)
    return out.select(*key, "day_ahead", F.round(F.col("last") + F.col("mu") * F.col("day_ahead"), 4).alias("forecast"), F.round(F.col("sigma") * F.sqrt("day_ahead"), 4).alias("forecast_std"))


def persist(df: DataFrame, columns: list[str], horizon: int, key: list[str]) -> DataFrame:
    """The last row's covariates on each day ahead."""
    last = df.groupBy(*key).agg(F.max("date").alias("__last"), *(F.max_by(c, "date").alias(c) for c in columns))
    return with_horizon(last, horizon).withColumn("date", F.expr("date_add(__last, day_ahead)")).drop("__last")


def seasonal(df: DataFrame, columns: list[str], horizon: int, key: list[str], years: int = 3) -> DataFrame:
    """Mean of the covariates on the same date of the years before, or one day earlier or later, else the last value."""
    last = persist(df, columns, horizon, key)
    asked = last.select(*key, "day_ahead", "date", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("year"))
    offsets = F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(o).alias("off")) for r, o in ((0, 0), (1, -1), (2, 1)))))
    asked = asked.withColumn("__o", offsets).withColumn("seen", F.expr("date_add(add_months(date, -12 * year), __o.off)"))
    hits = asked.join(df.select(*key, F.col("date").alias("seen"), *columns), [*key, "seen"])
    per_year = hits.groupBy(*key, "day_ahead", "year").agg(*(F.min_by(c, "__o.rank").alias(c) for c in columns))
    mean = per_year.groupBy(*key, "day_ahead").agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    return last.join(mean, [*key, "day_ahead"], "left").select(*key, "day_ahead", "date", *(F.round(F.coalesce(f"__{c}", c), 4).alias(c) for c in columns))


def trend(df: DataFrame, columns: list[str], horizon: int, key: list[str], lookback: int = 30, least: int = 5) -> DataFrame:
    """Straight line through the last `lookback` rows (fewer than `least`: the last value)."""
    back = Window.partitionBy(*key).orderBy(F.desc("date"))
    own = df.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= lookback).withColumn("__x", (-F.col("__n")).cast("double"))
    fit = own.groupBy(*key).agg(F.count(F.lit(1)).alias("__c"), *(x for c in columns for x in (F.regr_slope(F.col(c), F.col("__x")).alias(f"__s_{c}"), F.regr_intercept(F.col(c), F.col("__x")).alias(f"__i_{c}"), F.max_by(c, "__x").alias(f"__l_{c}"))))
    line = {c: F.when(F.col("__c") >= least, F.col(f"__i_{c}") + F.col(f"__s_{c}") * (F.col("day_ahead") - 1)).otherwise(F.col(f"__l_{c}")) for c in columns}
    return with_horizon(fit, horizon).select(*key, "day_ahead", *(F.round(x, 4).alias(c) for c, x in line.items()))


def naive_at_cutoffs(df: DataFrame, key: list[str], every: int, horizon: int, column: str = "close") -> DataFrame:
    """The naive forecast and its drift form at every `every`-th row of a series, scored against later rows: no loop over cut-offs."""
    w = Window.partitionBy(*key).orderBy("date")
    past = w.rowsBetween(-30, 0)
    own = df.withColumns({"__i": F.row_number().over(w), "__d": F.col(column) - F.lag(column, 1).over(w)})
    own = own.withColumns({"drift": F.avg("__d").over(past), "actual": F.lead(column, horizon).over(w)})
    own = own.where((F.col("__i") % every == 0) & F.col("actual").isNotNull())
    return own.select(*key, F.col("date").alias("data_cutoff_date"), F.lit(horizon).alias("day_ahead"), F.round(column, 4).alias("naive"), F.round(F.col(column) + horizon * F.col("drift"), 4).alias("drifted"), F.round("actual", 4).alias("actual"))


def all_at_cutoffs(df: DataFrame, key: list[str], horizon: int, column: str = "close", lookback: int = 30, least: int = 5, years: int = 3) -> DataFrame:
    """Every baseline (naive, drift, trend, seasonal) at every row of a series as its cut-off, beside the value `horizon` rows later.

    Drift and trend are windows that end at the cut-off. The seasonal value is the mean over the years before of the value on the
    target's date (`horizon` days ahead), or one day earlier or later; without any it is the last value.
    """
    w = Window.partitionBy(*key).orderBy("date")
    past, line = w.rowsBetween(-lookback, 0), w.rowsBetween(1 - lookback, 0)
    own = df.select(*key, "date", column).withColumns({"__i": F.row_number().over(w).cast("double"), "__d": F.col(column) - F.lag(column, 1).over(w)})
    slope, start = (f(F.col(column), F.col("__i")).over(line) for f in (F.regr_slope, F.regr_intercept))
    trended = F.when(F.count(F.lit(1)).over(line) >= least, start + slope * (F.col("__i") + horizon)).otherwise(F.col(column))
    own = own.withColumns({"actual": F.lead(column, horizon).over(w), "drift": F.col(column) + horizon * F.avg("__d").over(past), "trend": trended, "naive": F.col(column)}).where("actual IS NOT NULL")
    asked = own.select(*key, "date", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("__y"))
    near = F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(o).alias("off")) for r, o in ((0, 0), (1, -1), (2, 1)))))
    asked = asked.withColumn("__o", near).withColumn("__seen", F.expr(f"date_add(add_months(date_add(date, {horizon}), -12 * __y), __o.off)"))
    hits = asked.join(df.select(*key, F.col("date").alias("__seen"), F.col(column).alias("__v")), [*key, "__seen"])
    mean = hits.groupBy(*key, "date", "__y").agg(F.min_by("__v", "__o.rank").alias("__v")).groupBy(*key, "date").agg(F.avg("__v").alias("__v"))
    out = own.join(mean, [*key, "date"], "left").withColumn("seasonal", F.coalesce("__v", column))
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.round(m, 4).alias("forecast")) for m in ("naive", "drift", "trend", "seasonal")))).alias("__m")
    return out.select(*key, F.col("date").alias("data_cutoff_date"), F.lit(horizon).alias("day_ahead"), F.round("actual", 4).alias("actual"), models).select(*key, "data_cutoff_date", "day_ahead", "actual", "__m.*")


def fan_out(df: DataFrame, key: list[str], months: int, horizon: int, column: str = "close", lookback: int = 30) -> DataFrame:
    """Forecasts of every series, model and cut-off from state that is fitted once in `months` months.

    A series is trained at its first row of each such period of the calendar: the mean change and the slope of the last
    `lookback` rows. Every cut-off takes the latest state at or before it (no join: the state runs along the series), and its
    own last value. So training work follows the periods and inference is one pass.
    """
    w = Window.partitionBy(*key).orderBy("date")
    line = w.rowsBetween(1 - lookback, 0)
    period = F.floor((F.year("date") * 12 + F.month("date") - 1) / months)
    own = df.select(*key, "date", column).withColumns({"__i": F.row_number().over(w).cast("double"), "__p": period})
    trains = F.col("__p") != F.coalesce(F.lag("__p", 1).over(w), F.lit(-1))
    fitted = F.when(trains, F.struct(F.col("date").alias("training_date"), F.try_divide(F.col(column) - F.first(column).over(line), F.count(F.lit(1)).over(line) - 1).alias("drift"), F.regr_slope(F.col(column), F.col("__i")).over(line).alias("slope")))
    own = own.withColumn("__fit", fitted).withColumn("__fit", F.last("__fit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = {"naive": F.lit(0.0), "drift": F.col("__fit.drift"), "trend": F.col("__fit.slope")}
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), x.alias("step")) for m, x in step.items())))
    out = with_horizon(own.withColumn("__m", models), horizon)
    return out.select(*key, F.col("date").alias("data_cutoff_date"), "__fit.training_date", "__m.model", "day_ahead", (F.floor((F.col(column) + F.coalesce(F.col("__m.step"), F.lit(0.0)) * F.col("day_ahead")) * 10000 + 0.5) / 10000).alias("forecast"))


def expand_paths(points: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    """n random-walk paths around point forecasts (forecast, std per root day); draws depend on key, path and day alone."""
    paths = points.withColumn("path_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u1, u2 = ((F.pmod(F.xxhash64(*key, "path_id", "day_ahead", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / (1 << 30) for k in (0, 1))
    step = F.sqrt(-2 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)
    w = Window.partitionBy(*key, "path_id").orderBy("day_ahead").rowsBetween(Window.unboundedPreceding, 0)
    return paths.withColumn("value", F.col("forecast") + F.col("daily_std") * F.sum(step).over(w)).select(*key, "path_id", "day_ahead", "value")


CADENCES = {"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month", "quarterly": "interval 3 months", "semiannually": "interval 6 months", "annually": "interval 1 year"}


def cadence(spark: SparkSession, start: str, end: str, frequency: str) -> DataFrame:
    """Training dates from start to end."""
    return spark.sql(f"SELECT explode(sequence(date '{start}', date '{end}', {CADENCES[frequency]})) AS training_date")


def retrain_due(runs: DataFrame, key: list[str], months: int, as_of: str) -> DataFrame:
    due = F.add_months("last_training", months)
    out = runs.groupBy(*key).agg(F.max("training_date").alias("last_training"))
    return out.withColumn("next_training", due).withColumn("retrain", F.col("next_training") <= F.lit(as_of).cast("date"))


def walk_windows(df: DataFrame, key: list[str], min_train: int, horizon: int, step: int) -> DataFrame:
    """Expanding windows by row number: train on rows up to cut, test on the next `horizon` rows; with the dates of both ends."""
    w = Window.partitionBy(*key).orderBy("date")
    rows = df.select(*key, "date").withColumn("__i", F.row_number().over(w)).withColumn("test_start", F.lead("date", 1).over(w)).withColumn("test_end", F.lead("date", horizon).over(w))
    cut = (F.col("__i") >= min_train) & ((F.col("__i") - min_train) % step == 0) & F.col("test_end").isNotNull()
    return rows.where(cut).select(*key, (F.floor((F.col("__i") - min_train) / step) + 1).cast("long").alias("window_id"), F.col("__i").cast("long").alias("n_train"), F.col("date").alias("train_end"), "test_start", "test_end")


def folds(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """n folds of equal calendar length per key, half-open, the last one up to and with the last date; rows in each."""
    ends = df.groupBy(*key).agg(F.min("date").alias("__a"), F.max("date").alias("__b"))
    span = F.datediff("__b", "__a") + 1
    fold = F.floor(F.datediff("date", "__a") * n / span).cast("long")
    return df.join(ends, key).groupBy(*key, fold.alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
