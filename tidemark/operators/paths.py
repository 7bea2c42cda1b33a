"""Forecast paths: reshaping, summaries, risk and probabilistic scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import saved
from . import runs

DAYS = 14
#: Rows that a task sorts at a time; accuracy of sketches, whose brackets are three times as wide. A sorted run gives an eighth of as many samples.
GROUP_ROWS, ACCURACY = 500_000, 1000


def unpivot_days(df: DataFrame, keep: list[str], n: int = DAYS) -> DataFrame:
    return df.unpivot(keep, [f"day_{h}" for h in range(1, n + 1)], "day_name", "value").withColumn("day", F.substring("day_name", 5, 2).cast("int")).drop("day_name")


def pivot_days(long_df: DataFrame, by: list[str], n: int = DAYS) -> DataFrame:
    return long_df.groupBy(*by).agg(*(F.max(F.when(F.col("day") == h, F.col("value"))).alias(f"day_{h}") for h in range(1, n + 1)))


def path_parts(df: DataFrame, by: list[str], size: int = 1000, n: int = DAYS, held: list[str] | None = None, days: Callable[[Callable[[str], Column]], list[Column]] | None = None) -> DataFrame:
    """Paths of each forecast in numbered parts of at most `size`: arrays of (path_id, days), in path order.

    path_id counts a forecast's paths from 1 (`carry.ranked`), so a path's part follows from its number and no row holds a forecast
    of any size. A path_id that repeats makes its part longer. Where days follow from fewer columns, `held` are these and `days`
    gives the days from them: then they alone are shuffled.
    """
    part = F.floor((F.col("path_id") - 1) / size).cast("long")
    rows = F.struct("path_id", *held) if held else F.struct("path_id", F.array(*(F.col(f"day_{h}") for h in range(1, n + 1))).alias("days"))
    out = df.groupBy(*by, part.alias("part")).agg(F.count(F.lit(1)).alias("n_paths"), F.array_sort(F.collect_list(rows)).alias("paths"))
    return out.withColumn("paths", F.transform("paths", lambda p: F.struct(p["path_id"].alias("path_id"), F.array(*days(lambda c: p[c])).alias("days")))) if held else out


def path_rows(parts: DataFrame, by: list[str], n: int = DAYS) -> DataFrame:
    """The paths of such parts, a row each with a column for each day: the reader of `path_parts`."""
    own = parts.select(*by, F.explode("paths").alias("p"))
    return own.select(*by, "p.path_id", *(F.col("p.days")[h - 1].alias(f"day_{h}") for h in range(1, n + 1)))


def actual_windows(prices: DataFrame, key: list[str], column: str = "close", n: int = DAYS) -> DataFrame:
    """day_h = the value h-1 days after each date, from a complete daily series."""
    w = Window.partitionBy(*key).orderBy("date")
    return prices.select(*key, F.col("date").alias("start"), *(F.lead(column, h - 1).over(w).alias(f"day_{h}") for h in range(1, n + 1))).where(f"day_{n} IS NOT NULL")


def day_columns(days: list[int]) -> list[str]:
    return [f"day_{d}" for d in days]


def exact_quantiles(df: DataFrame, by: list[str], columns: list[str], levels: list[float]) -> DataFrame:
    """A row for each group with, for every column, the array of its quantiles (linear between neighbours, nulls left out).

    Groups of all sizes go one way (`runs.quantiles`): tasks sort up to GROUP_ROWS rows at a time, samples of these runs bound each
    quantile, and only the values within the bounds are shuffled. A column without values has null quantiles; NaN counts as
    greater than all numbers.
    """
    found = runs.quantiles(df, by, columns, levels, GROUP_ROWS, max(ACCURACY // 8, 1))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("__cell") == i, F.col("__q"))).alias(c) for i, c in enumerate(columns)))


def bracketed_quantiles(df: DataFrame, by: list[str], columns: list[str], levels: list[float]) -> DataFrame:
    """The same without Python workers, in two passes, with no group in a task; a group's sketches are as many as its tasks.

    A mergeable sketch per group brackets each quantile; then values inside a bracket, some per mille of a large group, are
    counted by value, and all others by the gap between brackets that they lie in. Running counts give the places. Should a
    place lie in a gap, the job fails instead of taking a neighbour.
    """
    margin = 3 / ACCURACY
    wide = [x for q in levels for x in (max(q - margin, 0.0), min(q + margin, 1.0))]
    sketch = df.groupBy(*by).agg(*(x for c in columns for x in (F.count(c).alias(f"__n_{c}"), F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__z_{c}"), F.percentile_approx(c, wide, ACCURACY).alias(f"__s_{c}"))))

    def bracket(c: str) -> list[Column]:
        small = F.col(f"__n_{c}") <= ACCURACY
        return [F.struct(F.when(small, F.col(f"__a_{c}")).otherwise(F.col(f"__s_{c}")[2 * k]).cast("double").alias("lo"), F.when(small, F.col(f"__z_{c}")).otherwise(F.col(f"__s_{c}")[2 * k + 1]).cast("double").alias("hi")) for k in range(len(levels))]

    bounds = sketch.select(*(F.col(c).alias(f"__by_{c}") for c in by), *(F.array(*bracket(c)).alias(f"__b_{c}") for c in columns))
    both = df.select(*by, *columns).join(bounds, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by])

    # one value a row before anything is computed from it: the same expressions over all columns at once would be too long to compile
    here = F.struct(F.lit(-1).alias("cell"), F.lit(None).cast("double").alias("v"), F.array(*bracket_none(len(levels))).alias("b"))  # a group of nulls is a group
    cells = [F.struct(F.lit(i).alias("cell"), F.col(c).cast("double").alias("v"), F.col(f"__b_{c}").alias("b")) for i, c in enumerate(columns)]
    each = both.select(*by, F.explode(F.array(here, *cells)).alias("x")).select(*by, "x.*").where("cell < 0 OR v IS NOT NULL")
    edges = [F.col("b")[k] for k in range(len(levels))]
    inside = F.coalesce(reduce(lambda x, y: x | y, (F.col("v").between(e["lo"], e["hi"]) for e in edges)), F.lit(True))
    after = F.greatest(F.lit(None).cast("double"), *(F.when(e["hi"] < F.col("v"), e["hi"]) for e in edges))
    # the value itself inside a bracket, else the end of the last bracket below it, marked as a gap
    counted = each.select(*by, "cell", F.when(inside, F.col("v")).otherwise(after).alias("key"), F.when(inside, 0).otherwise(1).alias("gap")).groupBy(*by, "cell", "key", "gap").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by, "cell")
    sums = counted.withColumns({"upto": F.sum("n").over(group.orderBy(F.asc_nulls_first("key"), "gap").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    places = [(F.col("total") - 1) * F.lit(q) for q in levels]
    at = {f"__{name}{k}": F.max(F.when((f(p) >= F.col("upto") - F.col("n")) & (f(p) < F.col("upto")), F.struct("gap", "key"))) for k, p in enumerate(places) for name, f in (("low", F.floor), ("high", F.ceil))}
    ends = sums.groupBy(*by, "cell").agg(F.first("total").alias("total"), *(x.alias(name) for name, x in at.items()))

    def value(k: int) -> Column:
        low, high, place = F.col(f"__low{k}"), F.col(f"__high{k}"), places[k]
        missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        return F.when(low["gap"] + high["gap"] > 0, missed).otherwise(low["key"] + (high["key"] - low["key"]) * (place - F.floor(place)))

    found = ends.select(*by, "cell", F.when(F.col("cell") >= 0, F.array(*(value(k) for k in range(len(levels))))).alias("q"))
    nothing = F.array(*[F.lit(None).cast("double")] * len(levels))
    return found.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col("cell") == i, F.col("q"))), nothing).alias(c) for i, c in enumerate(columns)))


def bracket_none(n: int) -> list[Column]:
    return [F.struct(F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))] * n


def by_day(df: DataFrame, by: list[str], days: list[int], values: dict[str, list]) -> DataFrame:
    """Wide rows as one row a day: for each name its day's column."""
    rows = F.array(*(F.struct(F.lit(d).alias("day"), *(F.col(own[k]).alias(n) if isinstance(own[k], str) else own[k].alias(n) for n, own in values.items())) for k, d in enumerate(days)))
    return df.select(*by, F.explode(rows).alias("__d")).select(*by, "__d.*")


def distribution_summary(paths: DataFrame, by: list[str], levels: list[float], days: list[int] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and quantiles of the paths' values on each day (columns day_1, day_2 and so on)."""
    days = days or list(range(1, DAYS + 1))
    columns = day_columns(days)
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "lowest": F.min, "highest": F.max}
    plain = paths.groupBy(*by).agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in parts.items()))
    q = exact_quantiles(paths, by, columns, levels)
    shown = {n: [F.col(f"__n_{c}") if n == "n" else F.round(f"__{n}_{c}", 2) for c in columns] for n in parts}
    shown |= {f"p{round(100 * level)}": [F.round(F.col(c)[k], 2) for c in columns] for k, level in enumerate(levels)}
    return by_day(plain.join(q, by), by, days, shown)


def point_metrics(df: DataFrame, by: list[str], forecast: str = "forecast", actual: str = "actual") -> DataFrame:
    e = F.col(forecast) - F.col(actual)
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(F.abs(F.try_divide(e, F.col(actual)))) * 100, 4).alias("mape"), F.round(F.avg(e), 4).alias("bias"))


def medians(paths: DataFrame, by: list[str], n: int = DAYS) -> DataFrame:
    """The median path: a point forecast for each day."""
    days = list(range(1, n + 1))
    return by_day(exact_quantiles(paths, by, day_columns(days), [0.5]), by, days, {"forecast": [F.col(c)[0] for c in day_columns(days)]})


def up_to_horizon(scored: DataFrame, horizons: list[int]) -> DataFrame:
    """Each row once for every horizon that its day is within."""
    return scored.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).where("day <= horizon")


def horizon_metrics(points: DataFrame, by: list[str], horizons: list[int]) -> DataFrame:
    return point_metrics(points.where(F.col("day").isin(horizons)), [*by, "day"])


def intervals(paths: DataFrame, by: list[str], level: float, n: int = DAYS) -> DataFrame:
    """Ends of the central interval on each day."""
    tail, days = (1 - level) / 2, list(range(1, n + 1))
    q = exact_quantiles(paths, by, day_columns(days), [tail, 1 - tail])
    return by_day(q, by, days, {name: [F.col(c)[k] for c in day_columns(days)] for k, name in enumerate(("lower", "upper"))})


def interval_coverage(paths: DataFrame, actuals: DataFrame, by: list[str], level: float, report: list[str]) -> DataFrame:
    """Share of actual values within the central interval and the interval's mean width, by `report`."""
    own = intervals(paths, by, level).join(actuals, [*[c for c in by if c in actuals.columns], "day"])
    return own.groupBy(*report).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")), 4).alias("coverage"), F.round(F.avg(F.col("upper") - F.col("lower")), 4).alias("sharpness"))


def calibration(paths: DataFrame, actuals: DataFrame, by: list[str], levels: list[float], report: list[str], n: int = DAYS) -> DataFrame:
    """Mean absolute difference between quantile levels and the share of actual values at or below them."""
    days = list(range(1, n + 1))
    q = by_day(exact_quantiles(paths, by, day_columns(days), levels), by, days, {"__q": day_columns(days)}).join(actuals, [*[c for c in by if c in actuals.columns], "day"])
    rows = q.select(*report, "actual", F.posexplode("__q").alias("k", "q")).groupBy(*report, "k").agg(F.avg((F.col("actual") <= F.col("q")).cast("double")).alias("hit"))
    level = F.array(*map(F.lit, levels))[F.col("k")]
    return rows.groupBy(*report).agg(F.round(F.avg(F.abs(F.col("hit") - level)), 4).alias("calibration_error"))


def crps(long_df: DataFrame, actuals: DataFrame, by: list[str], report: list[str]) -> DataFrame:
    """`path_crps` of samples with a row for each day (day, value)."""
    group = [*by, "day"]
    return mean_crps(runs.ranked_sums(long_df, group, ["value"], lambda rows: beside(rows, actuals, group), GROUP_ROWS, max(ACCURACY // 8, 1)), report)


def path_crps(paths: DataFrame, actuals: DataFrame, by: list[str], report: list[str], n: int = DAYS) -> DataFrame:
    """Continuous ranked probability score of the paths: mean distance to the actual value less half their mean distance to each other.

    The second part needs each value's rank in its group and day (`runs.ranked_sums`), so a value is shuffled once, packed with
    others of its bin, and no task holds a group. Null values and days without an actual value are left out.
    """
    days = list(range(1, n + 1))
    day = (F.col("__cell") + 1).alias("day")
    sums = runs.ranked_sums(paths, by, day_columns(days), lambda rows: beside(rows.withColumn("day", day), actuals, [*by, "day"]), GROUP_ROWS, max(ACCURACY // 8, 1))
    return mean_crps(sums.withColumn("day", day), report)


def beside(rows: DataFrame, actuals: DataFrame, group: list[str]) -> DataFrame:
    """Groups with the actual value of their day."""
    return rows.join(actuals.withColumnRenamed("actual", "__near"), [c for c in group if c in actuals.columns])


def mean_crps(sums: DataFrame, report: list[str]) -> DataFrame:
    score = F.col("__a") / F.col("__n") - (F.col("__s") - F.col("__n") * F.col("__v")) / (F.col("__n") * F.col("__n"))
    return sums.groupBy(*report).agg(F.round(F.avg(score), 4).alias("crps"))


def var_cvar(paths: DataFrame, by: list[str], p: float, n: int = DAYS) -> DataFrame:
    """On each day the p-quantile of the paths' values and the mean of those at or below it.

    The quantiles, a row for each group, are written first: a join with them goes by their size and leaves the paths where they are.
    """
    days = list(range(1, n + 1))
    columns = day_columns(days)
    var = saved(exact_quantiles(paths, by, columns, [p]).select(*by, *(F.col(c)[0].alias(f"__v_{c}") for c in columns)), "var")
    own = paths.select(*by, *columns).join(var, by).groupBy(*by).agg(*(x for c in columns for x in (F.first(f"__v_{c}").alias(f"__v_{c}"), F.avg(F.when(F.col(c) <= F.col(f"__v_{c}"), F.col(c))).alias(f"__m_{c}"))))
    return by_day(own, by, days, {"value_at_risk": [F.round(f"__v_{c}", 4) for c in columns], "conditional_value_at_risk": [F.round(f"__m_{c}", 4) for c in columns]})


def with_n_paths(df: DataFrame, by: list[str], parts: list[Column]) -> DataFrame:
    """Aggregates of each group and its number of different path_ids, counted apart: together every path would carry all aggregates through its shuffle."""
    own = df.groupBy(*by).agg(*parts)
    paths = df.groupBy(*(F.col(c).alias(f"__by_{c}") for c in by)).agg(F.count_distinct("path_id").alias("n_paths"))
    return own.join(paths, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by))).drop(*(f"__by_{c}" for c in by))


def validate_paths(df: DataFrame, by: list[str], n: int = DAYS) -> DataFrame:
    """Rows, paths, negative values and null values of each group."""
    days = [F.col(f"day_{h}") for h in range(1, n + 1)]
    negative, null = (sum((c.cast("int") for c in x), F.lit(0)) for x in ([F.coalesce(d < 0, F.lit(False)) for d in days], [d.isNull() for d in days]))
    return with_n_paths(df, by, [F.count(F.lit(1)).alias("n_rows"), F.sum(negative).cast("long").alias("n_negative"), F.sum(null).cast("long").alias("n_null")]).select(*by, "n_rows", "n_paths", "n_negative", "n_null")


def hit_rate(points: DataFrame, by: list[str], pct: float) -> DataFrame:
    e = F.abs(F.try_divide(F.col("forecast"), F.col("actual")) - 1)
    return points.groupBy(*by).agg(F.round(F.avg((e <= pct / 100).cast("double")) * 100, 4).alias("hit_rate"))


def directional_accuracy(points: DataFrame, by: list[str], group: list[str], mode: str) -> DataFrame:
    """Share of days whose direction is right: from the day before (`step`) or from the first day (`origin`)."""
    w = Window.partitionBy(*by).orderBy("day")
    base = (lambda c: F.lag(c, 1).over(w)) if mode == "step" else (lambda c: F.first(c).over(w))
    right = F.signum(F.col("forecast") - F.col("__f")) == F.signum(F.col("actual") - F.col("__a"))
    own = points.withColumns({"__f": base("forecast"), "__a": base("actual")}).where("day > 1")
    return own.groupBy(*group).agg(F.round(F.avg(right.cast("double")) * 100, 4).alias("directional_accuracy"))


def path_features(df: DataFrame, by: list[str], column: str = "day_14", price: str = "price") -> DataFrame:
    """Consensus, expected return, relative spread, skew, relative range and downside of the paths' values of one day against a price."""
    r = F.col(column) / F.col(price) - 1
    plain = df.groupBy(*by).agg(F.avg((r > 0).cast("double")).alias("consensus"), F.avg(r).alias("expected_return"), F.when(F.var_pop(r) > 0, F.skewness(r)).alias("skewness"), ((F.max(column) - F.min(column)) / F.first(price)).alias("relative_range"), F.avg(F.least(r, F.lit(0.0))).alias("downside"))
    q = exact_quantiles(df, by, [column], [0.25, 0.5, 0.75]).withColumnRenamed(column, "__q")
    out = plain.join(q, by).withColumn("relative_spread", F.try_divide(F.col("__q")[2] - F.col("__q")[0], F.col("__q")[1]))
    return out.select(*by, *(F.round(n, 4).alias(n) for n in ("consensus", "expected_return", "relative_spread", "skewness", "relative_range", "downside")))


def dispersion_tier(paths: DataFrame, by: list[str], edges: tuple[float, float], column: str = "day_14", middle: DataFrame | None = None) -> DataFrame:
    """Deviation over median, and the confidence tier it gives; `middle` has the medians (by, __q) where they are known."""
    if middle is None:
        middle = exact_quantiles(paths, by, [column], [0.5]).select(*by, F.col(column)[0].alias("__q"))
    own = paths.groupBy(*by).agg(F.stddev_pop(column).alias("__s")).join(middle, by)
    out = own.select(*by, F.round(F.try_divide("__s", "__q"), 4).alias("dispersion"))
    return out.withColumn("tier", F.when(F.col("dispersion") < edges[0], "high").when(F.col("dispersion") < edges[1], "medium").otherwise("low"))


def expected_value(paths: DataFrame, by: list[str], storage_pct: float, fee_pct: float, middle: DataFrame | None = None) -> DataFrame:
    """Median value of selling on each day net of storage and fee (per cent), the best day and its gain over day 1; `middle` has the medians where they are known."""
    m = (medians(paths, by) if middle is None else middle).withColumnRenamed("forecast", "median")
    net = F.col("median") * (1 - F.col("day") * storage_pct / 100) * (1 - fee_pct / 100)
    own = m.withColumn("net", F.round(net, 6)).groupBy(*by).agg(F.max(F.struct("net", (-F.col("day")).alias("minus_day"))).alias("best"), F.max(F.when(F.col("day") == 1, F.col("net"))).alias("now"))
    return own.select(*by, (-F.col("best.minus_day")).cast("int").alias("best_day"), F.round("best.net", 2).alias("best_value"), F.round((F.try_divide(F.col("best.net"), F.col("now")) - 1) * 100, 4).alias("net_benefit_pct"))


def best_window(points: DataFrame, by: list[str], width: int = 3) -> DataFrame:
    """First day of the `width` days with the highest mean median."""
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(0, width - 1)
    own = points.withColumn("window_mean", F.when(F.count(F.lit(1)).over(w) == width, F.round(F.avg("forecast").over(w), 6))).where("window_mean IS NOT NULL")
    return own.groupBy(*by).agg(F.max_by("day", F.struct("window_mean", -F.col("day"))).alias("first_day"), F.round(F.max("window_mean"), 4).alias("window_mean"))


def score_table(points: DataFrame, by: list[str], horizons: list[int], metrics: tuple[str, ...] = ("n", "mae", "rmse", "mape", "bias")) -> DataFrame:
    """One row for each window with every metric up to each horizon in a column of its own (`mae_7d`)."""
    own = point_metrics(up_to_horizon(points, horizons), [*by, "horizon"])
    return own.groupBy(*by).agg(*(F.max(F.when(F.col("horizon") == h, F.col(m))).alias(f"{m}_{h}d") for h in horizons for m in metrics))


def path_inventory(df: DataFrame, by: list[str], start: str, n: int = DAYS) -> DataFrame:
    """Rows, paths, first and last start, value range, actual rows, leaking rows and nulls of each day's column.

    Needs path_id, is_actuals and has_data_leakage beside the days.
    """
    days = [F.col(c) for c in day_columns(list(range(1, n + 1)))]
    out = with_n_paths(df, by, [
        F.count(F.lit(1)).alias("n_rows"), F.min(start).alias("first_start"), F.max(start).alias("last_start"),
        F.round(F.min(F.array_min(F.array(*days))), 4).alias("lowest"), F.round(F.max(F.array_max(F.array(*days))), 4).alias("highest"),
        F.count_if("is_actuals").alias("n_actuals"), F.count_if("has_data_leakage").alias("n_leakage"),
        *(F.count_if(F.isnull(d)).alias(f"null_day_{h}") for h, d in enumerate(days, 1)),
    ])
    return out.select(*by, "n_rows", "n_paths", *(c for c in out.columns if c not in (*by, "n_rows", "n_paths")))


def path_validity(df: DataFrame, by: list[str], start: str, cutoff: str, expected: int, n: int = DAYS) -> DataFrame:
    """Whether each forecast has the expected paths (one more with its actual row), and its rows with wrong flags or values.

    A row is an actual one if and only if its path_id is 0, and leaks if and only if its cutoff is not before its start.
    """
    days = [F.col(c) for c in day_columns(list(range(1, n + 1)))]
    out = with_n_paths(df, by, [
        F.max("is_actuals").alias("__actual"),
        F.count_if(F.col("is_actuals") != (F.col("path_id") == 0)).alias("n_wrong_actuals"),
        F.count_if(F.col("has_data_leakage") != (F.col(cutoff) >= F.col(start))).alias("n_wrong_leakage"),
        F.count_if(F.array_min(F.array(*days)) < 0).alias("n_negative"),
    ])
    complete = (F.col("n_paths") == F.lit(expected) + F.col("__actual").cast("int")).alias("is_complete")
    out = out.select(*by, "n_paths", complete, "n_wrong_actuals", "n_wrong_leakage", "n_negative")
    return out.withColumn("is_valid", F.col("is_complete") & (F.col("n_wrong_actuals") + F.col("n_wrong_leakage") + F.col("n_negative") == 0))


def with_actuals(points: DataFrame, actuals: DataFrame) -> DataFrame:
    """Point forecasts beside what came true on their day."""
    return points.join(actuals, ["start", "day"])


def error_by_horizon(points: DataFrame) -> DataFrame:
    """Mean and median absolute error of each day ahead; the errors, which the median reads more than once, are written first."""
    errors = saved(points.select("day", F.abs(F.col("forecast") - F.col("actual")).alias("__e")), "errors")
    own = exact_quantiles(errors, ["day"], ["__e"], [0.5]).select("day", F.round(F.col("__e")[0], 2).alias("median_error"))
    return errors.groupBy("day").agg(F.round(F.avg("__e"), 2).alias("mean_error")).join(own, "day")


def day_ahead(points: DataFrame) -> DataFrame:
    """Days from a forecast's start to its target, and whether they agree with the day's number."""
    after = F.datediff(F.expr("date_add(start, day)"), "start")
    return points.select("start", "model", "day", after.cast("long").alias("days_after"), (after == F.col("day")).alias("consistent"))


def overlapping(points: DataFrame, n: int) -> DataFrame:
    """The n latest forecasts of each target date, by age and model."""
    own = points.withColumn("target", F.expr("date_add(start, day - 1)")).withColumn("age", F.datediff("target", "start").cast("long")).select("target", "model", "age", F.round("forecast", 2).alias("forecast"))
    w = Window.partitionBy("target").orderBy("age", "model")
    return own.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
