"""Queries on reshaping, set operations, reports and remaining signals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg, baseline, clean, features as feat, news as nw, paths as pt, signals as sg, spine
from ..sources import files, tables
from .bindings import PRICED, Frames, path_days, with_views as sql
from .forecasts import BY, grouped, tier_sql, tiers, EXPLODED, GROUP_SQL, MEANS
from .jobs import shared
from .series import FX, KEY

#: The regions of the dimension table.
REGIONS = [f"NATION_{k}" for k in range(25)]
GROUPED = f", {EXPLODED}, g AS (SELECT article_date, theme_group, {MEANS} FROM (SELECT *, {GROUP_SQL} AS theme_group FROM rows UNION ALL SELECT *, 'ALL' FROM rows) GROUP BY ALL)"
W = "PARTITION BY commodity ORDER BY date"


def frame(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sentiment(f: Frames):
    """Tone of each event type over seven rows."""
    day = nw.parse_tone(f.news).groupBy(F.col("all_names").alias("commodity"), "date").agg(F.round(F.avg("tone_avg"), 6).alias("tone"))
    return feat.sentiment_spans(day, KEY, "tone", [7]).withColumnsRenamed({"momentum_7": "momentum", "acceleration_7": "acceleration"})


def new_files(f: Frames):
    """A folder that grows, loaded three times: each run takes what the control table lacks, and the third finds nothing."""
    folder, control, out = shared(f, "new"), shared(f, "new-control"), shared(f, "new-rows")
    own = f.table("orders").select("o_orderkey", "o_totalprice")
    f.spark.createDataFrame([], "path string").write.parquet(control)
    for run in range(3):
        if run < 2:
            own.where(F.col("o_orderkey") % 2 == run).write.mode("append").parquet(folder)
        listed = f.spark.read.schema("path string").parquet(control)
        loaded = tables.saved(files.load_new_files(f.spark, folder, listed, own.schema).withColumn("run", F.lit(run).cast("long")), "new-load")
        loaded.write.mode("append").parquet(out)
        files.new_paths(loaded).write.mode("append").parquet(control)
    return f.spark.read.parquet(out).select("o_orderkey", "o_totalprice", "run")


def versioned(f: Frames):
    """Prices published, then some replaced and days added, twice by the same updates; each time as a whole new version."""
    path = shared(f, "versions")
    base = f.market.where("volume > 1").select("date", "commodity", "close", "volume")
    updates = f.market.where("volume <> 2").select("date", "commodity", F.col("open").alias("close"))
    tables.publish(base, path)
    for _ in range(2):
        tables.upsert(updates, path, ["date", "commodity"], ["close"])
    return tables.read_current(f.spark, path)


def stored_parts(f: Frames):
    """Path arrays in parts of 50, stored and read again; the text has every value."""
    path = shared(f, "path-parts")
    pt.path_parts(f.numbered_lines, BY, 50, held=PRICED, days=path_days).write.option("compression", "zstd").parquet(path)
    whole = F.transform("paths", lambda p: F.array_join(F.transform(p["days"], lambda x: F.floor(x * 10000 + 0.5).cast("string")), ","))
    return f.spark.read.parquet(path).select(*BY, "part", "n_paths", F.array_join(whole, ";").alias("paths"))


def read_parts(f: Frames):
    path = shared(f, "path-parts")
    pt.path_parts(f.numbered_lines, BY, 50, held=PRICED, days=path_days).write.option("compression", "zstd").parquet(path)
    return pt.path_rows(f.spark.read.parquet(path), BY).select(*BY, F.col("path_id").cast("long").alias("path_id"), *((F.floor(F.col(f"day_{h}") * 10000 + 0.5) / 10000).alias(f"day_{h}") for h in range(1, 15)))


def rebuilt(f: Frames):
    path = shared(f, "rebuilt")
    files.rebuild(f.market.where("volume = 1"), path)
    files.rebuild(f.market, path)
    return f.spark.read.schema(f.market.schema).parquet(path)


def health(f: Frames):
    """Health of each commodity from completeness and share of days without violations."""
    full = agg.completeness(f.market, KEY).select("commodity", (F.col("n_days") / F.col("n_expected")).alias("complete"))
    good = f.market.groupBy("commodity").agg(F.avg((F.col("high") > F.col("low")).cast("double")).alias("ranging"))
    return full.join(good, "commodity").select("commodity", agg.health_score(F.array("complete", "ranging"), [70, 30]).alias("score"))


def overridden(f: Frames):
    base = f.points.where("day = 1").select(*BY, F.lit(0.25).alias("share"))
    return sg.prediction_override(base, tiers(f).select(*BY, "net_benefit_pct", "tier"), BY, 0.2).select(*BY, "share")


CASES = {
    "j3_trading_days": (lambda f: spine.with_trading_flag(f.vix, f.market), sql("vix market", "SELECT date, vix, CASE WHEN date IN (SELECT date FROM market) THEN 1 ELSE 0 END AS is_trading_day FROM vix")),
    "j5_with_actuals": (lambda f: f.points, sql("points", "SELECT * FROM points")),
    "j12_with_stats": (lambda f: agg.with_group_stats(f.market, KEY, "close"), sql("market", "SELECT date, commodity, close, round(avg(close) OVER (PARTITION BY commodity), 2) AS mean, round(stddev_samp(close) OVER (PARTITION BY commodity), 2) AS std FROM market")),
    "a23_error_by_horizon": (lambda f: pt.error_by_horizon(f.points), sql("points", "SELECT day, round(avg(abs(forecast - actual)), 2) AS mean_error, round(quantile_cont(abs(forecast - actual), 0.5), 2) AS median_error FROM points GROUP BY 1")),
    "w15_sentiment": (sentiment, sql("news", f", d AS (SELECT all_names AS commodity, date, round(avg(try_cast(split_part(tone, ',', 1) AS DOUBLE)), 6) AS tone FROM news GROUP BY ALL), m AS (SELECT *, " + ", ".join(f"CASE WHEN count(*) {frame(7)} = 7 THEN round({fn}(tone) {frame(7)}, 6) END AS tone_{n}_7" for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + f", round(tone - lag(tone, 7) OVER ({W}), 6) AS momentum FROM d) SELECT *, round(momentum - lag(momentum, 7) OVER ({W}), 6) AS acceleration FROM m").replace(") , ", "), ", 1)),
    "k1_ordered_output": (lambda f: f.market.orderBy("date", "commodity"), sql("market", "SELECT * FROM market ORDER BY date, commodity")),
    "k4_recent": (lambda f: clean.top_k(f.unit_price, [F.desc("date")], 30), sql("unit_price", "SELECT * FROM unit_price ORDER BY date DESC LIMIT 30")),
    "k5_overlapping": (lambda f: pt.overlapping(f.points, 14), sql("points", "SELECT target, model, age, round(forecast, 2) AS forecast FROM (SELECT *, start + CAST(day - 1 AS INT) AS target, CAST(day - 1 AS BIGINT) AS age FROM points) QUALIFY row_number() OVER (PARTITION BY target ORDER BY age, model) <= 14")),
    "u1_stack_rows": (lambda f: files.stack_rows(f.market.select("date", F.lit("market").alias("layer")), f.vix.select("date", F.lit("vix").alias("layer"))), sql("market vix", "SELECT date, 'market' AS layer FROM market UNION ALL SELECT date, 'vix' FROM vix")),
    "u2_unique": (lambda f: f.weather.select("region", "commodity").distinct(), sql("weather", "SELECT DISTINCT region, commodity FROM weather")),
    "p6_select_prefix": (lambda f: clean.select_prefix(spine.merge_series(f.macro_long, FX), ["date"], ["fx_0", "fx_3"]), sql("macro_long", "SELECT date, max(value) FILTER (series = 'fx_0') AS fx_0, max(value) FILTER (series = 'fx_3') AS fx_3 FROM macro_long GROUP BY 1")),
    "p10_convert_units": (lambda f: clean.convert_units(f.market, f.macro_long, 20), sql("market macro_long", "SELECT m.date, commodity, series, floor(close * 20 * value * 100 + 0.5) / 100 AS local_price FROM market m, (SELECT * FROM macro_long QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) = 1) x")),
    "r4_pivot_regions": (lambda f: agg.pivot_groups(f.weather, ["date", "commodity"], "region", REGIONS, "temp_c"), sql("weather", "SELECT date, commodity, " + ", ".join(f"max(temp_c) FILTER (region = '{r}') AS temp_c_{r.lower()}" for r in REGIONS) + " FROM weather GROUP BY ALL")),
    "r6_path_arrays": (stored_parts, sql("paths", "SELECT start, model, CAST((path_id - 1) // 50 AS BIGINT) AS part, count(*) AS n_paths, string_agg(" + " || ',' || ".join(f"floor(day_{h} * 10000 + 0.5)::BIGINT" for h in range(1, 15)) + ", ';' ORDER BY path_id) AS paths FROM paths GROUP BY ALL")),
    "r6_path_rows": (read_parts, sql("paths", "SELECT start, model, CAST(path_id AS BIGINT) AS path_id, " + ", ".join(f"floor(day_{h} * 10000 + 0.5) / 10000 AS day_{h}" for h in range(1, 15)) + " FROM paths")),
    "s6_new_files": (new_files, "SELECT o_orderkey, o_totalprice, CAST(o_orderkey % 2 AS BIGINT) AS run FROM orders"),
    "s13_versioned_upsert": (versioned, sql("market", "SELECT date, commodity, CASE WHEN volume <> 2 THEN open ELSE close END AS close, CASE WHEN volume > 1 THEN volume END AS volume FROM market")),
    "s9_rebuild": (rebuilt, sql("market", "SELECT * FROM market")),
    "f12_minmax": (lambda f: feat.scale(f.weather.select("date", "region", "commodity", "temp_c"), ["temp_c"], "minmax", "1999-12-31")[0], sql("weather", "SELECT date, region, commodity, temp_c, round((temp_c - a) / (b - a), 4) AS temp_c_scaled FROM weather, (SELECT min(temp_c) AS a, max(temp_c) AS b FROM weather WHERE date <= DATE '1999-12-31')")),
    "f13_row_means": (lambda f: feat.row_mean_by_suffix(nw.pivot_metrics(grouped(f), ["article_date"], "theme_group", ["DEMAND", "MARKET", "OTHER"], ["tone_avg"], "g_"), "g_", ["tone_avg"]).select("article_date", F.col("g_tone_avg_all").alias("tone_all")), sql("news", GROUPED + " SELECT article_date, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT), 4) AS tone_all FROM (SELECT article_date, max(tone_avg) FILTER (theme_group = 'DEMAND') AS a, max(tone_avg) FILTER (theme_group = 'MARKET') AS b, max(tone_avg) FILTER (theme_group = 'OTHER') AS c FROM g GROUP BY 1)").replace(") , ", "), ", 1)),
    "f15_day_ahead": (lambda f: pt.day_ahead(f.points), sql("points", "SELECT start, model, day, CAST(day AS BIGINT) AS days_after, true AS consistent FROM points")),
    "f16_health_score": (health, sql("market", "SELECT commodity, round(((count(DISTINCT date) / (date_diff('day', min(date), max(date)) + 1)) * 70 + avg((high > low)::INT) * 30) * 100 / 100, 2) AS score FROM market GROUP BY 1")),
    "g3_prediction_override": (overridden, tier_sql("SELECT p.start, p.model, round(coalesce(CASE WHEN tier = 'high' THEN CASE WHEN net_benefit_pct > 0.2 THEN 0.0 ELSE 0.4 END WHEN tier = 'medium' THEN (0.25 + CASE WHEN net_benefit_pct > 0.2 THEN 0.0 ELSE 0.4 END) / 2 ELSE 0.25 END, 0.25), 4)::DOUBLE AS share FROM (SELECT DISTINCT start, model FROM long_paths WHERE start IN (SELECT start FROM actuals WHERE day = 1)) p LEFT JOIN t ON t.start = p.start AND t.model = p.model")),
}
