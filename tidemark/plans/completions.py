"""Queries on validity, scores, cut-offs and votes that take in all of an operator's outputs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as agg, baseline, clean, features as feat, news as nw, paths as pt, signals as sg, spine
from ..sources import files
from ..streaming import jobs as st
from .bindings import Frames, with_views as sql
from .forecasts import BY, ladder_input, rsi_sql, LADDER
from .jobs import shared
from .reshape import health
from .series import KEY, W, frame

#: Forecast paths with cut-offs and flags, some of them wrong on purpose.
FLAGGED = ", flagged AS (SELECT *, start - CAST(CASE WHEN path_id % 97 = 0 THEN 0 ELSE 1 END AS INT) AS data_cutoff_date, path_id % 101 = 0 AS is_actuals, path_id % 97 = 0 AND path_id % 2 = 0 AS has_data_leakage FROM (SELECT * REPLACE (path_id - 1 AS path_id) FROM paths))"
LIMITS = {"temp_c": (5.0, 45.0), "humidity_pct": (1.0, 7.0)}
METRICS = {"n": "count(*)", "mae": "round(avg(abs(e)), 4)", "rmse": "round(sqrt(avg(e * e)), 4)", "mape": "round(avg(abs(e / actual)) * 100, 4)", "bias": "round(avg(e), 4)"}


def flagged(f: Frames) -> DataFrame:
    own = f.paths.withColumn("path_id", F.col("path_id") - 1)
    late = F.col("path_id") % 97 == 0
    return own.withColumns({"data_cutoff_date": F.expr("date_sub(start, CASE WHEN path_id % 97 = 0 THEN 0 ELSE 1 END)"), "is_actuals": F.col("path_id") % 101 == 0, "has_data_leakage": late & (F.col("path_id") % 2 == 0)})


def tone_by_type(f: Frames) -> DataFrame:
    return nw.parse_tone(f.news).groupBy(F.col("all_names").alias("commodity"), "date").agg(F.round(F.avg("tone_avg"), 6).alias("tone"))


def scores_upserted(f: Frames) -> DataFrame:
    """A score table of one horizon, whose partitions are replaced by the scores of all horizons, model after model."""
    path = shared(f, "scores")
    for rows in (pt.score_table(f.points, BY, [1, 7, 14]).where("false"), pt.score_table(f.points, BY, [1, 7, 14]), pt.score_table(f.points.where("model = 'A'"), BY, [1, 7, 14])):
        files.write_partitions(rows, path, ["model"])
    return f.spark.read.parquet(path)


def restored(f: Frames) -> DataFrame:
    """Features and target scaled apart, each by its own parameters, and brought back."""
    own, features = feat.scale(f.market.select("date", "commodity", "open", "close"), ["open"], "standard", "1999-12-31")
    own, target = feat.scale(own, ["close"], "minmax", "1999-12-31")
    return feat.unscale(feat.unscale(own, ["open"], features), ["close"], target)


def ingested(f: Frames) -> DataFrame:
    """A folder that grows between two runs of one ingest: each file is read once."""
    source, out, mark = shared(f, "ingest-in"), shared(f, "ingest-out"), shared(f, "ingest-mark")
    events = f.table("events").select("event_id", "user_id", "event_type", "value")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        st.run_to_table(st.ingest_stream(f.spark, source, events.schema), out, mark).awaitTermination()
    return f.spark.read.schema(events.schema).parquet(out)


def voted(f: Frames) -> DataFrame:
    own = ladder_input(f)
    signals = sg.threshold_signal(own).select("date", "commodity", "share").unionByName(sg.crossover_signal(own).select("date", "commodity", "share"))
    signals = signals.unionByName(own.select("date", "commodity", F.when(F.col("rsi_14") > 70, 0.35).otherwise(0.0).alias("share")))
    trend = feat.week_trend(f.market, KEY)
    return sg.primary_vote(signals, ["date", "commodity"], trend)


CASES = {
    "p8_range_examples": (lambda f: clean.range_examples(f.weather, LIMITS, ["date", "region", "commodity"]), sql("weather", "SELECT date, region, commodity, \"column\", value FROM (" + " UNION ALL ".join(f"SELECT date, region, commodity, '{c}' AS \"column\", {c} AS value FROM weather WHERE {c} NOT BETWEEN {a} AND {b}" for c, (a, b) in LIMITS.items()) + ") QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY date, region, commodity) <= 5")),
    "a12_duplicate_totals": (lambda f: agg.duplicate_totals(f.table("lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"]), "SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, n_rows - n_keys AS n_duplicates FROM lineitem GROUP BY 1"),
    "a29_path_inventory": (lambda f: pt.path_inventory(flagged(f), ["model"], "start"), sql("paths", FLAGGED + " SELECT model, count(*) AS n_rows, count(DISTINCT path_id) AS n_paths, min(start) AS first_start, max(start) AS last_start, round(min(least(" + ", ".join(f"day_{h}" for h in range(1, 15)) + ")), 4) AS lowest, round(max(greatest(" + ", ".join(f"day_{h}" for h in range(1, 15)) + ")), 4) AS highest, count(*) FILTER (is_actuals) AS n_actuals, count(*) FILTER (has_data_leakage) AS n_leakage, " + ", ".join(f"count(*) FILTER (day_{h} IS NULL) AS null_day_{h}" for h in range(1, 15)) + " FROM flagged GROUP BY 1").replace(") , ", "), ", 1)),
    "e17_path_validity": (lambda f: pt.path_validity(flagged(f), BY, "start", "data_cutoff_date", 20), sql("paths", FLAGGED + " SELECT *, is_complete AND n_wrong_actuals + n_wrong_leakage + n_negative = 0 AS is_valid FROM (SELECT start, model, count(DISTINCT path_id) AS n_paths, count(DISTINCT path_id) = 20 + max(is_actuals::INT) AS is_complete, count(*) FILTER (is_actuals <> (path_id = 0)) AS n_wrong_actuals, count(*) FILTER (has_data_leakage <> (data_cutoff_date >= start)) AS n_wrong_leakage, count(*) FILTER (least(" + ", ".join(f"day_{h}" for h in range(1, 15)) + ") < 0) AS n_negative FROM flagged GROUP BY ALL)").replace(") , ", "), ", 1)),
    "e6_score_upsert": (scores_upserted, sql("points", "SELECT start, model, " + ", ".join(f"max({m}) FILTER (horizon = {h}) AS {m}_{h}d" for h in (1, 7, 14) for m in METRICS) + " FROM (SELECT start, model, horizon, " + ", ".join(f"{x} AS {m}" for m, x in METRICS.items()) + " FROM (SELECT *, forecast - actual AS e FROM points), (VALUES (1), (7), (14)) h(horizon) WHERE day <= horizon GROUP BY ALL) GROUP BY ALL")),
    "f12_restored": (restored, sql("market", "SELECT date, commodity, open, close, round((open - m) / s, 4) AS open_scaled, round((close - a) / (b - a), 4) AS close_scaled, round(round((open - m) / s, 4) * s + m, 2) AS open_restored, round(round((close - a) / (b - a), 4) * (b - a) + a, 2) AS close_restored FROM market, (SELECT avg(open) AS m, stddev_pop(open) AS s, min(close) AS a, max(close) AS b FROM market WHERE date <= DATE '1999-12-31')")),
    "f16_health_bands": (lambda f: health(f).withColumn("band", agg.health_band(F.col("score"))), sql("market", "SELECT *, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 50 THEN 'WARNING' ELSE 'CRITICAL' END AS band FROM (SELECT commodity, round(((count(DISTINCT date) / (date_diff('day', min(date), max(date)) + 1)) * 70 + avg((high > low)::INT) * 30) * 100 / 100, 2) AS score FROM market GROUP BY 1)")),
    "g11_primary_vote": (voted, rsi_sql(f"SELECT v.date, v.commodity, n_sell, n_hold, CASE WHEN n_sell > n_hold THEN 'SELL' ELSE 'HOLD' END AS action, CASE WHEN n_sell > n_hold THEN round(q, 4) ELSE 0.0 END::DOUBLE AS quantity, trend_pct, CASE WHEN trend_pct > 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT date, commodity, count(*) FILTER (share > 0) AS n_sell, count(*) FILTER (share <= 0) AS n_hold, avg(share) FILTER (share > 0) AS q FROM (SELECT date, commodity, CASE WHEN over_threshold THEN {LADDER} ELSE 0.0 END::DOUBLE AS share FROM z UNION ALL SELECT date, commodity, CASE WHEN cross_down THEN {LADDER} ELSE 0.0 END::DOUBLE FROM z UNION ALL SELECT date, commodity, CASE WHEN rsi_14 > 70 THEN 0.35 ELSE 0.0 END::DOUBLE FROM z) GROUP BY ALL) v JOIN (SELECT date, commodity, round((close / first_value(close) {frame(7)} - 1) * 100, 4) AS trend_pct FROM market) t USING (date, commodity)")),
    "j6_training_date": (lambda f: spine.as_of_join(f.trades.select(F.col("strategy").alias("commodity"), "date").distinct(), f.market.select("commodity", F.col("date").alias("training_date")), "date", "training_date", KEY, required=True), sql("trades market", "SELECT t.commodity, t.date, max(m.date) AS training_date FROM (SELECT DISTINCT strategy AS commodity, date FROM trades) t JOIN market m ON m.commodity = t.commodity AND m.date <= t.date GROUP BY ALL")),
    "m6_all_at_cutoffs": (lambda f: baseline.all_at_cutoffs(f.market, KEY, 7), sql("market", f", b AS (SELECT *, close + 7 * avg(d) {frame(31)} AS drift, CASE WHEN count(*) {frame(30)} >= 5 THEN regr_intercept(close, i) {frame(30)} + regr_slope(close, i) {frame(30)} * (i + 7) ELSE close END AS trend, lead(close, 7) OVER ({W}) AS actual FROM (SELECT *, row_number() OVER ({W})::DOUBLE AS i, close - lag(close) OVER ({W}) AS d FROM market)), s AS (SELECT commodity, date, avg(v) AS v FROM (SELECT b.commodity, b.date, y, arg_min(m.close, r) AS v FROM b, range(1, 4) a(y), (VALUES (0, 0), (1, -1), (2, 1)) o(r, off), market m WHERE m.commodity = b.commodity AND m.date = (CAST((b.date + 7) - to_months(CAST(12 * y AS INT)) AS DATE) + CAST(off AS INT)) GROUP BY ALL) GROUP BY ALL) SELECT b.commodity, b.date AS data_cutoff_date, 7 AS day_ahead, round(actual, 4) AS actual, model, round(CASE model WHEN 'naive' THEN close WHEN 'drift' THEN drift WHEN 'trend' THEN trend ELSE coalesce(v, close) END, 4) AS forecast FROM b LEFT JOIN s ON s.commodity = b.commodity AND s.date = b.date, (VALUES ('naive'), ('drift'), ('trend'), ('seasonal')) x(model) WHERE actual IS NOT NULL").replace(") , ", "), ", 1)),
    "m10_fan_out": (lambda f: baseline.fan_out(f.market, KEY, 6, 14), sql("market", f", b AS (SELECT *, (close - first_value(close) {frame(30)}) / nullif(count(*) {frame(30)} - 1, 0) AS mu, CASE WHEN count(*) {frame(30)} > 1 THEN regr_slope(close, i) {frame(30)} END AS sl, p <> coalesce(lag(p) OVER ({W}), -1) AS trains FROM (SELECT *, row_number() OVER ({W})::DOUBLE AS i, (year(date) * 12 + month(date) - 1) // 6 AS p FROM market)), s AS (SELECT commodity, date, close, last_value(CASE WHEN trains THEN {{'t': date, 'mu': mu, 'sl': sl}} END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS fit FROM b) SELECT commodity, date AS data_cutoff_date, fit.t AS training_date, model, h::INT AS day_ahead, floor((close + coalesce(CASE model WHEN 'drift' THEN fit.mu WHEN 'trend' THEN fit.sl ELSE 0 END, 0) * h) * 10000 + 0.5) / 10000 AS forecast FROM s, (VALUES ('naive'), ('drift'), ('trend')) x(model), range(1, 15) r(h)").replace(") , ", "), ", 1)),
    "st1_incremental_ingest": (ingested, "SELECT event_id, user_id, event_type, value FROM events"),
    "w15_sentiment_spans": (lambda f: feat.sentiment_spans(tone_by_type(f), KEY, "tone", [7, 14, 30]), sql("news", f", d AS (SELECT all_names AS commodity, date, round(avg(try_cast(split_part(tone, ',', 1) AS DOUBLE)), 6) AS tone FROM news GROUP BY ALL), m AS (SELECT *, " + ", ".join([*(f"CASE WHEN count(*) {frame(n)} = {n} THEN round({fn}(tone) {frame(n)}, 6) END AS tone_{name}_{n}" for n in (7, 14, 30) for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))), *(f"round(tone - lag(tone, {n}) OVER ({W}), 6) AS momentum_{n}" for n in (7, 14, 30))]) + " FROM d) SELECT *, " + ", ".join(f"round(momentum_{n} - lag(momentum_{n}, {n}) OVER ({W}), 6) AS acceleration_{n}" for n in (7, 14, 30)) + " FROM m").replace(") , ", "), ", 1)),
    "w29_direction_origin": (lambda f: pt.directional_accuracy(f.points, BY, ["model"], "origin"), sql("points", "SELECT model, round(avg((sign(forecast - pf) = sign(actual - pa))::INT) * 100, 4) AS directional_accuracy FROM (SELECT *, first_value(forecast) OVER w AS pf, first_value(actual) OVER w AS pa FROM points WINDOW w AS (PARTITION BY start, model ORDER BY day)) WHERE day > 1 GROUP BY 1")),
}
