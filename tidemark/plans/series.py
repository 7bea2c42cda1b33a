"""Queries on daily series: cleaning, spines, joins, windows, features and baselines, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg, baseline, carry, clean, features as feat, spine
from .bindings import Frames, with_views

KEY = ["commodity"]
W = "PARTITION BY commodity ORDER BY date"
#: A series for each nation of the dimension table.
FX = [f"fx_{k}" for k in range(25)]


def filled_market(f: Frames):
    names = f.market.select("commodity").distinct()
    grid = spine.grid(spine.date_spine(f.market), names)
    own = spine.onto_spine(grid, f.market.withColumn("is_trading_day", F.lit(1)), ["date", "commodity"])
    return spine.ffill(own.withColumn("is_trading_day", F.coalesce("is_trading_day", F.lit(0))), ["open", "high", "low", "close"], KEY)


FILLED = "days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM market), filled AS (SELECT date, commodity, is_trading_day, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("open", "high", "low", "close")) + " FROM (SELECT d.date, n.commodity, m.open, m.high, m.low, m.close, CASE WHEN m.close IS NULL THEN 0 ELSE 1 END AS is_trading_day FROM days d CROSS JOIN (SELECT DISTINCT commodity FROM market) n LEFT JOIN market m ON m.date = d.date AND m.commodity = n.commodity))"


def on_filled(body: str, extra: str = "") -> str:
    return with_views("market " + extra, "SELECT 0").removesuffix(" SELECT 0") + ", " + FILLED + " " + body


def filled_fx(f: Frames):
    days = spine.date_spine(f.market)
    return spine.ffill_series(f.macro_long, days)


FX_FILLED = "fx AS (SELECT date, series, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT d.date, s.series, m.value FROM days d CROSS JOIN (SELECT DISTINCT series FROM macro_long) s LEFT JOIN macro_long m ON m.date = d.date AND m.series = s.series))"


def unified(f: Frames):
    market = filled_market(f)
    days = spine.date_spine(f.market)
    vix = spine.ffill_series(f.vix.select(F.lit("vix").alias("series"), "date", F.col("vix").alias("value")), days).select("date", F.col("value").alias("vix"))
    macro = spine.merge_series(filled_fx(f), FX)
    trading = market.select("date", "commodity", "is_trading_day").where("is_trading_day = 1")
    return spine.unify(f.weather, market.drop("is_trading_day", "volume"), vix, macro, trading)


UNIFIED = on_filled("", "weather vix macro_long").rstrip() + ", " + FX_FILLED + ", vixf AS (SELECT d.date, last_value(v.vix IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS vix FROM days d LEFT JOIN vix v ON v.date = d.date), macro AS (SELECT date, " + ", ".join(f"max(value) FILTER (series = '{n}') AS {n}" for n in FX) + " FROM fx GROUP BY date) SELECT w.date, w.commodity, region, temp_c, humidity_pct, precipitation_mm, open, high, low, close, vix, " + ", ".join(FX) + ", is_trading_day FROM weather w JOIN filled m ON w.date = m.date AND w.commodity = m.commodity JOIN vixf ON vixf.date = w.date JOIN macro ON macro.date = w.date"


def landing(f: Frames):
    return f.table("orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("commodity"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ingest_ts"))


LANDING = "landing AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS commodity, o_totalprice AS price, o_orderkey AS ingest_ts FROM orders)"


def frame(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def market_sql(body: str, views: str = "market") -> str:
    return with_views(views, body)


D = f"close - lag(close) OVER ({W})"
CASES = {
    "unified_daily": (unified, UNIFIED),
    "w3_latest_wins": (lambda f: clean.latest_wins(landing(f), ["date", "commodity"], "ingest_ts"), f"WITH {LANDING} SELECT * FROM landing QUALIFY row_number() OVER (PARTITION BY date, commodity ORDER BY ingest_ts DESC) = 1"),
    "w4_most_complete": (lambda f: clean.most_complete(landing(f).withColumn("price", F.when(F.col("ingest_ts") % 3 != 0, F.col("price"))), ["date", "commodity"], ["price"], "ingest_ts"), f"WITH {LANDING}, holes AS (SELECT date, commodity, CASE WHEN ingest_ts % 3 <> 0 THEN price END AS price, ingest_ts FROM landing) SELECT * FROM holes QUALIFY row_number() OVER (PARTITION BY date, commodity ORDER BY (price IS NOT NULL)::INT DESC, ingest_ts DESC) = 1"),
    "w5_latest_row": (lambda f: clean.first_by(f.macro_long, ["series"], [F.desc("date")]), market_sql("SELECT * FROM macro_long QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) = 1", "macro_long")),
    "w18_last_n": (lambda f: clean.last_n(f.market, KEY, "date", 30).groupBy("commodity").agg(F.round(F.avg("close"), 4).alias("mean_close"), F.min("date").alias("since")), market_sql("SELECT commodity, round(avg(close), 4) AS mean_close, min(date) AS since FROM (SELECT * FROM market QUALIFY row_number() OVER (PARTITION BY commodity ORDER BY date DESC) <= 30) GROUP BY 1")),
    "f6_j1_j2_w1_filled_market": (lambda f: filled_market(f).drop("volume"), on_filled("SELECT * FROM filled")),
    "w2_ffill_series": (filled_fx, on_filled("", "macro_long").rstrip() + ", " + FX_FILLED + " SELECT * FROM fx"),
    "j4_missing_dates": (lambda f: spine.missing(f.vix.select("date"), f.market, ["date"]), market_sql("SELECT date FROM vix WHERE date NOT IN (SELECT date FROM market)", "vix market")),
    "j6_as_of": (lambda f: spine.as_of_join(f.trades.select(F.col("strategy").alias("commodity"), "date").distinct(), f.market.where(F.dayofmonth("date") == 1).select("commodity", F.col("date").alias("training_date")), "date", "training_date", KEY), market_sql("SELECT t.commodity, t.date, max(m.date) AS training_date FROM (SELECT DISTINCT strategy AS commodity, date FROM trades) t LEFT JOIN (SELECT * FROM market WHERE day(date) = 1) m ON m.commodity = t.commodity AND m.date <= t.date GROUP BY ALL", "trades market")),
    "j7_merge_series": (lambda f: spine.merge_series(f.macro_long, FX), market_sql("SELECT date, " + ", ".join(f"max(value) FILTER (series = '{n}') AS {n}" for n in FX) + " FROM macro_long GROUP BY date", "macro_long")),
    "j8_join_ffill": (lambda f: spine.join_ffill(f.market.select("date", "commodity", "close"), f.vix, ["date"], ["vix"], KEY), market_sql(f"SELECT date, commodity, close, last_value(vix IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS vix FROM market LEFT JOIN vix USING (date)", "market vix")),
    "j9_join_zero": (lambda f: spine.join_zero(f.market.select("date", "commodity", "close"), f.vix, ["date"], ["vix"]), market_sql("SELECT date, commodity, close, coalesce(vix, 0) AS vix FROM market LEFT JOIN vix USING (date)", "market vix")),
    "j11_version_diff": (lambda f: spine.version_diff(f.market, f.market.withColumn("close", F.col("open")), ["date", "commodity"], "close"), market_sql("SELECT date, commodity, close AS v1, open AS v2, round(abs(close - open), 4) AS difference FROM market")),
    "j13_latest_only": (lambda f: spine.latest_only(f.weather, ["region", "commodity"], "date"), market_sql("SELECT * FROM weather QUALIFY date = max(date) OVER (PARTITION BY region, commodity)", "weather")),
    "a1_region_mean": (lambda f: agg.region_mean(f.weather, ["temp_c", "humidity_pct"], []), market_sql("SELECT date, commodity, round(avg(temp_c), 4) AS temp_c, round(avg(humidity_pct), 4) AS humidity_pct FROM weather GROUP BY ALL", "weather")),
    "a2_region_weighted": (lambda f: agg.region_weighted(f.weather, f.table("nation").select(F.col("n_name").alias("region"), F.sqrt(F.col("n_nationkey") + 1.0).alias("weight")), ["temp_c"]), market_sql("SELECT date, commodity, round(coalesce(sum(temp_c * sqrt(n_nationkey + 1.0)) / sum(sqrt(n_nationkey + 1.0)), avg(temp_c)), 4) AS temp_c FROM weather JOIN nation ON n_name = region GROUP BY ALL", "weather")),
    "a3_numeric_mean": (lambda f: agg.numeric_mean(f.market.drop("commodity"), ["date"]), market_sql("SELECT date, round(avg(open), 4) AS open, round(avg(high), 4) AS high, round(avg(low), 4) AS low, round(avg(close), 4) AS close, round(avg(volume), 4) AS volume FROM market GROUP BY 1")),
    "a11_null_report": (lambda f: agg.null_report(spine.merge_series(f.macro_long, FX).withColumn("year", F.year("date")), ["year"], FX), market_sql("SELECT year, n_rows, \"column\", n_null, round(100 * n_null / n_rows, 2) AS null_pct FROM (UNPIVOT (SELECT year(date)::INT AS year, count(*) AS n_rows, " + ", ".join(f"count(*) - count({n}) AS {n}" for n in FX) + " FROM (SELECT date, " + ", ".join(f"max(value) FILTER (series = '{n}') AS {n}" for n in FX) + " FROM macro_long GROUP BY date) GROUP BY 1) ON " + ", ".join(FX) + " INTO NAME \"column\" VALUE n_null)", "macro_long")),
    "a12_duplicates": (lambda f: agg.duplicate_report(f.table("lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "a13_completeness": (lambda f: agg.completeness(f.market, KEY), market_sql("SELECT commodity, count(DISTINCT date) AS n_days, date_diff('day', min(date), max(date)) + 1 AS n_expected, min(date) AS first_day, max(date) AS last_day, n_expected - n_days AS missing_days, round(100 * n_days / n_expected, 2) AS completeness_pct FROM market GROUP BY 1")),
    "a14_retention": (lambda f: agg.retention({"landing": landing(f), "bronze": f.market, "silver": f.market.where("volume > 1")}), market_sql("SELECT layer, n_rows, round(100 * n_rows / (SELECT count(*) FROM orders), 2) AS retention_pct FROM (SELECT 'landing' AS layer, count(*) AS n_rows FROM orders UNION ALL SELECT 'bronze', count(*) FROM market UNION ALL SELECT 'silver', count(*) FROM market WHERE volume > 1)")),
    "a15_freshness": (lambda f: agg.freshness(f.market, KEY, "2001-08-05", 3, 10), market_sql("SELECT commodity, max(date) AS latest, date_diff('day', max(date), DATE '2001-08-05') AS age_days, CASE WHEN age_days > 10 THEN 'CRITICAL' WHEN age_days > 3 THEN 'WARNING' ELSE 'OK' END AS status FROM market GROUP BY 1")),
    "a16_presence": (lambda f: agg.presence({"market": f.market, "weather": f.weather}, ["date", "commodity"]), market_sql("SELECT date, commodity, count(*) FILTER (layer = 'market') AS n_market, count(*) FILTER (layer = 'weather') AS n_weather FROM (SELECT date, commodity, 'market' AS layer FROM market UNION ALL SELECT date, commodity, 'weather' FROM weather) GROUP BY ALL", "market weather")),
    "a19_stability": (lambda f: agg.stability(f.market.withColumn("score", F.col("close") - F.col("open")), KEY, "score"), market_sql("SELECT commodity, strftime(date, '%Y-%m') AS month, round(avg(close - open), 6) AS mean, round(stddev_samp(close - open), 4) AS std, round(CASE WHEN avg(close - open) <> 0 THEN stddev_samp(close - open) / avg(close - open) END, 4) AS stability, round(avg((close - open > 0)::INT), 4) AS win_rate FROM market GROUP BY ALL")),
    "a20_availability": (lambda f: agg.availability(spine.merge_series(f.macro_long, FX).withColumn("year", F.year("date")), ["year"], FX), market_sql("SELECT year(date)::INT AS year, count(*) AS n_rows, " + ", ".join(f"count({n}) AS n_{n}" for n in FX) + " FROM (SELECT date, " + ", ".join(f"max(value) FILTER (series = '{n}') AS {n}" for n in FX) + " FROM macro_long GROUP BY date) GROUP BY 1", "macro_long")),
    "a21_walk_summary": (lambda f: agg.walk_summary(f.market.withColumn("mae", F.abs(F.col("close") - F.col("open")) / 1000), KEY, "mae"), market_sql("SELECT commodity, count(*) AS n_windows, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(min(e), 4) AS best, round(max(e), 4) AS worst, round(1 / (1 + stddev_pop(e)), 4) AS stability FROM (SELECT commodity, abs(close - open) / 1000 AS e FROM market) GROUP BY 1")),
    "a22_residual_moments": (lambda f: agg.residual_moments(f.market.withColumn("e", (F.col("close") - F.col("open")) / 1000), KEY, "e"), market_sql("SELECT commodity, n, round(m, 4) AS mean, round(s, 4) AS std, round(m3 / pow(m2, 1.5), 4) AS skewness, round(m4 / (m2 * m2) - 3, 4) AS kurtosis, round(lo, 4) AS lowest, round(hi, 4) AS highest, round(n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jarque_bera FROM (SELECT commodity, count(*) AS n, any_value(m) AS m, stddev_samp(e) AS s, avg(pow(e - m, 2)) AS m2, avg(pow(e - m, 3)) AS m3, avg(pow(e - m, 4)) AS m4, min(e) AS lo, max(e) AS hi FROM (SELECT commodity, (close - open) / 1000 AS e, avg((close - open) / 1000) OVER (PARTITION BY commodity) AS m FROM market) GROUP BY 1)")),
    "a24_correlations": (lambda f: agg.correlations(f.market, KEY, "close", ["open", "volume"]), market_sql("SELECT commodity, round(corr(close, open), 4) AS corr_open, round(corr(close, volume), 4) AS corr_volume FROM market GROUP BY 1")),
    "a28_qualify": (lambda f: agg.qualify_series(f.trades, ["strategy"]), market_sql("SELECT strategy, count(*) AS n_runs, count(DISTINCT date) AS n_days, date_diff('day', min(date), max(date)) + 1 AS span_days, round(n_days / span_days, 4) AS coverage, round(n_runs / n_days, 4) AS runs_per_day, span_days >= 730 AND coverage >= 0.9 AS qualified, CASE WHEN coverage < 0.5 THEN 'sparse' WHEN coverage < 0.9 THEN 'partial' ELSE 'dense' END AS rating FROM trades GROUP BY 1", "trades")),
    "w6_lags": (lambda f: feat.lags(f.market.select("date", "commodity", "close"), ["close"], [1, 7, 14, 30], KEY), market_sql("SELECT date, commodity, close, " + ", ".join(f"lag(close, {p}) OVER ({W}) AS close_lag_{p}" for p in (1, 7, 14, 30)) + " FROM market")),
    "w7_rolling": (lambda f: feat.rolling(f.market.select("date", "commodity", "close"), ["close"], [7, 30], KEY), market_sql("SELECT date, commodity, close, " + ", ".join(f"round({fn}(close) {frame(n)}, 4) AS close_{name}_{n}" for n in (7, 30) for name, fn in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM market")),
    "w8_diffs": (lambda f: feat.diffs(f.market.select("date", "commodity", "close"), ["close"], [1, 7], KEY), market_sql("SELECT date, commodity, close, " + ", ".join(f"round(close - lag(close, {p}) OVER ({W}), 4) AS close_diff_{p}" for p in (1, 7)) + " FROM market")),
    "w9_rolling_full": (lambda f: feat.rolling(f.market.select("date", "commodity", "close"), ["close"], [14], KEY, full=True), market_sql("SELECT date, commodity, close, " + ", ".join(f"CASE WHEN count(*) {frame(14)} = 14 THEN round({fn}(close) {frame(14)}, 4) END AS close_{name}_14" for name, fn in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM market")),
    "w10_rsi_momentum_vol": (lambda f: feat.rsi_momentum_vol(f.market.select("date", "commodity", "close"), "close", [14], KEY), market_sql(f"SELECT date, commodity, close, CASE WHEN count(d) {frame(14)} = 14 THEN CASE WHEN avg(greatest(-d, 0)) {frame(14)} = 0 THEN 100.0 ELSE round(100 - 100 / (1 + avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) {frame(14)} / avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) {frame(14)}), 4) END END AS rsi_14, round(close / lag(close, 14) OVER ({W}) - 1, 4) AS momentum_14, CASE WHEN count(d) {frame(14)} = 14 THEN round(stddev_samp(r) {frame(14)}, 4) END AS volatility_14 FROM (SELECT *, {D} AS d, close / lag(close) OVER ({W}) - 1 AS r FROM market)")),
    "w11_macd": (lambda f: carry.macd(f.market, "close", KEY), market_sql(f"RECURSIVE_MACD")),
    "w12_bollinger": (lambda f: feat.bollinger(f.market.select("date", "commodity", "close"), "close", KEY), market_sql(f"SELECT date, commodity, close, round(m, 4) AS bb_mid, round(m + 2 * s, 4) AS bb_upper, round(m - 2 * s, 4) AS bb_lower, round(4 * s / m, 4) AS bb_width, round((close - (m - 2 * s)) / (4 * s), 4) AS bb_position FROM (SELECT date, commodity, close, CASE WHEN count(*) {frame(20)} = 20 THEN avg(close) {frame(20)} END AS m, CASE WHEN count(*) {frame(20)} = 20 THEN stddev_samp(close) {frame(20)} END AS s FROM market)")),
    "w13_channel": (lambda f: feat.channel(f.market.select("date", "commodity", "close"), "close", [5, 20], KEY), market_sql("SELECT date, commodity, close, " + ", ".join(f"round(close / avg(close) {frame(n)} - 1, 4) AS ma_distance_{n}, round(CASE WHEN max(close) {frame(n)} > min(close) {frame(n)} THEN (close - min(close) {frame(n)}) / (max(close) {frame(n)} - min(close) {frame(n)}) END, 4) AS channel_{n}" for n in (5, 20)) + " FROM market")),
    "w14_trend_slope": (lambda f: feat.trend_slope(f.market.select("date", "commodity", "close"), "close", [10], KEY), market_sql(f"SELECT date, commodity, close, CASE WHEN count(*) {frame(10)} = 10 THEN round(regr_slope(close, i) {frame(10)}, 4) END AS slope_10 FROM (SELECT *, row_number() OVER ({W})::DOUBLE AS i FROM market)")),
    "w16_gaps": (lambda f: feat.gaps(f.market, KEY, 1), market_sql(f"SELECT * FROM (SELECT commodity, date, lag(date) OVER ({W}) AS previous, date_diff('day', lag(date) OVER ({W}), date) AS gap_days FROM market) WHERE gap_days > 1")),
    "w17_outliers": (lambda f: feat.outliers(f.market.select("date", "commodity", "close"), KEY, "close", 2.0), market_sql("SELECT * FROM (SELECT date, commodity, close, round((close - avg(close) OVER (PARTITION BY commodity)) / stddev_samp(close) OVER (PARTITION BY commodity), 4) AS z_score FROM market) WHERE abs(z_score) > 2")),
    "w20_change_high_low": (lambda f: feat.change_high_low(f.market, "close", 7, 30, KEY), market_sql(f"SELECT commodity, date, close, round((close / b - 1) * 100, 4) AS change_pct, h AS span_high, l AS span_low FROM (SELECT *, lag(close, 7) OVER ({W}) AS b, max(close) {frame(30)} AS h, min(close) {frame(30)} AS l FROM market) QUALIFY row_number() OVER (PARTITION BY commodity ORDER BY date DESC) = 1")),
    "w22_hist_vol": (lambda f: feat.hist_vol(f.market.select("date", "commodity", "close"), 30, KEY), market_sql(f"SELECT date, commodity, close, round(stddev_pop(r) {frame(30)}, 4) AS hist_vol_30 FROM (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM market)")),
    "w23_crossings": (lambda f: feat.crossings(f.market.select("date", "commodity", "close"), 30, 5.0, KEY), market_sql(f"SELECT date, commodity, close, round(ma, 4) AS ma, coalesce(close > ma AND NOT pc > pm, false) AS cross_up, coalesce(NOT close > ma AND pc > pm, false) AS cross_down, coalesce(close > ma * 1.05, false) AS over_threshold FROM (SELECT *, lag(close) OVER ({W}) AS pc, lag(ma) OVER ({W}) AS pm FROM (SELECT *, CASE WHEN count(*) {frame(30)} = 30 THEN avg(close) {frame(30)} END AS ma FROM market))")),
    "f7_calendar": (lambda f: feat.calendar(f.market.select("date", "commodity")), market_sql("SELECT date, commodity, (dayofweek(date) + 1)::INT AS day_of_week, month(date)::INT AS month, quarter(date)::INT AS quarter, dayofyear(date)::INT AS day_of_year FROM market")),
    "f8_cyclic": (lambda f: feat.cyclic(f.market.select("date").distinct()), market_sql("SELECT date, " + ", ".join(f"round({fn}(2 * pi() * {x} / {p}), 4) AS {n}_{fn}" for n, x, p in (("dow", "((dayofweek(date) + 6) % 7)", 7), ("dom", "day(date)", 31), ("doy", "dayofyear(date)", 365), ("week", "week(date)", 52)) for fn in ("sin", "cos")) + " FROM (SELECT DISTINCT date FROM market)")),
    "f9_fourier": (lambda f: feat.fourier(f.market.select("date").distinct(), 2, 365.25), market_sql("SELECT date, " + ", ".join(f"round({fn}(2 * pi() * {k} * dayofyear(date) / 365.25), 4) AS fourier_{fn}_{k}" for k in (1, 2) for fn in ("sin", "cos")) + " FROM (SELECT DISTINCT date FROM market)")),
    "f10_interactions": (lambda f: feat.interactions(f.weather, [("temp_c", "humidity_pct")]), market_sql("SELECT *, round(temp_c * humidity_pct, 4) AS temp_c_x_humidity_pct FROM weather", "weather")),
    "f11_regime": (lambda f: feat.regime(f.weather.select("date", "region", "commodity", "temp_c"), "temp_c", [15.0, 30.0]), market_sql("SELECT date, region, commodity, temp_c, r AS regime, (r = 0)::INT AS regime_0, (r = 1)::INT AS regime_1, (r = 2)::INT AS regime_2 FROM (SELECT *, (temp_c > 15)::INT + (temp_c > 30)::INT AS r FROM weather)", "weather")),
    "f12_scale": (lambda f: feat.scale(f.market.select("date", "commodity", "close"), ["close"], "standard", "1999-12-31")[0], market_sql("SELECT date, commodity, close, round((close - m) / s, 4) AS close_scaled FROM market, (SELECT avg(close) AS m, stddev_pop(close) AS s FROM market WHERE date <= DATE '1999-12-31')")),
    "m1_naive": (lambda f: baseline.naive(f.market, 14, KEY), market_sql("SELECT commodity, round(l, 4) AS forecast, c AS data_cutoff_date, h::INT AS day_ahead, (c + h::INT) AS forecast_date, " + ", ".join(f"round(l {sign} {z} * (l * s * sqrt(h)), 4) AS {side}_{level}" for level, z in ((80, 1.28), (95, 1.96)) for side, sign in (("lower", "-"), ("upper", "+"))) + f" FROM (SELECT commodity, arg_max(close, date) AS l, stddev_samp(r) AS s, max(date) AS c FROM (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM market) GROUP BY 1), range(1, 15) x(h)")),
    "m2_drift": (lambda f: baseline.drift(f.market, 14, KEY), market_sql(f"SELECT commodity, h::INT AS day_ahead, round(l + m * h, 4) AS forecast, round(s * sqrt(h), 4) AS forecast_std FROM (SELECT commodity, arg_max(close, date) AS l, avg(d) AS m, stddev_samp(d) AS s FROM (SELECT *, {D} AS d FROM market QUALIFY row_number() OVER (PARTITION BY commodity ORDER BY date DESC) <= 30) GROUP BY 1), range(1, 15) x(h)")),
    "m3_persist": (lambda f: baseline.persist(f.weather, ["temp_c"], 14, ["region", "commodity"]), market_sql("SELECT region, commodity, t AS temp_c, h::INT AS day_ahead, d + h::INT AS date FROM (SELECT region, commodity, arg_max(temp_c, date) AS t, max(date) AS d FROM weather GROUP BY ALL), range(1, 15) x(h)", "weather")),
    "m4_seasonal": (lambda f: baseline.seasonal(f.weather, ["temp_c"], 14, ["region", "commodity"]), market_sql("SELECT l.region, l.commodity, l.day_ahead, l.date, round(coalesce(s.t, l.t), 4) AS temp_c FROM last l LEFT JOIN (SELECT region, commodity, day_ahead, avg(t) AS t FROM (SELECT l.region, l.commodity, l.day_ahead, y, arg_min(w.temp_c, r) AS t FROM last l, range(1, 4) a(y), (VALUES (0, 0), (1, -1), (2, 1)) o(r, off), weather w WHERE w.region = l.region AND w.commodity = l.commodity AND w.date = (CAST(l.date - to_months(12 * y::INT) AS DATE) + off) GROUP BY ALL) GROUP BY ALL) s USING (region, commodity, day_ahead)", "weather").replace(" SELECT l.region, l.commodity, l.day_ahead, l.date", ", last AS (SELECT region, commodity, t, h::INT AS day_ahead, d + h::INT AS date FROM (SELECT region, commodity, arg_max(temp_c, date) AS t, max(date) AS d FROM weather GROUP BY ALL), range(1, 15) x(h)) SELECT l.region, l.commodity, l.day_ahead, l.date", 1)),
    "m5_trend": (lambda f: baseline.trend(f.market, ["close"], 14, KEY), market_sql("SELECT commodity, h::INT AS day_ahead, round(CASE WHEN n >= 5 THEN i + s * (h - 1) ELSE l END, 4) AS close FROM (SELECT commodity, count(*) AS n, regr_slope(close, x) AS s, regr_intercept(close, x) AS i, arg_max(close, x) AS l FROM (SELECT *, -(row_number() OVER (PARTITION BY commodity ORDER BY date DESC))::DOUBLE AS x FROM market QUALIFY x >= -30) GROUP BY 1), range(1, 15) y(h)")),
    "m6_at_cutoffs": (lambda f: baseline.naive_at_cutoffs(f.market, KEY, 1, 7), market_sql(f"SELECT commodity, date AS data_cutoff_date, 7 AS day_ahead, round(close, 4) AS naive, round(close + 7 * m, 4) AS drifted, round(a, 4) AS actual FROM (SELECT *, avg(d) {frame(31)} AS m, lead(close, 7) OVER ({W}) AS a FROM (SELECT *, {D} AS d FROM market)) WHERE a IS NOT NULL")),
    "m11_retrain_due": (lambda f: baseline.retrain_due(f.trades.select("strategy", F.col("date").alias("training_date")), ["strategy"], 6, "2002-01-15"), market_sql("SELECT strategy, max(date) AS last_training, CAST(max(date) + INTERVAL 6 MONTH AS DATE) AS next_training, next_training <= DATE '2002-01-15' AS retrain FROM trades GROUP BY 1", "trades")),
    "w27_walk_windows": (lambda f: baseline.walk_windows(f.market, KEY, 365, 14, 14), market_sql(f"SELECT commodity, (i - 365) // 14 + 1 AS window_id, i AS n_train, date AS train_end, s AS test_start, e AS test_end FROM (SELECT *, row_number() OVER ({W}) AS i, lead(date, 1) OVER ({W}) AS s, lead(date, 14) OVER ({W}) AS e FROM market) WHERE i >= 365 AND (i - 365) % 14 = 0 AND e IS NOT NULL")),
    "w28_folds": (lambda f: baseline.folds(f.market, KEY, 5), market_sql("SELECT commodity, date_diff('day', a, date) * 5 // (date_diff('day', a, b) + 1) AS fold, count(*) AS n_rows, min(date) AS first_day, max(date) AS last_day FROM (SELECT *, min(date) OVER (PARTITION BY commodity) AS a, max(date) OVER (PARTITION BY commodity) AS b FROM market) GROUP BY ALL")),
    "p1_as_of_slice": (lambda f: clean.as_of_slice(f.market, "2-HIGH", "1996-06-30"), market_sql("SELECT * FROM market WHERE commodity = '2-HIGH' AND date <= DATE '1996-06-30'")),
    "p4_match_newer": (lambda f: clean.matching_newer(f.market, "commodity", "high|urgent", "2000-12-31"), market_sql("SELECT * FROM market WHERE regexp_matches(upper(commodity), 'HIGH|URGENT') AND date > DATE '2000-12-31'")),
    "p7_ohlc_violations": (lambda f: clean.ohlc_violations(f.market.withColumn("high", F.when(F.col("volume") % 2 == 0, F.col("low")).otherwise(F.col("high")))), market_sql("SELECT * FROM (SELECT date, commodity, open, CASE WHEN volume % 2 = 0 THEN low ELSE high END AS high, low, close, volume FROM market) WHERE least(open, high, low, close) <= 0 OR high < low OR high < greatest(open, close) OR low > least(open, close) OR volume < 0")),
    "p8_range_anomalies": (lambda f: clean.range_anomalies(f.weather, {"temp_c": (5.0, 45.0), "humidity_pct": (1.0, 7.0)}), market_sql("SELECT 'temp_c' AS \"column\", count(*) FILTER (temp_c NOT BETWEEN 5 AND 45) AS n_out FROM weather UNION ALL SELECT 'humidity_pct', count(*) FILTER (humidity_pct NOT BETWEEN 1 AND 7) FROM weather", "weather")),
    "p9_frost_band": (lambda f: f.weather.select("date", "region", "commodity", clean.band(F.col("temp_c") - 20, [(0.0, "frost"), (5.0, "risk")], "none").alias("frost")), market_sql("SELECT date, region, commodity, CASE WHEN temp_c - 20 < 0 THEN 'frost' WHEN temp_c - 20 < 5 THEN 'risk' ELSE 'none' END AS frost FROM weather", "weather")),
    "k2_top_k": (lambda f: clean.top_k(f.market, [F.desc("close"), "date", "commodity"], 25), market_sql("SELECT * FROM market ORDER BY close DESC, date, commodity LIMIT 25")),
    "u3_set_minus": (lambda f: clean.set_minus(f.vix.select("date"), f.weather.select("date")).unionByName(clean.set_minus(f.weather.select("date"), f.vix.select("date"))), market_sql("(SELECT date FROM vix EXCEPT SELECT date FROM weather) UNION ALL (SELECT date FROM weather EXCEPT SELECT date FROM vix)", "vix weather")),
    "u4_overlap": (lambda f: clean.overlap(f.market, f.vix, "date"), market_sql("SELECT (SELECT count(DISTINCT date) FROM market) AS n_left, (SELECT count(DISTINCT date) FROM vix) AS n_right, count(*) AS n_common, round(count(*) / (SELECT count(DISTINCT date) FROM market), 4) AS match_rate FROM (SELECT date FROM market INTERSECT SELECT date FROM vix)", "market vix")),
    "u6_key_diff": (lambda f: clean.key_diff(f.market, f.weather, ["date", "commodity"]), market_sql("SELECT date, commodity, 'right' AS missing_in FROM (SELECT date, commodity FROM market EXCEPT SELECT date, commodity FROM weather) UNION ALL SELECT date, commodity, 'left' FROM (SELECT date, commodity FROM weather EXCEPT SELECT date, commodity FROM market)", "market weather")),
}
MACD = with_views("market", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f", s AS (SELECT commodity, date, close, row_number() OVER ({W}) AS i FROM market), e AS (SELECT commodity, date, i, close AS f, close AS g, 0.0::DOUBLE AS sig FROM s WHERE i = 1 UNION ALL SELECT s.commodity, s.date, s.i, 2 / 13.0::DOUBLE * s.close + 11 / 13.0::DOUBLE * e.f, 2 / 27.0::DOUBLE * s.close + 25 / 27.0::DOUBLE * e.g, 0.2::DOUBLE * ((2 / 13.0::DOUBLE * s.close + 11 / 13.0::DOUBLE * e.f) - (2 / 27.0::DOUBLE * s.close + 25 / 27.0::DOUBLE * e.g)) + 0.8::DOUBLE * e.sig FROM e JOIN s ON s.commodity = e.commodity AND s.i = e.i + 1) SELECT commodity, date, round(f - g, 4) AS macd, round(sig, 4) AS macd_signal, round(f - g - sig, 4) AS macd_hist FROM e"
CASES["w11_macd"] = (CASES["w11_macd"][0], MACD)
