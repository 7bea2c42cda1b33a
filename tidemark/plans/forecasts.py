"""Queries on news, forecast paths, scores, ledgers and signals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, features as feat, ledger, news as nw, paths as pt, scores as sc, signals as sg
from ..sources.tables import saved
from .bindings import Frames, with_views as sql

BY = ["start", "model"]
THEMES = ["CLICK", "PURCHASE", "VIEW", "ECON_0", "ECON_1", "ECON_2"]
GROUPS = {"CLICK": "DEMAND", "PURCHASE": "DEMAND", "ECON_0": "MARKET", "ECON_1": "MARKET", "ECON_2": "MARKET"}
GROUP_SQL = "CASE WHEN theme IN ('CLICK', 'PURCHASE') THEN 'DEMAND' WHEN theme IN ('ECON_0', 'ECON_1', 'ECON_2') THEN 'MARKET' ELSE 'OTHER' END"
TONE_SQL = ", ".join(f"try_cast(split_part(tone, ',', {k + 1}) AS DOUBLE) AS {n}" for k, n in enumerate(nw.TONES))
EXPLODED = f"rows AS (SELECT date AS article_date, unnest(string_split(themes, ';')) AS theme, {TONE_SQL} FROM news)"
MEANS = "count(*) AS n_articles, " + ", ".join(f"round(avg({n}), 8) AS {n}" for n in nw.TONES)
DIFFER = "date, commodity, (close - open) / 1000 AS e1, (close - (high + low) / 2) / 1000 AS e2"


def exploded(f: Frames):
    return nw.explode_themes(nw.parse_day(nw.parse_tone(f.news), "day_text")).select("article_date", "theme", *nw.TONES)


def groups(f: Frames):
    return f.spark.createDataFrame(list(GROUPS.items()), "theme string, theme_group string")


def grouped(f: Frames):
    return nw.group_agg(nw.theme_group(exploded(f), groups(f)), ["article_date"])


def errors(f: Frames):
    return f.market.select("date", "commodity", ((F.col("close") - F.col("open")) / 1000).alias("e1"), ((F.col("close") - (F.col("high") + F.col("low")) / 2) / 1000).alias("e2"))


def ladder_input(f: Frames):
    m = feat.rsi_dx(f.market, 14, ["commodity"])
    return feat.crossings(m, 30, 5.0, ["commodity"])


def tiers(f: Frames):
    """Gain, dispersion and consensus, a row for each start and model, written once for queries that read them more than once."""
    gain = pt.expected_value(f.path_rows, BY, 0.005, 0.01, f.medians)
    spread = pt.dispersion_tier(f.path_rows, BY, (0.3, 0.5), middle=f.medians.where("day = 14").select(*BY, F.col("forecast").alias("__q")))
    rise = f.path_rows.join(f.actuals.where("day = 1").select("start", F.col("actual").alias("price")), "start")
    return saved(gain.join(spread, BY).join(rise.groupBy(*BY).agg(F.round(F.avg((F.col("day_14") > F.col("price")).cast("double")), 4).alias("consensus")), BY), "tiers")


EV = "ev AS (SELECT start, model, arg_max(day, (net, -day)) AS best_day, max(net) AS bv, max(net) FILTER (day = 1) AS nv FROM (SELECT start, model, day, round(quantile_cont(value, 0.5) * (1 - day * 0.005 / 100) * (1 - 0.01 / 100), 6) AS net FROM long_paths GROUP BY start, model, day) GROUP BY ALL)"
TIER = "spread AS (SELECT start, model, round(stddev_pop(value) / quantile_cont(value, 0.5), 4) AS dispersion FROM long_paths WHERE day = 14 GROUP BY ALL), rise AS (SELECT start, model, round(avg((value > actual)::INT), 4) AS consensus FROM (SELECT * FROM long_paths WHERE day = 14) p JOIN (SELECT start, actual FROM actuals WHERE day = 1) a USING (start) GROUP BY ALL), t AS (SELECT start, model, best_day, round(bv, 2) AS best_value, round((bv / nv - 1) * 100, 4) AS net_benefit_pct, dispersion, CASE WHEN dispersion < 0.3 THEN 'high' WHEN dispersion < 0.5 THEN 'medium' ELSE 'low' END AS tier, consensus FROM ev JOIN spread USING (start, model) JOIN rise USING (start, model))"


def tier_sql(body: str) -> str:
    return sql("long_paths actuals", ", " + EV + ", " + TIER + " " + body).replace(") , ", "), ", 1)


W14 = "OVER (PARTITION BY commodity ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
W30 = "OVER (PARTITION BY commodity ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
WK = "OVER (PARTITION BY commodity ORDER BY date)"
RSI = f"x AS (SELECT *, close - lag(close) {WK} AS d, high - lag(high) {WK} AS up, lag(low) {WK} - low AS dn, greatest(high - low, abs(high - lag(close) {WK}), abs(low - lag(close) {WK})) AS tr FROM market), y AS (SELECT *, count(d) {W14} = 14 AS fullw, avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) {W14} AS gain, avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) {W14} AS loss, avg(tr) {W14} AS atr, avg(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END) {W14} AS pdm, avg(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END) {W14} AS mdm, CASE WHEN count(*) {W30} = 30 THEN avg(close) {W30} END AS ma FROM x), z AS (SELECT date, commodity, open, high, low, close, volume, CASE WHEN NOT fullw THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE round(100 - 100 / (1 + gain / loss), 4) END AS rsi_14, CASE WHEN NOT fullw OR pdm + mdm = 0 THEN 20.0 ELSE round(100 * abs(pdm / atr - mdm / atr) / (pdm / atr + mdm / atr), 4) END AS dx_14, round(ma, 4) AS ma, coalesce(close > ma AND NOT lag(close) {WK} > lag(ma) {WK}, false) AS cross_up, coalesce(NOT close > ma AND lag(close) {WK} > lag(ma) {WK}, false) AS cross_down, coalesce(close > ma * 1.05, false) AS over_threshold FROM y)"
LADDER = "CASE WHEN rsi_14 > 70 AND dx_14 > 25 THEN 0.35 WHEN rsi_14 > 70 THEN 0.30 WHEN rsi_14 < 30 AND dx_14 > 25 THEN 0.10 WHEN rsi_14 < 30 THEN 0.15 ELSE 0.25 END"


def rsi_sql(body: str) -> str:
    return sql("market", ", " + RSI + " " + body).replace(") , ", "), ", 1)


def ladder_sql(flag: str) -> str:
    return rsi_sql(f"SELECT date, commodity, CASE WHEN {flag} THEN 'SELL' ELSE 'HOLD' END AS action, CASE WHEN {flag} THEN {LADDER} ELSE 0.0 END::DOUBLE AS share FROM z")


LEDGER = "count(*) AS n_trades, round(sum(amount * price), 2) AS revenue, round(sum(amount * price) * 0.01 / 100, 2) AS fees, round(sum(amount * price) * (1 - 0.01 / 100), 2) AS net, round(sum(amount * price) / sum(amount), 4) AS mean_price, arg_min(price, (date, trade_id)) AS first_price, arg_max(price, (date, trade_id)) AS last_price, date_diff('day', min(date), max(date)) AS days, round(date_diff('day', min(date), max(date)) / nullif(count(*) - 1, 0), 4) AS mean_gap"
def simpson(f: str, top: str, n: int = 4000) -> str:
    """The integral of f (an expression of x) from 0 to `top`, by Simpson's rule."""
    return f"({top}) / {n} / 3 * list_sum(list_transform(range(0, {n + 1}), lambda i: CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f.replace('x_', f'(({top}) * i / {n})')}))"


def student_p(t: str, nu: str) -> str:
    """Student's two-sided p in SQL: the density integrated over the angle atan(t / sqrt(nu))."""
    return f"1 - 2 * exp(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2)) / sqrt(pi()) * {simpson(f'pow(cos(x_), {nu} - 1)', f'atan(abs({t}) / sqrt({nu}))')}"


def normal_p(z: str) -> str:
    return f"1 - 2 / sqrt(2 * pi()) * {simpson('exp(-x_ * x_ / 2)', f'CASE WHEN abs({z}) > 40 THEN 40 ELSE abs({z}) END')}"


def normal_above(z: str) -> str:
    return f"CASE WHEN {z} >= 0 THEN ({normal_p(z)}) / 2 ELSE 1 - ({normal_p(z)}) / 2 END"


def chi_p(q: str, k: int) -> str:
    return f"1 - 2 / (pow(2, {k / 2}) * gamma({k / 2})) * {simpson(f'pow(x_, {k - 1}) * exp(-x_ * x_ / 2)', f'sqrt(CASE WHEN {q} > 1600 THEN 1600 ELSE {q} END)')}"


def binomial_p(k: str, n: str) -> str:
    return f"list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))"


def judged(p: str, body: str, more: str = "") -> str:
    """body with p_value and is_significant of the expression p over its columns."""
    return f"SELECT * EXCLUDE (p), round(p, 6) AS p_value, coalesce(p < 0.05, false) AS is_significant{more} FROM (SELECT *, {p} AS p FROM ({body}))"


SIGNED = "e1 * e1 - e2 * e2"
LOSS = f"l AS (SELECT commodity, date, l - avg(l) OVER (PARTITION BY commodity) AS c, avg(l) OVER (PARTITION BY commodity) AS m FROM (SELECT commodity, date, {SIGNED} AS l FROM (SELECT {DIFFER} FROM market)))"
#: Foresight: what the trades' amounts were worth at the best later price less storage.
RATED = sql("market trades", ", s AS (SELECT date, commodity, close, row_number() OVER (PARTITION BY commodity ORDER BY date) AS i FROM market), bounds AS (SELECT date, commodity, round(max(close * (1 - 0.01 / 100) - (i - 1) * 50.0) OVER (PARTITION BY commodity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + (i - 1) * 50.0, 4) AS bound FROM s), rated AS (SELECT strategy, net, bound_value, round(net / bound_value, 4) AS efficiency, round(bound_value - net, 2) AS gap, CASE WHEN net / bound_value >= 0.95 THEN 'excellent' WHEN net / bound_value >= 0.85 THEN 'good' WHEN net / bound_value >= 0.7 THEN 'fair' ELSE 'poor' END AS category FROM (SELECT strategy, round(sum(amount * price) * (1 - 0.01 / 100), 2) AS net FROM trades GROUP BY 1) JOIN (SELECT strategy, round(sum(amount * bound), 0) AS bound_value FROM trades JOIN bounds ON bounds.commodity = strategy AND bounds.date = trades.date GROUP BY 1) USING (strategy))").replace(") , ", "), ", 1)


def rated(f: Frames):
    """Each strategy's net proceeds against those of perfect foresight."""
    bounds = ledger.foresight_bound(f.market.select("date", "commodity", "close"), ["commodity"], 50.0, 0.01).withColumnRenamed("commodity", "strategy")
    best = ledger.foresight_value(f.trades, bounds, ["strategy"], ["strategy"])
    return ledger.efficiency(ledger.ledger_metrics(f.trades, ["strategy"], 0.01).select("strategy", "net").join(best, "strategy"), F.col("bound_value"))


def decided(f: Frames):
    t = tiers(f)
    return ledger.decision_diff(sg.consensus_signal(t, min_gain=0.2), sg.risk_signal(t, 0.3, 0.5, 0.2), BY, "share")


CASES = {
    "p2_relevant": (lambda f: nw.relevant(f.news.select("event_id", "themes", "all_names"), ["ECON_1", "TAX_P"], ["view"]), sql("news", "SELECT event_id, themes, all_names FROM news WHERE regexp_matches(themes, '(^|;)(ECON_1|TAX_P)') OR contains(lower(all_names), 'view')")),
    "p3_commodity_flags": (lambda f: nw.commodity_flags(f.table("documents").select("doc_id", "text"), "text", {"coffee": ("the|und", None), "sugar": ("la ", "el ")}).drop("text"), "SELECT doc_id, coalesce(regexp_matches(lower(text), 'the|und'), false) AS is_coffee, coalesce(regexp_matches(lower(text), 'la ') AND NOT regexp_matches(lower(text), 'el '), false) AS is_sugar FROM documents"),
    "f1_f2_parse": (lambda f: nw.parse_day(nw.parse_tone(f.news), "day_text").select("event_id", "article_date", *nw.TONES), sql("news", f"SELECT event_id, date AS article_date, {TONE_SQL} FROM news")),
    "f3_explode_themes": (lambda f: exploded(f).groupBy("article_date", "theme").agg(F.count(F.lit(1)).alias("n")), sql("news", f", {EXPLODED} SELECT article_date, theme, count(*) AS n FROM rows GROUP BY ALL").replace(") , ", "), ", 1)),
    "a4_theme_agg": (lambda f: nw.theme_agg(exploded(f), ["article_date"], THEMES), sql("news", f", {EXPLODED} SELECT article_date, theme, {MEANS} FROM rows WHERE theme IN {tuple(THEMES)} GROUP BY ALL").replace(") , ", "), ", 1)),
    "f4_a5_group_agg": (grouped, sql("news", f", {EXPLODED} SELECT article_date, theme_group, {MEANS} FROM (SELECT *, {GROUP_SQL} AS theme_group FROM rows UNION ALL SELECT *, 'ALL' FROM rows) GROUP BY ALL").replace(") , ", "), ", 1)),
    "a6_merge_partials": (lambda f: nw.merge_partials(exploded(f).groupBy("theme", F.dayofmonth("article_date").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("tone_avg").alias("sum_tone_avg")), ["theme"], ["tone_avg"]), sql("news", f", {EXPLODED} SELECT theme, CAST(count(*) AS BIGINT) AS n, round(sum(tone_avg) / count(*), 8) AS tone_avg FROM rows GROUP BY ALL").replace(") , ", "), ", 1)),
    "r1_pivot_news": (lambda f: nw.pivot_metrics(grouped(f), ["article_date"], "theme_group", ["ALL", "DEMAND", "MARKET"], ["n_articles", "tone_avg"], "group_"), sql("news", f", {EXPLODED}, g AS (SELECT article_date, theme_group, {MEANS} FROM (SELECT *, {GROUP_SQL} AS theme_group FROM rows UNION ALL SELECT *, 'ALL' FROM rows) GROUP BY ALL) SELECT article_date, " + ", ".join(f"coalesce(max(n_articles) FILTER (theme_group = '{g}'), 0) AS group_{g.lower()}_n_articles, max(tone_avg) FILTER (theme_group = '{g}') AS group_{g.lower()}_tone_avg" for g in ("ALL", "DEMAND", "MARKET")) + " FROM g GROUP BY article_date").replace(") , ", "), ", 1)),
    "a30_event_counts": (lambda f: nw.event_counts(nw.parse_tone(f.news), ["date"], "click|tax_view", ["themes", "all_names"]), sql("news", f"SELECT date, count(*) AS n_events, round(avg(tone_avg), 8) AS tone, count(*) FILTER (tone_avg > 200) AS n_positive, count(*) FILTER (tone_avg <= 200) AS n_negative FROM (SELECT *, {TONE_SQL} FROM news) WHERE regexp_matches(lower(themes), 'click|tax_view') OR regexp_matches(lower(all_names), 'click|tax_view') GROUP BY 1")),
    "f21_json_fields": (lambda f: nw.json_fields(f.table("events").select("event_id", "props"), "props", "k long").select("event_id", "k"), "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events"),
    "r2_unpivot_days": (lambda f: f.long_rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")), sql("long_paths", "SELECT day, count(*) AS n, round(avg(value), 4) AS mean FROM long_paths GROUP BY 1")),
    "r3_pivot_days": (lambda f: pt.pivot_days(f.actuals.withColumnRenamed("actual", "value"), ["start"]), sql("actuals", "SELECT start, " + ", ".join(f"max(actual) FILTER (day = {h}) AS day_{h}" for h in range(1, 15)) + " FROM actuals GROUP BY 1")),
    "r5_actual_windows": (lambda f: pt.actual_windows(f.market, ["commodity"]), sql("market", "SELECT * FROM (SELECT commodity, date AS start, " + ", ".join(f"lead(close, {h - 1}) {WK} AS day_{h}" for h in range(1, 15)) + " FROM market) WHERE day_14 IS NOT NULL")),
    "a7_distribution_summary": (lambda f: pt.distribution_summary(f.path_rows, BY, [0.05, 0.25, 0.5, 0.75, 0.95]), sql("long_paths", "SELECT start, model, day, count(*) AS n, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, round(min(value), 2) AS lowest, round(max(value), 2) AS highest, " + ", ".join(f"round(quantile_cont(value, {q}), 2) AS p{round(100 * q)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM long_paths GROUP BY ALL")),
    "a8_point_metrics": (lambda f: pt.point_metrics(f.points, ["model"]), sql("points", "SELECT model, count(*) AS n, round(avg(abs(forecast - actual)), 4) AS mae, round(sqrt(avg(pow(forecast - actual, 2))), 4) AS rmse, round(avg(abs((forecast - actual) / actual)) * 100, 4) AS mape, round(avg(forecast - actual), 4) AS bias FROM points GROUP BY 1")),
    "a9_horizon_metrics": (lambda f: pt.horizon_metrics(f.points, ["model"], [1, 7, 14]), sql("points", "SELECT model, day, count(*) AS n, round(avg(abs(forecast - actual)), 4) AS mae, round(sqrt(avg(pow(forecast - actual, 2))), 4) AS rmse, round(avg(abs((forecast - actual) / actual)) * 100, 4) AS mape, round(avg(forecast - actual), 4) AS bias FROM points WHERE day IN (1, 7, 14) GROUP BY ALL")),
    "e5_window_scores": (lambda f: pt.point_metrics(pt.up_to_horizon(f.points, [1, 7, 14]), [*BY, "horizon"]), sql("points", "SELECT start, model, horizon, count(*) AS n, round(avg(abs(forecast - actual)), 4) AS mae, round(sqrt(avg(pow(forecast - actual, 2))), 4) AS rmse, round(avg(abs((forecast - actual) / actual)) * 100, 4) AS mape, round(avg(forecast - actual), 4) AS bias FROM points, (VALUES (1), (7), (14)) h(horizon) WHERE day <= horizon GROUP BY ALL")),
    "a10_e3_e4_coverage": (lambda f: pt.interval_coverage(f.path_rows, f.actuals, BY, 0.9, ["model"]), sql("long_paths actuals", "SELECT model, count(*) AS n, round(avg((actual BETWEEN lo AND hi)::INT), 4) AS coverage, round(avg(hi - lo), 4) AS sharpness FROM (SELECT start, model, day, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM long_paths GROUP BY ALL) JOIN actuals USING (start, day) GROUP BY 1")),
    "e1_crps": (lambda f: pt.path_crps(f.path_rows, f.actuals, BY, ["model"]), sql("long_paths actuals", "SELECT model, round(avg(a - (s - n * v) / (n * n)), 4) AS crps FROM (SELECT start, model, day, avg(abs(value - actual)) AS a, sum((2 * i - 1) * value) AS s, sum(value) AS v, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY start, model, day ORDER BY value, path_id) AS i FROM long_paths) JOIN actuals USING (start, day) GROUP BY ALL) GROUP BY 1")),
    "e2_calibration": (lambda f: pt.calibration(f.path_rows, f.actuals, BY, [0.1, 0.25, 0.5, 0.75, 0.9], ["model"]), sql("long_paths actuals", "SELECT model, round(avg(abs(hit - level)), 4) AS calibration_error FROM (SELECT model, level, avg((actual <= q)::INT) AS hit FROM (SELECT start, model, day, level, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9])[k] AS q FROM long_paths, (VALUES (1, 0.1), (2, 0.25), (3, 0.5), (4, 0.75), (5, 0.9)) l(k, level) GROUP BY ALL) JOIN actuals USING (start, day) GROUP BY ALL) GROUP BY 1").replace("quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9])[k] AS q", "list_extract(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]), any_value(k)) AS q")),
    "e15_var_cvar": (lambda f: pt.var_cvar(f.path_rows, ["model"], 0.05), sql("long_paths", "SELECT model, day, round(any_value(v), 4) AS value_at_risk, round(avg(value) FILTER (value <= v), 4) AS conditional_value_at_risk FROM long_paths JOIN (SELECT model, day, quantile_cont(value, 0.05) AS v FROM long_paths GROUP BY ALL) USING (model, day) GROUP BY ALL")),
    "e16_compare_models": (lambda f: pt.distribution_summary(f.path_rows, ["model"], [0.1, 0.5, 0.9], [14]).drop("day"), sql("long_paths", "SELECT model, count(*) AS n, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, round(min(value), 2) AS lowest, round(max(value), 2) AS highest, round(quantile_cont(value, 0.1), 2) AS p10, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.9), 2) AS p90 FROM long_paths WHERE day = 14 GROUP BY 1")),
    "e17_a29_validate_paths": (lambda f: pt.validate_paths(f.paths, BY), sql("paths", "SELECT start, model, count(*) AS n_rows, count(DISTINCT path_id) AS n_paths, CAST(sum(" + " + ".join(f"(day_{h} < 0)::INT" for h in range(1, 15)) + ") AS BIGINT) AS n_negative, CAST(sum(" + " + ".join(f"(day_{h} IS NULL)::INT" for h in range(1, 15)) + ") AS BIGINT) AS n_null FROM paths GROUP BY ALL")),
    "e18_hit_rate": (lambda f: pt.hit_rate(f.points, ["model"], 10.0), sql("points", "SELECT model, round(avg((abs(forecast / actual - 1) <= 0.1)::INT) * 100, 4) AS hit_rate FROM points GROUP BY 1")),
    "w29_direction_step": (lambda f: pt.directional_accuracy(f.points, BY, ["model"], "step"), sql("points", "SELECT model, round(avg(coalesce(sign(forecast - pf) = sign(actual - pa), NULL)::INT) * 100, 4) AS directional_accuracy FROM (SELECT *, lag(forecast) OVER w AS pf, lag(actual) OVER w AS pa FROM points WINDOW w AS (PARTITION BY start, model ORDER BY day)) WHERE day > 1 GROUP BY 1")),
    "f17_path_features": (lambda f: pt.path_features(f.path_rows.join(f.actuals.where("day = 1").select("start", F.col("actual").alias("price")), "start"), BY), sql("long_paths actuals", ", r AS (SELECT start, model, value, actual AS price, value / actual - 1 AS r FROM (SELECT * FROM long_paths WHERE day = 14) JOIN (SELECT start, actual FROM actuals WHERE day = 1) USING (start)), m AS (SELECT *, avg(r) OVER (PARTITION BY start, model) AS m FROM r) SELECT start, model, round(avg((r > 0)::INT), 4) AS consensus, round(any_value(m), 4) AS expected_return, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / quantile_cont(value, 0.5), 4) AS relative_spread, round(CASE WHEN avg(pow(r - m, 2)) > 0 THEN avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) END, 4) AS skewness, round((max(value) - min(value)) / any_value(price), 4) AS relative_range, round(avg(least(r, 0)), 4) AS downside FROM m GROUP BY ALL").replace(") , ", "), ", 1)),
    "f18_f19_tiers": (tiers, tier_sql("SELECT * FROM t")),
    "f20_best_window": (lambda f: pt.best_window(f.points, BY), sql("points", "SELECT start, model, arg_max(day, (w, -day)) AS first_day, round(max(w), 4) AS window_mean FROM (SELECT *, CASE WHEN count(*) OVER x = 3 THEN round(avg(forecast) OVER x, 6) END AS w FROM points WINDOW x AS (PARTITION BY start, model ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE w IS NOT NULL GROUP BY ALL")),
    "e8_paired_t": (lambda f: sc.paired_t(errors(f), "e1", "e2", ["commodity"]), sql("market", judged(student_p("t", "(n - 1)"), f"SELECT commodity, n, round(m, 4) AS mean_difference, round(m / nullif(s / sqrt(n), 0), 4) AS t_statistic, round(m / nullif(s, 0), 4) AS cohens_d, round(m - 1.96 * s / sqrt(n), 4) AS lower_95, round(m + 1.96 * s / sqrt(n), 4) AS upper_95, m / nullif(s / sqrt(n), 0) AS t, CASE WHEN m < 0 THEN 'e1' WHEN m > 0 THEN 'e2' END AS lower FROM (SELECT commodity, count(*) AS n, avg(e1 - e2) AS m, stddev_samp(e1 - e2) AS s FROM (SELECT {DIFFER} FROM market) GROUP BY 1)").replace("EXCLUDE (p)", "EXCLUDE (p, t)"))),
    "e9_two_sample_t": (lambda f: sc.two_sample_t(f.trades.withColumn("year", F.year("date")), ["year"], "reason", "F", "amount"), sql("trades", judged(student_p("t", "(n1 + n2 - 2)"), "SELECT year, n1, n2, d / sqrt(1 / n1 + 1 / n2) AS t, round(d / sqrt(1 / n1 + 1 / n2), 4) AS t_statistic, round(d, 4) AS pooled_d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM (SELECT *, (m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0)), 0) AS d FROM (SELECT year(date)::INT AS year, count(*) FILTER (reason = 'F') AS n1, count(*) FILTER (reason <> 'F') AS n2, avg(amount) FILTER (reason = 'F') AS m1, avg(amount) FILTER (reason <> 'F') AS m2, var_samp(amount) FILTER (reason = 'F') AS v1, var_samp(amount) FILTER (reason <> 'F') AS v2 FROM trades GROUP BY 1))").replace("EXCLUDE (p)", "EXCLUDE (p, t)"))),
    "e10_diebold_mariano": (lambda f: sc.diebold_mariano(errors(f), ["commodity"], "e1", "e2", 3), sql("market", f", {LOSS} " + judged(normal_p("dm"), f"SELECT commodity, n, dm, dm * sqrt((n + 1 - 6 + 6 / n) / n) AS dc, round(dm, 4) AS dm_statistic, round(dm * sqrt((n + 1 - 6 + 6 / n) / n), 4) AS dm_corrected, CASE WHEN m < 0 THEN 'e1' WHEN m > 0 THEN 'e2' END AS lower_loss FROM (SELECT commodity, n, m, m / sqrt(CASE WHEN g > 0 THEN g END / n) AS dm FROM (SELECT commodity, count(*) AS n, any_value(m) AS m, avg(c * c) + 2 * (0.0 + sum(c * c1) / count(*) + sum(c * c2) / count(*)) AS g FROM (SELECT *, lag(c, 1) {WK} AS c1, lag(c, 2) {WK} AS c2 FROM l) GROUP BY 1))", ", round(" + student_p("dc", "(n - 1)") + ", 6) AS p_corrected").replace("EXCLUDE (p)", "EXCLUDE (p, dm, dc)")).replace(") , ", "), ", 1)),
    "e11_ljung_box": (lambda f: sc.ljung_box(errors(f), ["commodity"], "e1", 5), sql("market", f", l AS (SELECT commodity, date, e1 - avg(e1) OVER (PARTITION BY commodity) AS c FROM (SELECT {DIFFER} FROM market)) " + judged(chi_p("q", 5), "SELECT commodity, n, round(q, 4) AS q_statistic, q FROM (SELECT commodity, n, n * (n + 2) * (" + " + ".join(f"pow(p{k} / n / g0, 2) / (n - {k})" for k in range(1, 6)) + f") AS q FROM (SELECT commodity, count(*) AS n, avg(c * c) AS g0, " + ", ".join(f"sum(c * c{k}) AS p{k}" for k in range(1, 6)) + " FROM (SELECT *, " + ", ".join(f"lag(c, {k}) {WK} AS c{k}" for k in range(1, 6)) + " FROM l) GROUP BY 1))").replace("EXCLUDE (p)", "EXCLUDE (p, q)")).replace(") , ", "), ", 1)),
    "e12_direction_counts": (lambda f: sc.direction_counts(f.market.withColumn("right", F.col("close") > F.col("open")), ["commodity"], "right"), sql("market", judged(binomial_p("n_right", "n"), "SELECT commodity, count(*) FILTER (close > open) AS n_right, count(*) AS n, round(count(*) FILTER (close > open) / count(*) * 100, 4) AS accuracy, round((count(*) FILTER (close > open) - count(*) / 2) / sqrt(count(*) / 4), 4) AS z_score FROM market GROUP BY 1"))),
    "e13_regression_alert": (lambda f: sc.regression_alert(errors(f).withColumn("mae", F.abs("e1")), ["commodity"], "mae", "2001-07-31"), sql("market", f"SELECT commodity, round(r, 4) AS recent, round(p, 4) AS prior, round((r / nullif(p, 0) - 1) * 100, 4) AS change_pct, round((r - m) / nullif(s, 0), 4) AS z_score, CASE WHEN (r / nullif(p, 0) - 1) * 100 > 50 THEN 'critical' WHEN (r / nullif(p, 0) - 1) * 100 > 20 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT commodity, avg(abs(e1)) FILTER (a BETWEEN 0 AND 29) AS r, avg(abs(e1)) FILTER (a BETWEEN 30 AND 59) AS p, avg(abs(e1)) FILTER (a >= 30) AS m, stddev_samp(abs(e1)) FILTER (a >= 30) AS s FROM (SELECT *, date_diff('day', date, DATE '2001-07-31') AS a FROM (SELECT {DIFFER} FROM market)) GROUP BY 1)")),
    "e19_signal_sharpe": (lambda f: sc.signal_sharpe(f.points, BY, "forecast", "actual", "day"), sql("points", "SELECT start, model, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252), 4) AS sharpe FROM (SELECT start, model, sign(forecast - lag(actual) OVER w) * (actual / lag(actual) OVER w - 1) AS r FROM points WINDOW w AS (PARTITION BY start, model ORDER BY day)) GROUP BY ALL")),
    "k3_best_model": (lambda f: sc.best_model(f.points.withColumn("mae", F.round(F.abs(F.col("forecast") - F.col("actual")), 6)), ["day"], "model", "mae", "start"), sql("points", "SELECT day, arg_min(model, (m, model)) AS model, round(min(m), 4) AS mean_metric FROM (SELECT day, model, avg(round(abs(forecast - actual), 6)) AS m FROM points GROUP BY ALL) GROUP BY 1")),
    "w19_best_flag": (lambda f: sc.best_flag(f.points.select("start", "model", "day", F.round(F.abs(F.col("forecast") - F.col("actual")), 4).alias("mae")), ["start", "day"], "mae", "model"), sql("points", "SELECT start, model, day, mae, row_number() OVER (PARTITION BY start, day ORDER BY mae, model) = 1 AS is_best FROM (SELECT *, round(abs(forecast - actual), 4) AS mae FROM points)")),
    "w30_retain": (lambda f: sc.retain(f.points.select("start", "model").distinct(), ["model"], "start", 12), sql("points", "SELECT start, model, CASE WHEN row_number() OVER (PARTITION BY model ORDER BY start DESC) <= 12 THEN 'active' ELSE 'archived' END AS status FROM (SELECT DISTINCT start, model FROM points)")),
    "a17_ledger": (lambda f: ledger.ledger_metrics(f.trades, ["strategy"], 0.01), sql("trades", f"SELECT strategy, {LEDGER} FROM trades GROUP BY 1")),
    "a18_ledger_by_year": (lambda f: ledger.ledger_metrics_by_year(f.trades, ["strategy"], 0.01), sql("trades", f"SELECT strategy, year(date)::INT AS year, {LEDGER} FROM trades GROUP BY ALL")),
    "a25_leaderboard": (lambda f: ledger.leaderboard(ledger.ledger_metrics(f.trades, ["strategy"], 0.01), ["4-NOT SPECIFIED", "5-LOW"]), sql("trades", f", x AS (SELECT strategy, {LEDGER} FROM trades GROUP BY 1) SELECT b.strategy AS best_baseline, p.strategy AS best_prediction, round(p.net - b.net, 2) AS difference, round((p.net / b.net - 1) * 100, 4) AS difference_pct FROM (SELECT * FROM x WHERE strategy IN ('4-NOT SPECIFIED', '5-LOW') ORDER BY net DESC LIMIT 1) b, (SELECT * FROM x WHERE strategy NOT IN ('4-NOT SPECIFIED', '5-LOW') ORDER BY net DESC LIMIT 1) p").replace(") , ", "), ", 1)),
    "a26_reason_share": (lambda f: ledger.reason_share(f.trades, ["strategy"], "^f$"), sql("trades", "SELECT strategy, n_forced, forced_pct, CASE WHEN forced_pct < 5 THEN 'rare' WHEN forced_pct < 25 THEN 'some' ELSE 'frequent' END AS scenario FROM (SELECT strategy, count(*) FILTER (reason = 'F') AS n_forced, round(sum(CASE WHEN reason = 'F' THEN amount ELSE 0 END) / sum(amount) * 100, 4) AS forced_pct FROM trades GROUP BY 1)")),
    "a27_efficiency": (rated, RATED + " SELECT * FROM rated"),
    "a27_efficiency_summary": (lambda f: ledger.efficiency_summary(rated(f)), RATED + " SELECT count(*) AS n, round(avg(efficiency), 4) AS mean, round(stddev_samp(efficiency), 4) AS std, min(efficiency) AS lowest, max(efficiency) AS highest, " + ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in ("excellent", "good", "fair", "poor")) + " FROM rated"),
    "a26_reason_counts": (lambda f: ledger.reason_counts(f.trades, ["strategy"], "^f$"), sql("trades", "SELECT strategy, reason, n, round(a, 2) AS amount, round(a / sum(a) OVER (PARTITION BY strategy) * 100, 4) AS amount_pct, reason = 'F' AS is_forced FROM (SELECT strategy, coalesce(reason, 'UNKNOWN') AS reason, count(*) AS n, sum(amount) AS a FROM trades GROUP BY ALL)")),
    "w24_portfolio_value": (lambda f: ledger.portfolio_value(f.trades, ["strategy"], 0.01), sql("trades", "SELECT strategy, date, proceeds, total, round((total / lag(total) OVER (PARTITION BY strategy ORDER BY date) - 1) * 100, 4) AS change_pct FROM (SELECT strategy, date, proceeds, round(sum(proceeds) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING), 2) AS total FROM (SELECT strategy, date, round(sum(amount * price) * (1 - 0.01 / 100), 2) AS proceeds FROM trades GROUP BY ALL))")),
    "w25_harvest_schedule": (lambda f: ledger.harvest_schedule(f.market.select("date").distinct(), 11, 2, 50.0), sql("market", "SELECT date, inh AS in_harvest, inh AND NOT coalesce(lag(inh) OVER (ORDER BY date), false) AS opens, CASE WHEN inh THEN round(50.0 / 120, 6) ELSE 0.0 END::DOUBLE AS daily_volume FROM (SELECT DISTINCT date, month(date) >= 11 OR month(date) <= 2 AS inh FROM market)")),
    "w26_foresight_bound": (lambda f: ledger.foresight_bound(f.market.select("date", "commodity", "close"), ["commodity"], 50.0, 0.01), sql("market", ", s AS (SELECT date, commodity, close, row_number() OVER (PARTITION BY commodity ORDER BY date) AS i FROM market) SELECT date, commodity, close, round(max(close * (1 - 0.01 / 100) - (i - 1) * 50.0) OVER (PARTITION BY commodity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + (i - 1) * 50.0, 4) AS bound FROM s").replace(") , ", "), ", 1)),
    "j14_pair": (lambda f: ledger.pair(f.market.where("commodity = '2-HIGH'"), f.market.where("commodity = '5-LOW'"), ["date"], "close"), sql("market", "SELECT date, a.close AS a, b.close AS b FROM market a JOIN market b USING (date) WHERE a.commodity = '2-HIGH' AND b.commodity = '5-LOW'")),
    "w21_w23_indicators": (lambda f: ladder_input(f), rsi_sql("SELECT * FROM z")),
    "g1_threshold_signal": (lambda f: sg.threshold_signal(ladder_input(f)).select("date", "commodity", "action", "share"), ladder_sql("over_threshold")),
    "g2_crossover_signal": (lambda f: sg.crossover_signal(ladder_input(f)).select("date", "commodity", "action", "share"), ladder_sql("cross_down")),
    "g4_ev_signal": (lambda f: sg.ev_signal(tiers(f), 0.2).select(*BY, "share"), tier_sql("SELECT start, model, CASE WHEN net_benefit_pct > 0.4 AND tier <> 'low' THEN 0.0 WHEN net_benefit_pct > 0.2 THEN CASE WHEN tier = 'low' THEN 0.15 ELSE 0.10 END WHEN net_benefit_pct > 0 THEN 0.20 ELSE CASE WHEN tier = 'high' THEN 0.40 ELSE 0.30 END END::DOUBLE AS share FROM t")),
    "g5_consensus_signal": (lambda f: sg.consensus_signal(tiers(f), min_gain=0.2).select(*BY, "share"), tier_sql("SELECT start, model, CASE WHEN consensus >= 0.7 AND net_benefit_pct > 0.2 THEN 0.0 WHEN consensus >= 0.6 AND net_benefit_pct > 0.2 THEN 0.10 WHEN consensus <= 1 - 0.7::DOUBLE THEN 0.40 WHEN consensus <= 1 - 0.6::DOUBLE THEN 0.30 ELSE 0.20 END::DOUBLE AS share FROM t")),
    "g6_risk_signal": (lambda f: sg.risk_signal(tiers(f), 0.3, 0.5, 0.2).select(*BY, "share"), tier_sql("SELECT start, model, CASE WHEN dispersion < 0.3 AND net_benefit_pct > 0.2 THEN 0.0 WHEN dispersion < 0.5 AND net_benefit_pct > 0.2 THEN 0.10 WHEN dispersion < 0.3 THEN 0.40 WHEN dispersion < 0.5 THEN 0.30 ELSE 0.25 END::DOUBLE AS share FROM t")),
    "g7_horizon_signal": (lambda f: sg.horizon_signal(f.points, BY, 1.0, 0.01, 0.001), sql("points", "SELECT start, model, round(nv, 2) AS now, round(lv, 2) AS later, nv >= lv AS sell_now FROM (SELECT start, model, max(n) FILTER (day = 1) AS nv, max(n) FILTER (day > 1) AS lv FROM (SELECT *, round(forecast * (1 - 0.01 / 100) * pow(1 - 0.001, day - 1) - 1.0 * (day - 1), 6) AS n FROM points) GROUP BY ALL)")),
    "g8_hold_or_sell": (lambda f: sg.hold_or_sell(f.points.groupBy(*BY).agg(F.round(F.max("forecast"), 4).alias("best_value"), F.round(F.max(F.when(F.col("day") == 1, F.col("forecast"))), 4).alias("now_value")), 5.0), sql("points", "SELECT start, model, best_value, now_value, round(best_value - now_value, 4) AS gain, CASE WHEN round(best_value - now_value, 4) >= 5 THEN 'HOLD' ELSE 'SELL' END AS recommendation FROM (SELECT start, model, round(max(forecast), 4) AS best_value, round(max(forecast) FILTER (day = 1), 4) AS now_value FROM points GROUP BY ALL)")),
    "g9_parameter_grid": (lambda f: sg.parameter_grid(tiers(f), [{"low": 0.2, "high": 0.4}, {"low": 0.3, "high": 0.6}], lambda d, low, high: sg.risk_signal(d, low, high, 0.2)).groupBy("variant").agg(F.round(F.avg("share"), 4).alias("mean_share"), F.count(F.lit(1)).alias("n")), tier_sql("SELECT variant, round(avg(share), 4) AS mean_share, count(*) AS n FROM (SELECT v AS variant, CASE WHEN dispersion < lo AND net_benefit_pct > 0.2 THEN 0.0 WHEN dispersion < hi AND net_benefit_pct > 0.2 THEN 0.10 WHEN dispersion < lo THEN 0.40 WHEN dispersion < hi THEN 0.30 ELSE 0.25 END AS share FROM t, (VALUES (0, 0.2, 0.4), (1, 0.3, 0.6)) p(v, lo, hi)) GROUP BY 1")),
    "g10_decision_diff": (decided, tier_sql("SELECT start, model, a AS optimal, b AS actual, round(b - a, 4) AS difference, abs(b - a) > 0.1 AS differs FROM (SELECT start, model, CASE WHEN consensus >= 0.7 AND net_benefit_pct > 0.2 THEN 0.0 WHEN consensus >= 0.6 AND net_benefit_pct > 0.2 THEN 0.10 WHEN consensus <= 1 - 0.7::DOUBLE THEN 0.40 WHEN consensus <= 1 - 0.6::DOUBLE THEN 0.30 ELSE 0.20 END::DOUBLE AS a, CASE WHEN dispersion < 0.3 AND net_benefit_pct > 0.2 THEN 0.0 WHEN dispersion < 0.5 AND net_benefit_pct > 0.2 THEN 0.10 WHEN dispersion < 0.3 THEN 0.40 WHEN dispersion < 0.5 THEN 0.30 ELSE 0.25 END::DOUBLE AS b FROM t)")),
    "g11_vote": (lambda f: sg.vote(sg.threshold_signal(ladder_input(f)).select("date", "commodity", "share").unionByName(sg.crossover_signal(ladder_input(f)).select("date", "commodity", "share")), ["date", "commodity"]), rsi_sql(f"SELECT date, commodity, count(*) FILTER (share > 0) AS n_sell, count(*) AS n, round(avg(share), 4) AS mean_share, CASE WHEN count(*) FILTER (share > 0) * 2 > count(*) THEN 'SELL' ELSE 'HOLD' END AS action, round(100 * count(*) FILTER (share > 0) / count(*), 2) AS sell_pct FROM (SELECT date, commodity, CASE WHEN over_threshold THEN {LADDER} ELSE 0.0 END::DOUBLE AS share FROM z UNION ALL SELECT date, commodity, CASE WHEN cross_down THEN {LADDER} ELSE 0.0 END::DOUBLE FROM z) GROUP BY ALL")),
}
