"""Queries on state carried over blocks, on tests of errors and on models fitted by training window, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg, carry, clean, news as nw, pooled, scores as sc, signals as sg, spine
from ..sources import tables
from .bindings import Frames, with_views as sql
from .forecasts import BY, DIFFER, errors, judged, normal_above
from .series import KEY, W, filled_market, on_filled

MONTHS = 12
AHEAD = 7


def unfilled_market(f: Frames):
    """Every day of every commodity, with holes where it was not traded."""
    grid = spine.grid(spine.date_spine(f.market), f.market.select("commodity").distinct())
    return spine.onto_spine(grid, f.market.select("date", "commodity", "open", "high", "low", "close"), ["date", "commodity"])


def whitney_sql(rows: str, by: str) -> str:
    """Mid-ranks by window functions over rows (by, v, f)."""
    ranks = f"SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2 AS k, count(*) OVER (PARTITION BY {by}, v) AS t FROM ({rows})"
    sums = f"SELECT {by}, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(k) FILTER (f) AS k1, sum(t * t - 1) AS ties, avg(v) FILTER (f) AS m1, avg(v) FILTER (NOT f) AS m2 FROM ({ranks}) GROUP BY 1"
    z = f"SELECT {by}, n1, n2, k1 - n1 * (n1 + 1) / 2 AS u, (k1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 0) AS z, m1 / nullif(m2, 0) AS m FROM ({sums})"
    return judged(normal_above("z"), f"SELECT {by}, n1, n2, round(u, 1) AS u_statistic, round(z, 4) AS z_score, round((m - 1) * 100, 4) AS shift_pct, z FROM ({z})").replace("EXCLUDE (p)", "EXCLUDE (p, z)")


ALERT = ", CASE WHEN is_significant AND shift_pct > 25 THEN 'critical' WHEN is_significant AND shift_pct > 10 THEN 'warning' ELSE 'ok' END AS level, CASE WHEN is_significant AND shift_pct > 10 THEN 'RETRAIN_NEEDED' ELSE 'OK' END AS status"


def recent_errors(f: Frames, as_of: str):
    """Absolute errors of the last 30 days, and of the 30 before."""
    age = F.datediff(F.lit(as_of).cast("date"), "date")
    return errors(f).where(age.between(0, 59)).select("commodity", F.round(F.abs("e1"), 1).alias("v"), (age < 30).alias("recent"))


def draw_sql(text: str) -> str:
    """The first 28 bits of an MD5."""
    return " + ".join(f"(strpos('0123456789abcdef', substr(md5({text}), {k + 1}, 1)) - 1) * {16 ** (6 - k)}" for k in range(7))


def bootstrap_sql() -> str:
    weight = " + ".join(f"(u >= {round(x * (1 << 28))})::INT" for x in sc.poisson_steps())
    draws = f"SELECT strategy, amount, r, {draw_sql('h')} AS u FROM (SELECT strategy, amount, r, '7|' || trade_id || '|' || r AS h FROM trades, range(1, 101) x(r))"
    totals = f"SELECT strategy, r, sum(amount * ({weight})) AS t FROM ({draws}) GROUP BY ALL"
    return sql("trades", f"SELECT strategy, round(quantile_cont(t, 0.025), 2) AS lower_95, round(quantile_cont(t, 0.975), 2) AS upper_95, round(avg(t), 2) AS mean_total FROM ({totals}) GROUP BY 1")


def samples(f: Frames):
    return pooled.samples(f.market, "close", KEY, AHEAD)


def walk_forward(f: Frames):
    return pooled.walk_forward(samples(f), KEY, MONTHS)


def windows(f: Frames):
    return pooled.fitted(pooled.grams(samples(f), MONTHS, "label_date")).select("window_start", "n_rows", "status", *(F.round(c, 6).alias(c) for c in pooled.WEIGHTS))


#: The same samples, Gram sums, prefix sums and elimination in SQL.
SAMPLES = f"samples AS (SELECT commodity, date, close / lag(close, 1) OVER ({W}) - 1 AS x1, close / lag(close, 7) OVER ({W}) - 1 AS x2, ln(close / avg(close) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS x3, lead(close, {AHEAD}) OVER ({W}) / close - 1 AS y, lead(date, {AHEAD}) OVER ({W}) AS label_date, row_number() OVER ({W}) AS i FROM market), usable AS (SELECT *, 1.0::DOUBLE AS x0 FROM samples WHERE i >= 30 AND y IS NOT NULL)"
PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]
PERIOD = f"(year(D_) * 12 + month(D_) - 1) // {MONTHS}"
GRAMS = (
    ", months AS (SELECT " + PERIOD.replace("D_", "label_date") + " AS w, count(*) AS n, " + ", ".join([*(f"sum(x{a} * x{b}) AS g{a}{b}" for a, b in PAIRS), *(f"sum(x{a} * y) AS b{a}" for a in range(4))]) + " FROM usable GROUP BY 1)"
    ", periods AS (SELECT unnest(range(min(p), max(p) + 1)) AS w FROM (SELECT DISTINCT " + PERIOD.replace("D_", "date") + " AS p FROM usable))"
    ", sums AS (SELECT periods.w, coalesce(sum(n), 0)::BIGINT AS n_rows, " + ", ".join(f"sum({c}) AS {c}" for c in [*(f"g{a}{b}" for a, b in PAIRS), *(f"b{a}" for a in range(4))]) + " FROM periods LEFT JOIN months ON months.w < periods.w GROUP BY 1)"
)


def determinant(rows: list[list[str]]) -> str:
    """A determinant's expansion along its first row, as SQL."""
    if len(rows) == 1:
        return rows[0][0]
    return "(" + " + ".join(f"{'-' if k % 2 else ''}{x} * {determinant([r[:k] + r[k + 1 :] for r in rows[1:]])}" for k, x in enumerate(rows[0])) + ")"


GRAM = [[f"g{min(a, b)}{max(a, b)}" for b in range(4)] for a in range(4)]
RIDGED = [[f"({x} + {pooled.RIDGE} * n_rows)" if a == b and a else x for b, x in enumerate(r)] for a, r in enumerate(GRAM)]
SOLVED = f", solved AS (SELECT w, n_rows, CASE WHEN n_rows = 0 THEN 'no data' WHEN n_rows < {pooled.LEAST} THEN 'too few rows' ELSE 'fitted' END AS status, " + ", ".join(f"CASE WHEN n_rows >= {pooled.LEAST} THEN " + determinant([[f"b{a}" if b == k else x for b, x in enumerate(r)] for a, r in enumerate(RIDGED)]) + " / " + determinant(RIDGED) + f" END AS w{k}" for k in range(4)) + " FROM sums)"
FIRST_DAY = f"make_date((w * {MONTHS} // 12)::INT, (w * {MONTHS} % 12 + 1)::INT, 1)"


def model_sql(body: str) -> str:
    return sql("market", f", {SAMPLES}{GRAMS}{SOLVED} {body}").replace(") , ", "), ", 1)


def day_tones(f: Frames):
    """Tone and number of events by day, on the calendar of the market: the last day of news is its last day."""
    last = f.market.agg(F.max("date").alias("m")).join(f.news.agg(F.max("date").alias("n"))).select(F.datediff("m", "n").alias("shift"))
    own = nw.parse_tone(f.news).groupBy("date").agg(F.round(F.avg("tone_avg"), 6).alias("tone"), F.count(F.lit(1)).alias("n_events"))
    return own.join(last).select(F.expr("date_add(date, shift)").alias("date"), "tone", "n_events")


def recommendations(f: Frames):
    """Recommendations as nested JSON lines, one a forecast, read back by their schema."""
    path = tables.scratch(f.spark, "recommendations")
    now, best = F.round(F.max(F.when(F.col("day") == 1, F.col("forecast"))), 4), F.round(F.max("forecast"), 4)
    own = sg.hold_or_sell(f.points.groupBy(*BY).agg(best.alias("best_value"), now.alias("now_value")), 5.0)
    nw.recommendation_json(own, BY, "recommendation", ["now_value", "best_value", "gain"]).write.text(path)
    schema = "forecast struct<start:string,model:string>, recommendation struct<action:string,values:struct<now_value:double,best_value:double,gain:double>>"
    return f.spark.read.schema(schema).json(path).select("forecast.*", "recommendation.action", "recommendation.values.*")


CASES = {
    "a24_covariates": (lambda f: agg.covariate_correlations(f.market, day_tones(f), KEY), sql("market news", ", d AS (SELECT date + CAST((SELECT date_diff('day', (SELECT max(date) FROM news), max(date)) FROM market) AS INT) AS date, round(avg(try_cast(split_part(tone, ',', 1) AS DOUBLE)), 6) AS tone, count(*) AS n_events FROM news GROUP BY 1), m AS (SELECT *, tone - lag(tone, 7) OVER (ORDER BY date) AS momentum FROM d) SELECT commodity, count(*) AS n, round(corr(close, tone), 4) AS corr_tone, round(corr(close, n_events), 4) AS corr_n_events, round(corr(close, momentum), 4) AS corr_momentum FROM market JOIN m USING (date) GROUP BY 1").replace(") , ", "), ", 1)),
    "f21_recommendation_json": (recommendations, sql("points", "SELECT CAST(start AS VARCHAR) AS start, model, CASE WHEN round(best_value - now_value, 4) >= 5 THEN 'HOLD' ELSE 'SELL' END AS action, now_value, best_value, round(best_value - now_value, 4) AS gain FROM (SELECT start, model, round(max(forecast), 4) AS best_value, round(max(forecast) FILTER (day = 1), 4) AS now_value FROM points GROUP BY ALL)")),
    "p1_trading_slice": (lambda f: clean.as_of_slice(filled_market(f), "2-HIGH", "1996-06-30", trading_only=True).drop("volume"), on_filled("SELECT * FROM filled WHERE commodity = '2-HIGH' AND date <= DATE '1996-06-30' AND is_trading_day = 1")),
    "u3_set_plus": (lambda f: clean.set_plus(f.vix.select("date"), f.weather.select("date")), sql("vix weather", "SELECT date FROM vix UNION SELECT date FROM weather")),
    "w1_filled_blocks": (lambda f: carry.filled(unfilled_market(f), ["open", "high", "low", "close"], KEY, ["date"]), on_filled("SELECT date, commodity, open, high, low, close FROM filled")),
    "j6_as_of_blocks": (lambda f: carry.as_of(f.trades.select(F.col("strategy").alias("commodity"), "date"), f.market.where(F.dayofmonth("date") == 1).select("commodity", F.col("date").alias("training_date")), "date", "training_date", KEY), sql("trades market", "SELECT t.strategy AS commodity, t.date, m.training_date FROM trades t ASOF LEFT JOIN (SELECT commodity, date AS training_date FROM market WHERE day(date) = 1) m ON m.commodity = t.strategy AND m.training_date <= t.date")),
    "j8_join_fill_blocks": (lambda f: carry.filled(f.trades.select("date", "trade_id", "strategy").join(f.vix, "date", "left"), ["vix"], ["strategy"], ["date", "trade_id"]), sql("trades vix", "SELECT date, trade_id, strategy, last_value(vix IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY date, trade_id ROWS UNBOUNDED PRECEDING) AS vix FROM trades LEFT JOIN vix USING (date)")),
    "e13_mann_whitney": (lambda f: sc.retrain_alert(sc.mann_whitney(recent_errors(f, "2001-07-31"), KEY, "recent", "v")), sql("market", f"SELECT *{ALERT} FROM (" + whitney_sql(f"SELECT commodity, floor(abs(e1) * 10 + 0.5) / 10 AS v, date_diff('day', date, DATE '2001-07-31') < 30 AS f FROM (SELECT {DIFFER} FROM market) WHERE date_diff('day', date, DATE '2001-07-31') BETWEEN 0 AND 59", "commodity") + ")")),
    "e13_mann_whitney_trades": (lambda f: sc.mann_whitney(f.trades.select("strategy", F.floor("amount").alias("v"), (F.col("reason") == "F").alias("filled")), ["strategy"], "filled", "v"), sql("trades", whitney_sql("SELECT strategy, floor(amount) AS v, reason = 'F' AS f FROM trades", "strategy"))),
    "e14_bootstrap": (lambda f: sc.bootstrap_totals(f.trades, ["strategy"], "amount", "trade_id", 100, 7), bootstrap_sql()),
    "m7_training_windows": (windows, model_sql(f"SELECT {FIRST_DAY} AS window_start, n_rows, status, " + ", ".join(f"round(w{k}, 6) AS {n}" for k, n in enumerate(pooled.WEIGHTS)) + " FROM solved")),
    "m7_walk_forward": (lambda f: walk_forward(f).withColumns({c: F.round(c, 4) for c in ("predicted_return", "actual_return")}), model_sql(f"SELECT commodity, date AS data_cutoff_date, {FIRST_DAY} AS window_start, status, round(w0 + w1 * x1 + w2 * x2 + w3 * x3, 4) AS predicted_return, round(y, 4) AS actual_return FROM (SELECT *, {PERIOD.replace('D_', 'date')} AS w FROM usable) JOIN solved USING (w)")),
    "m10_scored_cutoffs": (lambda f: pooled.score_windows(walk_forward(f), ["window_start", "status"]), model_sql(f"SELECT {FIRST_DAY} AS window_start, status, count(*) AS n, round(avg(abs(w0 + w1 * x1 + w2 * x2 + w3 * x3 - y)), 4) AS mae, round(sqrt(avg(pow(w0 + w1 * x1 + w2 * x2 + w3 * x3 - y, 2))), 4) AS rmse, round(avg((sign(w0 + w1 * x1 + w2 * x2 + w3 * x3) = sign(y))::INT) * 100, 4) AS directional_accuracy FROM (SELECT *, {PERIOD.replace('D_', 'date')} AS w FROM usable) JOIN solved USING (w) GROUP BY ALL")),
}
