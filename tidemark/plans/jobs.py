"""Queries on files, control tables, streams and learned models, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as agg, baseline, clean, learners, news as nw, paths as pt, spine
from ..sources import files, tables
from ..streaming import jobs as st
from .bindings import Frames, with_views as sql


def shared(f: Frames, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return tables.scratch(f.spark, name)


def csv_round_trip(f: Frames) -> DataFrame:
    """Orders written as daily and history CSV folders and scanned with a schema."""
    own = f.table("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    daily, history = shared(f, "csv"), shared(f, "csv")
    own.where("o_orderkey % 2 = 0").write.option("header", True).csv(daily)
    own.where("o_orderkey % 2 = 1").write.option("header", True).csv(history)
    return files.scan_csv(f.spark, [daily, history], own.schema)


def jsonl_round_trip(f: Frames) -> DataFrame:
    path = shared(f, "jsonl")
    f.news.select(F.col("day_text").alias("date"), "event_id", "themes").write.json(path)
    return files.scan_jsonl(f.spark, [path], "date string, event_id long, themes string").select("event_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "themes")


def delimited_round_trip(f: Frames) -> DataFrame:
    path = shared(f, "tsv")
    short = F.when(F.col("event_id") % 10 == 0, F.col("themes")).otherwise(F.concat_ws("\t", F.col("event_id").cast("string"), "themes", "all_names"))
    f.news.select(short.alias("value")).write.text(path)
    return files.scan_delimited(f.spark, [path], ["event_id", "themes", "all_names"], min_fields=3)


def partition_overwrite(f: Frames) -> DataFrame:
    """A partitioned table of which only the touched partitions are replaced."""
    path = shared(f, "parts")
    own = f.trades.select("strategy", "trade_id", "amount")
    files.write_partitions(own, path, ["strategy"])
    files.write_partitions(own.where("strategy = '2-HIGH'").withColumn("amount", F.col("amount") * 2), path, ["strategy"])
    return files.scan_parquet(f.spark, path, ["strategy", "trade_id", "amount"]).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


def append_sink(f: Frames) -> DataFrame:
    path = shared(f, "append")
    schema = f.table("orders").select("o_orderkey", F.col("o_totalprice").cast("float").alias("price")).schema
    own = f.table("orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    files.append_typed(own.where("o_orderkey % 2 = 0"), path, schema)
    files.append_typed(own.where("o_orderkey % 2 = 1"), path, schema)
    return f.spark.read.schema(schema).parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


def file_names(f: Frames) -> DataFrame:
    return f.news.select(F.concat(F.substring("day_text", 1, 10), F.lit(".csv.gz")).alias("file")).distinct()


def control(f: Frames) -> DataFrame:
    code = F.pmod(F.substring("file", 7, 4).cast("int"), F.lit(5))
    return file_names(f).withColumn("status", F.when(code == 0, "success").when(code == 1, "404").when(code == 2, "in_progress").when(code == 3, "error"))


NAMES = "names AS (SELECT DISTINCT substr(day_text, 1, 10) || '.csv.gz' AS file FROM news), control AS (SELECT file, CASE CAST(substr(file, 7, 4) AS INT) % 5 WHEN 0 THEN 'success' WHEN 1 THEN '404' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'error' END AS status FROM names)"


def on_names(body: str) -> str:
    return sql("news", f", {NAMES} {body}").replace(") , ", "), ", 1)


def day_counts(f: Frames) -> DataFrame:
    return f.news.groupBy(F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("files"), F.lit(334).cast("bigint").alias("expected"))


def backlog(f: Frames) -> DataFrame:
    days = day_counts(f)
    by = lambda n, r: days.where(F.dayofmonth("day") % n == r).select("day")
    return files.backlog(days, by(2, 0), by(6, 0), by(7, 0))


def streamed(f: Frames, job, mode: str = "append") -> DataFrame:
    """The result of a streaming job over the events folder, run until nothing is left, read back as a table."""
    source, out, mark = shared(f, "stream-in"), shared(f, "stream-out"), shared(f, "stream-mark")
    events = f.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(4, "event_id").write.parquet(source)
    sdf = job(st.ingest_stream(f.spark, source, events.schema))
    st.run_to_table(sdf, out, mark, mode).awaitTermination()
    return f.spark.read.schema(sdf.schema).parquet(out)


def stream_dedup(f: Frames) -> DataFrame:
    """Each event delivered twice and kept once."""
    twice = lambda s: st.dedup_stream(s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy"), ["event_id"], "ts", "60 days")
    return streamed(f, twice).select("event_id", "user_id", "event_type")


def weekly_feed(f: Frames, source: str, late: int | None, weeks: list[int] | None = None) -> int:
    """Events as one file a week, in order of time; every `late`-th event arrives three files after its own. Gives the number of weeks."""
    events = f.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    week = F.floor(F.unix_date(F.to_date("ts")) / 7)
    first, last = events.agg(F.min(week), F.max(week)).first()
    held = (F.col("event_id") % late == 0) if late else F.lit(False)
    at = F.least(week - first + F.when(held, 3).otherwise(0), F.lit(last - first))
    for w in range(last - first + 1) if weeks is None else weeks:
        events.where(at == w).coalesce(1).write.parquet(f"{source}/week-{w:05d}")
    return last - first + 1


def stream_tone(f: Frames) -> DataFrame:
    """Tone by type over seven days, day by day, of a feed in weekly micro-batches: the watermark moves between them and drops late rows."""
    source, out, mark = shared(f, "stream-in"), shared(f, "stream-out"), shared(f, "stream-mark")
    weekly_feed(f, source, 50)
    sdf = st.tone_windows(st.ingest_stream(f.spark, f"{source}/*", f.spark.read.parquet(f"{source}/*").schema, files=1), "ts", ["event_type"], "7 days", "1 day", "1 day")
    query = st.run_to_table(sdf, out, mark)
    query.awaitTermination()
    return f.spark.read.schema(sdf.schema).parquet(out).withColumn("n_dropped", F.lit(st.dropped(query)).cast("long"))


#: The same feed replayed: a batch's late rows are judged by the watermark of the batch before, which follows from the batches before that.
FEED = "feed AS (SELECT *, least(w - min(w) OVER () + CASE WHEN event_id % 50 = 0 THEN 3 ELSE 0 END, max(w) OVER () - min(w) OVER ()) AS b FROM (SELECT *, (CAST(ts AS DATE) - DATE '1970-01-01') // 7 AS w FROM events)), marks AS (SELECT x.b, max(ts) - INTERVAL 1 DAY AS mark FROM (SELECT unnest(range(0, max(b) + 1)) AS b FROM feed) x LEFT JOIN feed ON feed.b < x.b - 1 GROUP BY 1), spread AS (SELECT event_type, value, feed.b, CAST(ts AS DATE) - CAST(o AS INT) AS window_start, coalesce(CAST(ts AS DATE) - CAST(o AS INT) + INTERVAL 7 DAY <= mark, false) AS late FROM feed JOIN marks USING (b), range(0, 7) r(o))"
TONE = f"WITH {FEED} SELECT window_start, event_type, count(*) AS n, round(avg(value), 8) AS tone, (SELECT count(DISTINCT (b, window_start, event_type)) FROM spread WHERE late) AS n_dropped FROM spread WHERE NOT late AND window_start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL"


def stream_bursts(f: Frames, stops: tuple[int, ...] = (1,)) -> DataFrame:
    """Runs of a user's events with pauses below an hour, closed by the watermark; the stream is stopped after the weeks of `stops` and goes on from its checkpoint."""
    source, out, mark = shared(f, "stream-in"), shared(f, "stream-out"), shared(f, "stream-mark")
    weeks = weekly_feed(f, source, None, [])
    for w in range(weeks):
        weekly_feed(f, source, None, [w])
        if w in stops or w == weeks - 1:
            sdf = st.burst_sessions(st.ingest_stream(f.spark, f"{source}/*", f.spark.read.parquet(f"{source}/*").schema, files=1), "ts", ["user_id"], "1 hour", "1 day")
            st.run_to_table(sdf, out, mark).awaitTermination()
    return f.spark.read.schema(sdf.schema).parquet(out)


#: Runs by gaps and islands.
BURSTS = "WITH runs AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS begins FROM events)) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n FROM runs GROUP BY user_id, run HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"


def with_text_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("session_start", "session_end")})


def stream_upsert(f: Frames) -> DataFrame:
    """Latest event per user and type, merged batch by batch into a partitioned table."""
    source, out, mark = shared(f, "stream-in"), shared(f, "stream-out"), shared(f, "stream-mark")
    events = f.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(4, "event_id").write.parquet(source)
    sdf = st.ingest_stream(f.spark, source, events.schema).withColumn("order", F.struct("ts", "event_id"))
    st.upsert_stream(sdf, out, mark, ["user_id", "event_type"], "order", "event_type").awaitTermination()
    return f.spark.read.schema(sdf.schema).parquet(out).select("user_id", "event_type", "event_id", "value")


def pooled(f: Frames) -> DataFrame:
    own, names = learners.pooled_features(f.market, "close", "commodity")
    return learners.fit_pooled(own, names, "commodity", "1999-12-31")


def importances(f: Frames) -> DataFrame:
    start = f.actuals.where("day = 1").select("start", F.col("actual").alias("price"))
    end = f.actuals.where("day = 14").select("start", F.col("actual").alias("later"))
    own = pt.path_features(f.path_rows.join(start, "start"), ["start", "model"]).join(start, "start").join(end, "start").withColumn("label", F.col("later") / F.col("price") - 1)
    return learners.importance(f.spark, own, ["consensus", "expected_return", "relative_spread", "skewness", "relative_range", "downside"], "label")


def expanded(f: Frames) -> DataFrame:
    points = baseline.drift(f.market, 14, ["commodity"]).withColumn("daily_std", F.col("forecast_std") / F.sqrt("day_ahead"))
    return baseline.expand_paths(points, 200, ["commodity"], 11)


CASES = {
    "s1_csv_scan": (csv_round_trip, "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"),
    "s2_jsonl_scan": (jsonl_round_trip, "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at, upper(event_type) || ';ECON_' || (CAST(props ->> '$.k' AS BIGINT) % 7) || ';TAX_' || upper(event_type) AS themes FROM events"),
    "s3_rename": (lambda f: files.rename(f.table("supplier"), {c: f"supplier_{c[2:]}" for c in f.table("supplier").columns}).select("supplier_suppkey", "supplier_nationkey"), "SELECT s_suppkey AS supplier_suppkey, s_nationkey AS supplier_nationkey FROM supplier"),
    "s4_delimited_scan": (delimited_round_trip, sql("news", "SELECT CAST(event_id AS VARCHAR) AS event_id, themes, all_names FROM news WHERE event_id % 10 <> 0")),
    "s5_parquet_scan": (lambda f: files.scan_parquet(f.spark, f"{f.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_quantity") > 45), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45"),
    "s7_partition_overwrite": (partition_overwrite, sql("trades", "SELECT strategy, count(*) AS n, round(sum(CASE WHEN strategy = '2-HIGH' THEN amount * 2 ELSE amount END), 2) AS amount FROM trades GROUP BY 1")),
    "s8_append_typed": (append_sink, "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders"),
    "s10_discover": (lambda f: files.discover(file_names(f), control(f).where("status = 'success'"), "2024-01-05", "2024-01-25"), on_names("SELECT file, CAST(strptime(substr(file, 1, 8), '%Y%m%d') AS DATE) AS day FROM names WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND file NOT IN (SELECT file FROM control WHERE status = 'success')")),
    "s11_gate": (lambda f: files.gate(file_names(f), control(f)), on_names("SELECT file, status, CASE status WHEN 'success' THEN 'already processed' WHEN '404' THEN 'not found before' WHEN 'in_progress' THEN 'in progress' END AS skip_reason, skip_reason IS NULL AS process FROM control")),
    "s12_backlog": (backlog, sql("news", "SELECT day, CASE WHEN n >= 334 THEN 'complete' ELSE 'partial' END AS completeness FROM (SELECT date AS day, count(*) AS n FROM news GROUP BY 1) WHERE (day(day) % 2 <> 0 OR day(day) % 6 = 0) AND day(day) % 7 <> 0")),
    "s13_upsert_columns": (lambda f: files.upsert_columns(f.market.select("date", "commodity", "close"), f.market.where("volume > 1").select("date", "commodity", F.col("open").alias("close")), ["date", "commodity"], ["close"]), sql("market", "SELECT date, commodity, CASE WHEN volume > 1 THEN open ELSE close END AS close FROM market")),
    "f5_file_day": (lambda f: nw.file_day(file_names(f), "file"), on_names("SELECT file, CAST(strptime(substr(file, 1, 8), '%Y%m%d') AS DATE) AS file_day, replace(file, '.gz', '') AS base_name FROM names")),
    "f14_cadence": (lambda f: f.market.select("commodity").distinct().join(baseline.cadence(f.spark, "1995-01-31", "2001-08-01", "monthly")).where(F.col("training_date") >= F.lit("1995-01-01")), sql("market", "SELECT commodity, CAST(DATE '1995-01-31' + to_months(CAST(k AS INT)) AS DATE) AS training_date FROM (SELECT DISTINCT commodity FROM market), range(0, 79) r(k)")),
    "u5_keep_last": (lambda f: clean.first_by(f.trades, ["strategy", "date"], [F.desc("trade_id")]), sql("trades", "SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY strategy, date ORDER BY trade_id DESC) = 1")),
    "j10_forecast_accuracy": (lambda f: agg.day_ahead_accuracy(f.weather, "region", "temp_c"), sql("weather", ", d AS (SELECT date, region, round(avg(temp_c), 6) AS t FROM weather GROUP BY ALL) SELECT a.region, count(*) AS n, round(avg(abs(a.t - b.t)), 4) AS mae FROM d a JOIN d b ON a.region = b.region AND b.date = a.date + 1 GROUP BY 1").replace(") , ", "), ", 1)),
    "e7_pending_windows": (lambda f: spine.missing(f.paths.groupBy("start", "model").agg(F.count_distinct("path_id").alias("n_paths")), f.points.where("day = 14 AND model <> 'N'").select("start", "model"), ["start", "model"]), sql("paths points", "SELECT start, model, count(DISTINCT path_id) AS n_paths FROM paths WHERE (start, model) NOT IN (SELECT (start, model) FROM points WHERE day = 14 AND model <> 'N') GROUP BY ALL")),
    "e6_score_table": (lambda f: pt.score_table(f.points, ["start", "model"], [1, 7, 14], ("mae", "rmse")), sql("points", "SELECT start, model, " + ", ".join(f"round(avg(abs(forecast - actual)) FILTER (day <= {h}), 4) AS mae_{h}d, round(sqrt(avg(pow(forecast - actual, 2)) FILTER (day <= {h})), 4) AS rmse_{h}d" for h in (1, 7, 14)) + " FROM points GROUP BY ALL")),
    "p5_leakage_flag": (lambda f: clean.leakage_flag(f.trades.select("trade_id", "date", F.expr("date_add(date, int(trade_id % 3) - 1)").alias("cutoff")), "date", "cutoff"), sql("trades", "SELECT trade_id, date, cutoff, date <= cutoff AS has_data_leakage FROM (SELECT trade_id, date, date + CAST(trade_id % 3 - 1 AS INT) AS cutoff FROM trades)")),
    "m7_pooled_trees": (pooled, None),
    "m8_importance": (importances, None),
    "m9_expand_paths": (expanded, None),
    "st2_stream_dedup": (stream_dedup, "SELECT event_id, user_id, event_type FROM events"),
    "st3_stream_tone": (stream_tone, TONE),
    "st4_stream_upsert": (stream_upsert, "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "st5_stream_bursts": (lambda f: with_text_times(stream_bursts(f)), BURSTS),
}
