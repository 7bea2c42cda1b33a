"""Canonical frames (market, volatility, weather, news, paths, trades) derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.carry import ranked
from ..sources.tables import saved

VIEWS = {
    "market": "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS commodity, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY ALL",
    "vix": "SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_discount) * 100, 6) AS vix FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5 GROUP BY ALL",
    "weather": "SELECT CAST(l_shipdate AS DATE) AS date, n_name AS region, CASE l_returnflag WHEN 'A' THEN '1-URGENT' WHEN 'N' THEN '2-HIGH' ELSE '3-MEDIUM' END AS commodity, round(avg(l_quantity), 6) AS temp_c, round(avg(l_tax) * 100, 6) AS humidity_pct, round(avg(l_discount) * 10, 6) AS precipitation_mm FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
    "macro_long": "SELECT CAST(l_shipdate AS DATE) AS date, 'fx_' || s_nationkey AS series, round(avg(l_discount), 6) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "news": "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS day_text, CAST(ts AS DATE) AS date, upper(event_type) || ';ECON_' || (CAST(props ->> '$.k' AS BIGINT) % 7) || ';TAX_' || upper(event_type) AS themes, value || ',' || CAST(props ->> '$.k' AS BIGINT) || ',' || abs(CAST(props ->> '$.k' AS BIGINT) - 50) AS tone, event_type AS all_names, CAST(props ->> '$.k' AS BIGINT) AS k, value, user_id FROM events",
    "paths": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS start, l_returnflag AS model, CAST(row_number() OVER (PARTITION BY date_trunc('month', l_shipdate), l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS path_id, " + ", ".join(f"(l_extendedprice / l_quantity) * (1 + 0.01 * {h} * (l_discount - 0.05)) AS day_{h}" for h in range(1, 15)) + " FROM lineitem",
    "long_paths": "SELECT start, model, path_id, CAST(substr(day_name, 5) AS INT) AS day, value FROM (UNPIVOT paths ON COLUMNS('day_.*') INTO NAME day_name VALUE value)",
    "unit_price": "SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice / l_quantity), 6) AS price FROM lineitem GROUP BY ALL",
    "actuals": "SELECT DISTINCT start, day, price AS actual FROM (SELECT DISTINCT start FROM paths), range(1, 15) r(day), unit_price WHERE unit_price.date = start + CAST(day - 1 AS INT)",
    "points": "SELECT start, model, day, quantile_cont(value, 0.5) AS forecast, any_value(actual) AS actual FROM long_paths JOIN actuals USING (start, day) GROUP BY ALL",
    "trades": "SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS trade_id, o_orderpriority AS strategy, o_totalprice / 1000 AS amount, o_totalprice AS price, o_orderstatus AS reason FROM orders",
}
ORDER = list(VIEWS)
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: What the days of a line's path follow from.
PRICED = ["l_extendedprice", "l_quantity", "l_discount"]


def path_days(of: Callable[[str], Column]) -> list[Column]:
    """The days of the path of a line, whose columns `of` gives."""
    base = of("l_extendedprice") / of("l_quantity")
    return [(base * (1 + 0.01 * h * (of("l_discount") - 0.05))).alias(f"day_{h}") for h in range(1, 15)]


def with_views(names: str, body: str) -> str:
    """SQL with the named views (and the ones before them that they need) as common table expressions."""
    wanted, queue = set(), names.split()
    while queue:
        n = queue.pop()
        if n in VIEWS and n not in wanted:
            wanted.add(n)
            queue += [v for v in VIEWS if v != n and f" {v}" in VIEWS[n].replace("(", " ").replace(",", " ")]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in ORDER if n in wanted) + " " + body


class Frames:
    """The frames over one data directory; each is planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def market(self) -> DataFrame:
        o = self.table("orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("commodity"), "o_orderkey", "o_totalprice")
        return o.groupBy("date", "commodity").agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume"))

    @cached_property
    def vix(self) -> DataFrame:
        return self.table("lineitem").where(F.dayofweek("l_shipdate").between(2, 6)).groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg("l_discount") * 100, 6).alias("vix"))

    @cached_property
    def shipped(self) -> DataFrame:
        return self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))

    @cached_property
    def weather(self) -> DataFrame:
        commodity = F.when(F.col("l_returnflag") == "A", "1-URGENT").when(F.col("l_returnflag") == "N", "2-HIGH").otherwise("3-MEDIUM")
        own = self.shipped.join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return own.groupBy(F.to_date("l_shipdate").alias("date"), F.col("n_name").alias("region"), commodity.alias("commodity")).agg(F.round(F.avg("l_quantity"), 6).alias("temp_c"), F.round(F.avg("l_tax") * 100, 6).alias("humidity_pct"), F.round(F.avg("l_discount") * 10, 6).alias("precipitation_mm"))

    @cached_property
    def macro_long(self) -> DataFrame:
        return self.shipped.groupBy(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("fx_"), F.col("s_nationkey").cast("string")).alias("series")).agg(F.round(F.avg("l_discount"), 6).alias("value"))

    @cached_property
    def news(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        e = self.table("events")
        return e.select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("day_text"), F.to_date("ts").alias("date"), F.concat(F.upper("event_type"), F.lit(";ECON_"), (k % 7).cast("string"), F.lit(";TAX_"), F.upper("event_type")).alias("themes"), F.concat_ws(",", F.col("value").cast("string"), k.cast("string"), F.abs(k - 50).cast("string")).alias("tone"), F.col("event_type").alias("all_names"), k.alias("k"), "value", "user_id")

    @cached_property
    def path_lines(self) -> DataFrame:
        """The lines that forecast paths stem from."""
        own = self.table("lineitem").withColumn("start", F.to_date(F.date_trunc("month", "l_shipdate"))).withColumn("model", F.col("l_returnflag"))
        return own.select("start", "model", *LINE, *PRICED)

    @cached_property
    def path_rows(self) -> DataFrame:
        """Forecast paths by the line that each stems from, without numbers."""
        return self.path_lines.select("start", "model", *LINE, *path_days(F.col))

    @cached_property
    def numbered_lines(self) -> DataFrame:
        """The lines, numbered within start and model. Their few columns are what is sorted, those that days follow from what is written."""
        own = ranked(self.path_lines, ["start", "model"], LINE, "path_id", keep=PRICED)
        return own.select("start", "model", F.col("path_id").cast("int").alias("path_id"), *PRICED)

    @cached_property
    def paths(self) -> DataFrame:
        """Forecast paths with numbers; for queries that read the number."""
        return self.numbered_lines.select("start", "model", "path_id", *path_days(F.col))

    @cached_property
    def long_rows(self) -> DataFrame:
        from ..operators.paths import unpivot_days

        return unpivot_days(self.path_rows, ["start", "model", *LINE])

    @cached_property
    def unit_price(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("price"))

    @cached_property
    def actuals(self) -> DataFrame:
        """A row for each start and day, written once: joins with paths go by its size."""
        starts = self.table("lineitem").select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("start")).distinct()
        days = starts.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(14)))).withColumn("date", F.expr("date_add(start, day - 1)"))
        return saved(days.join(self.unit_price, "date").select("start", "day", F.col("price").alias("actual")), "actuals")

    @cached_property
    def medians(self) -> DataFrame:
        """The median path of each start and model, computed once."""
        from ..operators.paths import medians

        return saved(medians(self.path_rows, ["start", "model"]), "medians")

    @cached_property
    def points(self) -> DataFrame:
        from ..operators.paths import with_actuals

        return with_actuals(self.medians, self.actuals)

    @cached_property
    def trades(self) -> DataFrame:
        return self.table("orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("trade_id"), F.col("o_orderpriority").alias("strategy"), (F.col("o_totalprice") / 1000).alias("amount"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("reason"))
