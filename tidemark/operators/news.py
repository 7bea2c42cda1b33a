"""News records: relevance, parsing, theme explosion, group aggregation and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

TONES = ["tone_avg", "tone_positive", "tone_negative"]


def relevant(df: DataFrame, themes: list[str], keywords: list[str], theme_col: str = "themes", name_col: str = "all_names") -> DataFrame:
    """Rows with a theme that begins with one of `themes` (at the start or behind a `;`) or a keyword in the names."""
    return df.where(F.coalesce(F.col(theme_col).rlike(f"(^|;)({'|'.join(themes)})") | F.lower(name_col).rlike("|".join(keywords)), F.lit(False)))


def commodity_flags(df: DataFrame, column: str, rules: dict[str, tuple[str, str | None]]) -> DataFrame:
    """A flag per commodity: its pattern is found, its exclusion is not; null text gives false."""
    text = F.lower(column)
    return df.withColumns({f"is_{name}": F.coalesce(text.rlike(has) & (~text.rlike(no) if no else F.lit(True)), F.lit(False)) for name, (has, no) in rules.items()})


def parse_tone(df: DataFrame, column: str = "tone", names: list[str] = TONES) -> DataFrame:
    """Numbers of a comma-separated field; missing or invalid ones are null."""
    parts = F.split(column, ",")
    return df.withColumns({n: F.get(parts, F.lit(k)).try_cast("double") for k, n in enumerate(names)})


def parse_day(df: DataFrame, column: str, into: str = "article_date") -> DataFrame:
    """The date of the first eight characters; rows without a valid one are dropped."""
    return df.withColumn(into, F.to_date(F.try_to_timestamp(F.substring(column, 1, 8), F.lit("yyyyMMdd")))).where(F.col(into).isNotNull())


def explode_themes(df: DataFrame, column: str = "themes") -> DataFrame:
    return df.withColumn("theme", F.explode(F.filter(F.split(column, ";"), lambda t: t != "")))


def theme_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    """The group of each theme from a lookup table (theme, theme_group); unknown themes are OTHER."""
    return df.join(groups, "theme", "left").withColumn("theme_group", F.coalesce("theme_group", F.lit("OTHER")))


def tone_means(columns: list[str] = TONES) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_articles"), *(F.round(F.avg(c), 8).alias(c) for c in columns)]


def theme_agg(df: DataFrame, by: list[str], tracked: list[str]) -> DataFrame:
    return df.where(F.col("theme").isin(tracked)).groupBy(*by, "theme").agg(*tone_means())


def group_agg(df: DataFrame, by: list[str], total: str = "ALL") -> DataFrame:
    """Counts and mean tones by theme group, with the total over groups as a group of its own, in one pass."""
    rolled = df.groupingSets([[F.col(c) for c in [*by, "theme_group"]], [F.col(c) for c in by]], *by, "theme_group")
    out = rolled.agg(F.grouping("theme_group").alias("__t"), *tone_means())
    return out.withColumn("theme_group", F.when(F.col("__t") == 1, total).otherwise(F.col("theme_group"))).drop("__t")


def merge_partials(parts: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Means from partial sums: rows hold n and sum_<column> of a chunk."""
    return parts.groupBy(*key).agg(F.sum("n").alias("n"), *(F.round(F.sum(f"sum_{c}") / F.sum("n"), 8).alias(c) for c in columns))


def pivot_metrics(df: DataFrame, by: list[str], column: str, values: list[str], metrics: list[str], prefix: str) -> DataFrame:
    """One column per value and metric with a fixed schema; absent counts are 0, absent tones null."""
    out = [F.max(F.when(F.col(column) == v, F.col(m))).alias(f"{prefix}{v.lower()}_{m}") for v in values for m in metrics]
    counts = [f"{prefix}{v.lower()}_{m}" for v in values for m in metrics if m.startswith("n_")]
    return df.groupBy(*by).agg(*out).fillna(0, counts)


def event_counts(df: DataFrame, by: list[str], pattern: str, columns: list[str]) -> DataFrame:
    match = F.lit(False)
    for c in columns:
        match = match | F.coalesce(F.lower(c).rlike(pattern), F.lit(False))
    return df.where(match).groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg("tone_avg"), 8).alias("tone"), F.count_if(F.col("tone_avg") > 200).alias("n_positive"), F.count_if(F.col("tone_avg") <= 200).alias("n_negative"))


def file_day(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("file_day", F.to_date(F.regexp_extract(column, r"(\d{8})", 1), "yyyyMMdd")).withColumn("base_name", F.regexp_replace(F.element_at(F.split(column, "/"), -1), r"\.gz$", ""))


def json_fields(df: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    return df.withColumn("__j", F.from_json(column, schema)).select(*df.columns, "__j.*")


def recommendation_json(df: DataFrame, key: list[str], action: str, values: list[str]) -> DataFrame:
    """Recommendations as JSON text (column value), one line each: the forecast's key, the action and its values. Nulls are left out."""
    forecast = F.struct(*(F.col(k).cast("string").alias(k) for k in key)).alias("forecast")
    return df.select(F.to_json(F.struct(forecast, F.struct(F.col(action).alias("action"), F.struct(*values).alias("values")).alias("recommendation"))).alias("value"))
