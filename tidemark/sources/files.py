"""Scans, sinks and the control tables of file processing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def scan_csv(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """CSV files with a header, typed by the schema; several paths (daily and history) are stacked."""
    return spark.read.schema(schema).option("header", True).csv(paths)


def scan_jsonl(spark: SparkSession, paths: list[str], schema: StructType, ts_format: str = "yyyyMMddHHmmss", column: str = "date") -> DataFrame:
    """JSON lines; `column` is read as text and parsed, invalid values become null."""
    raw = spark.read.schema(schema).json(paths)
    return raw.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(ts_format)))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select([F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def split_fields(lines: DataFrame, names: list[str], sep: str = "\t", min_fields: int = 27) -> DataFrame:
    """Named fields of delimited lines (column value); lines with fewer than min_fields are dropped."""
    fields = F.split("value", sep.replace("|", "\\|"), -1)
    return lines.where(F.size(fields) >= min_fields).select([fields[k].alias(n) for k, n in enumerate(names)])


def scan_delimited(spark: SparkSession, paths: list[str], names: list[str], sep: str = "\t", min_fields: int = 27) -> DataFrame:
    return split_fields(spark.read.text(paths), names, sep, min_fields)


def scan_parquet(spark: SparkSession, path: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Pruned and filtered scan; both reach the reader."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(columns)


def load_new_files(spark: SparkSession, folder: str, control: DataFrame, schema: StructType) -> DataFrame:
    """Rows of the folder's files that the control table (column path) does not list, with their file's path.

    A row's file comes from the scan's hidden metadata, so no list of files passes through the driver: rows meet the control
    table in an anti-join. Files that are listed are scanned too; a stream with a checkpoint (`streaming.jobs.ingest_stream`) spares that.
    """
    rows = spark.read.schema(schema).parquet(folder).withColumn("path", F.col("_metadata.file_path"))
    return rows.join(control.select("path"), "path", "left_anti")


def new_paths(loaded: DataFrame) -> DataFrame:
    """What to add to the control table once the rows are stored."""
    return loaded.select("path").distinct()


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_typed(df: DataFrame, path: str, schema: StructType) -> None:
    df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def discover(master: DataFrame, processed: DataFrame, start: str, end: str) -> DataFrame:
    """Files of the master list (column file, beginning with yyyyMMdd) of a date range that are not processed yet."""
    day = F.to_date(F.regexp_extract("file", r"(\d{8})", 1), "yyyyMMdd")
    return master.withColumn("day", day).where(F.col("day").between(start, end)).join(processed.select("file"), "file", "left_anti")


def gate(files: DataFrame, control: DataFrame) -> DataFrame:
    """Whether to process each file, and else why not, by its status in the control table."""
    reason = F.when(F.col("status") == "success", "already processed").when(F.col("status") == "404", "not found before").when(F.col("status") == "in_progress", "in progress")
    return files.join(control.select("file", "status"), "file", "left").withColumn("skip_reason", reason).withColumn("process", F.col("skip_reason").isNull())


def backlog(bronze: DataFrame, silver: DataFrame, reprocess: DataFrame, queued: DataFrame) -> DataFrame:
    """Days in bronze but not in silver, and days to process again, without queued ones; labelled by completeness."""
    days = bronze.select("day").distinct().join(silver.select("day"), "day", "left_anti").unionByName(reprocess.select("day")).distinct()
    counts = bronze.groupBy("day").agg(F.sum("files").alias("files"), F.sum("expected").alias("expected"))
    label = F.when(F.col("files").isNull() | F.col("expected").isNull(), "unknown").when(F.col("files") >= F.col("expected"), "complete").otherwise("partial")
    return days.join(queued.select("day"), "day", "left_anti").join(counts, "day", "left").select("day", label.alias("completeness"))


def upsert_columns(base: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """base with the columns replaced where updates has a value for the key."""
    new = updates.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    held = [c for c in base.columns if c not in columns]
    return base.join(new, key, "left").select(*held, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def stack_rows(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
