"""Structured Streaming jobs: incremental ingest, dedup, tone windows, upserts, bursts (ST1-ST5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.clean import latest_wins
from ..sources.files import write_partitions
from ..sources.tables import saved


def ingest_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """New files of a folder, each exactly once per checkpoint; at most `files` of them in a micro-batch, the oldest first."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def dedup_stream(sdf: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """The first of re-delivered records that arrive within the delay."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def tone_windows(sdf: DataFrame, ts: str, by: list[str], size: str, slide: str, delay: str, value: str = "value") -> DataFrame:
    """Counts and mean tone in sliding windows; rows later than the watermark are dropped."""
    own = sdf.withWatermark(ts, delay).groupBy(F.window(ts, size, slide).alias("w"), *by)
    return own.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 8).alias("tone")).select(F.to_date("w.start").alias("window_start"), *by, "n", "tone")


def burst_sessions(sdf: DataFrame, ts: str, key: list[str], gap: str, delay: str) -> DataFrame:
    """Runs of records of a key with pauses shorter than the gap."""
    own = sdf.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *key)
    return own.agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path's file system has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upsert_stream(sdf: DataFrame, path: str, checkpoint: str, key: list[str], ts: str, partition: str) -> StreamingQuery:
    """Latest record per key into a partitioned table: each batch rewrites only the partitions that it touches."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = latest_wins(batch, key, ts)
        touched = batch.select(partition).distinct()
        held = spark.read.schema(batch.schema).parquet(path).join(touched, partition, "left_semi") if exists(spark, path) else batch.limit(0)
        write_partitions(saved(latest_wins(held.unionByName(batch), key, ts), "upsert"), path, [partition])

    return sdf.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """State rows that the watermark turned away in the batches that a query reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_to_table(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, to parquet."""
    return sdf.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
