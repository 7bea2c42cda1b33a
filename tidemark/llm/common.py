"""What the training-data operators share: scratch tables, Arrow mapping, word rules, global ranks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch

#: Rows and bytes handed to Python at once; a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Returns freed memory to the system. Driver and Python workers live on, and what they have freed would count beside what they do next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def drop_finished(spark: SparkSession) -> None:
    """Has the driver collect its garbage: plans, compiled code, broadcasts and shuffles of tables that are written are let go.

    For operators of many short rounds, whose finished plans would else stay until the heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches, so that memory follows the batch and not the partition, and is given back at a task's end."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def split_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() parts at exactly these six bytes."""
    return text.split()


def doc_crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def global_rank(df: DataFrame, order: list[str], name: str, value: Column | None = None, into: str = "rank") -> DataFrame:
    """Adds `into`: rows before this one by `order` (or the sum of `value` over them), for any number of rows.

    Rows are range-partitioned by `order`, written once with their partition's number, and ranked within it;
    only one total per partition goes to the driver. Nulls sort first. Rows equal in `order` get distinct ranks
    in arbitrary order. A key that many rows share is split as long as `order` ends in something distinct.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1) if value is None else value
    parts = saved(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).withColumn("__one", one.cast("long")), name)
    totals = {r[0]: r[1] for r in parts.groupBy("__part").agg(F.sum("__one")).collect()}
    starts, so_far = [], 0
    for p in range(max(totals, default=-1) + 1):
        starts.append(so_far)
        so_far += totals.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), F.col("__part") + 1)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(into, F.coalesce(F.sum("__one").over(w), F.lit(0)) + offset).drop("__part", "__one")


def packed(key: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[list[tuple]]:
    """Rows (bucket, bytes of each column), a row for each bucket that `key` (unsigned 64-bit) deals values to."""
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
    full = [k for k in range(buckets) if edges[k] < edges[k + 1]]
    for at in range(0, len(full), 100):
        yield [(k, *(c[by[edges[k] : edges[k + 1]]].tobytes() for c in columns)) for k in full[at : at + 100]]


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_bucket(df: DataFrame, close: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """close(bucket, rows without the bucket) for each value of the first column, whole buckets together.

    Rows are dealt by bucket, sorted, and streamed: a task holds one bucket at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now and held:
                    yield from close(now, held)
                    held = []
                now = bucket
                held.append(tuple(rest))
        if held:
            yield from close(now, held)

    n, first = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns[0]
    return map_arrow(df.repartition(n, first).sortWithinPartitions(first), run, ddl)
