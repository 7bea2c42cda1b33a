"""Tables in the folder that driver and executors share: scratch tables that cut lineage, and versioned ones with a pointer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

POINTER = "CURRENT"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder on a single machine, a folder in the warehouse on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        single = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = tempfile.mkdtemp(prefix="tidemark-") if single else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: it survives lost executors and is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a versioned table's current version, as its pointer names it; None before the first."""
    _, at, fs = file_system(spark, f"{path}/{POINTER}")
    return f"{path}/{spark.read.text(at.toString()).first()[0]}" if fs.exists(at) else None


def publish(df: DataFrame, path: str) -> str:
    """Writes df as a new version of the table and swaps the pointer last, in one rename: a reader sees the old or the new version whole.

    Older versions stay for readers that have begun.
    """
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, new, fs = file_system(spark, f"{path}/{POINTER}-{version}")
    out = fs.create(new)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), over)
    return f"{path}/{version}"


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    at = current(spark, path)
    return spark.read.parquet(at) if at else None


def upsert(updates: DataFrame, path: str, key: list[str], columns: list[str]) -> str:
    """A new version of the table at path in which `columns` have the updates' values where these have the key, and new keys are added.

    Null values of an update keep what was there; an update's key comes once. The same updates twice give the same table.
    """
    held = read_current(updates.sparkSession, path)
    if held is None:
        return publish(updates, path)
    new = updates.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    rest = [c for c in held.columns if c not in (*key, *columns)]
    merged = held.join(new, key, "full_outer").select(*key, *rest, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))
    return publish(merged.select(*held.columns), path)
