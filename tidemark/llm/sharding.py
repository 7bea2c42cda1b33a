"""Sharding along a Hilbert curve over quantised metadata, for files that prune in several dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, global_rank

BITS = 5
SHARDS = 8


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of points whose rows of `levels` are coordinates of `bits` bits each.

    Bit planes from the top: each coordinate that has the plane's bit flips the lower bits of the first one, each
    that lacks it trades them with the first one; the Gray code of the planes is then undone and interleaved.
    """
    x = levels.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for d in range(dims):
            has = (x[d] >> plane) & 1 == 1
            swap = np.where(has, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(has, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> plane) & 1)
    return index


def level_bounds(df: DataFrame, column: str, bits: int) -> list[tuple]:
    """(value, level) where a new level begins: a value's level is the share of rows below it, in 2**bits steps.

    The column is counted by value first, and only the at most 2**bits bounds reach the driver.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL")
    ranked = global_rank(counts, ["v"], f"levels-{column}", F.col("n"), "below")
    total = ranked.agg(F.sum("n")).first()[0] or 1
    levels = ranked.groupBy(F.expr(f"below * {1 << bits} div {total}").alias("level")).agg(F.min("v").alias("bound"))
    return sorted((r["bound"], r["level"]) for r in levels.collect())


def level(column: str, bounds: list[tuple]) -> Column:
    """The level of the last bound that does not exceed the value; null has level 0."""
    if not bounds:
        return F.lit(0)
    values, levels = (F.array(*map(F.lit, x)) for x in zip(*bounds, strict=True))
    return F.coalesce(F.get(levels, F.size(F.filter(values, lambda b: b <= F.col(column))) - 1), F.lit(0))


def hilbert_order(df: DataFrame, dimensions: list[str], ties: list[str], bits: int = BITS) -> DataFrame:
    """Adds hilbert (curve index) and curve_rank (place of the row in curve order, from 0).

    Nulls in a dimension take the lowest level; an empty table stays empty; equal indices are ordered by `ties`,
    rows equal in those too are told apart arbitrarily. Columns named `hilbert` or `curve_rank` are replaced.
    """
    levels = [level(c, level_bounds(df, c, bits)) for c in dimensions]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([c.to_numpy() for c in columns]), bits))

    return global_rank(df.withColumn("hilbert", index(*levels)), ["hilbert", *ties], "curve", into="curve_rank")


def size_of(column: str) -> Column:
    return (F.coalesce(F.octet_length(column), F.lit(0)) + 1).cast("long")


def crc_of(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def shard_by_hilbert(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """The documents with shard and slot, cut from the Hilbert order of (lang, source, size) at equal row counts.

    Law `rows`: shards' counts differ by one at most, whatever the skew. Null text has size 1 and the CRC of nothing.
    """
    own = docs.select("doc_id", "lang", "source", size_of("text").alias("size"), crc_of("text").alias("text_crc32"))
    ranked = hilbert_order(own, ["lang", "source", "size"], ["text_crc32", "doc_id"], bits)
    n = ranked.count()
    return ranked.withColumn("shard", F.expr(f"int(curve_rank * {shards} div {max(n, 1)})")).withColumn("slot", F.expr(f"curve_rank - (shard * bigint({n}) + {shards - 1}) div {shards}"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes whole documents as one folder per shard, rows in curve order, so that min/max statistics prune.

    A document is named by doc_id (which may be null) and its text's size and CRC; rows that repeat all follow the first one's
    place. Columns named `shard` or `slot` are replaced.
    """
    name = {"__id": F.col("doc_id"), "__size": size_of("text"), "__crc": crc_of("text")}
    at = shard_by_hilbert(docs, shards).groupBy("doc_id", "size", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("at")).select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), "at.*")
    own = docs.drop("shard", "slot").alias("d")
    same = F.lit(True)
    for c, x in name.items():
        same = same & x.eqNullSafe(F.col(c))
    rows = own.join(at, same).select("d.*", "shard", "slot")
    rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and law `rows` of every document; nulls, ties and repeated rows as in `hilbert_order` and `shard_by_hilbert`."""
    placed = shard_by_hilbert(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES = {"op5_hilbert_shards": op5_hilbert_shards}
SQL: dict[str, str] = {}
