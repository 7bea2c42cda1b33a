"""Connected components of undirected links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_finished, saved


def connected_components(links: DataFrame, salts: int = 1) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the smallest node that it reaches.

    Alternates two star operations until the links no longer change: each node hands its larger neighbours, then
    its smaller ones, to the smallest node that it sees. Every round is a table in the shared folder, and only a
    count and a checksum come to the driver. Self-links and nulls are left out; no links give an empty table.
    With `salts` the links of a node are dealt to so many tasks when they learn its smallest neighbour (each node's is copied
    to them), so that a node with a great share of the links is no single task's.
    """
    salted = lambda df: df if salts == 1 else df.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    copied = lambda df: df if salts == 1 else df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = ["u"] if salts == 1 else ["u", "salt"]
    mark = None
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark or not now[0]:
            break
        mark = now
        drop_finished(edges.sparkSession)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted(both.where("v > u")).join(copied(least), on).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
