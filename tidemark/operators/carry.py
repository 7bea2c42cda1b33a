"""State carried over blocks of a sorted key: ranks, running sums, fills, as-of values and recursions for keys of any size.

Rows are range-partitioned by key and order, so a key with very many rows is cut into blocks, one for each partition that it
reaches into. A block is summarised where it lies, the summaries of a key (one a partition at most) are carried forward in
order, and each block adds what came before it. No task holds a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import saved


def cut(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df sorted by key and order over range partitions, with `__part` (the partition) and `__at` (a row's place in it), not written.

    `order` should tell rows apart: rows equal in key and order share a block.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*key, *order]
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


def rejoin(rows: DataFrame, blocks: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """rows with the columns of their block; null keys meet. Blocks are written first, so that the join goes by their size and leaves the rows where they are."""
    other = saved(blocks.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), *columns), "blocks")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(other, same, "left").drop("__p", *(f"__k{i}" for i in range(len(key))))


def earlier(key: list[str]):  # noqa: ANN201
    """The window over the summaries of a key's blocks before this one: at most as many as there are partitions."""
    return Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, key: list[str], order: list[str], into: str = "rank", parts: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the row's place in its key by order, from 1. With `keep`, only the key and these columns are written and stay."""
    rows = cut(df, key, order, parts)
    rows = saved(rows if keep is None else rows.select(*key, *keep, "__part", "__at"), "ranked")
    blocks = rows.groupBy("__part", *key).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    blocks = blocks.withColumn("__shift", F.coalesce(F.sum("__n").over(earlier(key)), F.lit(0)) - F.col("__first") + 1)
    return rejoin(rows, blocks, key, ["__shift"]).withColumn(into, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds, under each name, the sum of its column over the rows before this one in its key (0 for the first)."""
    rows = saved(cut(df.withColumns({f"__s_{n}": c for n, c in sums.items()}), key, order, parts), "running")
    blocks = rows.groupBy("__part", *key).agg(*(F.sum(f"__s_{n}").alias(f"__b_{n}") for n in sums))
    blocks = blocks.withColumns({f"__b_{n}": F.coalesce(F.sum(f"__b_{n}").over(earlier(key)), F.lit(0)) for n in sums})
    w = Window.partitionBy("__part", *key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = rejoin(rows, blocks, key, [f"__b_{n}" for n in sums])
    out = out.withColumns({n: F.coalesce(F.sum(f"__s_{n}").over(w), F.lit(0)) + F.col(f"__b_{n}") for n in sums})
    return out.drop("__part", "__at", *(f"__{x}_{n}" for n in sums for x in "sb"))


def filled(df: DataFrame, columns: list[str], key: list[str], on: list[str], parts: int | None = None) -> DataFrame:
    """Each column's last value up to the row, within the key: what `spine.ffill` gives, for keys of any size."""
    rows = saved(cut(df, key, on, parts), "filled")
    last = {c: F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), F.col("__at"))) for c in columns}
    blocks = rows.groupBy("__part", *key).agg(*(x.alias(f"__b_{c}") for c, x in last.items()))
    blocks = blocks.withColumns({f"__b_{c}": F.last(f"__b_{c}", ignorenulls=True).over(earlier(key)) for c in columns})
    w = Window.partitionBy("__part", *key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = rejoin(rows, blocks, key, [f"__b_{c}" for c in columns])
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__b_{c}.v")) for c in columns}).select(*df.columns)


def as_of(left: DataFrame, right: DataFrame, left_on: str, right_on: str, key: list[str], parts: int | None = None) -> DataFrame:
    """left (key and left_on) with the latest right_on at or before left_on: one union, filled over blocks."""
    kind = right.schema[right_on].dataType
    events = left.select(*key, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias(right_on))
    events = events.unionByName(right.select(*key, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.col(right_on)))
    return filled(events, [right_on], key, ["__t", "__side"], parts).where("__side = 1").select(*key, F.col("__t").alias(left_on), right_on)


#: What a block does to the state (fast, slow, signal) that enters it: fast and slow become decay * state + own, the signal line
#: becomes decay * signal + of_fast * fast + of_slow * slow + own. Two such maps, one after the other, are such a map again.
MAP = ("f", "g", "s", "sf", "sg", "f0", "g0", "s0")


def composed(a: Column, b: Column) -> Column:
    """The map of block a followed by block b."""
    parts = {
        "f": a["f"] * b["f"], "g": a["g"] * b["g"], "s": a["s"] * b["s"],
        "sf": b["sf"] * a["f"] + b["s"] * a["sf"], "sg": b["sg"] * a["g"] + b["s"] * a["sg"],
        "f0": b["f"] * a["f0"] + b["f0"], "g0": b["g"] * a["g0"] + b["g0"],
        "s0": b["s"] * a["s0"] + b["sf"] * a["f0"] + b["sg"] * a["g0"] + b["s0"],
    }
    return F.struct(*(parts[m].alias(m) for m in MAP))


def smooth(values: np.ndarray, decay: float, start: float) -> np.ndarray:
    """start, then decay * previous + (1 - decay) * value, in runs short enough for powers of the decay to stay in range."""
    out, run = np.empty(len(values)), max(1, int(200 / -np.log10(decay)))
    for k in range(0, len(values), run):
        some = values[k : k + run]
        power = decay ** np.arange(1, len(some) + 1)
        out[k : k + run] = power * (start + np.cumsum((1 - decay) * some / power))
        start = out[min(k + run, len(values)) - 1]
    return out


def macd(df: DataFrame, column: str, key: list[str], on: str = "date", fast: int = 12, slow: int = 26, signal: int = 9, parts: int | None = None) -> DataFrame:
    """macd, macd_signal and macd_hist by key and date, as an associative scan over blocks.

    Each block runs the three recursions from a zero state and gives the affine map of whatever state enters it; the maps of
    a key's blocks are composed in order, and a row's values are its block's own plus the entering state's share. The first
    value of a key is its starting state. A row without a value keeps the state; before a key's first value the lines are null.
    """
    a, b, c = (1 - 2 / (n + 1) for n in (fast, slow, signal))
    own = df.select(*key, on, F.col(column).cast("double").alias("__x"))
    rows = saved(cut(own, key, [on], parts), "macd-rows")
    names = ["__f", "__g", "__s", "__i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Zero-state values (f, g, s) and the number i of values so far, block by block; rows come sorted by block and place."""
        now, state, n = None, (0.0, 0.0, 0.0), 0
        for batch in batches:
            block, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            found = [np.empty(len(x)) for _ in names]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, int)
            for k, z in zip(edges[:-1], edges[1:], strict=True):
                if now != block[k]:
                    now, state, n = block[k], (0.0, 0.0, 0.0), 0
                has = ~np.isnan(x[k:z])
                some = x[k:z][has]
                f, g = smooth(some, a, state[0]), smooth(some, b, state[1])
                s = smooth(f - g, c, state[2])
                at = np.cumsum(has)  # how many values up to each row; 0: the state before
                for out, line, before in zip(found, (f, g, s), state, strict=False):
                    out[k:z] = np.concatenate([[before], line])[at]
                found[3][k:z] = n + at
                n += len(some)
                state = (f[-1], g[-1], s[-1]) if len(some) else state
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v) for v in found)], names=["__block", "__at", *names])

    # a block's number: its partition and its place among the keys there, so that equal numbers are one key's rows in one partition
    blocks = rows.groupBy("__part", *key).agg(F.min("__at").alias("__first"), F.min_by("__x", F.when(F.col("__x").isNotNull(), F.col("__at"))).alias("__x0")).withColumn("__block", F.shiftleft(F.col("__part").cast("long"), 33) + F.col("__first"))
    numbered = rejoin(rows, blocks, key, ["__block"])
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = numbered.select("__block", "__at", "__x").repartition(n, "__block").sortWithinPartitions("__block", "__at").mapInArrow(run, "__block long, __at long, __f double, __g double, __s double, __i double")
    local = saved(local, "macd-lines")
    ends = local.groupBy("__block").agg(F.max_by(F.struct("__f", "__g", "__s", "__i"), "__at").alias("e"))
    of_fast, of_slow = ((lambda i, r=r: (1 - c) * r * (F.pow(F.lit(r), i) - F.pow(F.lit(c), i)) / (r - c) if r != c else (1 - c) * i * F.pow(F.lit(c), i)) for r in (a, b))
    i = F.col("e.__i")
    maps = F.struct(F.pow(F.lit(a), i).alias("f"), F.pow(F.lit(b), i).alias("g"), F.pow(F.lit(c), i).alias("s"), of_fast(i).alias("sf"), (-of_slow(i)).alias("sg"), F.col("e.__f").alias("f0"), F.col("e.__g").alias("g0"), F.col("e.__s").alias("s0"))
    nothing = F.struct(*(F.lit(1.0 if m in "fgs" else 0.0).alias(m) for m in MAP))
    # the first value of a key, and the maps of the blocks before this one, composed: at most one a partition
    whole = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = blocks.join(ends.select("__block", maps.alias("__map")), "__block").withColumns({"__start": F.first("__x0", ignorenulls=True).over(whole), "__maps": F.collect_list("__map").over(earlier(key))})
    m = F.aggregate("__maps", nothing, composed)
    entering = {"__ef": m["f"] * F.col("__start") + m["f0"], "__eg": m["g"] * F.col("__start") + m["g0"], "__es": (m["sf"] + m["sg"]) * F.col("__start") + m["s0"], "__met": F.coalesce(F.sum(F.col("__x0").isNotNull().cast("int")).over(earlier(key)), F.lit(0)) > 0}
    carried = carried.withColumns(entering).select("__part", "__block", *key, "__ef", "__eg", "__es", "__met")
    out = rejoin(rows.select(*key, on, "__part", "__at"), carried, key, ["__block", "__ef", "__eg", "__es", "__met"]).join(local, ["__block", "__at"])
    i = F.col("__i")
    f = F.pow(F.lit(a), i) * F.col("__ef") + F.col("__f")
    g = F.pow(F.lit(b), i) * F.col("__eg") + F.col("__g")
    s = F.pow(F.lit(c), i) * F.col("__es") + of_fast(i) * F.col("__ef") - of_slow(i) * F.col("__eg") + F.col("__s")
    seen = F.col("__met") | (i > 0)
    return out.select(*key, on, *(F.when(seen, F.round(x, 4)).alias(name) for name, x in (("macd", f - g), ("macd_signal", s), ("macd_hist", f - g - s))))
