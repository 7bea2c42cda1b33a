"""Order statistics of groups of any size from sorted runs: quantiles and ranked sums without a row of the shuffle per value.

Each task sorts its own rows' values by group and column into runs. A regular sample of every run (each s-th value and the last)
goes to the group; as no run has more than s - 1 values between two of its samples, the samples bound every rank. What these
bounds leave open is then read from the runs themselves: for quantiles the few values between two bounds of a place, for ranked
sums all values, in bins of bounded size. Results are exact for every distribution, and no task holds a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, LongType, StructField, StructType

from ..sources.tables import saved

#: Values of a bin of ranked sums, beside the few that the samples cannot tell apart.
BIN_ROWS = 1 << 16


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive pieces of the values as binary cells."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(cells: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary cells, one cell after the other, and each cell's number of values."""
    some = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    if not len(some):
        return np.empty(0, kind), np.empty(0, np.int64)
    ends = np.frombuffer(some.buffers()[1], np.int32, len(some) + 1, some.offset * 4).astype(np.int64)
    held = some.buffers()[2]
    flat = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]].view(kind) if held is not None and ends[-1] > ends[0] else np.empty(0, kind)
    return flat, np.diff(ends) // np.dtype(kind).itemsize


def by_group(table: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which groups are consecutive, and where each begins; null is a key like any other."""
    codes = np.zeros(table.num_rows, np.int64)
    for c in by:
        own = table.column(c).combine_chunks().dictionary_encode()
        at = own.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes = np.unique(codes * (len(own.dictionary) + 1) + at, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    return order, np.flatnonzero(np.diff(codes[order], prepend=-1))


def sampled(v: np.ndarray, starts: np.ndarray, ends: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """The regular sample of each run: every s-th value and the last, s being the run's length over `samples`, rounded up."""
    n = ends - starts
    if not len(n) or n.max() <= samples:
        return v, n
    s = np.maximum(-(-n // samples), 1)
    k = -(-n // s)
    first = np.repeat(np.cumsum(k) - k, k)
    place = np.minimum((np.arange(len(first)) - first + 1) * np.repeat(s, k), np.repeat(n, k)) - 1
    return v[np.repeat(starts, k) + place], k


def runs(df: DataFrame, by: list[str], columns: list[str], rows: int, samples: int | None = None) -> DataFrame:
    """A row for each group and column of every `rows` rows that a task reads: by, __cell (the column's place), __n and the sorted values as __data.

    Nulls are left out of the values and NaN counts as greater than all numbers. With `samples`, __data is the regular sample.
    """

    def sort(table: pa.Table) -> Iterator[pa.RecordBatch]:
        order, starts = by_group(table, by)
        ends = np.append(starts[1:], len(order))
        keys = [table.column(c).combine_chunks().take(pa.array(order[starts])) for c in by]
        for i in range(len(columns)):
            own = table.column(len(by) + i).combine_chunks()
            v, a, z = own.to_numpy(zero_copy_only=False)[order], starts, ends
            if own.null_count:
                has = own.is_valid().to_numpy(zero_copy_only=False)[order]
                upto = np.concatenate([[0], np.cumsum(has)])
                v, a, z = v[has], upto[starts], upto[ends]
            for x, y in zip(a.tolist(), z.tolist(), strict=True):
                v[x:y].sort()
            data, sizes = (v, z - a) if samples is None else sampled(v, a, z, samples)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(a), i, np.int32)), pa.array(z - a), packed(data, sizes)], names=[*by, "__cell", "__n", "__data"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from sort(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from sort(pa.Table.from_batches(held))

    own = df.select(*by, *(F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)))
    return own.mapInArrow(work, with_keys(df, by, {"__n": LongType(), "__data": BinaryType()}))


def with_keys(df: DataFrame, by: list[str], more: dict[str, DataType]) -> StructType:
    return StructType([*(StructField(c, df.schema[c].dataType) for c in by), StructField("__cell", IntegerType()), *(StructField(n, t) for n, t in more.items())])


def merged(table: pa.Table, samples: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The samples of a group's runs in order, with for each a least number of values up to it; the number of values, and by how much that least number may fall short."""
    n = table.column("__n").to_numpy()
    x, k = unpacked(table.column("__data"))
    s = np.maximum(-(-n // samples), 1)
    weight = np.repeat(s, k)
    weight[np.cumsum(k)[k > 0] - 1] = (n - s * (k - 1))[k > 0]
    order = np.argsort(x, kind="stable")
    return x[order], np.cumsum(weight[order]), int(n.sum()), int((s - 1).sum())


def places(total: int, level: float) -> tuple[int, int, float]:
    """The two neighbours that a quantile lies between, counted from 0, and its distance from the first."""
    at = (total - 1) * level
    return int(np.floor(at)), int(np.ceil(at)), at - np.floor(at)


def one_row(table: pa.Table, schema: StructType, by: list[str], values: list) -> pa.Table:
    """A group's key and its results."""
    keys = [table.column(c).slice(0, 1).combine_chunks() for c in [*by, "__cell"]]
    return pa.Table.from_arrays([*keys, *(v if isinstance(v, pa.Array) else pa.array([v]) for v in values)], names=schema.fieldNames())


def met(rows: DataFrame, groups: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Runs with what is known of their group and column; null keys meet. `groups` is a saved table, so its size decides how they are joined."""
    other = groups.select(F.col("__cell").alias("__oc"), *(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), *columns)
    same = F.col("__cell") == F.col("__oc")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return rows.join(other, same).drop("__oc", *(f"__by{i}" for i in range(len(by))))


def quantiles(df: DataFrame, by: list[str], columns: list[str], levels: list[float], rows: int, samples: int) -> DataFrame:
    """by, __cell and the array of the column's quantiles (linear between neighbours) as __q; nulls where it has no values."""
    bound_schema = with_keys(df, by, {"__total": LongType(), "__lo": BinaryType(), "__hi": BinaryType()})

    def bounds(table: pa.Table) -> pa.Table:
        x, least, total, short = merged(table, samples)
        lo, hi = np.full(len(levels), -np.inf), np.full(len(levels), np.nan)
        for k, level in enumerate(levels if total else []):
            low, high, _ = places(total, level)
            j = np.searchsorted(least, low - short, "right") - 1
            lo[k] = x[j] if j >= 0 else -np.inf
            hi[k] = x[np.searchsorted(least, high + 1, "left")]
        return one_row(table, bound_schema, by, [total, lo.tobytes(), hi.tobytes()])

    known = saved(runs(df, by, columns, rows, samples).groupBy(*by, "__cell").applyInArrow(bounds, bound_schema), "quantile-bounds")
    part_schema = with_keys(df, by, {"__total": LongType(), "__below": BinaryType(), "__sizes": BinaryType(), "__data": BinaryType()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each run and level the number of values below the bounds and the values within."""
        for batch in batches:
            v, n = unpacked(batch.column("__data"))
            lo, hi = (unpacked(batch.column(c))[0].reshape(-1, len(levels)) for c in ("__lo", "__hi"))
            ends = np.cumsum(n)
            below, sizes, pieces = np.empty(lo.shape, np.int64), np.empty(lo.shape, np.int64), []
            for r, (a, z) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
                own = v[a:z]
                below[r] = np.searchsorted(own, lo[r], "left")
                sizes[r] = np.searchsorted(own, hi[r], "right") - below[r]
                pieces += [own[b : b + s] for b, s in zip(below[r].tolist(), sizes[r].tolist(), strict=True)]
            each = np.full(batch.num_rows, len(levels))
            data = packed(np.concatenate(pieces) if pieces else np.empty(0), sizes.sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*by, "__cell", "__total"]), packed(below.ravel(), each), packed(sizes.ravel(), each), data], names=part_schema.fieldNames())

    found_schema = with_keys(df, by, {"__q": ArrayType(DoubleType())})

    def pick(table: pa.Table) -> pa.Table:
        total = table.column("__total")[0].as_py()
        below, sizes = (unpacked(table.column(c), np.int64)[0].reshape(-1, len(levels)) for c in ("__below", "__sizes"))
        v, _ = unpacked(table.column("__data"))
        level_of = np.repeat(np.tile(np.arange(len(levels)), len(sizes)), sizes.ravel())
        out = []
        for k, level in enumerate(levels if total else []):
            low, high, rest = places(total, level)
            own, skipped = np.sort(v[level_of == k]), below[:, k].sum()
            a, z = own[low - skipped], own[high - skipped]
            out.append(float(a + (z - a) * rest))
        return one_row(table, found_schema, by, [pa.array([out if total else [None] * len(levels)], pa.list_(pa.float64()))])

    parts = met(runs(df, by, columns, rows), known, by, ["__total", "__lo", "__hi"])
    return parts.mapInArrow(cut, part_schema).groupBy(*by, "__cell").applyInArrow(pick, found_schema)


def ranked_sums(df: DataFrame, by: list[str], columns: list[str], near: Callable[[DataFrame], DataFrame], rows: int, samples: int) -> DataFrame:
    """For each group and column with a value `__near`: its number of values (__n), their sum (__v), the sum of (2 rank - 1) * value (__s) and of distances to `__near` (__a).

    `near` adds `__near` to the rows (by, __cell) and drops those without one, whose values then stay where they are.
    """
    cut_schema = with_keys(df, by, {"__cuts": BinaryType()})

    def cuts(table: pa.Table) -> pa.Table:
        x, least, total, _ = merged(table, samples)
        bins = -(-total // BIN_ROWS)
        at = np.searchsorted(least, np.arange(1, bins) * (total / max(bins, 1)))
        return one_row(table, cut_schema, by, [np.unique(x[at][~np.isnan(x[at])]).tobytes()])

    known = saved(near(runs(df, by, columns, rows, samples).groupBy(*by, "__cell").applyInArrow(cuts, cut_schema)), "rank-cuts")
    part_schema = with_keys(df, by, {"__bin": IntegerType(), "__a": DoubleType(), "__data": BinaryType()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run's values by bin; equal values share one."""
        for batch in batches:
            v, n = unpacked(batch.column("__data"))
            edges, k = unpacked(batch.column("__cuts"))
            near_by, known_near = (x.to_numpy(zero_copy_only=False) for x in (batch.column("__near"), batch.column("__near").is_valid()))
            ends, cut_ends = np.cumsum(n), np.cumsum(k)
            row, bins, sizes, far = [], [], [], []
            for r in range(batch.num_rows):
                a, z = ends[r] - n[r], ends[r]
                upto = np.concatenate([[a], a + np.searchsorted(v[a:z], edges[cut_ends[r] - k[r] : cut_ends[r]], "right"), [z]])
                has = np.flatnonzero(np.diff(upto))
                row += [r] * len(has)
                bins += has.tolist()
                sizes += np.diff(upto)[has].tolist()
                away = np.add.reduceat(np.abs(v[a:z] - near_by[r]), upto[has] - a).tolist() if len(has) else []
                far += away if known_near[r] else [None] * len(away)
            keys = [batch.column(c).take(pa.array(row, pa.int64())) for c in [*by, "__cell"]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(bins, pa.int32()), pa.array(far, pa.float64()), packed(v, np.array(sizes, np.int64))], names=part_schema.fieldNames())

    bin_schema = with_keys(df, by, {"__bin": IntegerType(), "__n": LongType(), "__v": DoubleType(), "__w": DoubleType(), "__a": DoubleType()})

    def rank(table: pa.Table) -> pa.Table:
        v = np.sort(unpacked(table.column("__data"))[0])
        sums = [len(v), float(v.sum()), float((np.arange(len(v)) * v).sum())]
        far = pa.array([pc.sum(table.column("__a"), skip_nulls=False).as_py()], pa.float64())
        return one_row(table, bin_schema, by, [table.column("__bin").slice(0, 1).combine_chunks(), *sums, far])

    parts = met(runs(df, by, columns, rows), known, by, ["__cuts", F.col("__near").cast("double").alias("__near")])
    blocks = parts.mapInArrow(deal, part_schema).groupBy(*by, "__cell", "__bin").applyInArrow(rank, bin_schema)
    before = Window.partitionBy(*by, "__cell").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__s", 2 * F.col("__w") + (2 * F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1) * F.col("__v"))
    return blocks.groupBy(*by, "__cell").agg(*(F.sum(c).alias(c) for c in ("__n", "__v", "__s", "__a")))
