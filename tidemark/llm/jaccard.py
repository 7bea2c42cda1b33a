"""Near-duplicate join in the Jaccard metric space of word shingles: pivots, Voronoi regions, windows, exact links.

The distance of two documents is 1 minus the Jaccard index of their shingle sets, which obeys the triangle
inequality. Sets that are equal are one point. A bounded number of points is drawn as pivots, once for the whole table, and every
point's exact distance to each of them is taken while the table is read. Points within reach of a pivot are linked to it
on the spot, so large groups of near copies are one component before any pair is formed. Of the pivots those far from each other are
centres: a point is at home in the Voronoi region of its nearest centre if that lies within CELL, otherwise in the
outer region. If d(x, y) is within reach and y is at home at Q, then d(x, Q) <= d(y, Q) + reach and d(x, Q) <= d(x,
nearest) + 2 reach; points in that window are replicated into the region of Q, and points more than CELL - reach away from
all centres into the outer one. So each pair within reach meets in a region.

Regions are joined recursively. Points of a region that may be within reach share one of a few shingles at a low position of a common
order (rare ones first), so each such shingle spans a part of the region, and a part ends where all its points are one
component. Small parts are compared at once; large ones draw pivots of their own, more from round to round, and
points are only compared if they are in different components and if their distances to a pivot that they share differ by at most the
reach. It ends when all points have been pivots, so every pair has been compared or excluded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOWER, documents, drop_finished, map_arrow, saved, split_words, texts
from .components import connected_components

SHINGLE_WORDS, PERCENT = 5, 80
#: Pivots of the whole table, bytes of the longest text that is drawn, distance up to which a point is at home at its nearest centre.
DRAWN, DRAWN_BYTES, CELL = 1024, 1 << 15, 0.5
#: Steps of a distance in the windows of a region.
STEPS = 200
#: Parts of up to LEAF points are joined at once; larger ones begin with so many pivots, and have GROW times as many after each round.
LEAF, PIVOTS, GROW = 6, 3, 64
#: Row pairs held at once.
PAIRS_AT_ONCE = 2_000_000
#: Shingles that come last in the order, as they are frequent; the list steers the cost and not the result.
FREQUENT, TASK_FREQUENT = 50_000, 20_000
#: A shingle that is known to be in more sets is dealt to a grid of parts, one row and one column of it for each set.
HOT_SETS, GRID = 100_000, 32
FLUSH = 1_000_000
REGION_ROWS, MEMBERS_PER_TASK = 500_000, 500
#: Least and most bits of a set's sketch, which has two to four bits a shingle; bits of the folded one that parts carry.
LEAST_BITS, MOST_BITS = 512, 1 << 16
#: Bits of the filter of wanted documents; its size is fixed, and whatever it lets through is joined exactly.
FILTER_BITS = 1 << 24
#: Copies of one set are dealt to so many parts when they fetch its component.
SALTS = 16
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
TURN = np.uint64(29)


def shingles(text: bytes, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one shingle, no word none."""
    words = split_words(text.translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(words_each, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ hashed[k : k + n]) * MIX[k % len(MIX)]
        out ^= out >> TURN
    return np.unique(out)


def set_key(own: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(own.tobytes()), np.int64)[0])


def linked(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * inter >= percent * (a + b - inter)


def sketch(own: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of some bins by hash, a bit each."""
    bins = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(own)).bit_length()))
    return np.packbits(np.bincount(((own * MIX[0]) >> np.uint64(44)).astype(np.int64) & (bins - 1), minlength=bins) & 1, bitorder="little").tobytes()


def folded(full: bytes, size: int) -> np.ndarray:
    """The sketch of fewer bins, in bytes: parities of bins that become one add up."""
    return np.bitwise_xor.reduce(np.frombuffer(full, np.uint8).reshape(-1, size), axis=0)


def may_link(odd_bits: np.ndarray | int, n_a: np.ndarray | int, n_b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of these sizes can share enough: a bit that differs takes a shingle that only one of them has."""
    return odd_bits * (100 + percent) <= (n_a + n_b) * (100 - percent)


def differing_bits(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


class Pivots:
    """Points drawn from the whole table, by their shingles, and which of them are centres of regions."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.reach = percent, (100 - percent) / 100
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        by = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[by]
        self.values, starts = np.unique(flat[by], return_index=True)
        self.starts = np.append(starts, len(flat))
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.centres = np.zeros(0, np.int64)
        linked_to = []
        for k, own in enumerate(sets):
            shared = self.shared(own)
            distances = 1 - shared / (len(own) + self.sizes - shared)
            linked_to += [(k, j) for j in np.flatnonzero(linked(shared, len(own), self.sizes, percent)).tolist() if j < k]
            if (distances[self.centres] > CELL + self.reach).all():
                self.centres = np.append(self.centres, k)
        self.links = linked_to

    def shared(self, own: np.ndarray) -> np.ndarray | None:
        """Common shingles with each pivot; None if there is none with any."""
        if not len(self.values):
            return None
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        if not len(at):
            return None
        sizes = self.starts[at + 1] - self.starts[at]
        places = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.owner[places], minlength=len(self.sizes))

    def linked(self, own: np.ndarray) -> np.ndarray:
        """The pivots within reach."""
        shared = self.shared(own)
        return np.zeros(0, np.int64) if shared is None else np.flatnonzero(linked(shared, len(own), self.sizes, self.percent))

    def regions(self, own: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
        """(the first pivot within reach or -1, (region, steps of the distance to its centre) of the regions that the point is in).

        The outer region is -1 and has no centre: 0 steps.
        """
        shared = self.shared(own)
        if shared is None:
            return -1, [(-1, 0)]
        near = np.flatnonzero(linked(shared, len(own), self.sizes, self.percent))
        shared, sizes = shared[self.centres], self.sizes[self.centres]
        distances = 1 - shared / (len(own) + sizes - shared)
        least, little = distances.min(), 1e-9
        inside = np.flatnonzero(distances <= min(least + 2 * self.reach, CELL + self.reach) + little)
        found = [(int(self.centres[k]), int(distances[k] * STEPS)) for k in inside]
        if least > CELL - self.reach - little:
            found.append((-1, 0))
        return int(near[0]) if len(near) else -1, found


def draw(docs: DataFrame, words_each: int, percent: int) -> Pivots:
    """DRAWN different texts, by hash, from all of up to DRAWN_BYTES bytes; which ones these are steers the cost and not the result."""
    able = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= DRAWN_BYTES)).select("text", F.xxhash64("text").alias("h"))
    hashes = [r["h"] for r in able.groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(DRAWN).select("h").collect()]
    chosen = docs.sparkSession.createDataFrame([(h,) for h in hashes], "h long")
    rows = able.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text")).orderBy("h").collect()
    sets = [shingles(r["text"].encode(), words_each) for r in rows]
    return Pivots([x for x in sets if len(x)], percent)


class Order:
    """The common order of shingles: by hash, the frequent ones after all others by their count."""

    def __init__(self, frequent: list[tuple[int, int]]):
        listed = np.array([f for f, _ in frequent], np.int64).astype(np.uint64)
        self.sorted = np.sort(listed)
        self.place = np.argsort(listed, kind="stable")
        self.grid = np.array([min(GRID, -(-n // HOT_SETS)) for _, n in frequent], np.int64)[self.place]

    def find(self, own: np.ndarray) -> np.ndarray:
        """Places of the frequent ones in the sorted list, -1 for others."""
        if not len(self.sorted):
            return np.full(len(own), -1)
        at = np.minimum(np.searchsorted(self.sorted, own), len(self.sorted) - 1)
        return np.where(self.sorted[at] == own, at, -1)

    def prefix(self, own: np.ndarray, percent: int) -> np.ndarray:
        """The shingles one of which a set within reach must share."""
        size = len(own) - -(-percent * len(own) // 100) + 1
        at = self.find(own)
        late = at >= 0
        own = np.concatenate([own[~late], own[late][np.argsort(self.place[at[late]], kind="stable")]])
        return own[:size]


#: What a document's text is fetched by: its doc_id, or where it has none a hash of its text.
NAME = "coalesce(doc_id, xxhash64(coalesce(text, '')))"


def text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def first_pass(docs: DataFrame, pivots, words_each: int) -> DataFrame:
    """kind 0: a document (a), its set's key (b), size (n), first pivot within reach or -1 (pivot), text's hash (h) and, if
    the task has not met the set, its sketch;
    kind 1: a shingle (a) that a task saw often (n); kind 2: pivots (a and b) that one set links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, total, joined = {}, [], 0, set()

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            keep = np.argsort(-counts, kind="stable")[:TASK_FREQUENT]
            keep = keep[counts[keep] > 2]
            return rows(1, values[keep].astype(np.int64), np.zeros(len(keep), np.int64), counts[keep])

        for b in batches:
            keys, sizes, nearest, sketches = [], [], [], []
            for t in texts(b):
                own = shingles(t, words_each)
                sizes.append(len(own))
                keys.append(set_key(own) if len(own) else None)
                sketches.append(None)
                if not len(own):
                    nearest.append(-1)
                    continue
                if keys[-1] not in seen:
                    sketches[-1] = sketch(own)
                    held.append(own)
                    total += len(own)
                    near = pivots.value.linked(own).tolist()
                    joined.update((near[0], k) for k in near[1:])
                    seen[keys[-1]] = near[0] if near else -1
                nearest.append(seen[keys[-1]])
            yield rows(0, b.column(0), pa.array(keys, pa.int64()), sizes, nearest, b.column(2), sketches)
            if total > FLUSH:
                yield frequent()
                seen, held, total = {}, [], 0
        yield frequent()
        yield rows(2, [x for x, _ in joined], [x for _, x in joined], [0] * len(joined))

    def rows(kind: int, a, b, n, pivot=None, h=None, sketches=None) -> pa.RecordBatch:
        pivot, h, sketches = ([None] * len(n) if x is None else x for x in (pivot, h, sketches))
        columns = {"kind": pa.array([kind] * len(n), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()), "pivot": pa.array(pivot, pa.int32()), "h": pa.array(h, pa.int64()), "sketch": pa.array(sketches, pa.binary())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_arrow(docs.select("doc_id", "text", text_hash("text").alias("h")), run, "kind int, a long, b long, n long, pivot int, h long, sketch binary")


def roots(n: int, links: list[tuple[int, int]]) -> np.ndarray:
    """For each pivot, the first one that it reaches over links."""
    root = list(range(n))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return np.array([top(k) for k in range(n)], np.int16)


#: Columns of packed parts: shingle and region as one hash, set, its size, the shingle's place in it, root of its pivot or -1, steps from the centre.
KINDS = (("tokens", np.uint64), ("keys", np.int64), ("sizes", np.int32), ("places", np.int32), ("roots", np.int16), ("steps", np.uint8))
REGION_DDL = "bucket int, " + ", ".join(f"{n} binary" for n, _ in KINDS)


def region_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(1, len(KINDS) + 1))], names=["bucket", *(n for n, _ in KINDS)])


def mixed(tokens: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Tokens told apart by a number, which leaves them as they are where it is 0."""
    return tokens ^ (number.astype(np.uint64) * MIX[1])


def dealt(tokens: np.ndarray, key: int, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """(places of the tokens, tokens with their parts): a hot one has a grid of parts, of which a set gets a row and a column."""
    at = order.find(tokens)
    side = np.where(at >= 0, order.grid[at] if len(order.grid) else 1, 1)
    if side.max() == 1:
        return np.arange(len(tokens)), tokens
    where, parts = [np.flatnonzero(side == 1)], [tokens[side == 1]]
    for k in np.flatnonzero(side > 1).tolist():
        n = int(side[k])
        row, column = key % n, (key // n) % n
        cells = np.unique(np.concatenate([row * n + np.arange(n), np.arange(n) * n + column]))
        where.append(np.full(len(cells), k))
        parts.append(mixed(np.full(len(cells), tokens[k]), (cells + 1) << 20))
    return np.concatenate(where), np.concatenate(parts)


def prefix_rows(docs: DataFrame, order, pivots, root: np.ndarray, buckets: int, words_each: int, percent: int) -> DataFrame:
    """Packed parts: every set's prefix in every region that the set is in, dealt into buckets by shingle and region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, total = [], set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            bucket = ((columns[0] * MIX[0]) >> np.uint64(40)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            full = [k for k in range(buckets) if edges[k] < edges[k + 1]]
            for at in range(0, len(full), 100):
                yield region_batch([(k, *(c[by[edges[k] : edges[k + 1]]] for c in columns)) for k in full[at : at + 100]])

        for b in batches:
            for t in texts(b):
                own = shingles(t, words_each)
                if not len(own) or (key := set_key(own)) in seen:
                    continue
                seen.add(key)
                pivot, regions = pivots.value.regions(own)
                where, prefix = dealt(order.value.prefix(own, percent), abs(key), order.value)
                n = len(prefix)
                for region, steps in regions:
                    held.append((mixed(prefix, np.full(n, region + 1)), np.full(n, key, np.int64), np.full(n, len(own), np.int32), where.astype(np.int32), np.full(n, root[pivot] if pivot >= 0 else -1, np.int16), np.full(n, steps, np.uint8)))
                    total += n
                if total > FLUSH:
                    yield from flush()
                    held, seen, total = [], set(), 0
        if held:
            yield from flush()

    return map_arrow(docs.select("doc_id", "text"), run, REGION_DDL)


def unpack(parts: list[tuple[bytes, ...]]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x), kind) for x, (_, kind) in zip(zip(*parts, strict=True), KINDS, strict=True)]


def shared_regions(packed: DataFrame) -> DataFrame:
    """The same rows, whole buckets together and sorted, without parts whose points are one set or one pivot's component.

    In a part the points of its most frequent component (as known so far) come last: they need not be compared with each other.
    """

    def close(bucket: int, parts: list) -> pa.RecordBatch | None:
        columns = unpack(parts)
        by = np.lexsort((columns[1], columns[0]))
        columns = [c[by] for c in columns]
        tokens, keys, known = columns[0], columns[1], columns[4]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        columns = [c[fresh] for c in columns]
        tokens, keys, known = columns[0], columns[1], columns[4]
        part = np.cumsum(np.append(True, tokens[1:] != tokens[:-1])) - 1
        pairs, of, counts = np.unique(np.stack([part, known.astype(np.int64)], axis=1)[known >= 0], axis=0, return_inverse=True, return_counts=True)
        most = np.zeros(part[-1] + 1, np.int64)
        np.maximum.at(most, pairs[:, 0], counts)
        first = np.full(part[-1] + 1, -1)
        largest = np.flatnonzero(counts == most[pairs[:, 0]])[::-1]
        first[pairs[largest, 0]] = pairs[largest, 1]
        tail = (known >= 0) & (known == first[part])
        sizes = np.bincount(part)
        keep = (sizes - np.bincount(part, tail).astype(np.int64) > 0)[part] & (sizes > 1)[part]
        if not keep.any():
            return None
        by = np.lexsort((keys[keep], tail[keep], tokens[keep]))
        return region_batch([(bucket, *(c[keep][by] for c in columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now and parts:
                    if (out := close(now, parts)) is not None:
                        yield out
                    parts = []
                now = bucket
                parts.append(tuple(rest))
        if parts and (out := close(now, parts)) is not None:
            yield out

    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(packed.repartition(n, "bucket").sortWithinPartitions("bucket"), run, REGION_DDL)


def in_reach(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose first common shingle has these places can still share enough."""
    need = -(-percent * (n[i].astype(np.int64) + n[j]) // (100 + percent))
    return np.minimum(n[i] - place[i], n[j] - place[j]) >= need


def group_bounds(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its group's size and its rank in the group."""
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(tokens)))
    return np.repeat(sizes, sizes), np.arange(len(tokens)) - np.repeat(starts, sizes)


def pivot_pairs(size: np.ndarray, rank: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of each pivot (ranks from first to below last) with all rows of its group that come later."""
    pivots = np.flatnonzero((rank >= first) & (rank < last))
    later = size[pivots] - rank[pivots] - 1
    offsets = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
    i = np.repeat(pivots, later)
    return i, i + offsets + 1


def tails(tokens: np.ndarray, known: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which rows belong to the component at their part's end; those are no pivots."""
    last = np.arange(len(tokens)) - rank + size - 1
    return (known >= 0) & (known == known[last]) if len(tokens) else np.zeros(0, bool)


def first_pairs(regions: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of small parts and the first pivots' pairs of large ones, by set key, where components and windows allow a link."""
    window = (100 - percent) * STEPS // 100 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens, keys, sizes, places, known, steps = unpack([tuple(rest)])
                size, rank = group_bounds(tokens)
                small = size <= LEAF
                open_rank = np.where(tails(tokens, known, size, rank), PIVOTS, rank)
                found = [pivot_pairs(np.where(small, 0, size), np.where(small, PIVOTS, open_rank), 0, PIVOTS)]
                for step in range(1, LEAF):
                    i = np.flatnonzero(small[:-step] & (tokens[:-step] == tokens[step:])) if len(tokens) > step else np.zeros(0, np.int64)
                    found.append((i, i + step))
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                fit = in_reach(sizes, places, i, j, percent) & ((known[i] < 0) | (known[i] != known[j]))
                fit &= np.abs(steps[i].astype(np.int16) - steps[j]) <= window
                pairs = np.unique(np.stack([keys[i[fit]], keys[j[fit]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return map_arrow(regions, run, "a long, b long").distinct()


def large_parts(regions: DataFrame) -> DataFrame:
    """Rows of the parts that are not done yet: token, key, size, place, and rank in the part, -1 for those that are no pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens, keys, sizes, places, known, _ = unpack([tuple(rest)])
                size, rank = group_bounds(tokens)
                rank = np.where(tails(tokens, known, size, rank), -1, rank)
                keep = size > LEAF
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tokens.astype(np.int64), keys, sizes, places, rank.astype(np.int32))], names=["token", "key", "size", "place", "rank"])

    return map_arrow(regions, run, "token long, key long, size int, place int, rank int")


def later_pairs(open_rows: DataFrame, first: int, last: int, percent: int) -> DataFrame:
    """(a, b) of the pivots ranked from first to below last in each part with the points behind them, where components and windows allow a link.

    A window: points of which both distances to a common pivot are known can't link if these differ by more than the
    reach. Nor can those whose folded sketches differ in too many bits.
    """
    reach = (100 - percent) / 100 + 1e-9

    def close(parts: list) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        tokens, keys, sizes, places, ranks, comps, pivots, dists = (t.column(c).to_numpy() for c in ("token", "key", "size", "place", "rank", "component", "pivot", "distance"))
        odd = np.frombuffer(b"".join(t.column("odd").to_pylist()), np.uint64).reshape(-1, LEAST_BITS // 64)
        size, order = group_bounds(tokens)
        mine = (ranks >= first) & (ranks < last)
        pairs_so_far = np.cumsum(np.where(mine, size - order, 0))
        cuts = np.searchsorted(pairs_so_far, np.arange(PAIRS_AT_ONCE, int(pairs_so_far[-1]) + 1, PAIRS_AT_ONCE))
        bounds = np.unique(np.concatenate([[0], cuts, [len(ranks)]]))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            held = np.full(len(ranks), -1)
            held[x:y] = np.where(mine[x:y], order[x:y], -1)
            i, j = pivot_pairs(size, held, 0, len(ranks) + 1)
            fit = (comps[i] != comps[j]) & in_reach(sizes, places, i, j, percent)
            fit &= ~((pivots[i] == pivots[j]) & (np.abs(dists[i] - dists[j]) > reach))
            i, j = i[fit], j[fit]
            bits = np.zeros(len(i), np.int64)
            for word in odd.T:
                bits += np.bitwise_count(word[i] ^ word[j])
            fit = may_link(bits, sizes[i].astype(np.int64), sizes[j].astype(np.int64), percent)
            pairs = np.unique(np.stack([keys[i[fit]], keys[j[fit]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:  # whole parts at a time: a batch may end within one
            if not b.num_rows:
                continue
            tokens = b.column(0).to_numpy()
            cut = int(np.searchsorted(tokens, tokens[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != tokens[0]):
                done = [*held, b.slice(0, cut)]
                held = []
                yield from close(done)
            held.append(b.slice(cut))
        if held:
            yield from close(held)

    n = int(open_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = open_rows.withColumn("tail", F.col("rank") < 0).repartition(n, "token").sortWithinPartitions("token", "tail", "key")
    return map_arrow(rows, run, "a long, b long").distinct()


def with_odd_bits(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows with `odd`, the sketch of their set (key), folded to LEAST_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folded(x, LEAST_BITS // 8).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["key", "odd"])

    return rows.join(map_arrow(sets.select("key", "sketch"), run, "key long, odd binary").hint("merge"), "key")


def probably(column: str, wanted: DataFrame) -> Column:
    """Whether a row of `wanted` (one column of longs) may have the value: a filter of FILTER_BITS bits, whatever the number of rows."""
    bit = F.expr(f"pmod(xxhash64(v), {FILTER_BITS}) + 1")  # bitmaps count from 1
    maps = wanted.toDF("v").select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for r in maps:
        bits[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    held = wanted.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def in_filter(at: pd.Series) -> pd.Series:
        k = at.to_numpy()
        return pd.Series((held.value[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool))

    return in_filter(F.expr(f"pmod(xxhash64({column}), {FILTER_BITS})"))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, rep_a, rep_b) of the pairs whose sketches allow a link."""
    known = sets.select("key", "rep", "n", "sketch")
    both = pairs.join(known.toDF("a", "rep_a", "n_a", "sketch_a").hint("merge"), "a").join(known.toDF("b", "rep_b", "n_b", "sketch_b").hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches = zip(*(b.column(k).to_pylist() for k in range(4, 8)), strict=True)
            keep = pa.array([may_link(differing_bits(x, y), n, m, percent) for x, y, n, m in sketches], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:4]], names=b.schema.names[:4])

    return map_arrow(both.select("a", "b", "rep_a", "rep_b", "sketch_a", "sketch_b", "n_a", "n_b"), run, "a long, b long, rep_a long, rep_b long")


def measured(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """(a, b, distance, linked) of the pairs (a, b) of set keys that sketches leave open, from the texts of the sets' first documents.

    Each a is the pivot of a part whose members are its b; a part of many members is split, and its pivot's text goes to
    every piece. A doc_id may stand for several texts, so a text must have the set that is asked for.
    """
    pairs = saved(possible(pairs, sets, percent), "jaccard-possible")
    w = pairs.groupBy("a").agg(F.expr(f"(count(*) + {MEMBERS_PER_TASK - 1}) div {MEMBERS_PER_TASK}").alias("parts"), F.first("rep_a").alias("rep"))
    members = pairs.join(w.select("a", "parts"), "a").select(F.col("b").alias("key"), F.col("a").alias("pivot"), F.expr("pmod(xxhash64(b), parts)").alias("part"), F.lit(1).alias("role"), F.col("rep_b").alias("rep"))
    pivots = w.select(F.col("a").alias("key"), F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "rep")
    wanted = saved(members.unionByName(pivots), "jaccard-wanted")
    held = docs.where("text IS NOT NULL").where(probably(NAME, wanted.select("rep"))).select(F.expr(NAME).alias("rep"), "text")
    rows = wanted.hint("merge").join(held, "rep").select("pivot", "part", "role", "key", "text")  # the same plan at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own, done = None, None, None
        for b in batches:
            out = []
            for p, part, role, key, text in zip(*(b.column(k).to_pylist() for k in range(4)), texts(b), strict=True):
                if done == (p, part, role, key) or (role == 0 and p == pivot):  # a repeated row
                    continue
                other = shingles(text, words_each)
                if set_key(other) != key:
                    continue
                done = p, part, role, key
                if role == 0:
                    pivot, own = p, other
                    continue
                inter = len(np.intersect1d(own, other, assume_unique=True))
                out.append((p, key, 1 - inter / (len(own) + len(other) - inter), bool(linked(inter, len(own), len(other), percent))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["a", "b", "distance", "linked"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(rows.repartition(n, "pivot", "part").sortWithinPartitions("pivot", "part", "role", "key"), run, "a long, b long, distance double, linked boolean")


def ends_of(links: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the nodes of linked sets."""
    nodes = sets.select("key", "node")
    ends = links.where("linked").select(F.col("a").alias("ka"), F.col("b").alias("kb"))
    return ends.join(nodes.toDF("ka", "a"), "ka").join(nodes.toDF("kb", "b"), "kb").where("a <> b").select("a", "b")


def within_two_links(ends: DataFrame) -> DataFrame:
    """(node, component): the smallest node within two links. Nodes with the same one are connected, so it serves to leave pairs out."""
    both = ends.toDF("u", "v").unionByName(ends.toDF("v", "u"))
    one = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    two = both.join(one.toDF("v", "n"), "v").groupBy("u").agg(F.min("n").alias("n"))
    return one.join(two, "u").select(F.col("u").alias("node"), F.least("m", "n").alias("component"))


def by_node(sets: DataFrame, found: DataFrame) -> DataFrame:
    """key, node and the columns of `found` (node and others) for every set, null where it lacks the node.

    The sets of a pivot's component are one node, numbered below DRAWN; so many of them fetch theirs from a table of at most DRAWN rows.
    """
    own = sets.select("key", "root", "node")
    few = F.broadcast(found.where(F.col("node").between(0, DRAWN - 1)))
    return own.where("root >= 0").join(few, "node", "left").unionByName(own.where("root < 0").join(found, "node", "left")).drop("root")


def jaccard_components(docs: DataFrame, words_each: int = SHINGLE_WORDS, percent: int = PERCENT, with_group: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every row.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets. Null and empty texts and
    texts of white space have no shingle and link with nothing, not even each other: their component is their own
    doc_id. Repeated rows repeat, and rows that share a doc_id but not the text are points of their own; a row without doc_id is a
    point like any other, which connects others and takes its component's id, null if no row of it has one; an empty table gives no rows; other columns are not read. Sets are known by
    64-bit hashes of their 64-bit shingle hashes. Ties of a distance go to the first centre. With with_group also
    `text_hash` and `group`, a number of the component that is not shared if components share a doc_id (null without shingles).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    drawn = draw(docs, words_each, percent)
    pivots = spark.sparkContext.broadcast(drawn)
    passed = saved(first_pass(docs, pivots, words_each), "jaccard-sets")
    drop_finished(spark)
    joined = passed.where("kind = 2").select("a", "b").distinct().collect()  # at most all pairs of pivots
    root = roots(len(drawn.sizes), [*drawn.links, *((r["a"], r["b"]) for r in joined)])
    own = passed.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), F.col("n").alias("n_shingles"), "pivot", F.col("h").alias("text_hash"), "sketch")
    of_pivot = F.broadcast(spark.createDataFrame([(-1, -1), *enumerate(root.tolist())], "pivot int, root int"))
    first_row = F.coalesce(F.min("doc_id"), F.min("text_hash")).alias("rep")  # as NAME, for a set without any id by its text
    keyed = own.where("key IS NOT NULL").groupBy("key").agg(first_row, F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.max("pivot").alias("pivot"), F.max("sketch").alias("sketch")).join(of_pivot, "pivot").drop("pivot")
    keyed = saved(keyed, "jaccard-keys")
    sets = keyed.withColumn("node", F.when(F.col("root") >= 0, F.col("root").cast("long")).otherwise(F.col("key")))
    total = keyed.agg(F.sum("n")).first()[0] or 0
    frequent = passed.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT).collect()
    order = spark.sparkContext.broadcast(Order([(r["a"], r["n"]) for r in reversed(frequent)]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * n, total // (4 * REGION_ROWS) + 1)
    regions = saved(shared_regions(prefix_rows(docs, order, pivots, root, buckets, words_each, percent)), "jaccard-regions")
    drop_finished(spark)
    done = saved(measured(first_pairs(regions, percent), sets, docs, words_each, percent), "jaccard-links")
    ends = saved(ends_of(done, sets), "jaccard-ends")
    large, first = saved(large_parts(regions), "jaccard-large"), PIVOTS
    while True:
        drop_finished(spark)
        nearest = done.groupBy(F.col("b").alias("key")).agg(F.min(F.struct("distance", "a")).alias("m")).select("key", F.col("m.a").alias("pivot"), F.col("m.distance").alias("distance"))
        labels = by_node(sets, within_two_links(ends)).select("key", F.coalesce("component", "node").alias("component"))
        marked = large.join(labels, "key").join(nearest, "key", "left")
        marked = saved(marked.select("token", "key", "size", "place", "rank", "component", F.coalesce("pivot", "key").alias("pivot"), F.coalesce("distance", F.lit(0.0)).alias("distance")), "jaccard-marked")
        split = marked.groupBy("token").agg((F.min("component") != F.max("component")).alias("open"), F.max("rank").alias("most")).where((F.col("most") >= first) & F.col("open")).select("token", "most")
        most = split.agg(F.max("most")).first()[0]
        if most is None:
            break
        large = marked.join(split.select("token"), "token", "left_semi")
        pairs = saved(later_pairs(with_odd_bits(large, sets), first, first * GROW, percent), "jaccard-pairs")
        if pairs.take(1):
            drop_finished(spark)
            more = saved(measured(pairs, sets, docs, words_each, percent), "jaccard-links")
            done, ends = done.unionByName(more), ends.unionByName(saved(ends_of(more, sets), "jaccard-ends"))
        large, first = saved(large.select("token", "key", "size", "place", "rank"), "jaccard-large"), first * GROW
    drop_finished(spark)
    nodes = sets.groupBy("node").agg(F.min("least").alias("least")).join(connected_components(ends), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(nodes.join(ids, "component").select("node", "component_id", F.col("component").alias("group")), "jaccard-components")
    final = by_node(sets, named).select("key", "component_id", *(["group"] if with_group else []))
    salted = final.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_set = own.where("key IS NOT NULL").withColumn("salt", F.expr(f"int(pmod(xxhash64(doc_id), {SALTS}))")).join(salted, ["key", "salt"], "left")
    without = own.where("key IS NULL").withColumn("component_id", F.col("doc_id"))
    out = with_set.unionByName(without, allowMissingColumns=True)
    return out.select("doc_id", "n_shingles", "component_id", *(["text_hash", "group"] if with_group else []))


def op10_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; cases as in `jaccard_components`."""
    return jaccard_components(documents(spark, sf_dir))


QUERIES = {"op10_jaccard_metric_join": op10_jaccard_metric_join}
SQL = {
    "op10_jaccard_metric_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY 1) r ON r.doc_id = d.doc_id
"""
}
