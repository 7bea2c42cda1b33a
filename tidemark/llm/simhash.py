"""SimHash near-duplicates: vantage-point trees deal fingerprints into shards, and exact pairs are found within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LOWER, documents, map_arrow, record, saved, split_words, texts
from .components import connected_components

WORDS, SEED, DISTANCE = 4, 42, 4
#: Shingles counted at once, fingerprints that trees are grown from, wanted fingerprints of a shard, least sample of a node that is divided.
RUN, SAMPLE, SHARD, NODE = 1 << 16, 1 << 15, 1024, 16
#: A shard of more fingerprints than this is dealt to several tasks. Tests at once: TILE fingerprints against those of a shard.
PART, TILE = 8192, 256
#: Fingerprints of more than a 1/HOT of all rows (so at most HOT of them) are looked up by broadcast.
HOT = 1024
#: Links of a fingerprint, and fingerprints of a component, are dealt to so many tasks.
SALTS = 16


def fingerprint(text: bytes, width: int = WORDS, seed: int = SEED) -> int:
    """Bit i is set if it is set in more than half of the XXH64 of the text's word shingles, repeats included; 0 without words."""
    words = split_words(text.translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    counts, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, RUN):
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:z], seed) for a, z in zip(starts[k : k + RUN].tolist(), ends[k : k + RUN].tolist(), strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed 64-bit number; null counts as no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, width, seed) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def slices(distance: int) -> list[tuple[int, int]]:
    """(mask, radius) of slices of the 64 bits so that fingerprints at most `distance` bits apart are at most `radius` bits apart in one.

    The radii and one more each sum up to distance + 1: were every slice beyond its radius, the whole would be beyond the distance.
    """
    radii = [1] * ((distance + 1) // 2) + [0] * ((distance + 1) % 2)
    weights = np.cumsum([0, *(3 if r else 2 for r in radii)])
    edges = (64 * weights // weights[-1]).tolist()
    return [(((1 << z) - 1) ^ ((1 << a) - 1), r) for a, z, r in zip(edges[:-1], edges[1:], radii, strict=True)]


class Tree:
    """A vantage-point tree by Hamming distance over a slice: nodes as arrays, a child below zero is the shard ~child."""

    def __init__(self, sample: np.ndarray, n: int, mask: int, radius: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.vantage, self.split, self.low, self.high, self.shards = [], [], [], [], 0
        self.root = self.grow(sample, max(n, 1) / max(len(sample), 1))
        self.vantage, self.split, self.low, self.high = (np.array(x, t) for x, t in ((self.vantage, np.uint64), (self.split, np.int64), (self.low, np.int64), (self.high, np.int64)))

    def far(self, fps: np.ndarray, vantage: np.ndarray | np.uint64) -> np.ndarray:
        return np.bitwise_count((fps ^ vantage) & self.mask).astype(np.int64)

    def grow(self, held: np.ndarray, weight: float) -> int:
        """A node that divides what the sample's rows stand for, or a shard where that is small or no vantage point divides it."""
        best = None
        if len(held) >= NODE and len(held) * weight > SHARD:
            for v in held[:: max(1, len(held) // 8)]:
                count = np.bincount(self.far(held, v), minlength=65 + self.radius) / len(held)
                for m in np.flatnonzero(count)[:-1]:
                    low, r = count[: m + 1].sum(), self.radius
                    cost = low * count[: m + r + 1].sum() + (1 - low) * count[max(0, m - r + 1) :].sum()
                    if best is None or cost < best[0]:
                        best = cost, v, int(m)
        if best is None or best[0] > 0.98:
            self.shards += 1
            return -self.shards
        at, far = len(self.vantage), self.far(held, best[1])
        for x, value in ((self.vantage, best[1]), (self.split, best[2]), (self.low, 0), (self.high, 0)):
            x.append(value)
        self.low[at], self.high[at] = self.grow(held[far <= best[2]], weight), self.grow(held[far > best[2]], weight)
        return at

    def places(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home) of every shard that a ball around a fingerprint reaches, from its home shard on.

        A branch is left out where the triangle bound shows that the ball does not reach it. Of two fingerprints in reach of each
        other the one with the lower home visits the other's home, so shards below a fingerprint's home are left out too.
        """
        at, node, home = np.arange(len(fps)), np.full(len(fps), self.root), np.ones(len(fps), bool)
        found = []
        while len(at):
            done = node < 0
            found.append((at[done], -1 - node[done], home[done]))
            at, node, home = at[~done], node[~done], home[~done]
            far, split = self.far(fps[at], self.vantage[node]), self.split[node]
            low, high, own = far - self.radius <= split, far + self.radius > split, far <= split
            at, node, home = np.concatenate([at[low], at[high]]), np.concatenate([self.low[node[low]], self.high[node[high]]]), np.concatenate([(home & own)[low], (home & ~own)[high]])
        at, shard, home = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, node, home)
        own = np.zeros(len(fps), np.int64)
        own[at[home]] = shard[home]
        keep = shard >= own[at]
        return at[keep], shard[keep], home[keep]


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[k] and b[k]; label gives each element the least element of its set."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= distance


class Shard:
    """Links within one part of a shard: its own fingerprints among each other, and those of visitors as they pass."""

    def __init__(self, own: np.ndarray, distance: int):
        self.own, self.distance, self.label = own, distance, np.arange(len(own))
        for k in range(0, len(own), TILE):
            a, b = np.nonzero(near(own[k : k + TILE], own[k:], distance))
            union(self.label, a + k, b + k)

    def visit(self, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visitor, own) links, one a visitor; what else a visitor is near to is joined within the shard."""
        for k in range(0, len(others), TILE):
            some = others[k : k + TILE]
            found = near(some, self.own, self.distance)
            a, b = np.nonzero(found)
            if len(a):
                first = found.argmax(axis=1)
                union(self.label, first[a], b)
                has = np.unique(a)
                yield some[has], self.own[first[has]]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        return self.own, self.own[self.label]


def shard_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect whatever is within the distance, from rows (cell, part, visits, fps) sorted by the first three."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        apart = a != b
        return pa.RecordBatch.from_arrays([pa.array(x[apart].view(np.int64)) for x in (a, b)], schema=schema)

    now, own, shard = None, [], None
    for batch in batches:
        for cell, part, visits, fps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (cell, part):
                if own or shard:
                    yield out(*(shard or Shard(np.concatenate(own), distance)).close())
                now, own, shard = (cell, part), [], None
            fps = np.frombuffer(fps, np.uint64)
            if not visits:
                own.append(fps)
            elif own or shard:  # a shard without fingerprints of its own has nothing to link
                shard = shard or Shard(np.concatenate(own), distance)
                for a, b in shard.visit(fps):
                    yield out(a, b)
    if own or shard:
        yield out(*(shard or Shard(np.concatenate(own), distance)).close())


def dealt(batches: Iterator[pa.RecordBatch], trees: list[Tree]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, home, n, fps): a task's fingerprints of each tree's shards, those at home and those that visit."""
    schema = pa.schema([("cell", pa.int64()), ("home", pa.bool_()), ("n", pa.int64()), ("fps", pa.binary())])

    def close(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fps = np.concatenate(held)
        for k, tree in enumerate(trees):
            at, shard, home = tree.places(fps)
            by = np.lexsort((home, shard))
            at, key = fps[at[by]], 2 * shard[by] + home[by]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for first in range(0, len(edges) - 1, 256):
                some = list(zip(edges[first : first + 256], edges[first + 1 : first + 257], strict=False))
                yield record([((k << 32) + int(key[a]) // 2, bool(key[a] % 2), int(z - a), at[a:z].tobytes()) for a, z in some if a < z], schema)

    held = []
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        if sum(map(len, held)) >= RUN:
            yield from close(held)
            held = []
    if held:
        yield from close(held)


def split_parts(batches: Iterator[pa.RecordBatch], parts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, visits, fps): a large shard's own fingerprints over its parts, and all of them as visitors of every part."""
    schema = pa.schema([("cell", pa.int64()), ("part", pa.int32()), ("visits", pa.bool_()), ("fps", pa.binary())])
    for b in batches:
        for cell, home, _, fps in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = parts.get(cell, 1)
            rows = []
            if home:
                own = np.frombuffer(fps, np.uint64)
                part = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)
                rows += [(cell, p, False, own[part == p].tobytes()) for p in range(n)]
            if not home or n > 1:
                rows += [(cell, p, True, fps) for p in range(n)]
            yield record(rows, schema)


def simhash_components(docs: DataFrame, width: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over fingerprints at most `distance` bits apart.

    Copies are one fingerprint. Distances to a vantage point over all 64 bits lie close together, so a ball of that radius would
    cross most of a tree's branches; so each slice of the bits has its own tree with a smaller radius (`slices`), and pairs that
    meet in a shard are tested on all bits. Shards send on links that connect what is near, not every pair of a dense group.
    Null and wordless texts have fingerprint 0 and are linked like any other. A row without doc_id connects others but names no
    component: it takes its component's, null if no row of it has an id. Repeated rows and ties share a component; no rows give none.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(fingerprints(docs, width, seed), "simhash-rows")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-fingerprints")
    total, count = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [Tree(sample, count, mask, radius) for mask, radius in slices(distance)]
    cells = saved(map_arrow(nodes.select("fp"), lambda b: dealt(b, trees), "cell long, home boolean, n long, fps binary"), "simhash-cells")
    large = cells.where("home").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > PART).collect()  # cells are bounded by the sample
    parts = {r["cell"]: -(-r["n"] // PART) for r in large}
    tasks = map_arrow(cells, lambda b: split_parts(b, parts), "cell long, part int, visits boolean, fps binary")
    tasks = tasks.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "visits")
    links = map_arrow(tasks, lambda b: shard_links(b, distance), "a long, b long")
    found = saved(connected_components(links, SALTS).withColumnRenamed("node", "fp"), "simhash-components")
    # the least doc_id of each component, by its node; components of one fingerprint need no look-up
    joined = nodes.join(found, "fp", "left")
    least = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    salted = joined.where("component IS NOT NULL").select("fp", "copies", "component", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    linked = salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["component", "salt"]).select("fp", "copies", "component_id")
    named = saved(linked.unionByName(joined.where("component IS NULL").select("fp", "copies", F.col("least").alias("component_id"))), "simhash-names")
    often = named.where(F.col("copies") > total // HOT).drop("copies")
    rare = named.where(F.col("copies") <= total // HOT).drop("copies")
    by_copy = rows.join(F.broadcast(often), "fp")
    alone = rows.join(F.broadcast(often), "fp", "left_anti").join(rare, "fp")
    return by_copy.unionByName(alone).select("doc_id", "fp", "component_id")


def op13_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at four or fewer of 64 bits; cases as in `simhash_components`."""
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op13_simhash_vantage": op13_simhash_vantage}
#: SQL has no XXH64; the tests compare with a brute force over all pairs.
SQL: dict[str, str] = {}
