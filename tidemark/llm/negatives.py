"""Hard negatives by a secondary sort: scored pairs packed into (anchor, descending score, id) keys, streamed past open windows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_arrow, record, saved

#: Rows of a chunk, anchors of a block, anchors that are scored against a chunk at once, chunks that a task streams past a block.
CHUNK, BLOCK, TILE, STREAM = 2048, 4096, 256, 512
#: Components count as no larger than COMPONENT, scores as no larger than SCORE (in magnitude); both keep integers exact.
COMPONENT, SCORE = 1 << 53, 1 << 62
LEAST = np.iinfo(np.int64).min
CHUNKS = "chunk long, ids binary, labels binary, anchors binary, kind string, dim int, vectors binary"
BLOCKS = "block long, ids binary, labels binary, chunks binary, places binary, kind string, dim int, vectors binary"
PAIRS = "block long, place int, anchor_id long, score long, id long, chunk long, pos int"
#: A pair's key: block and place of the anchor (12 bytes, they choose the partition), descending score, whether it is a negative, id, chunk and place.
KEY = ">QIQBQQI"
ANCHOR = 12


def numbered(counter: list[int]) -> int:
    """A number that no other task gives: the partition's and a count."""
    counter[0] += 1
    return (TaskContext.get().partitionId() << 33) + counter[0]


def small(vectors: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest integer type that holds them."""
    most = np.abs(vectors).max(initial=0)
    kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 62)) if most < top)
    return kind, vectors.astype(kind).tobytes()


def chunked(scale: float) -> callable:
    """Packs rows (id, label, anchor, vector) into chunks of whole numbers floor(scale * x), sorted by id."""
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchors", pa.binary()), ("kind", pa.string()), ("dim", pa.int32()), ("vectors", pa.binary())])

    def pack(rows: list[tuple], count: list[int]) -> pa.RecordBatch:
        ids, labels, anchors = (np.array([r[k] for r in rows], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.uint8)))
        dim = max(len(r[3]) for r in rows)
        vectors = np.zeros((len(rows), dim))
        for k, r in enumerate(rows):
            vectors[k, : len(r[3])] = r[3]
        with np.errstate(over="ignore"):
            vectors = np.clip(np.floor(scale * vectors), -COMPONENT, COMPONENT)
        by = np.argsort(ids, kind="stable")
        kind, blob = small(vectors[by])
        return record([(numbered(count), ids[by].tobytes(), labels[by].tobytes(), anchors[by].tobytes(), kind, dim, blob)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], [0]
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns[:3]), (np.asarray(v, np.float64) for v in b.column(3).to_pylist()), strict=True)
            while len(held) >= CHUNK:
                yield pack(held[:CHUNK], count)
                held = held[CHUNK:]
        if held:
            yield pack(held, count)

    return run


def matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["dim"]) if row["dim"] else np.zeros((len(row["ids"]) // 8, 0), np.int16)


def widened(m: np.ndarray, dim: int) -> np.ndarray:
    """Shorter vectors end in zeros."""
    return np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of a partition's chunks in blocks, each with its row's chunk and place."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("chunks", pa.binary()), ("places", pa.binary()), ("kind", pa.string()), ("dim", pa.int32()), ("vectors", pa.binary())])
    count = [0]

    def close(held: list[tuple]) -> pa.RecordBatch:
        dim = max(h[4].shape[1] for h in held)
        kind, blob = small(np.concatenate([widened(h[4].astype(np.int64), dim) for h in held]))
        return record([(numbered(count), *(np.concatenate([h[k] for h in held]).tobytes() for k in range(4)), kind, dim, blob)], schema)

    held, n = [], 0
    for b in batches:
        for row in b.to_pylist():
            at = np.flatnonzero(np.frombuffer(row["anchors"], np.uint8))
            if len(at):
                held.append((np.frombuffer(row["ids"], np.int64)[at], np.frombuffer(row["labels"], np.int64)[at], np.full(len(at), row["chunk"], np.int64), at.astype(np.int64), matrix(row)[at]))
                n += len(at)
            if n >= BLOCK:
                yield close(held)
                held, n = [], 0
    if held:
        yield close(held)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where nothing rounds, else by unbounded integers."""
    dim = max(a.shape[1], b.shape[1])
    a, b = widened(a, dim), widened(b, dim)
    most = int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(b.astype(np.float64)).max(initial=0)) * dim
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -SCORE, SCORE).astype(np.int64)


def order_of(values: np.ndarray) -> np.ndarray:
    """Numbers that order each row by value and the first of equals; for huge values their places in that order."""
    n = values.shape[1]
    if int(np.abs(values).max(initial=0)) < (1 << 61) // max(n, 1):
        return values * n + (n - 1 - np.arange(n))
    order = np.empty_like(values)
    np.put_along_axis(order, np.argsort(-values, axis=1, kind="stable"), np.arange(n, 0, -1)[None, :], 1)
    return order


def best(order: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the columns of its k highest wanted numbers; and which of these there are."""
    n = order.shape[1]
    if not wanted.any():
        return np.zeros((len(order), 0), np.int64), np.zeros((len(order), 0), bool)
    at = np.argpartition(np.where(wanted, order, LEAST), n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), order.shape)
    return at, np.take_along_axis(wanted, at, 1)


def kept(state: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """The k best of both along the second axis; entries are (there, score, id, chunk, pos)."""
    both = new if state is None else np.concatenate([state, new], axis=1)
    by = np.lexsort((both[..., 4], both[..., 3], both[..., 2], -both[..., 1], 1 - both[..., 0]), axis=1)[:, :k]
    return np.take_along_axis(both, by[..., None], 1)


def entries(at: np.ndarray, there: np.ndarray, values: np.ndarray, ids: np.ndarray, chunk: int) -> np.ndarray:
    return np.stack([there.astype(np.int64), np.take_along_axis(values, at, 1), ids[at], np.full(at.shape, chunk, np.int64), at], axis=-1)


def search(find: callable) -> callable:
    """Runs over joined (chunk, block) rows; find(block row, anchors of a tile, chunk, scores, state) keeps each anchor's best pairs.

    The pairs of a task's block are kept while chunks pass and handed out at the end: (anchors x best) at most.
    """
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("anchor_id", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("chunk", pa.int64()), ("pos", pa.int32())])

    def close(block: int, ids: np.ndarray, state: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for start, found in sorted(state.items()):
            place = np.broadcast_to(np.arange(start, start + len(found))[:, None], found.shape[:2])[found[..., 0] == 1]
            rows = found[found[..., 0] == 1]
            # a negative may be among the best of several windows
            once = np.unique(np.column_stack([place, rows[:, 3:]]), axis=0, return_index=True)[1] if len(rows) else []
            place, rows = place[once], rows[once]
            columns = [np.full(len(place), block), place.astype(np.int32), ids[place], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            for row in b.to_pylist():
                if row["block"] not in held:
                    anchors = {k: np.frombuffer(row[k], np.int64) for k in ("labels", "chunks", "places")}
                    held[row["block"]] = np.frombuffer(row["ids"], np.int64), anchors, matrix(row), {}
                ids, anchors, vectors, state = held[row["block"]]
                chunk = {"chunk": row["chunk"], "ids": np.frombuffer(row["r_ids"], np.int64), "labels": np.frombuffer(row["r_labels"], np.int64)}
                others = matrix({"vectors": row["r_vectors"], "kind": row["r_kind"], "dim": row["r_dim"], "ids": row["r_ids"]})
                for start in range(0, len(ids), TILE):
                    tile = slice(start, start + TILE)
                    state[start] = find(row, tile, {k: v[tile] for k, v in anchors.items()}, chunk, scores(vectors[tile], others), state.get(start))
        for block, (ids, _, _, state) in held.items():
            yield from close(block, ids, state)

    return run


def positives_in(k: int) -> callable:
    def find(row, tile, anchors, chunk, values, state):  # noqa: ANN001
        same = anchors["labels"][:, None] == chunk["labels"]
        own = np.flatnonzero(anchors["chunks"] == chunk["chunk"])
        same[own, anchors["places"][own]] = False
        at, there = best(order_of(values), same, k)
        return kept(state, entries(at, there, values, chunk["ids"], chunk["chunk"]), k)

    return find


def negatives_in(k: int, keep: int, low: int, high: int) -> callable:
    def find(row, tile, anchors, chunk, values, state):  # noqa: ANN001
        differs = anchors["labels"][:, None] != chunk["labels"]
        lows, highs = np.full((len(values), k), 1, np.int64), np.zeros((len(values), k), np.int64)
        for p in row["positives"]:
            if tile.start <= p["place"] < tile.start + len(values):
                lows[p["place"] - tile.start, p["nth"]], highs[p["place"] - tile.start, p["nth"]] = window(p["score"], low, high)
        parts, order = [], order_of(values)
        for nth in range(k):
            at, there = best(order, differs & (values >= lows[:, nth, None]) & (values <= highs[:, nth, None]), keep)
            new = entries(at, there, values, chunk["ids"], chunk["chunk"])
            parts.append(padded(kept(None if state is None else state[:, nth * keep : (nth + 1) * keep], new, keep), keep))
        return np.concatenate(parts, axis=1)

    return find


def padded(found: np.ndarray, k: int) -> np.ndarray:
    return np.pad(found, ((0, 0), (0, k - found.shape[1]), (0, 0)))


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The lowest and highest negative score n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def pair_key(negative: int) -> callable:
    def key(r) -> tuple[bytes, int]:  # noqa: ANN001
        return struct.pack(KEY, r["block"], r["place"], (1 << 63) - 1 - r["score"], negative, r["id"] + (1 << 63), r["chunk"], r["pos"]), r["anchor_id"]

    return key


def by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:ANCHOR])


def first_positives(rows: Iterator[tuple[bytes, int]], k: int) -> Iterator[tuple]:
    """(block, place, anchor_id, score, id, chunk, pos, nth) of each anchor's first k pairs."""
    now, n = None, 0
    for key, anchor_id in rows:
        if key[:ANCHOR] != now:
            now, n = key[:ANCHOR], 0
        if n < k:
            block, place, down, _, up, chunk, pos = struct.unpack(KEY, key)
            yield block, place, anchor_id, (1 << 63) - 1 - down, up - (1 << 63), chunk, pos, n
            n += 1


def past_windows(rows: Iterator[tuple[bytes, int]], keep: int, low: int, high: int) -> Iterator[tuple]:
    """Streams an anchor's pairs by descending score: a positive opens a window, a negative is given to each open one that has room.

    Only the open windows are held; one closes when it is full or the scores have fallen below it.
    """
    now, held = None, []
    for key, anchor_id in rows:
        if key[:ANCHOR] != now:
            now, held = key[:ANCHOR], []
        _, _, down, negative, up, _, _ = struct.unpack(KEY, key)
        score, other = (1 << 63) - 1 - down, up - (1 << 63)
        if not negative:
            held.append([other, score, *window(score, low, high), 0])
            continue
        for w in held:
            if w[2] <= score <= w[3] and w[4] < keep:
                w[4] += 1
                yield anchor_id, w[0], w[4], other, w[1], score
        held = [w for w in held if w[2] <= score and w[4] < keep]


def hard_negatives(rows: DataFrame, positives: int = 5, keep: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, vector, anchor).

    A score is the integer inner product of floor(scale * x); higher ones come first, ties by smaller id. An anchor's positives are
    its first `positives` other rows of the same label; each gets its first `keep` rows of another label whose score is from `low`
    to `high` percent of its own. Rows with a null id, label or vector or a null or non-finite component take no part; a null `anchor`
    is false. A shorter vector ends in zeros. Repeated rows are rows of their own: each can be the other's positive, and each repeated
    anchor has its own results. Components count as at most 2**53 and scores as at most 2**62 in magnitude. Other columns play no part.

    Rows are packed into chunks once, anchors into blocks. A task streams a part of the chunks past a block and keeps its anchors'
    best pairs (what cannot be among an anchor's first pairs is not shuffled). Blocks and chunks are dealt once and met as a Cartesian
    product of partitions, so neither is copied by the shuffle or broadcast by the driver. Then pairs are sorted by their keys and
    streamed, first to find the positives, then past the windows that these open.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.coalesce("anchor", F.lit(False)).cast("int").alias("anchor"), F.col("vector").cast("array<double>"))
    chunks = saved(map_arrow(rows, chunked(scale), CHUNKS), "negatives-chunks")
    blocks = saved(map_arrow(chunks, blocks_of, BLOCKS), "negatives-blocks")
    many, packs = chunks.count(), max(1, blocks.count())
    streams = max(1, min(many, -(-n // packs)), -(-many // STREAM))
    others = chunks.select("chunk", *(F.col(c).alias(f"r_{c}") for c in ("ids", "labels", "kind", "dim", "vectors"))).repartition(streams)

    def pairs(sides: DataFrame, find: callable) -> DataFrame:
        return map_arrow(others.crossJoin(sides.repartitionByRange(packs, "block").hint("shuffle_replicate_nl")), search(find), PAIRS)

    def in_order(*sides: tuple[DataFrame, int]):  # noqa: ANN202
        keyed = [df.rdd.map(pair_key(negative)) for df, negative in sides]
        return spark.sparkContext.union(keyed).repartitionAndSortWithinPartitions(n, by_anchor) if len(keyed) > 1 else keyed[0].repartitionAndSortWithinPartitions(n, by_anchor)

    first = in_order((pairs(blocks, positives_in(positives)), 0)).mapPartitions(lambda it: first_positives(it, positives))
    found = saved(spark.createDataFrame(first, f"{PAIRS}, nth int", verifySchema=False), "negatives-positives")
    opened = found.groupBy("block").agg(F.collect_list(F.struct("place", "nth", "score")).alias("positives"))
    closed = saved(pairs(blocks.join(opened.hint("merge"), "block"), negatives_in(positives, keep, low, high)), "negatives-pairs")
    mined = in_order((found, 0), (closed, 1)).mapPartitions(lambda it: past_windows(it, keep, low, high))
    return spark.createDataFrame(mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every fiftieth row of embeddings; a seventh of the labels is moved first.

    Nulls, ties and repeated rows as in `hard_negatives`.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {
    "op12_hard_negatives": """
WITH quantised AS (
  SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row_id AS anchor_row, a.vec_id AS anchor_id, r.row_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM quantised a JOIN quantised r ON a.vec_id % 50 = 0 AND a.row_id <> r.row_id
), positives AS (
  SELECT anchor_row, anchor_id, row_id AS positive_row, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_row = p.anchor_row AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_row, p.positive_row ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
}
