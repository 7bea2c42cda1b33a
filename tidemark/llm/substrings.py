"""Removal of long byte strings that occur more than once, by suffix arrays over shards of anchored regions.

A string of LENGTH bytes has a smallest hash among its SEED-byte windows, its anchor; equal strings have equal anchors. So only
strings whose anchor occurs twice can be repeated (a few per cent of a text, as a rule), and all occurrences of a
string meet in the shard of its anchor. Each shard is sorted as one suffix array, neighbours that share LENGTH
bytes are repeats, and shards of one bucket are merged by binary search. An anchor with many different regions is
split by what its strings share beside the anchor, see `split_hot`, so that no shard grows with the number of documents.

Passages of words are found the same way in spelled texts, where each word is a hash of CODE bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import by_bucket, documents, map_arrow, packed, record, saved, split_words, texts
from .suffix_array import common_prefixes, find, suffix_array

LENGTH, SEED = 400, 96
#: Words of a passage, bytes of a word's hash, words whose hashes a task remembers.
WORDS, CODE, FLUSH_WORDS = 50, 8, 200_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Starts of strings handled at once, bytes of a suffix array, runs that a task packs at a time, bytes a bucket is meant for.
CHUNK, SHARD_BYTES, FLUSH_RUNS, BUCKET_BYTES = 1 << 20, 1 << 21, 200_000, 1 << 21
#: Runs of one group that a task takes as they are, and parts into which each round splits the runs of larger ones.
HOT_RUNS, SPLIT = 4096, 8
RADIX = 0x5851F42D4C957F2D
PLACE = np.uint64((1 << 22) - 1)
RUN = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("keys", pa.binary()), ("firsts", pa.binary()), ("lasts", pa.binary())])
RUN_DDL = "bucket int, anchors binary, keys binary, firsts binary, lasts binary"
REGION = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("firsts", pa.binary()), ("data", pa.binary())])
REGION_DDL = "bucket int, anchors binary, owners binary, sizes binary, keys binary, firsts binary, data binary"
MARK = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
PIECE = pa.schema([("again", pa.bool_()), ("key", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("digest", pa.binary())])
PIECE_DDL = "again boolean, key long, anchor long, first long, last long, digest binary"
#: Different pieces that a task remembers at a time.
FLUSH_PIECES = 100_000


def text_key(column: str = "text") -> Column:
    """A 64-bit hash that stands for a text: copies of one text are handled once."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(RADIX, -1, 1 << 64)
    up, down = np.full(n, RADIX, np.uint64), np.full(n, back, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A mixed hash of the bytes of each window: differences of one running sum, shifted to place 0."""
    up, down = powers(CHUNK + LENGTH + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    x = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: running minima of blocks from both sides."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(text: bytes, length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first, last) of runs of string starts with the same anchor, in pieces of at most CHUNK starts."""
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, len(whole) - length + 1, CHUNK):
        data = whole[at : at + CHUNK + length - 1]
        hashes = window_hashes(data, seed)
        marked = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_minimum(marked, length - seed + 1) & PLACE).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        yield hashes[place[starts]], starts + at, np.append(starts[1:], len(place)) - 1 + at


def digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


class Codes(dict):
    """Hashes of the words met so far."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= FLUSH_WORDS:
            self.clear()
        self[word] = code = digest(word, CODE)
        return code


def speller(words: bool) -> Callable[[bytes], bytes]:
    """What strings are sought in: the text itself, or the hashes of its words side by side."""
    if not words:
        return lambda text: text
    codes = Codes()
    return lambda text: b"".join([codes[w] for w in split_words(text)])


def runs(docs: DataFrame, buckets: int, length: int, seed: int, words: bool = False) -> DataFrame:
    """Packed runs of every text, dealt by anchor; a text that a task meets again is left out.

    Equal runs of a task are repeats whole: all are marked, in buckets below -buckets, and only one of them goes on. Two
    different runs of an anchor prove it repeated, so the further ones of a task are dealt by text, to buckets from -1 down.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, whole, total = [], set(), {}, 0
        spell = speller(words)

        def equal_ones(anchors, keys, firsts, lasts) -> tuple[np.ndarray, np.ndarray]:
            """Which runs have an equal one, and which of these go on."""
            by = np.argsort(anchors, kind="stable")
            same = np.append(False, anchors[by[1:]] == anchors[by[:-1]])
            by = by[same | np.append(same[1:], False)]
            again, first, first_of = np.zeros(len(anchors), bool), np.ones(len(anchors), bool), {}
            for i, anchor, key, a, z in zip(by.tolist(), anchors[by].tolist(), keys[by].tolist(), firsts[by].tolist(), lasts[by].tolist(), strict=True):
                j = first_of.setdefault((anchor, digest(whole[key][a : z + length])), i)
                if j != i:
                    again[i] = again[j] = True
                    first[i] = False
            return again, first

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            again, first = equal_ones(*columns)
            marks, columns = [x[again] for x in columns], [x[first] for x in columns]
            anchors, keys = columns[:2]
            by = np.argsort(anchors, kind="stable")
            sorted_anchors, third = anchors[by], np.zeros(len(by), bool)
            third[by[2:]] = sorted_anchors[2:] == sorted_anchors[:-2]
            for deal, own, bucket_of in (
                (anchors[~third], [x[~third] for x in columns], lambda b: b),
                (keys[third].view(np.uint64), [x[third] for x in columns], lambda b: -1 - b),
                (marks[1].view(np.uint64), marks, lambda b: -1 - buckets - b),
            ):
                for rows in packed(deal, own, buckets):
                    yield record([(bucket_of(b), *r) for b, *r in rows], RUN)

        for b in batches:
            for key, text in zip(b.column(1).to_pylist(), texts(b), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                whole[key] = text = spell(text)
                for anchors, firsts, lasts in anchored_runs(text, length, seed):
                    held.append((anchors, np.full(len(anchors), key, np.int64), firsts, lasts))
                    total += len(anchors)
            if total > FLUSH_RUNS:
                yield from flush()
                held, seen, whole, total = [], set(), {}, 0
        if held:
            yield from flush()

    return map_arrow(docs.select("text", F.col("__key").alias("key")), run, RUN_DDL)


def unpack(rows: list[tuple], kinds: tuple) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]


def repeated_runs(dealt: DataFrame, buckets: int) -> DataFrame:
    """(again, key, anchor, first, last): with `again` marks of repeats, else runs whose anchor another place has too."""

    def rows(again: bool, keys, anchors, firsts, lasts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), again)), *(pa.array(x) for x in (keys, anchors.astype(np.int64), firsts, lasts))], names=["again", "key", "anchor", "first", "last"])

    def close(bucket: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchors, keys, firsts, lasts = unpack(parts, (np.uint64, np.int64, np.int64, np.int64))
        if bucket < 0:
            yield rows(bucket < -buckets, keys, anchors, firsts, lasts)
            return
        by = np.lexsort((firsts, keys, anchors))
        anchors, keys, firsts, lasts = anchors[by], keys[by], firsts[by], lasts[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (anchors[1:] != anchors[:-1]) | (keys[1:] != keys[:-1]) | (firsts[1:] != firsts[:-1])
        anchors, keys, firsts, lasts = anchors[fresh], keys[fresh], firsts[fresh], lasts[fresh]
        same = np.zeros(len(anchors) + 1, bool)
        same[1:-1] = anchors[1:] == anchors[:-1]
        keep = same[1:] | same[:-1]
        yield rows(False, keys[keep], anchors[keep], firsts[keep], lasts[keep])

    return by_bucket(dealt, close, "again boolean, key long, anchor long, first long, last long")


def regions(wanted: DataFrame, buckets: int, length: int, words: bool = False) -> DataFrame:
    """Packed regions (the bytes of a run's strings) of the wanted texts, dealt by anchor; equal ones of a batch once, with all owners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(words)
        for b in batches:
            found: dict[tuple, list] = {}
            for key, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(spell, texts(b)), strict=True):
                for r in own:
                    found.setdefault((r["anchor"], text[r["first"] : r["last"] + length]), set()).add((key, r["first"]))
            if not found:
                continue
            by: dict[int, list] = {}
            for (anchor, data), owners in found.items():
                by.setdefault((((anchor & (1 << 64) - 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40) % buckets, []).append((anchor, data, owners))
            out = []
            for bucket, rows in by.items():
                owners = [o for _, _, own in rows for o in own]
                numbers = (np.array(x, np.int64).tobytes() for x in ([a for a, _, _ in rows], [len(o) for _, _, o in rows], [len(d) for _, d, _ in rows], [k for k, _ in owners], [f for _, f in owners]))
                out.append((bucket, *numbers, zstandard.ZstdCompressor(level=1).compress(b"".join(d for _, d, _ in rows))))
            for at in range(0, len(out), 100):
                yield record(out[at : at + 100], REGION)

    return map_arrow(wanted, run, REGION_DDL)


def pieces(text: bytes, first: int, last: int, width: int, length: int, seed: int) -> Iterator[tuple[int, int, int]]:
    """(group, first, last) of the parts of a run whose strings have the anchor at `width` neighbouring places.

    Equal strings have the anchor at equal places, so they fall into equal parts. All strings of a part have the bytes
    between its last start and its first end; these, with the places, make the group.
    """
    hashes = window_hashes(np.frombuffer(text, np.uint8, length, first), seed)
    place = first + int(np.argmin(hashes & ~PLACE))
    for k in range((place - last) // width, (place - first) // width + 1):
        deepest = min(k * width + width - 1, length - seed)
        core = text[place - k * width : place - deepest + length]
        yield int.from_bytes(digest(b"%d %d " % (width, k) + core, 8), "little", signed=True), max(first, place - deepest), min(last, place - k * width)


def cut_runs(wanted: DataFrame, width: int | None, length: int, seed: int, words: bool = False) -> DataFrame:
    """Runs of the wanted texts with the digest of their bytes, cut into parts before if a width is given.

    `again` is set on what a task has met before: these are repeats, and only the first of them (told apart by nothing
    but the place) goes on; it comes a second time with `again`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], tuple | None] = {}
        spell = speller(words)
        for b in batches:
            out = []
            for key, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(spell, texts(b)), strict=True):
                for r in own:
                    parts = [(r["anchor"], r["first"], r["last"])] if width is None else pieces(text, r["first"], r["last"], width, length, seed)
                    for group, first, last in parts:
                        known = group, digest(text[first : last + length])
                        row = key, group, first, last, known[1]
                        if known not in seen:
                            seen[known] = row
                            out.append((False, *row))
                            continue
                        if seen[known] is not None:
                            out.append((True, *seen[known]))
                            seen[known] = None
                        out.append((True, *row))
                    if len(out) > 50_000:
                        yield record(out, PIECE)
                        out = []
                    if len(seen) > FLUSH_PIECES:
                        seen.clear()
            yield record(out, PIECE)

    return map_arrow(wanted, run, PIECE_DDL)


def split_hot(found: DataFrame, with_text: Callable[[DataFrame], DataFrame], length: int, seed: int, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(runs of groups of at most HOT_RUNS runs, marks of repeats found before or on the way).

    Equal runs of a larger group are repeats whole, and one of them stands for all. If still more than HOT_RUNS
    different ones are left, they are cut into parts, first of a SPLIT-th of the anchor's places and at last of one,
    where a part is a string and its group holds nothing else. Only runs of groups that are too large are cut.
    """
    spark = found.sparkSession
    found = saved(found, "repeats-runs")
    done, marks, places, width = [], [found.where("again").select("key", "first", "last")], length - seed + 1, None
    found = found.where("NOT again").drop("again")
    while True:
        sizes = saved(found.groupBy("anchor").count().where(F.col("count") > HOT_RUNS).select("anchor"), "repeats-hot")
        if not sizes.take(1):
            return reduce(DataFrame.unionByName, [*done, found]), reduce(DataFrame.unionByName, marks, spark.createDataFrame([], "key long, first long, last long"))
        done.append(found.join(sizes, "anchor", "left_anti"))
        cut_now = saved(cut_runs(with_text(found.join(sizes, "anchor", "left_semi")), width, length, seed, words), "repeats-cut")
        marks.append(cut_now.where("again").select("key", "first", "last"))
        cut_now = cut_now.where("NOT again").select("key", "anchor", "first", "last", "digest")
        # Whoever is alone with its digest is a class of one; of a larger class all are marked and the smallest goes on.
        classes = saved(cut_now.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("one")), "repeats-classes")
        again = cut_now.join(classes.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
        marks.append(again.select("key", "first", "last"))
        different = classes.groupBy("anchor").count().where("count > 1").select("anchor")
        found = saved(classes.join(different, "anchor", "left_semi").select("one.key", "anchor", "one.first", "one.last"), "repeats-runs")
        width = places = -(-places // SPLIT)


class Shard:
    """Some regions side by side, their suffix array, and which string starts are repeats."""

    def __init__(self, parts: list[bytes], length: int):
        sizes = np.array([len(p) for p in parts])
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.ends = np.cumsum(sizes)
        inside = np.ones(len(self.data), bool)
        for k in range(length - 1):
            inside[self.ends - 1 - k] = False
        order, _ = suffix_array(self.data, length)
        shared = np.concatenate([common_prefixes(self.data, order) >= length, [False]])
        keep = inside[order]
        # Suffixes that start too near a region's end stand between others of their group and are passed over.
        group = np.cumsum(~shared[:-1])[keep]
        self.order = order[keep]
        self.heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        self.number = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1 if len(group) else np.zeros(0, np.int64)
        self.repeated = np.diff(np.append(self.heads, len(group))) > 1
        self.padded = np.concatenate([self.data, np.zeros(8, np.uint8)])

    def strings(self) -> np.ndarray:
        return self.order[self.heads]

    def flags(self) -> np.ndarray:
        out = np.zeros(len(self.data), bool)
        out[self.order] = self.repeated[self.number]
        return out


def merge(shards: list[Shard], length: int) -> None:
    """Marks strings that several shards have: those of each are searched in all later ones."""
    for i, a in enumerate(shards):
        for b in shards[i + 1 :]:
            at = find(a.padded, a.strings(), b.padded, b.strings(), length)
            a.repeated[at >= 0] = True
            b.repeated[at[at >= 0]] = True


def repeated_parts(dealt: DataFrame, length: int) -> DataFrame:
    """(key, first, last): starts of strings that occur elsewhere too, as runs."""

    def close(_: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        distinct: dict[tuple, list] = {}
        for anchors, counts, sizes, keys, firsts, data in rows:
            anchors, counts, sizes, keys, firsts = (np.frombuffer(x, np.int64).tolist() for x in (anchors, counts, sizes, keys, firsts))
            text, at, k = zstandard.ZstdDecompressor().decompress(data), 0, 0
            for anchor, count, size in zip(anchors, counts, sizes, strict=True):
                distinct.setdefault((anchor, text[at : at + size]), set()).update(zip(keys[k : k + count], firsts[k : k + count], strict=True))
                at, k = at + size, k + count
        variants: dict[int, list] = {}
        for anchor, data in distinct:
            variants.setdefault(anchor, []).append(data)
        out: list[tuple] = []
        groups, size = [[]], 0
        for anchor, own in variants.items():
            for data in own:
                if len(own) == 1:  # whoever has this anchor has it in the same region
                    if len(owners := distinct[anchor, data]) > 1:
                        out.extend((k, f, f + len(data) - length) for k, f in owners)
                    continue
                if size + len(data) > SHARD_BYTES and groups[-1]:
                    groups.append([])
                    size = 0
                groups[-1].append((anchor, data))
                size += len(data)
        shards = [Shard([d for _, d in g], length) for g in groups if g]
        merge(shards, length)
        for g, shard in zip([g for g in groups if g], shards, strict=True):
            flags, start = shard.flags(), 0
            for anchor, data in g:
                owners = distinct[anchor, data]
                own = flags[start : start + len(data) - length + 1] | (len(owners) > 1)
                start += len(data)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    out.extend((k, f + a, f + b - 1) for k, f in owners)
        for at in range(0, len(out), 50_000):
            yield record(out[at : at + 50_000], MARK)

    return by_bucket(dealt, close, "key long, first long, last long")


def spans(marks: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte ranges that strings starting in these runs cover, joined where they touch."""
    out: list[list[int]] = []
    for first, last in sorted(marks):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [tuple(x) for x in out]


FIELDS = ("n_bytes", "n_removed", "n_spans", "kept")
#: Columns of the work; input columns with these names are set aside and come back.
INNER = ("__key", "__row", "__whole", "__marks")
#: Copies of one text are dealt to so many parts when they learn that they are copies.
SALTS = 16


def remove_repeats(docs: DataFrame, keep_text: bool = True, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the bytes left as binary; where keep_text is False, their SHA-256 in hex).

    Every byte goes that a string of `length` bytes covers which starts elsewhere too, in this or another row; rows
    are independent, so repeated rows and copies of at least `length` bytes remove each other. Bytes are judged on
    the input: no copy stays. Null counts as empty; shorter texts stay whole; an empty table gives no rows. Needs
    doc_id (nulls allowed) and text; other columns are kept, columns named as the new ones are replaced.
    """
    return without(docs, F.octet_length("text") >= length, keep_text, length, seed)


def remove_passages(docs: DataFrame, keep_text: bool = True, words: int = WORDS) -> DataFrame:
    """Like `remove_repeats` for strings of `words` words (at most WORDS), whatever stands between them.

    A passage goes from its first word's first byte to its last word's last; passages that touch or overlap go with what
    stands between them. Words are told apart by 64-bit hashes.
    """
    gap = "[\\x20\\x09-\\x0D]"
    word = gap.replace("[", "[^")
    return without(docs, F.col("text").rlike(f"^{gap}*+(?:{word}++{gap}++){{{words - 1}}}{word}"), keep_text, CODE * words, CODE * max(1, words // 4), True)


def without(docs: DataFrame, long_enough: Column, keep_text: bool, length: int, seed: int, words: bool = False) -> DataFrame:
    """docs without repeated strings of `length` bytes of the texts, or of the spelled texts if `words` is set."""
    aside = {c: f"{c} of the input" for c in INNER if c in docs.columns}
    docs = docs.withColumnsRenamed(aside)
    held = docs.drop(*FIELDS).withColumn("__key", text_key()).withColumn("__row", F.coalesce("doc_id", F.lit(-(1 << 62))))
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = held.where(long_enough)
    own = saved(long.select("__key", "__row", F.octet_length("text").alias("size")), "repeats-rows")
    counted = saved(own.groupBy("__key").agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.min("__row").alias("rep")), "repeats-texts")
    total = counted.agg(F.sum("size")).first()[0] or 0
    buckets = max(2 * n, total // (4 * BUCKET_BYTES))
    found = repeated_runs(runs(long, buckets, length, seed, words), buckets)

    def with_text(some: DataFrame) -> DataFrame:
        per_text = some.groupBy("key").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("runs")).withColumnRenamed("key", "__key").join(counted.select("__key", "rep"), "__key")
        return long.select("__key", F.col("__row").alias("rep"), "text").join(per_text, ["__key", "rep"]).select("__key", "runs", "text")

    few, hot_marks = split_hot(found, with_text, length, seed, words)
    marks = saved(repeated_parts(regions(with_text(few), buckets, length, words), length).unionByName(hot_marks), "repeats-marks")
    per_mark = marks.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("__marks")).withColumnRenamed("key", "__key")
    copies = counted.where("copies > 1").select("__key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    whole = own.withColumn("salt", F.expr(f"int(pmod(xxhash64(__row), {SALTS}))")).join(copies, ["__key", "salt"]).select("__key", "__row", F.lit(True).alias("__whole")).distinct()
    parts = counted.where("copies = 1").join(per_mark, "__key").select("__key", F.col("rep").alias("__row"), "__marks")
    status = whole.withColumn("__marks", F.lit(None).cast(parts.schema["__marks"].dataType)).unionByName(parts.withColumn("__whole", F.lit(False)))
    out = cut(held.join(status, ["__key", "__row"], "left").drop("__key", "__row"), keep_text, length, words)
    return out.withColumnsRenamed({new: old for old, new in aside.items()})


def word_spans(text: bytes, spelled: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the words that ranges of the spelled text hold whole."""
    places = [m.span() for m in WORD.finditer(text)]
    numbers = [(-(-a // CODE), z // CODE) for a, z in spelled]
    return [(places[a][0], places[z - 1][1]) for a, z in numbers]


def cut(marked: DataFrame, keep_text: bool, length: int, words: bool = False) -> DataFrame:
    """Carries the removal out: `__whole` rows lose everything, others the spans of their `__marks`."""
    kept_type = pa.binary() if keep_text else pa.string()
    names = [c for c in marked.columns if c not in ("__whole", "__marks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            marks = b.column(b.schema.get_field_index("__marks")).to_pylist()
            for text, whole, own in zip(texts(b), b.column(b.schema.get_field_index("__whole")).to_pylist(), marks, strict=True):
                gone = [] if whole else spans([(m["first"], m["last"]) for m in own or ()], length)
                if words and (whole or gone):
                    gone = word_spans(text, gone or [(0, CODE * len(split_words(text)))])
                elif whole:
                    gone = [(0, len(text))]
                kept, at = [], 0
                for a, z in gone:
                    kept.append(text[at:a])
                    at = z
                left = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(left), len(gone), left if keep_text else hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            new = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), kept_type), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *new], names=[*names, *FIELDS])

    kinds = ", ".join(f"`{c}` {t}" for c, t in marked.dtypes if c in names)
    return map_arrow(marked, run, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept {'binary' if keep_text else 'string'}")


def op8_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, by its digest; cases as in `remove_repeats`."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


QUERIES = {"op8_suffix_array_repeats": op8_suffix_array_repeats}
SQL: dict[str, str] = {}
