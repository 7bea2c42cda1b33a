"""Best-fit packing of tokenised documents into sequences, as rounds of partition-local packing and a merge tree."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, map_arrow, saved, texts

CAPACITY = 4096
END_ID = 1
#: A bin with so little room left is emitted at once.
NEARLY_FULL = 4
FAN_IN = 8
#: Items that one task packs at a time.
TASK_ITEMS = 200_000
#: Bytes of the cache of words.
CACHE_BYTES = 24 << 20
#: Texts whose ids are put together at once.
TEXTS = 100
#: Signs that end words; behind a letter or digit they are always pre-tokens of their own.
TAIL = ".,;:!?&$%*#|"
#: Stands between words that are tokenised together: white space and a sign with an id of its own.
SEPARATOR = " \x01 "

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("sequence_id", pa.int64()), ("open", pa.bool_()), ("fill", pa.int32()), ("members", pa.list_(MEMBER))])
BIN_DDL = "sequence_id long, open boolean, fill int, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


def last_bytes(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last bytes of each word, as many as its size."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + 1 + len(words)]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(ends - edges[1:], sizes) + np.arange(edges[-1])
    held = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(held[at])])


class WordTokenizer:
    """Ids of texts, by way of a bounded cache of words' ids.

    The tokenizer drops white space and no pre-token crosses it, so a text's ids are those of its words in order.
    It lower-cases, and signs that follow a letter or digit are pre-tokens apart, so a word is looked up as a
    lower-case core and the signs behind it. Arrow splits a batch and finds its different words; only cores and signs
    that are not in the cache go to the tokenizer itself. The cache is three arrays, without an object for a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        (self.separator,) = self.model.encode(SEPARATOR, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.cells = pa.array([], pa.large_string())
        self.ids, self.starts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def cache_bytes(self) -> int:
        return self.cells.nbytes + self.ids.nbytes + self.starts.nbytes

    @staticmethod
    def cores_and_tails(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        low = pc.ascii_lower(words)
        core = pc.ascii_rtrim(low, characters=TAIL)
        # a special token is matched as it is written
        special = pc.match_substring(words, "<|")
        apart = pc.and_not(pc.match_substring_regex(core, "[a-z0-9]$"), special)
        core = pc.if_else(apart, core, pc.if_else(special, words, low))
        return core, last_bytes(low, pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy())

    def tokenised(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and each word's number of them. Words are told apart by a separator; if one holds it, all go alone."""
        whole = np.array(self.model.encode_batch_fast([SEPARATOR.join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(whole == self.separator)
        if len(at) == len(words) - 1:
            return np.delete(whole, at), np.diff(at, prepend=-1, append=len(whole)) - 1
        found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.array([len(x) for x in found])

    def places(self, cells: pa.Array) -> np.ndarray:
        """Where each cell's ids are in the cache; new cells are tokenised first."""
        at = pc.index_in(cells, self.cells)
        if at.null_count:
            new = cells.filter(at.is_null()).unique()
            own = [w.decode("utf-8", "replace") for w in new.cast(pa.large_binary()).to_pylist()]
            parts = [self.tokenised(own[k : k + 1000]) for k in range(0, len(own), 1000)]
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in parts)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([n for _, n in parts]))])
            self.cells = pa.concat_arrays([self.cells, new])
            at = pc.index_in(cells, self.cells)
        return at.to_numpy()

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.cache_bytes() > CACHE_BYTES:
            self.clear()
        split = pc.ascii_split_whitespace(pa.array(batch, pa.large_binary()).view(pa.large_string()))
        words, upto = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        core, tail = self.cores_and_tails(words.dictionary)
        both = self.places(pa.concat_arrays([core, tail])).reshape(2, -1).T  # a word's core, then its signs
        word, out = words.indices.to_numpy(), []
        for k in range(0, len(batch), TEXTS):
            edges = upto[k : k + TEXTS + 1]
            cells = both[word[edges[0] : edges[-1]]].ravel()
            sizes = self.starts[cells + 1] - self.starts[cells]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.ids[np.repeat(self.starts[cells] - ends[:-1], sizes) + np.arange(ends[-1])]
            edges = ends[2 * (edges - edges[0])]
            out += [ids[a:z].tobytes() for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def let_go() -> None:
    """Workers live on, and would hold the tokenizer beside what they do next. A function of the module: a task's own has a copy of its globals."""
    _tokenizers.clear()


def pieces(doc_id: int, ids: bytes, capacity: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc) of a document's pieces; its end id counts."""
    ids += END_ID.to_bytes(4, "little")
    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)


def best_fit(items: Iterable[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Bins (fill, members) of items (size, members): largest first, each into the open bin that it fills best.

    Bins are kept by the room they have left, with one bit per room in use, so that the least sufficient room is
    the lowest bit from the item's size on. Members' last field is their offset in the bin.
    """
    rooms: dict[int, list] = {}
    used, out = 0, []
    for size, members in sorted(items, key=lambda x: -x[0]):
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, own = capacity, []
        filled = capacity - room
        own.extend((*m[:-1], m[-1] + filled) for m in members)
        room -= size
        if room:
            rooms.setdefault(room, []).append(own)
            used |= 1 << room
        else:
            out.append((capacity, own))
    return out + [(capacity - room, own) for room, bins in rooms.items() for own in bins]


def emitted(items: Iterator[tuple[int, list]], capacity: int, slack: int, level: int) -> Iterator[pa.RecordBatch]:
    """Packs a task's items, TASK_ITEMS at a time; what stays underfull is packed again with the next ones."""
    number = (level << 56) + (TaskContext.get().partitionId() << 32)
    held: list = []

    def batches(bins: list, is_open: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number
        for at in range(0, len(bins), 2000):
            part = bins[at : at + 2000]
            members = pa.array([[dict(zip([f.name for f in MEMBER], m, strict=True)) for m in own] for _, own in part], pa.list_(MEMBER))
            yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(part)), pa.int64()), pa.array([is_open] * len(part)), pa.array([f for f, _ in part], pa.int32()), members], schema=BIN)
            number += len(part)

    def split(bins: list) -> tuple[list, list]:
        return [b for b in bins if b[0] >= capacity - slack], [b for b in bins if b[0] < capacity - slack]

    for item in items:
        held.append(item)
        if len(held) >= TASK_ITEMS:
            full, held = split(best_fit(held, capacity))
            yield from batches(full, False)
            if len(held) > TASK_ITEMS // 2:
                yield from batches(held, True)
                held = []
    full, rest = split(best_fit(held, capacity))
    yield from batches(full, False)
    yield from batches(rest, True)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = NEARLY_FULL) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    First every input partition tokenises and packs its own pieces, without a shuffle; bins with at most `slack`
    room are final. The underfull bins go on as single items, FAN_IN partitions merging into one in each round, and
    are best-fit anew, down to one partition (or to as many as TASK_ITEMS items each need). Every round is a
    table in the shared folder. Null and empty texts are the end id alone; repeated rows are packed repeatedly;
    an empty table gives no rows; a null doc_id stays null.
    """
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for b in batches:
                for doc_id, ids in zip(b.column(0).to_pylist(), tokenizer(path).encode(texts(b)), strict=True):
                    for p in pieces(doc_id, ids, capacity):
                        yield p[3], [(*p, 0)]
            let_go()

        return emitted(items(), capacity, slack, 0)

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = ((fill, [tuple(m.values()) for m in own]) for b in batches for fill, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            return emitted(items, capacity, capacity if last else slack, level)

        return run

    bins = saved(map_arrow(docs.select("doc_id", "text"), first, BIN_DDL), "pack-0")
    tables, width, level = [bins.where("NOT open")], max(1, bins.rdd.getNumPartitions()), 0
    while True:
        left = bins.where("open")
        n = left.count()
        if not n:
            break
        level += 1
        width = min(width, max(-(-width // FAN_IN), -(-n // TASK_ITEMS)))
        last = width == 1 or width == -(-n // TASK_ITEMS)
        merged = left.select("fill", "members").repartition(width)
        bins = saved(map_arrow(merged, again(level, last), BIN_DDL), f"pack-{level}")
        tables.append(bins if last else bins.where("NOT open"))
        if last:
            break
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; cases as in `pack`."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
