"""SentencePiece encoding and decoding with N-best segmentations over the piece lattice.

The scores of the best segmentations of all prefixes (a forward Viterbi pass) are exact heuristics for a search
from the end of the text, so that A* takes complete segmentations off its queue in order of score. Space marks stand
only at the start of a piece and no piece holds a line's end; so the lattice falls apart into units (a run of marks with the word
behind it), distinct units are scored once, side by side, and only the units with the least gaps between best and
second best segmentation can differ among the N best. A unit too long for that is cut where no piece crosses.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_arrow, texts

SPACE = "▁"
N_BEST = 4
CACHE_UNITS = 400_000
#: Characters from which a unit is cut where no piece crosses; what stays longer is searched by itself.
LONG_UNIT = 256
#: Units of a side-by-side pass, in characters; a byte of a character without a piece costs so much below the worst piece.
PASS_CHARS, BYTE_COST = 200_000, 10.0
FACTOR = 0x9E3779B97F4A7C15
NEVER = -1e15
UNIT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class Lattice:
    """The pieces of a model by hash, and best, second best and N best segmentations of units."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.spellings = [n.encode("utf-8") for n in self.names]
        self.byte_ids = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        for b, i in self.byte_ids.items():
            self.spellings[i] = bytes([b])
        usable = [i for i, n in enumerate(self.names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and "\n" not in n and SPACE not in n.lstrip(SPACE)]
        self.ids = {self.names[i]: i for i in usable}
        self.scores = {n: float(model.get_score(i)) for n, i in self.ids.items()}
        self.byte_score = min(self.scores.values(), default=0.0) - BYTE_COST
        self.longest = max(map(len, self.ids), default=1)
        hashed = [self.hashes(np.frombuffer(n.encode("utf-32-le"), np.uint32).astype(np.uint64)) for n in self.ids]
        keys = np.array(hashed, np.uint64)
        by = np.argsort(keys)
        self.keys = keys[by]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have the same hash")
        self.key_score = np.array(list(self.scores.values()))[by]
        self.key_id = np.array(list(self.ids.values()), np.int64)[by]
        slots = np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(48)
        slots[-1] = np.iinfo(np.uint64).max
        self.slot = np.searchsorted(self.keys, slots)
        self.deepest = int(np.diff(self.slot).max(initial=1))
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.best_ids: list[bytes] = []
        self.searched: dict[int, list[tuple[float, list[int]]]] = {}
        self.best, self.gap = np.zeros(0), np.zeros(0)

    @staticmethod
    def hashes(code_points: np.ndarray) -> int:
        h = 0
        for c in code_points.tolist():
            h = ((h + c + 1) * FACTOR) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the pieces' sorted ones, or -1: a slot by the first bits, then the few keys in it."""
        at = self.slot[(h >> np.uint64(48)).astype(np.int64)]
        found = np.full(len(h), -1, np.int64)
        for step in range(self.deepest):
            k = np.minimum(at + step, len(self.keys) - 1)
            hit = self.keys[k] == h
            found[hit] = k[hit]
        return found

    def units_of(self, text: str) -> list[str]:
        """The units of a text, in order."""
        units = UNIT.findall((SPACE + text.replace(" ", SPACE)) if text else "")
        if len(text) >= LONG_UNIT and max(map(len, units)) >= LONG_UNIT:
            return [part for u in units for part in (self.parts(u) if len(u) >= LONG_UNIT else (u,))]
        return units

    def parts(self, unit: str) -> Iterator[str]:
        """The unit cut at all places that no piece crosses."""
        start = reach = 0
        for at in range(len(unit)):
            if at and at == reach:
                yield unit[start:at]
                start = at
            widest = next((w for w in range(min(self.longest, len(unit) - at), 1, -1) if unit[at : at + w] in self.ids), 1)
            reach = max(reach, at + widest)
        yield unit[start:]

    def add(self, units: list[str]) -> None:
        """Scores new units, some at a time."""
        held, size = [], 0
        for u in units:
            if len(u) >= LONG_UNIT:
                self.score_long(u)
                continue
            held.append(u)
            size += len(u)
            if size > PASS_CHARS:
                self.score_units(held)
                held, size = [], 0
        if held:
            self.score_units(held)

    def enter(self, units: list[str], ids: list[bytes], best: np.ndarray, gap: np.ndarray) -> None:
        """Keeps what is known of new units."""
        base = len(self.best_ids)
        self.known.update(zip(units, range(base, base + len(units)), strict=True))
        self.best_ids += ids
        self.best, self.gap = np.append(self.best, best), np.append(self.gap, gap)

    def score_long(self, unit: str) -> None:
        found = self.n_best(unit, 2)
        self.enter([unit], [np.array(found[0][1], "<u4").tobytes()], np.array([found[0][0]]), np.array([found[0][0] - found[1][0] if len(found) > 1 else np.inf]))

    def score_units(self, units: list[str]) -> None:
        """Best and second best scores of all prefixes of the units, width by width, and the best path backwards."""
        units = sorted(units, key=len)
        lengths = np.array([len(u) for u in units])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(points)
        last = np.repeat(ends, lengths)
        widest = min(self.longest, int(lengths[-1]))
        score = np.full((widest + 1, n), NEVER)
        piece = np.full((widest + 1, n), -1, np.int32)
        h, live = np.zeros(n, np.uint64), np.arange(n)
        for width in range(1, widest + 1):
            live = live[live + width <= last[live]]
            x = (h[live] + points[live + width - 1] + np.uint64(1)) * np.uint64(FACTOR)
            x ^= x >> np.uint64(29)
            h[live] = x
            at = self.look_up(x)
            hit = at >= 0
            score[width, live[hit]] = self.key_score[at[hit]]
            piece[width, live[hit]] = self.key_id[at[hit]]
        bare = piece[1] < 0
        if bare.any():
            size = 1 + (points[bare] >= 0x80).astype(np.int64) + (points[bare] >= 0x800) + (points[bare] >= 0x10000)
            score[1, bare] = self.byte_score * size
        # Scores of prefixes: one more place than characters in each unit, units by length.
        first = starts + np.arange(len(units))
        top, second = np.full(n + len(units), NEVER), np.full(n + len(units), NEVER)
        step_to = np.zeros(n + len(units), np.int32)
        top[first] = 0
        for t in range(1, int(lengths[-1]) + 1):
            some = int(np.searchsorted(lengths, t))
            at, edge = first[some:] + t, starts[some:] + t
            most, next_most, width_of = np.full(len(at), NEVER), np.full(len(at), NEVER), np.zeros(len(at), np.int32)
            for width in range(min(t, widest), 0, -1):  # on ties, the longest piece
                x, y = top[at - width], second[at - width]
                step = score[width, edge - width]
                x, y = x + step, y + step
                np.maximum(next_most, np.maximum(np.minimum(most, x), y), out=next_most)
                better = x > most
                width_of[better] = width
                np.maximum(most, x, out=most)
            top[at], second[at], step_to[at] = most, next_most, width_of
        on_path, numbers = np.zeros(n, bool), np.zeros(n, np.int32)
        at, edge = first + lengths, ends.copy()
        live = np.flatnonzero(lengths > 0)
        while len(live):
            width = step_to[at[live]]
            at[live] -= width
            edge[live] -= width
            on_path[edge[live]] = True
            numbers[edge[live]] = piece[width, edge[live]]
            live = live[at[live] > first[live]]
        best, second = top[first + lengths], second[first + lengths]
        picked = np.flatnonzero(on_path)
        which = np.searchsorted(ends, picked, "right")
        edges = (4 * np.searchsorted(which, np.arange(len(units) + 1))).tolist()
        raw = numbers[picked].astype("<u4").tobytes()
        ids = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        for k in np.unique(which[numbers[picked] < 0]).tolist():
            own = picked[edges[k] // 4 : edges[k + 1] // 4]
            ids[k] = b"".join(np.array(self.spelled(units[k][p - starts[k]]) if i < 0 else [i], "<u4").tobytes() for p, i in zip(own.tolist(), numbers[own].tolist(), strict=True))
        self.enter(units, ids, best, np.where(second <= NEVER / 2, np.inf, best - second))

    def spelled(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def edges_to(self, unit: str, end: int) -> Iterator[tuple[int, float, list[int]]]:
        """(start, score, ids) of the pieces that end there."""
        for width in range(min(end, self.longest), 0, -1):
            part = unit[end - width : end]
            if part in self.ids:
                yield end - width, self.scores[part], [self.ids[part]]
            elif width == 1:
                yield end - 1, self.byte_score * len(part.encode("utf-8", "surrogatepass")), self.spelled(part)

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a unit: forward Viterbi, then A* from the end with its scores as heuristics.

        Of equal scores the one whose last pieces are longer comes first. A node's edges are queued one after the other, the best
        first, so the queue grows by at most two entries for each one taken off.
        """
        ahead = [0.0] + [NEVER] * len(unit)
        for end in range(1, len(unit) + 1):
            ahead[end] = max(ahead[s] + x for s, x, _ in self.edges_to(unit, end))
        tick = count()
        queue: list = []

        def push(gone: float, chain, edges: list, k: int) -> None:
            if k < len(edges):
                s, x, _ = edges[k]
                heapq.heappush(queue, (-(ahead[s] + x + gone), s, next(tick), gone, chain, edges, k))

        def edges_of(at: int) -> list:
            return sorted(self.edges_to(unit, at), key=lambda e: -(ahead[e[0]] + e[1]))

        push(0.0, None, edges_of(len(unit)), 0)
        out = []
        while queue and len(out) < n:
            _, _, _, gone, chain, edges, k = heapq.heappop(queue)
            s, x, ids = edges[k]
            push(gone, chain, edges, k + 1)
            if s:
                push(gone + x, (ids, chain), edges_of(s), 0)
                continue
            own = list(ids)
            while chain:
                own += chain[0]
                chain = chain[1]
            out.append((gone + x, own))
        return out

    def options(self, number: int, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """n_best of a unit, kept by its number."""
        own = self.searched.get(number, ())
        if len(own) < n:
            own = self.searched[number] = self.n_best(unit, n)
        return own[:n]

    def encode(self, text: str, n: int, units: list[str] | None = None) -> tuple[bytes, list[float], list[dict[int, list[int]]], list[int]]:
        """(ids of the best segmentation, the n best scores, for each of these the units that differ, units' numbers)."""
        units = self.units_of(text) if units is None else units
        number = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        gaps = self.gap[number]
        few = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) > n - 1 > 0 else np.arange(len(gaps) if n > 1 else 0)
        few = [k for k in few.tolist() if np.isfinite(gaps[k])]
        total = float(self.best[number].sum())
        found = [(0.0, {})]
        for k in few:  # the n best sums so far with each of the unit's segmentations
            own = self.options(int(number[k]), units[k], n)
            sums = ((cost + own[0][0] - s, chosen | ({k: ids} if j else {})) for cost, chosen in found for j, (s, ids) in enumerate(own))
            found = heapq.nsmallest(n, sums, key=lambda x: x[0])
        numbers = number.tolist()
        return b"".join(map(self.best_ids.__getitem__, numbers)), [total - cost for cost, _ in found], [chosen for _, chosen in found], numbers

    def prepare(self, batch: list[str]) -> list[list[str]]:
        """The units of each text; new ones are scored."""
        if len(self.known) > CACHE_UNITS:
            self.clear()
        out = [self.units_of(t) for t in batch]
        self.add(list(set().union(*out).difference(self.known)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the space marks as spaces, the first one dropped."""
        text = b"".join([self.spellings[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def all_ids(model: Lattice, numbers: list[int], chosen: dict[int, list[int]]) -> bytes:
    """The ids of a segmentation, 32-bit little-endian."""
    parts = list(map(model.best_ids.__getitem__, numbers))
    for k, ids in chosen.items():
        parts[k] = np.array(ids, "<u4").tobytes()
    return b"".join(parts)


def encode(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """doc_id and n_best: array of (score, ids), best first, at most n (a text may have fewer segmentations).

    Null and empty texts have the empty segmentation alone. A character that is no piece is spelled in byte pieces. The
    mark U+2581 in a text counts as a space. Segmentations of equal score come in the search's order, see `Lattice.n_best`.
    Repeated rows repeat; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for b in batches:
            batch = [t.decode("utf-8", "replace") for t in texts(b)]
            rows = []
            for t, units in zip(batch, model.prepare(batch), strict=True):
                _, scores, chosen, numbers = model.encode(t, n, units)
                rows.append([{"score": s, "ids": np.frombuffer(all_ids(model, numbers, c), "<i4")} for s, c in zip(scores, chosen, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "n_best"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_best array<struct<score: double, ids: array<int>>>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if ids is None else lattice(path).decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_arrow(rows.select("doc_id", "ids"), run, "doc_id long, text string")


DIGEST = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("n_best_scores", pa.list_(pa.float64())), ("n_best_crc32", pa.list_(pa.int64())), ("decoded", pa.bool_())]


def digests(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """Per document: pieces and CRC of the best ids, the n best scores and the CRC of the ids of each (32-bit little-endian), and whether the best ids decode to the text.

    Null and empty texts have no piece, the score 0 and one segmentation. Ties, repeated rows, an empty table and other columns
    are treated as by `encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for b in batches:
            batch = [t.decode("utf-8", "replace") for t in texts(b)]
            rows = []
            for doc_id, t, units in zip(b.column(0).to_pylist(), batch, model.prepare(batch), strict=True):
                ids, scores, chosen, numbers = model.encode(t, n, units)
                crcs = [zlib.crc32(all_ids(model, numbers, c) if c else ids) for c in chosen]
                rows.append((doc_id, len(ids) // 4, crcs[0], scores[0], scores, crcs, model.decode(memoryview(ids).cast("I")) == t))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), DIGEST, strict=True)] if rows else [pa.array([], k) for _, k in DIGEST], names=[f for f, _ in DIGEST])
        model.clear()

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_pieces long, ids_crc32 long, score double, n_best_scores array<double>, n_best_crc32 array<long>, decoded boolean")


def op2_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best segmentation, n best scores and whether decoding gives the text, for every document; cases as in `digests`."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op2_sentencepiece_n_best": op2_sentencepiece_n_best}
SQL: dict[str, str] = {}
