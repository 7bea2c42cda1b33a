"""Language identification by cross-parsing: how few phrases of a language's own text does a document need?"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import doc_crc_mod, documents, give_back, map_arrow, texts

UNKNOWN = "und"
#: Bounds of the training sample: characters of all languages together and of each (all labels have an equal share, if
#: they are many), different whole texts of each, and the length up to which texts are taken first.
SAMPLE_TOTAL, SAMPLE_CHARS, SAMPLE_DOCS, SAMPLE_LENGTH = 4_000_000, 60_000, 150, 1200
#: The hashes of a language are ranked in so many parts first.
SALTS = 32
#: Symbols that are parsed one after the other before the next block's begin, and symbols parsed side by side at most.
BLOCK, PASS_SYMBOLS = 256, 1_000_000
#: Limits of the bits a symbol: lengths in symbols, parts that the sample is held out in, shares of own and of foreign texts between which a limit lies.
LENGTHS, FOLDS, OWN_SHARE, FOREIGN_SHARE = (10, 20, 30, 50, 100, 200), 3, 0.995, 0.1
#: Held-out texts of a length that a limit needs, and what it exceeds theirs by where no other language is known.
LEAST_TEXTS, ALONE = 20, 1.25
#: Codes: any run of signs that are no letters, a letter that no sample has, and from there on the letters of the samples.
SPACE, UNSEEN, LETTERS = 0, 1, 2


def normal_text(text: bytes) -> str:
    return text.decode("utf-8", "replace").lower()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Transitions:
    """The transitions of one language's suffix automaton in one table, with restarts filled in.

    A state is the place where its row of the table begins: rows of few symbols lie in the gaps of others, and each
    entry holds the state that it belongs to beside the next one. A match that can't go on ends its phrase, and the symbol
    begins the next one, in the state behind the root's transition. `dead` is the state of a symbol that the language's text
    lacks: whatever follows begins a phrase.
    """

    def __init__(self, text: list[int], width: int):
        goto = suffix_automaton(text)
        place = row_places(goto, width)
        self.length, self.dead = len(text), int(max(place)) + 1
        table = np.full((self.dead + width + 1, 2), -1, np.int32)
        for own, at in zip(goto, place, strict=True):
            for symbol, state in own.items():
                table[at + symbol] = place[state], at
        self.table = table.view(np.int64).ravel()
        self.first = np.full(width, self.dead, np.int32)
        for symbol, state in goto[0].items():
            self.first[symbol] = place[state]

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase began)."""
        found = self.table.take(state + symbols).view(np.int32).reshape(-1, 2)
        out, began = found[:, 0].copy(), found[:, 1] != state
        miss = np.flatnonzero(began)
        out[miss] = self.first.take(symbols.take(miss))
        return out, began


#: Places that are tried for a row before it goes behind all others.
TRIES = 40


def row_places(goto: list[dict[int, int]], width: int) -> list[int]:
    """For each state a place of its own such that no two rows need the same entry; rows of many symbols are placed first."""
    size = 2 * sum(map(len, goto)) + 3 * len(goto) + 4 * width
    used, taken, place = bytearray(size), bytearray(size), [0] * len(goto)
    free = end = 0
    for state in sorted(range(len(goto)), key=lambda k: -len(goto[k])):
        symbols = list(goto[state])
        at, tries = free, 0
        low = min(symbols, default=0)
        while True:
            at = used.find(0, at)
            if tries > TRIES:
                at = max(at, end + low)
            here = at - low
            if here >= 0 and not taken[here] and not any(used[here + c] for c in symbols):
                break
            at, tries = at + 1, tries + 1
        place[state] = here
        taken[here] = 1
        for c in symbols:
            used[here + c] = 1
            end = max(end, here + c + 1)
        if tries > TRIES:
            free = min(end, free + TRIES)
        if len(used) < end + 2 * width + TRIES:
            used.extend(bytes(size))
            taken.extend(bytes(size))
    return place


class CrossParser:
    """Suffix automata of several languages' texts over one alphabet: all letters of the samples."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        letters = sorted({c for own in samples.values() for t in own for c in set(t) if c.isalpha()})
        self.codes = np.where(letter_table(), UNSEEN, SPACE).astype(np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(LETTERS, LETTERS + len(letters))
        texts_of = ([self.encode(t) for t in samples[name]] for name in self.names)
        self.tables = [Transitions(np.concatenate([*own, np.zeros(0, np.int32)]).tolist(), LETTERS + len(letters)) for own in texts_of]
        self.bits = [np.log2(t.length + 2) for t in self.tables]

    def encode(self, text: str) -> np.ndarray:
        """Codes of the letters, each run of anything else as one space."""
        codes = self.codes[code_points(text)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        return codes[keep]

    def phrases(self, encoded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) by each language (column): longest matches from left to right."""
        out, start, size = np.zeros((len(encoded), len(self.names)), np.int64), 0, 0
        for k, e in enumerate([*encoded, None]):
            if k > start and (e is None or size + len(e) > PASS_SYMBOLS):
                out[start:k] = self.side_by_side(encoded[start:k])
                start, size = k, 0
            size += 0 if e is None else len(e)
        return out

    def side_by_side(self, encoded: list[np.ndarray]) -> np.ndarray:
        """The same for texts that are cut into blocks, a symbol of each block at a time.

        First every block is parsed as if a phrase began with it. Then blocks are parsed again from the state in which
        the block before ends, until state and first parse agree (from there on all is equal), and the next ones as
        long as an end changes.
        """
        sizes = np.array([len(e) for e in encoded], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(encoded)), blocks)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lengths = np.minimum(sizes[owner] - rank * BLOCK, BLOCK)
        by = np.argsort(-lengths, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        after = np.full(len(by), -1, np.int64)  # the block behind, by place
        inner = np.flatnonzero(rank > 0)
        after[place[inner - 1]] = place[inner]
        lengths = lengths[by]
        flat = np.zeros((len(owner), BLOCK), np.int32)
        whole = np.concatenate([*encoded, np.zeros(0, np.int32)])
        flat.ravel()[np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(whole))] = whole
        columns = np.ascontiguousarray(flat[by].T)
        active = np.searchsorted(-lengths, -np.arange(BLOCK), "left")
        out = np.zeros((len(encoded), len(self.names)), np.int64)
        trace, sums = np.zeros(columns.shape, np.int32), np.zeros(columns.shape, np.int16)
        for k, table in enumerate(self.tables):
            state, cuts = np.full(len(by), table.dead, np.int32), np.zeros(len(by), np.int16)
            for t, n in enumerate(active.tolist()):
                state[:n], began = table.step(state[:n], columns[t, :n])
                cuts[:n] += began
                trace[t], sums[t] = state, cuts
            again = np.sort(place[inner])
            before = np.zeros(len(by), np.int64)
            before[after[after >= 0]] = np.flatnonzero(after >= 0)
            while len(again):
                again = after[self.parse_again(table, columns, lengths, again, state[before[again]], trace, sums, state, cuts)]
                again = np.sort(again[again >= 0])
            out[:, k] = np.bincount(owner[by], cuts, minlength=len(encoded))
        return out

    @staticmethod
    def parse_again(table, columns, lengths, at, now, trace, sums, state, cuts) -> np.ndarray:
        """Parses the blocks `at` (by place, long ones first) from the states `now`; gives those whose end has changed."""
        own, changed = np.zeros(len(at), np.int16), []
        for t in range(len(columns)):
            live = int(np.searchsorted(-lengths[at], -t, "left"))
            if live < len(at):  # these have ended without agreeing
                over, at = at[live:], at[:live]
                cuts[over], state[over] = own[live:], now[live:]
                changed.append(over)
                own, now = own[:live], now[:live]
            if not len(at):
                break
            now, began = table.step(now, columns[t, at])
            own = own + began
            same = now == trace[t, at]
            over = at[same]
            cuts[over] += own[same] - sums[t, over]
            more = ~same
            at, now, own = at[more], now[more], own[more]
            trace[t, at], sums[t, at] = now, own
        else:
            cuts[at], state[at] = own, now
            changed.append(at)
        return np.concatenate([*changed, np.zeros(0, np.int64)])

    def rates(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a symbol by each language (phrases times the bits that name a place in its text), symbols, has letters."""
        encoded = [self.encode(normal_text(t)) for t in batch]
        sizes = np.array([len(e) for e in encoded])
        lettered = np.array([bool((e > SPACE).any()) for e in encoded], bool)
        return self.phrases(encoded) * np.array(self.bits)[None, :] / np.maximum(sizes, 1)[:, None], sizes, lettered


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of `text`, grown a symbol at a time; the root is state 0."""
    goto, link, longest, last = [{}], [-1], [0], 0
    for symbol in text:
        new = len(goto)
        goto.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at, last = last, new
        while at >= 0 and symbol not in goto[at]:
            goto[at][symbol] = new
            at = link[at]
        if at < 0:
            continue
        old = goto[at][symbol]
        if longest[old] == longest[at] + 1:
            link[new] = old
            continue
        copy = len(goto)
        goto.append(goto[old].copy())
        longest.append(longest[at] + 1)
        link.append(link[old])
        link[old] = link[new] = copy
        while at >= 0 and goto[at].get(symbol) == old:
            goto[at][symbol] = copy
            at = link[at]
    return goto


def sample(docs: DataFrame) -> tuple:
    """(language, texts) pairs to learn from: of every label, at most SAMPLE_DOCS different whole texts with SAMPLE_CHARS characters in all.

    Texts up to SAMPLE_LENGTH characters come first, and among these the choice is by hash over all labelled documents,
    so that copies count once. Texts are whole; only one that alone exceeds a language's share is cut. Hashes and lengths of
    the candidates and then the chosen texts come to the driver, SAMPLE_TOTAL characters at most.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("size"), "text")
    distinct = labelled.select("lang", "h", "size", (F.col("size") > SAMPLE_LENGTH).alias("long")).distinct()
    parts, whole = Window.partitionBy("lang", F.expr(f"pmod(h, {SALTS})")).orderBy("long", "h"), Window.partitionBy("lang").orderBy("long", "h")
    first = distinct.withColumn("k", F.row_number().over(parts)).where(F.col("k") <= SAMPLE_DOCS)
    candidates = first.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= SAMPLE_DOCS).orderBy("lang", "k").collect()
    names = sorted({r["lang"] for r in candidates})
    share = min(SAMPLE_CHARS, SAMPLE_TOTAL // max(len(names), 1))
    left, wanted = dict.fromkeys(names, share), []
    for r in candidates:
        if r["size"] <= left[r["lang"]] or left[r["lang"]] == share:
            left[r["lang"]] -= r["size"]
            wanted.append((r["lang"], r["h"]))
    chosen = docs.sparkSession.createDataFrame(wanted, "lang string, h long")
    rows = labelled.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, share)).alias("text")).collect()
    return tuple((n, tuple(r["text"].lower() for r in sorted(rows, key=lambda r: r["h"]) if r["lang"] == n)) for n in names)


@lru_cache(2)
def parser_of(samples: tuple) -> CrossParser:
    """Built once in each Python worker; the sample that is shipped stays small."""
    return CrossParser({name: list(own) for name, own in samples})


def verdicts(parser: CrossParser, batch: list[bytes]) -> tuple[list[str], list[float], list[float], list[int]]:
    """Languages, scores, bits a symbol and symbols of some texts."""
    rates, sizes, lettered = parser.rates(batch)
    if not parser.names:
        return [UNKNOWN] * len(batch), [0.0] * len(batch), [0.0] * len(batch), sizes.tolist()
    best = rates.argmin(axis=1)
    low = rates[np.arange(len(batch)), best]
    scores = 1 / np.exp2(-(rates - low[:, None]) * np.sqrt(sizes)[:, None]).sum(axis=1)
    names = [parser.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, scores, 0.0).tolist(), np.where(lettered, low, 0.0).tolist(), sizes.tolist()


def limits(samples: tuple) -> list[tuple[int, float]]:
    """(symbols, most bits a symbol) from which length on a text above these is in none of the languages.

    Each part of the sample is parsed by what is learned from the other parts: from all languages and, as a text in an
    unknown language, from all but its own. The limit lies halfway between the two, by the foreign language that is
    nearest. Lengths at which they overlap have none, nor have shorter ones: there any text may stay.
    """
    own, foreign = {n: [] for n in LENGTHS}, {n: {} for n in LENGTHS}
    for fold in range(FOLDS):
        parser = CrossParser({name: [t for k, t in enumerate(starts) if k % FOLDS != fold] for name, starts in samples})
        for c, (name, starts) in enumerate((n, dict(samples)[n]) for n in parser.names):
            held = [parser.encode(t) for t in starts[fold::FOLDS]]
            for n in LENGTHS:
                cut = [e[:n] for e in held if len(e) >= n and (e[:n] > SPACE).any()]
                if not cut:
                    continue
                rates = parser.phrases(cut) * np.array(parser.bits)[None, :] / n
                own[n].extend(rates.min(axis=1))
                if len(parser.names) > 1:
                    foreign[n].setdefault(name, []).extend(np.delete(rates, c, axis=1).min(axis=1))
    out: list[tuple[int, float]] = []
    for n in LENGTHS:
        if len(own[n]) < LEAST_TEXTS:
            continue
        low = float(np.quantile(own[n], OWN_SHARE))
        high = min((float(np.quantile(x, FOREIGN_SHARE)) for x in foreign[n].values()), default=(2 * ALONE - 1) * low)
        if low < high:
            out.append((n, (low + high) / 2))
        else:
            out.clear()
    return out


def identify(docs: DataFrame, training: DataFrame, with_foreign: bool = False) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and bits (a symbol, by the language predicted).

    The language whose text's automaton parses the document into the fewest phrases wins, phrases weighted by the
    bits of a place in that text; ties go to the name that sorts first. Null texts and texts without a letter, and
    all texts where no training row has a label, give `und` and score 0. Every label is learned, from a bounded sample. Other columns and repeated rows are kept;
    columns named as the new ones are replaced. With with_foreign also `foreign`: whether the bits are above what texts
    of that length in a learned language take.
    """
    samples = sample(training)
    bounds = limits(samples) if with_foreign else []
    give_back()
    new = [("lang_pred", "string"), ("score", "double"), ("bits", "double"), *([("foreign", "boolean")] if with_foreign else [])]
    held = docs.drop(*(f for f, _ in new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parser, batch = parser_of(samples), texts(b)
            names, scores, bits, sizes = verdicts(parser, batch)
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            if with_foreign:
                most = (next((limit for n, limit in reversed(bounds) if size >= n), np.inf) for size in sizes)
                columns.append(pa.array([x > limit for x, limit in zip(bits, most, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *(f for f, _ in new)])

    return map_arrow(held, run, ", ".join(f"`{c}` {t}" for c, t in [*held.dtypes, *new]))


def op6_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that are not held out; cases as in `identify`."""
    docs = documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), docs.where(doc_crc_mod("doc_id", 4) != 2))
    return out.select("doc_id", (doc_crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits")


QUERIES = {"op6_cross_parsing_language": op6_cross_parsing_language}
SQL: dict[str, str] = {}
