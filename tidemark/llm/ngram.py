"""Bigram language model by deleted interpolation, and scores of whole texts by it.

Maximum-likelihood estimates of two orders and a uniform share are mixed; the weights depend on the bucket of the
context's frequency and are learned by expectation-maximisation on a held-out part of the training documents, with
estimates from the other part. The final estimates are of all training documents.

Counts are exchanged in packed form: documents are handled in chunks; a chunk sends the sorted hashes of its
distinct words and bigrams with its counts, dealt into buckets by hash, and each bucket answers every chunk with
the corpus counts in the same order. So every distinct n-gram of a chunk moves once, and no table is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LOWER, doc_crc_mod, documents, map_arrow, saved, split_words, texts

#: Words have 64-bit hashes; these two stand for a text's end and the place before its first word.
END, START = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\n\n")
SPREAD = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES, BUCKET_TOKENS = 8 << 20, 1_500_000
#: Context-frequency buckets are powers of two; likelihood ratios are binned in eighths of an octave for the learning.
BUCKETS, BINS, ROUNDS = 48, 8, 60
HELD_OUT_MOD = 5
ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("kept", pa.binary()), ("held", pa.binary())])
ASK_DDL = "part int, chunk long, kind int, bucket int, keys binary, kept binary, held binary"
ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("kept", pa.binary()), ("held", pa.binary()), ("n_kept", pa.int64()), ("n_all", pa.int64()), ("v_all", pa.int64())])
ANSWER_DDL = "chunk long, kind int, bucket int, kept binary, held binary, n_kept long, n_all long, v_all long"


def squeeze(x: np.ndarray) -> bytes:
    """Eight-byte numbers, first bytes of all, then second ones and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def restore(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def token_hashes(text: bytes) -> np.ndarray:
    words = split_words(text.translate(LOWER))
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


class Chunk:
    """Some documents' tokens, as numbers of the chunk's distinct words and bigrams in hash order."""

    def __init__(self, batch: list[bytes]):
        streams = [token_hashes(t) for t in batch]
        self.lengths = np.array([len(s) for s in streams], np.int64)
        tokens = np.concatenate([*streams, np.zeros(0, np.uint64)])
        contexts = np.empty_like(tokens)
        contexts[1:] = tokens[:-1]
        self.starts = np.cumsum(self.lengths) - self.lengths
        contexts[self.starts] = START
        self.words, numbers = np.unique(np.concatenate([tokens, np.array([START], np.uint64)]), return_inverse=True)
        self.token = numbers[:-1]
        start = numbers[-1]
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.starts] = start
        mixed = (contexts * SPREAD) ^ (tokens + (contexts >> np.uint64(31)))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        self.pairs, self.pair = np.unique(mixed ^ (mixed >> np.uint64(32)), return_inverse=True)
        self.start = start

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words (the start counts once for each text) and of bigrams, in the chosen documents."""
        on = np.repeat(chosen, self.lengths)
        words = np.bincount(self.token[on], minlength=len(self.words))
        words[self.start] += int(chosen.sum())
        return words.astype(np.int64), np.bincount(self.pair[on], minlength=len(self.pairs)).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted keys bucket by bucket, and where each bucket begins."""
    bucket = ((keys * SPREAD) >> np.uint64(40)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))


def in_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text, role (0: not for training, 1: for the estimates, 2: for the weights too) and chunk.

    A chunk is what an input partition holds of a role, divided by hash where partitions may exceed CHUNK_BYTES.
    """
    most = docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").lower()
    size = int("".join(c for c in most if c.isdigit())) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(most.rstrip("b")[-1], 1)
    parts = max(1, -(-size // CHUNK_BYTES))
    share = F.expr(f"pmod(xxhash64(doc_id, text), {parts})")
    weights = F.when(F.col("role") == 2, 1).otherwise(0)
    return docs.select("doc_id", "text", "role").withColumn("chunk", (F.spark_partition_id().cast("long") * parts + share) * 2 + weights)


def by_chunk(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one chunk after another, from rows sorted by chunk."""
    now, held = None, []
    for b in batches:
        for row in zip(*((c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in b.columns), strict=True):
            if row[at] != now and held:
                yield now, held
                held = []
            now = row[at]
            held.append(row)
    if held:
        yield now, held


def asked(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_chunk(batches):
            own = Chunk([r[1] or b"" for r in rows])
            roles = np.array([r[2] for r in rows])
            kept, held = own.counts(roles == 1), own.counts(roles == 2)
            for kind, keys in enumerate((own.words, own.pairs)):
                by, edges = dealt(keys, buckets)
                out = []
                for k in range(buckets):
                    at = by[edges[k] : edges[k + 1]]
                    if len(at):
                        out.append((kind * buckets + k, number, kind, k, squeeze(np.diff(keys[at], prepend=np.uint64(0))), squeeze(kept[kind][at]), squeeze(held[kind][at])))
                    if len(out) == 50 or (out and k == buckets - 1):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ASK, strict=True)], schema=ASK)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ASK, strict=True)], schema=ASK)

    return map_arrow(chunks.select("chunk", "text", "role").sortWithinPartitions("chunk"), run, ASK_DDL)


def answered(questions: DataFrame) -> DataFrame:
    """The corpus counts of what each chunk asked for, in its order; once per bucket also the bucket's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_chunk(batches):
            keys = [np.cumsum(restore(r[4], np.uint64), dtype=np.uint64) for r in rows]
            values, number = np.unique(np.concatenate(keys), return_inverse=True)
            kept, held = (np.bincount(number, np.concatenate([restore(r[c]) for r in rows])).astype(np.int64) for c in (5, 6))
            counted = values != np.uint64(START)
            both = kept + held
            sums, at = (int(kept[counted].sum()), int(both[counted].sum()), int((both[counted] > 0).sum())), 0
            for r, k in zip(rows, keys, strict=True):
                own = number[at : at + len(k)]
                at += len(k)
                out = [(r[1], r[2], r[3], squeeze(kept[own]), squeeze(held[own]), *sums)]
                sums = (0, 0, 0)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ANSWER, strict=True)], schema=ANSWER)

    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(questions.repartition(n, "part").sortWithinPartitions("part"), run, ANSWER_DDL)


def with_counts(chunks: DataFrame, answers: DataFrame, buckets: int, fn, ddl: str) -> DataFrame:
    """fn(documents, chunk, (kept, held) of its words, (kept, held) of its bigrams) for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_chunk(batches):
            docs = [r for r in rows if r[1] == 2]
            if not docs:
                continue
            own, found = Chunk([r[4] or b"" for r in docs]), []
            for kind, keys in enumerate((own.words, own.pairs)):
                by, edges = dealt(keys, buckets)
                counts = np.zeros((2, len(keys)), np.int64)
                done = 0
                for r in rows:
                    if r[1] == kind:
                        at = by[edges[r[2]] : edges[r[2] + 1]]
                        counts[0, at], counts[1, at] = restore(r[5]), restore(r[6])
                        done += len(at)
                if done != len(keys):
                    raise RuntimeError("a chunk holds other documents than when it was counted")
                found.append(counts)
            yield from fn(docs, own, *found)

    none = F.lit(None)
    left = answers.select("chunk", "kind", "bucket", none.cast("long").alias("doc_id"), none.cast("string").alias("text"), "kept", "held")
    right = chunks.select("chunk", F.lit(2).alias("kind"), F.lit(0).alias("bucket"), "doc_id", "text", none.cast("binary").alias("kept"), none.cast("binary").alias("held"))
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(left.unionByName(right).repartition(n, "chunk").sortWithinPartitions("chunk"), run, ddl)


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], BUCKETS - 1)


def learned_weights(table: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bucket x order: bigram, unigram, uniform) that make held-out counts likely.

    table: rows (bucket, bin of the bigram's estimate or -1 for none, bin of the unigram's, count); bins are of the
    logarithm of the estimate over the uniform share. Expectation-maximisation from equal weights; buckets without
    held-out counts take those of the nearest lower one that has some.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    for b in range(BUCKETS):
        own = table[table[:, 0] == b]
        if not len(own):
            weights[b] = weights[b - 1] if b else (0.0, 0.5, 0.5)
            continue
        shares = np.stack([np.where(own[:, 1] > -10_000, np.exp2(own[:, 1] / BINS), 0), np.where(own[:, 2] > -10_000, np.exp2(own[:, 2] / BINS), 0), np.ones(len(own))], axis=1)
        w = weights[b].copy()
        for _ in range(rounds):
            mix = shares * w
            w = (mix / mix.sum(axis=1, keepdims=True) * own[:, 3:4]).sum(axis=0) / own[:, 3].sum()
        weights[b] = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
    return weights


def log_bins(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1e-300)) * BINS + 0.5), -10_001).astype(np.int64)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


SCORE = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text, role).

    role 1 and 2 are training documents; 2 also serve as the held-out part that the weights are learned on. Null
    counts as empty: its end is its only token. Repeated rows repeat; an empty table gives no rows; without training
    documents all words are unknown and the score is the uniform share's. Words and bigrams are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n, size // 6 // BUCKET_TOKENS + 1)
    chunks = in_chunks(docs)
    answers = saved(answered(asked(chunks, buckets)), "ngram-answers")
    sums = answers.where("kind = 0").agg(F.sum("n_kept"), F.sum("n_all"), F.sum("v_all")).first()
    n_kept, n_all, v_all = (x or 0 for x in sums)
    uniform = 1 / (v_all + 1)

    def bins(_: list, own: Chunk, words: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen = own.counts(np.ones(len(own.lengths), bool))[1]
        first = np.zeros(len(own.pairs), np.int64)
        first[own.pair] = np.arange(len(own.pair))
        word, context = own.token[first], own.context[first]
        before = words[0][context]
        rows = np.stack([frequency_bucket(before), log_bins(ratio(pairs[0], before) / uniform), log_bins(words[0][word] / max(n_kept, 1) / uniform)], axis=1)
        values, number = np.unique(rows, axis=0, return_inverse=True)
        counts = np.bincount(number.ravel(), seen).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*values.T, counts)], names=["b", "q2", "q1", "n"])

    held = with_counts(chunks.where("role = 2"), answers.where("chunk % 2 = 1"), buckets, bins, "b long, q2 long, q1 long, n long")
    table = np.array([tuple(r) for r in held.groupBy("b", "q2", "q1").agg(F.sum("n")).collect()], np.float64).reshape(-1, 4)
    weights = learned_weights(table)

    def scores(rows: list, own: Chunk, words: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts, both = words.sum(axis=0), pairs.sum(axis=0)
        c, before = counts[own.token], counts[own.context]
        w = weights[frequency_bucket(before)]
        p = w[:, 0] * ratio(both[own.pair], before) + w[:, 1] * c / max(n_all, 1) + w[:, 2] * uniform
        missing = np.where(before > 0, 0.0, w[:, 0]) + (w[:, 1] if not n_all else 0.0)
        logs, base = np.log10(p / np.maximum(1 - missing, 1e-9)), np.log10((c + 1) / (n_all + v_all + 1))
        columns = [[r[3] for r in rows], own.lengths, np.add.reduceat((c > 0).astype(np.int64), own.starts), np.add.reduceat(base, own.starts), np.add.reduceat(logs, own.starts)]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000], k) for x, (_, k) in zip(columns, SCORE, strict=True)], names=[f for f, _ in SCORE])

    out = with_counts(chunks, answers, buckets, scores, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_all).cast("long"))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document by the model of those that are not held out; cases as in `score_texts`."""
    part = doc_crc_mod("doc_id", 7)
    docs = documents(spark, sf_dir).select("doc_id", "text", F.when(part == 2, 0).when(part == HELD_OUT_MOD, 2).otherwise(1).alias("role"))
    out = score_texts(docs)
    return out.select("doc_id", (doc_crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_deleted_interpolation": op7_deleted_interpolation}
SQL: dict[str, str] = {}
