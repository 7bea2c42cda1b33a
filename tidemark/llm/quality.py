"""Quality rules: word statistics, and the divergence of a document's histograms from its language's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import LOWER, documents, map_arrow, saved, split_words, texts

SYMBOLS = b"#*$%&|<>"
#: Character classes: small, capital, digit, white space, stop, other sign, beyond ASCII (one for each code point).
CLASSES = 7
STOPS = b".,;:'\"?!()-"
WINDOW_WORDS, REPEAT_PERCENT, LEAST_WORDS = 8, 30, 20
#: Common words of each reference, words (of the word histogram) and bytes (of the class histogram)
#: from which a histogram is judged.
COMMON_WORDS, GUARD_WORDS, GUARD_BYTES = 100, 60, 150
#: Greatest Jensen-Shannon distance (0 to 1) from the class reference.
CLASS_LIMIT = 0.26
#: Word limit by length where none is given: BASE + SLOPE / sqrt(words), and always MARGIN below a text without common
#: words. Greatest distances of labelled clean texts of sf0.1: 0.477 below 120 words, 0.391 below 200, 0.345 below 400,
#: 0.276 below 1,000, 0.199 from there on.
LIMIT_BASE, LIMIT_SLOPE, LIMIT_MARGIN = 0.09, 3.9, 0.005
#: Words that a task counts before it hands the counts on.
FLUSH_WORDS = 100_000


def class_table() -> bytes:
    table = bytearray([5] * 256)
    for first, last, kind in ((97, 122, 0), (65, 90, 1), (48, 57, 2), (9, 13, 3), (32, 32, 3), (192, 255, 6), (128, 191, 7)):
        table[first : last + 1] = bytes([kind] * (last + 1 - first))
    for c in STOPS:
        table[c] = 4
    return bytes(table)


CLASS_OF = class_table()


def class_counts(text: bytes) -> np.ndarray:
    """Code points in each class; continuation bytes have one of their own, which is left out."""
    return np.bincount(np.frombuffer(text.translate(CLASS_OF), np.uint8), minlength=CLASSES + 1)[:CLASSES]


def common_form(words: list[bytes]) -> list[bytes]:
    return [w.strip(b".,;:!?") for w in b" ".join(words).translate(LOWER).split()]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW_WORDS that occur twice or more. Windows are numbered exactly, by doubling: two, four, eight words."""
    n = len(words)
    if n <= WINDOW_WORDS:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n:
        return 0
    span, counts = 1, None
    while span < WINDOW_WORDS:
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        values, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        span *= 2
    again = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW_WORDS, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_row(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = Counter(line for line in text.split(b"\n") if line.strip())
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), sum(lines.values()) - len(lines), repeated_words(words)


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; 0 to 1."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    parts = [np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])) for x in (p, q)]
    return float(np.sqrt(max(0.0, (parts[0] + parts[1]) / 2)))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """For each label: class counts, places of its common words, counts of those and of the rest.

    Counted over all labelled documents, in each task first; only the result, some hundred rows a label, comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            flat = [(k, w, n) for k, own in found.items() for w, n in own.items()]
            flat += [(k, bytes([255, c]), int(n)) for k, own in classes.items() for c, n in enumerate(own)]
            found.clear()
            classes.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.binary()), pa.array([r[2] for r in flat], pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            langs = b.column(0).to_pylist()
            for lang, text in zip(langs, texts(b), strict=True):
                found.setdefault(lang, Counter()).update(common_form(split_words(text)))
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            if sum(map(len, found.values())) > FLUSH_WORDS:
                yield rows()
        yield rows()

    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = saved(map_arrow(labelled, count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "quality-words")
    is_class = F.substring("word", 1, 1) == F.lit(b"\xff")
    top = Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("is_class", is_class).withColumn("k", F.row_number().over(top)).where(F.col("k") <= COMMON_WORDS).collect()
    totals = {r["lang"]: r["n"] for r in counts.where(~is_class).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rows: dict[str, list] = {}
    for r in kept:
        rows.setdefault(r["lang"], []).append(r)
    out = {}
    for name in sorted(totals):
        own = sorted(((r["k"], bytes(r["word"]), r["n"]) for r in rows[name] if not r["is_class"]))
        classes = np.zeros(CLASSES)
        for r in rows[name]:
            if r["is_class"]:
                classes[bytes(r["word"])[1]] = r["n"]
        common = np.array([n for _, _, n in own], float)
        out[name] = classes, {w: i for i, (_, w, _) in enumerate(own)}, np.append(common, totals[name] - common.sum())
    return out


def word_limit_of(n_words: int, common: np.ndarray) -> float:
    """The greatest word distance of a text of so many words from a reference with these counts."""
    none = np.zeros(len(common))
    none[-1] = 1
    return min(LIMIT_BASE + LIMIT_SLOPE / max(n_words, 1) ** 0.5, js_distance(none, common) - LIMIT_MARGIN)


def divergence(text: bytes, words: list[bytes], own: list[tuple]) -> tuple[float, float, float]:
    """Class and word distance from the reference that is nearest by their sum, and its word limit; distances are 0 where a guard or no reference forbids a judgement."""
    if not own or len(text) < GUARD_BYTES:
        return 0.0, 0.0, 1.0
    classes, forms = class_counts(text), Counter(common_form(words))
    best = (2.0, 2.0, 1.0)
    for reference, places, common in own:
        if len(words) < GUARD_WORDS:
            best = min(best, (js_distance(classes, reference), 0.0, 1.0))
            continue
        seen = np.zeros(len(common))
        for w in forms.keys() & places.keys():
            seen[places[w]] = forms[w]
        seen[-1] = len(words) - seen.sum()
        best = min(best, (js_distance(classes, reference), js_distance(seen, common), word_limit_of(len(words), common)), key=lambda x: x[0] + x[1])
    return best


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_())]
KINDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def judge(docs: DataFrame, training: DataFrame | None = None, class_limit: float = CLASS_LIMIT, word_limit: float | None = None) -> DataFrame:
    """docs with the word statistics, both distances and the verdict `kept`.

    A document is compared with the reference of its own label or, where it has none, with the nearest one. Texts of
    fewer than GUARD_BYTES bytes are not judged by divergence at all and those of fewer than GUARD_WORDS words only by
    class. Without word_limit the limit of word_limit_of holds. The base rules hold for all, and null counts as empty and fails them. Without any labelled row only the base rules hold. Other columns and repeated
    rows are kept; columns named as the new ones are replaced.
    """
    known = references(docs if training is None else training)
    held = docs.drop(*(f for f, _ in FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, text in zip(b.column(b.schema.get_field_index("lang")).to_pylist(), texts(b), strict=True):
                words = split_words(text)
                base = base_row(text, words)
                failed = base_fails(base[0], base[4])
                by_class, by_word, limit = divergence(text, words, [known[lang]] if lang in known else list(known.values()))
                rows.append((*base, failed, by_class, by_word, not failed and by_class <= class_limit and by_word <= (limit if word_limit is None else word_limit)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True))], names=[*b.schema.names, *(f for f, _ in FIELDS)])

    return map_arrow(held, run, ", ".join(f"`{c}` {t}" for c, t in held.dtypes) + ", " + KINDS)


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics, distances and verdict of every document; cases as in `judge`."""
    out = judge(documents(spark, sf_dir).select("doc_id", "lang", "text")).drop("lang", "text")
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


QUERIES = {"op3_distribution_divergence": op3_distribution_divergence}
CLASS_SQL = ", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g')) AS c{k}" for k, c in enumerate(("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", ".,;:''\"?!()\\-", r"\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F")))
HALF = "(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"
#: For documents with a label, as all of the driver's have; the nearest reference of others is left to the tests.
SQL = {
    "op3_distribution_divergence": f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
v AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
g AS (SELECT doc_id, i, CASE WHEN i + 8 <= count(*) OVER (PARTITION BY doc_id) THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS gram FROM v),
h AS (SELECT doc_id, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
k AS (SELECT doc_id, i, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM h),
rep AS (SELECT doc_id, sum(covered)::BIGINT AS n_repeat_words FROM k GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
base AS (SELECT d.doc_id, d.lang, d.text, len(w.w) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN w USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
forms AS (SELECT doc_id, lang, trim(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?') AS word, count(*) AS n FROM v GROUP BY ALL),
common AS (SELECT lang, word, n, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM (SELECT lang, word, sum(n) AS n FROM forms GROUP BY ALL)),
ref AS (SELECT lang, word, n / total AS q FROM common WHERE k <= {COMMON_WORDS}),
bare AS (SELECT lang, sqrt(sum(s)) AS bare FROM (SELECT lang, {HALF.format(p="0.0::DOUBLE", q="q")} AS s FROM ref UNION ALL SELECT lang, {HALF.format(p="1.0::DOUBLE", q="(1 - sum(q))")} FROM ref GROUP BY 1) GROUP BY 1),
seen AS (SELECT b.doc_id, r.q, coalesce(f.n, 0) / b.n_words AS p FROM base b JOIN ref r USING (lang) LEFT JOIN forms f ON f.doc_id = b.doc_id AND f.word = r.word),
wd AS (SELECT doc_id, sum({HALF.format(p="p", q="q")}) AS s FROM (SELECT doc_id, p, q FROM seen UNION ALL SELECT doc_id, 1 - sum(p), 1 - sum(q) FROM seen GROUP BY 1) GROUP BY 1),
c AS (SELECT doc_id, lang, {CLASS_SQL}, length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS c6 FROM d),
cl AS (UNPIVOT c ON c0, c1, c2, c3, c4, c5, c6 INTO NAME class VALUE n),
cr AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cl GROUP BY lang, class),
cd AS (SELECT doc_id, sum({HALF.format(p="p", q="q")}) AS s FROM (SELECT doc_id, cl.n / nullif(sum(cl.n) OVER (PARTITION BY doc_id), 0) AS p, q FROM cl JOIN cr USING (lang, class)) GROUP BY 1),
out AS (SELECT base.*, least({LIMIT_BASE} + {LIMIT_SLOPE} / sqrt(greatest(n_words, 1)), bare - {LIMIT_MARGIN}) AS word_limit, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN strlen(text) >= {GUARD_BYTES} THEN sqrt(greatest(cd.s, 0)) ELSE 0 END AS class_distance, CASE WHEN strlen(text) >= {GUARD_BYTES} AND n_words >= {GUARD_WORDS} THEN sqrt(greatest(wd.s, 0)) ELSE 0 END AS word_distance FROM base JOIN bare USING (lang) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, NOT base_failed AND class_distance <= {CLASS_LIMIT} AND word_distance <= word_limit AS kept FROM out
"""
}
