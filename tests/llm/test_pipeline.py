"""The pipeline's stages keep their contract, and their effects equal those of the operators by brute force."""

import random

import __spark_entry__
import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F
from test_jaccard import brute as components
from test_langid import greedy
from test_packing import check as packed
from test_quality import base
from test_substrings import brute as removal

from tidemark.llm import langid


def test_stages(spark, few, sf_dir, tmp_path):
    docs = few
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == before.columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "quality_rules":
            failed = {r["doc_id"] for r in before.collect() if (b := base(r["text"]))[0] < 20 or 100 * b[4] > 30 * b[0]}
            assert failed and not failed & {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "best_fit_packing":
            used, least = packed([(r["doc_id"], r["text"]) for r in before.collect()], docs.collect(), 4096)
            assert used <= least + 1
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert {r["doc_id"] for r in docs.collect()} == {c for _, _, c in components(rows)}
        if name == "repeated_strings":
            rows = {r["doc_id"]: r["text"].encode() for r in before.collect()}
            expected = removal(list(rows.values()), 400)
            for (i, text), (n, gone, _, _) in zip(rows.items(), expected, strict=True):
                left = docs.where(f"doc_id = {i}").first() if gone else None
                assert left is None or n - gone - 6 <= len(left["text"].encode()) <= n - gone
    assert docs.count() >= before.count()


def test_language_id_by_brute_force(spark, sf_dir, few):
    """Phrases counted by search in the learned texts themselves; a row stays if its language takes few enough bits a symbol."""
    foreign = spark.createDataFrame([(-1, "zwölf xq jjk vvw " * 30, None, "s", 9), (-2, " 12 ", "en", "s", 4), (-3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = few.where("length(text) BETWEEN 100 AND 700").unionByName(foreign).cache()
    samples = langid.sample(docs)
    parser, bounds = langid.CrossParser({n: list(own) for n, own in samples}), langid.limits(samples)
    spelled = lambda codes: "".join(map(chr, (codes + 1).tolist()))
    learned = {n: "".join(spelled(parser.encode(t)) for t in own) for n, own in samples}
    expected = {}
    for r in docs.collect():
        codes = parser.encode(langid.normal_text((r["text"] or "").encode()))
        if not (codes > langid.SPACE).any():
            continue
        bits = {n: greedy(spelled(codes), t) * np.log2(len(t) + 2) / len(codes) for n, t in learned.items()}
        best = min(sorted(bits), key=bits.get)
        if bits[best] <= next((limit for n, limit in reversed(bounds) if len(codes) >= n), np.inf):
            expected[r["doc_id"]] = r["lang"] or best
    assert {r["doc_id"]: r["lang"] for r in cp.language_id(spark, docs, sf_dir).collect()} == expected
    assert 0 < len(expected) < docs.count()


def test_odd_rows_pass(spark, odd, nothing, sf_dir):
    for docs in (odd.drop("a"), nothing.drop("a")):
        for _, stage in cp.STAGES:
            stage(spark, docs, sf_dir).count()


def test_languages_that_were_not_learned_go(spark, sf_dir, few):
    for left in ("en", "es"):
        docs = few.withColumn("lang", F.when(F.col("lang") != left, F.col("lang"))).where("length(text) > 300")
        kept = {r["doc_id"] for r in cp.language_id(spark, docs, sf_dir).collect()}
        rows = few.where("length(text) > 300").select("doc_id", "lang").collect()
        own, other = ([r["doc_id"] in kept for r in rows if (r["lang"] == left) == foreign] for foreign in (False, True))
        assert sum(own) >= 0.95 * len(own) > 0
        assert sum(other) <= 0.2 * len(other) and other


def test_texts_too_short_to_judge_stay(spark, sf_dir, few):
    short = spark.createDataFrame([(-1, "A.", None, "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.language_id(spark, few.unionByName(short), sf_dir).where("doc_id = -1").count() == 1


def test_registered():
    known = __spark_entry__.queries()
    assert "pipeline" in known and {f"op{n}_" for n in range(1, 14)} == {k[: k.index("_") + 1] for k in known if k.startswith("op")}


def test_short_passages_of_many_words_go(spark, sf_dir):
    """A passage of 60 words, 359 bytes, in documents that share nothing else; one of 45 words stays."""
    r = random.Random(5)
    own = lambda n: [f"w{r.randrange(1000, 9999)}" for _ in range(n)]
    passage, short = (" ".join(f"x{r.randrange(1000, 9999)}" for _ in range(n)) for n in (60, 45))
    rows = [(k, " ".join(own(80)) + " " + (passage if k < 9 else short) + " " + " ".join(own(70)), "en", "s", 1) for k in range(18)]
    rows += [(50, " ".join(own(150)), "en", "s", 1), (51, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        if name.startswith("repeated"):
            docs = stage(spark, docs, sf_dir)
    left = {x["doc_id"]: x for x in docs.collect()}
    assert {i: left[i]["text"] for i in left} == {i: t and t.replace(passage, "") for i, t, *_ in rows}
    assert all(x["n_chars"] == len(x["text"]) for x in left.values() if x["text"] is not None)
    assert len(left) == 20
