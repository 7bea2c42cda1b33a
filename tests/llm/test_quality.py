import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if counts[g] > 1 for d in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(odd, few, nothing):
    for docs in (odd, few):
        texts = Counter((r["doc_id"], base(r["text"] or "")) for r in docs.collect())
        out = quality.judge(docs).collect()
        assert Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in out) == texts
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in out)
        assert not any(r["kept"] for r in out if r["base_failed"])
    assert quality.judge(nothing).count() == 0


def test_clean_stay_and_junk_goes(few, spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    clean = [r["text"] for r in few.where("length(text) > 600 AND length(text) < 4000").join(good, "doc_id").collect()][:30]
    junk = [re.sub(r"(\S+)", r"\1&&&", t) for t in clean[:10]] + [t.upper().replace(" ", "!! ") for t in clean[:10]]
    rows = [(k, t, None) for k, t in enumerate(clean + junk)]
    out = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), few).collect()}
    assert all(out[k] for k in range(len(clean)))
    assert not any(out[k] for k in range(len(clean), len(rows)))


def test_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 3.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([1.0, 2]), np.array([2, 4.0])) == pytest.approx(0)


def test_texts_without_common_words_and_in_another_language_go(few, spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    clean = few.where("length(text) > 2500").join(good, "doc_id").select("text", "lang").collect()
    known = quality.references(few)

    def uncommon(text, lang):
        return " ".join(w for w in text.split() if quality.common_form([w.encode()]) and quality.common_form([w.encode()])[0] not in known[lang][1])

    other = {"en": "de", "de": "en", "es": "en", "fr": "en"}
    rows = [(r["text"], r["lang"], True) for r in clean] + [(r["text"], other[r["lang"]], False) for r in clean] + [(uncommon(r["text"], r["lang"]), r["lang"], False) for r in clean]
    out = quality.judge(spark.createDataFrame(rows, "text string, lang string, good boolean"), few).where("NOT base_failed AND n_words >= 60").collect()
    assert len({r["good"] for r in out}) == 2
    assert all(r["kept"] == r["good"] for r in out)


def test_every_label_has_a_reference(spark):
    rows = [(f"l{k:03}", f"word{k} other{k} word{k}") for k in range(70) for _ in range(2 if k < 64 else 1)]
    known = quality.references(spark.createDataFrame(rows, "lang string, text string"))
    assert len(known) == 70 and all(f"word{k}".encode() in known[f"l{k:03}"][1] for k in range(70))
