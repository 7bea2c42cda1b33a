import random

import pytest

from tidemark.llm import langid


def greedy(text, source):
    n = at = 0
    while at < len(text):
        length = 1
        while at + length < len(text) and text[at : at + length + 1] in source:
            length += 1
        at += length
        n += 1
    return n


@pytest.mark.parametrize("text", ["abcabcab", "bbbbb", "cab", "xaxb"])
def test_phrases_equal_longest_matches(text):
    source = "abcabbacabc"
    parser = langid.CrossParser({"k": [source]})
    assert parser.phrases([parser.encode(text)])[0, 0] == greedy(text, source)


@pytest.mark.parametrize("seed", range(6))
def test_long_texts_in_several_scripts_equal_greedy_parsing(seed):
    """Texts of many blocks; some follow the source for longer than a block, so that ends change block after block."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeабвгд中文字語", k=r.randrange(1, 6))) for _ in range(40)]
    sources = {k: " ".join(r.choices(words, k=400)) for k in ("one", "two", "three")}
    long = sources["one"] * 3
    texts = [" ".join(r.choices(words, k=n)) for n in (1, 5, 90, 700)] + [long[5:], "z" * 700, "", "a", sources["two"][300:1200] + "я" + long]
    parser = langid.CrossParser({k: [v] for k, v in sources.items()})
    got = parser.phrases([parser.encode(t) for t in texts])
    assert got.tolist() == [[greedy(t, sources[n]) for n in parser.names] for t in texts]


def test_every_label_is_learned(spark):
    r = random.Random(1)
    alphabets = {f"l{k}": "".join(r.sample("abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопαβγδεζηθ", 9)) for k in range(70)}
    rows = [(k, " ".join("".join(r.choices(own, k=4)) for _ in range(30)), name) for k, (name, own) in enumerate([x for x in alphabets.items() for _ in range(3)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, docs.where("doc_id % 3 > 0")).collect()
    assert sum(x["lang_pred"] == x["lang"] for x in out) >= 0.97 * len(out)


def test_the_sample_is_whole_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 100)
    rows = [(k, f"text {k} " * 5, "en") for k in range(30)] + [(99, "long " * 200, "de")]
    got = dict(langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert got["de"] == (("long " * 200)[:100],)
    assert 60 <= sum(map(len, got["en"])) <= 100 and all(t in {x for _, x, _ in rows} for t in got["en"])


def test_held_out_accuracy(spark, few):
    out = langid.identify(few, few.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2")).where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out) > 0
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_rows(odd, nothing):
    out = langid.identify(odd, odd).collect()
    assert len(out) == odd.count() and set(odd.columns) < set(out[0].asDict())
    for r in out:
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))
    assert langid.identify(nothing, nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
