import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import substrings
from tidemark.llm.suffix_array import common_prefixes, find, suffix_array


def brute(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("data", [b"", b"a", b"banana" * 9, b"\0\0a\0\0", bytes(random.Random(3).choices(b"ab", k=300)), bytes(random.Random(4).choices(range(256), k=300))])
def test_suffix_array_and_prefixes(data):
    x = np.frombuffer(data, np.uint8)
    order, rank = suffix_array(x, 512)
    assert [data[k:] for k in order] == sorted(data[k:] for k in range(len(data)))
    common = common_prefixes(x, order).tolist() if len(x) else []
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :], data[order[k] :]
        assert common[k] == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def test_find_in_another_array():
    a, b = (np.frombuffer(bytes(random.Random(s).choices(b"ab", k=90)) + b"\0" * 8, np.uint8) for s in (1, 2))
    places = np.array(sorted(range(82), key=lambda k: b[k : k + 8].tobytes()))
    got = find(a, np.arange(82), b, places, 8)
    strings = {b[k : k + 8].tobytes() for k in range(82)}
    assert all((g >= 0) == (a[k : k + 8].tobytes() in strings) for k, g in enumerate(got.tolist()))
    assert all(g < 0 or b[places[g] : places[g] + 8].tobytes() == a[k : k + 8].tobytes() for k, g in enumerate(got.tolist()))


def test_equal_strings_have_equal_anchors():
    text = bytes(random.Random(5).choices(range(97, 123), k=3000))
    for at in (0, 7, 1000, 2500):
        part = text[at : at + substrings.LENGTH]
        alone = next(substrings.anchored_runs(part))[0][0]
        anchors, firsts, lasts = next(substrings.anchored_runs(text))
        assert alone == anchors[np.searchsorted(firsts, at, "right") - 1]


@pytest.mark.parametrize("length,seed", [(40, 16), (400, 96)])
def test_removal_equals_brute_force(length, seed, odd, spark):
    r = random.Random(length)
    line = "".join(r.choices("abcdefgh ", k=length + 30))
    more = [(100 + k, "".join(r.choices("xyz ", k=r.randrange(50, 300))) + line[k % 7 :] + "".join(r.choices("uvw", k=40)) * (k % 3), None, None, None, None) for k in range(25)]
    more += [(200, "ab" * length, None, None, None, None), (201, "é" * length, None, None, None, None)]
    docs = odd.union(spark.createDataFrame(more, odd.schema))
    rows = docs.collect()
    out = substrings.remove_repeats(docs, keep_text=False, length=length, seed=seed)
    got = Counter((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept"]) for x in out.collect())
    assert got == Counter((str(x["doc_id"]), *b) for x, b in zip(rows, brute([(x["text"] or "").encode() for x in rows], length), strict=True))
    assert set(docs.columns) < set(out.columns)


@pytest.mark.parametrize("shared", [30, 36, 39, 60])
def test_no_task_takes_all_regions_of_an_anchor(shared, spark, monkeypatch):
    r = random.Random(shared)
    passage = "".join(r.choices("abcdefgh", k=shared))
    around = ["".join(r.choices("uvwxyz", k=60)) for _ in range(12)]
    rows = [(k, around[k % 5] + passage + around[k // 5]) for k in range(60)] + [(100 + k, "".join(r.choices("uvwxyz", k=70)) + passage + "".join(r.choices("uvwxyz", k=70))) for k in range(40)]
    largest, regions = [], substrings.regions

    def spy(wanted, *rest):
        largest.append(wanted.selectExpr("explode(runs) AS r").groupBy("r.anchor").count().agg({"count": "max"}).first()[0] or 0)
        return regions(wanted, *rest)

    monkeypatch.setattr(substrings, "regions", spy)
    monkeypatch.setattr(substrings, "HOT_RUNS", 6, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substrings.remove_repeats(docs, keep_text=False, length=40, seed=16).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept"]) for x in out} == {i: b for (i, _), b in zip(rows, brute([t.encode() for _, t in rows], 40), strict=True)}
    assert max(largest) <= 6


def test_several_shards_of_a_bucket_are_merged():
    r = random.Random(8)
    parts = [bytes(r.choices(b"abcd", k=60)) for _ in range(6)]
    parts[4] = b"z" * 10 + parts[1][5:45] + b"y" * 10
    shards = [substrings.Shard(parts[:3], 40), substrings.Shard(parts[3:], 40)]
    substrings.merge(shards, 40)
    assert shards[0].flags().nonzero()[0].tolist() == [60 + 5] and shards[1].flags().nonzero()[0].tolist() == [60 + 10]


def test_documents(few):
    rows = few.collect()
    out = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in substrings.remove_repeats(few).collect()}
    assert out == {x["doc_id"]: b for x, b in zip(rows, brute([x["text"].encode() for x in rows], 400), strict=True)}


def test_texts_beyond_a_chunk_and_of_one_letter(spark):
    """Repeats on both sides of a chunk's end and across it, and a text all of whose strings are equal."""
    r = random.Random(12)
    size = substrings.CHUNK
    long = "".join(r.choices("abcdefghijklmnop", k=size + 5000))
    passage = long[size - 300 : size + 300]
    rows = [(1, long), (2, "x" * 50 + passage + "y" * 30 + long[100:180]), (3, "a" * 30_000), (4, "z" + long[-70:])]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False, length=40, seed=16).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept"]) for x in out} == {i: b for (i, _), b in zip(rows, brute([t.encode() for _, t in rows], 40), strict=True)}


def test_clashing_columns_come_back(spark):
    text = "".join(random.Random(3).choices("abcdef", k=500))
    rows = [(1, text, "k", 7, "r", "m", 5), (2, text[:100], None, 8, None, "n", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __row int, __whole string, __marks string, n_bytes int")
    out = {x["doc_id"]: x for x in substrings.remove_repeats(docs, length=40, seed=16).collect()}
    assert [(out[i]["__key"], out[i]["__row"], out[i]["__whole"], out[i]["__marks"]) for i in (1, 2)] == [("k", 7, "r", "m"), (None, 8, None, "n")]
    assert [out[i]["n_bytes"] for i in (1, 2)] == [500, 100]


def test_nothing(nothing):
    assert substrings.remove_repeats(nothing).count() == 0


def brute_words(texts, words):
    """What is left of each text without its repeated passages of so many words."""
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    passages = [[tuple(t[a:z] for a, z in own[k : k + words]) for k in range(len(own) - words + 1)] for t, own in zip(texts, found, strict=True)]
    seen = Counter(p for own in passages for p in own)
    out = []
    for t, own, at in zip(texts, passages, found, strict=True):
        gone = [False] * len(t)
        starts = [k for k, p in enumerate(own) if seen[p] > 1]
        for i, k in enumerate(starts):
            last = k + words - 1
            if i + 1 < len(starts) and starts[i + 1] == k + words:  # the next passage touches this one
                last += 1
            gone[at[k][0] : at[last][1]] = [True] * (at[last][1] - at[k][0])
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("words,hot", [(50, 4096), (5, 6), (2, 4096)])
def test_passages_equal_brute_force(words, hot, odd, spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_RUNS", hot)
    r = random.Random(words)
    own = lambda n: [f"q{r.randrange(10**6)}" for _ in range(n)]
    passage, edge, twin = own(words), own(words - 1), own(words + 3)
    more = [(100 + k, " ".join(own(r.randrange(9)) + passage + own(r.randrange(1, 9)))) for k in range(20)]
    more += [(200 + k, " ".join(own(3) + edge + own(3))) for k in range(4)]
    more += [(300, "  " + "\t\n".join(passage + passage) + " "), (301, " ".join(twin) + " é\u00a0 "), (302, " ".join(twin) + " é\u00a0 "), (303, "a" * 500), (304, "a" * 500), (305, "ab " * 80), (306, " ".join(twin[1:] + own(40 + words) + twin[:-1]))]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(5)
    rows = docs.collect()
    expected = Counter((str(x["doc_id"]), *b) for x, b in zip(rows, brute_words([(x["text"] or "").encode() for x in rows], words), strict=True))
    got = Counter((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept"]) for x in substrings.remove_passages(docs, keep_text=False, words=words).collect())
    assert got == expected
