import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram
from tidemark.llm.common import LOWER, doc_crc_mod


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def roles(docs):
    part = doc_crc_mod("doc_id", 7)
    return docs.select("doc_id", "text", F.when(part == 2, 0).when(part == 5, 2).otherwise(1).alias("role"))


@pytest.mark.parametrize("name", ["few", "odd"])
def test_counts_and_scores_equal_brute_force(name, request):
    docs = roles(request.getfixturevalue(name))
    rows = docs.collect()
    train = [tokens(r["text"]) for r in rows if r["role"]]
    one = Counter(w for t in train for w in t)
    n, v = sum(one.values()), len(one)
    two = Counter(p for t in train for p in zip(["<s>", *t], t))
    before = Counter(h for t in train for h in ["<s>", *t[:-1]])
    expected = Counter()
    for r in rows:
        t = tokens(r["text"])
        expected[(r["doc_id"], len(t), sum(one[w] > 0 for w in t), round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), 6))] += 1
    out = ngram.score_texts(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == expected
    assert {r["train_tokens"] for r in out} == {n}
    # The mixture itself, with weights found anew from the same held-out counts.
    kept = [tokens(r["text"]) for r in rows if r["role"] == 1]
    k1, k2 = Counter(w for t in kept for w in t), Counter(p for t in kept for p in zip(["<s>", *t], t))
    kb, nk = Counter(h for t in kept for h in ["<s>", *t[:-1]]), sum(len(t) for t in kept)
    table = Counter()
    for r in rows:
        if r["role"] == 2:
            t = tokens(r["text"])
            for h, w in zip(["<s>", *t], t):
                bins = [int(ngram.log_bins(np.array([x * (v + 1)]))[0]) for x in ((k2[h, w] / kb[h]) if kb[h] else 0.0, k1[w] / nk)]
                table[int(ngram.frequency_bucket(np.array([kb[h]]))[0]), *bins] += 1
    weights = ngram.learned_weights(np.array([[*k, c] for k, c in table.items()], float).reshape(-1, 4))
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], r["score"])
    for r in rows[:40]:
        t, total = tokens(r["text"]), 0.0
        for h, w in zip(["<s>", *t], t):
            a, b, c = weights[int(ngram.frequency_bucket(np.array([before[h]]))[0])]
            p = (a * two[h, w] / before[h] if before[h] else 0) + b * one[w] / n + c / (v + 1)
            total += math.log10(p / (1 if before[h] else 1 - a))
        assert by_id[r["doc_id"]] == pytest.approx(total, rel=1e-6)


def test_weights_are_a_maximum_likelihood_mixture():
    table = np.array([[3, 40, 8, 70.0], [3, -10_001, 16, 20.0], [3, -10_001, -10_001, 10.0]])
    w = ngram.learned_weights(table)[3]
    assert w.sum() == pytest.approx(1)
    shares = np.array([[2.0**5, 2, 1], [0, 4, 1], [0, 0, 1]])
    value = lambda x: (np.log(shares @ x) * table[:, 3]).sum()
    r = np.random.default_rng(1)
    assert all(value(w) >= value(x) - 1e-3 for x in r.dirichlet([1, 1, 1], 500))


def test_beats_the_base_on_held_out_text(few):
    out = ngram.score_texts(roles(few)).join(roles(few).select("doc_id", "role"), "doc_id").where("role = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_empty_and_untrained(spark, nothing):
    assert ngram.score_texts(nothing.select("doc_id", "text", F.lit(1).alias("role"))).count() == 0
    r = ngram.score_texts(spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, role int")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["score"] <= 0
