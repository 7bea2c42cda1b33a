import random

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_scores(m, text):
    unit = (pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else ""

    def rest(i):
        if i == len(unit):
            return [0.0]
        out = []
        for width in range(1, min(m.longest, len(unit) - i) + 1):
            part = unit[i : i + width]
            if part in m.ids:
                out += [m.scores[part] + s for s in rest(i + width)]
            elif width == 1:
                out += [m.byte_score * len(part.encode()) + s for s in rest(i + width)]
        return out

    return sorted(rest(0), reverse=True)


@pytest.mark.parametrize("text", ["a", "the cat", "é\nx", "hello the", "日本 b", "  x", "", "Über ß", "a   b", "x  "])
def test_n_best_equals_enumeration(text):
    m = pieces.lattice(PATH)
    m.prepare([text])
    ids, scores, _, _ = m.encode(text, 4)
    assert scores == pytest.approx(all_scores(m, text)[:4])
    assert all(round(s, 3) <= round(scores[0], 3) for s in scores)


def test_encode_and_decode(spark, odd, nothing):
    got = {(r["doc_id"], k): r["n_best"] for k, r in enumerate(pieces.encode(odd, PATH).collect())}
    flat = spark.createDataFrame([(k, [list(x["ids"]) for x in n]) for k, n in enumerate(got.values())], "doc_id long, all array<array<int>>")
    back = pieces.decode(flat.selectExpr("doc_id", "explode(all) AS ids"), PATH)
    texts = {}
    for r in back.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    originals = [r["text"] for r in odd.select("doc_id", "text").collect()]
    assert all(own == {(t or "")} for own, t in zip((texts[k] for k in sorted(texts)), originals, strict=True))
    assert pieces.encode(nothing, PATH).count() == 0


def test_digests_agree_with_the_model_pieces(odd):
    rows = pieces.digests(odd, PATH).collect()
    assert len(rows) == odd.count() and all(r["decoded"] for r in rows)
    assert all(list(r["n_best_scores"]) == sorted(r["n_best_scores"], reverse=True) for r in rows)


def viterbi(m, text):
    unit = pieces.SPACE + text.replace(" ", pieces.SPACE)
    best = [0.0] + [float("-inf")] * len(unit)
    for end in range(1, len(unit) + 1):
        best[end] = max(best[s] + x for s, x, _ in m.edges_to(unit, end))
    return best[-1]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "a", "日本語中文字", "ab \n"])
def test_long_texts_without_words(alphabet):
    m = pieces.lattice(PATH)
    text = "".join(random.Random(6).choices(alphabet, k=20_000))
    units = m.prepare([text])[0]
    ids, scores, chosen, numbers = m.encode(text, 4, units)
    assert scores[0] == pytest.approx(viterbi(m, text))
    assert "".join(units) == pieces.SPACE + text.replace(" ", pieces.SPACE)
    n = 1 if alphabet == "日本語中文字" else 4  # the model has no piece of several of these signs
    assert len(scores) == n and scores == sorted(scores, reverse=True)
    every = [pieces.all_ids(m, numbers, c) for c in chosen]
    assert len(set(every)) == n and all(m.decode(np.frombuffer(x, "<u4").tolist()) == text for x in every)


@pytest.mark.parametrize("seed", range(4))
def test_n_best_of_many_units_equals_a_search_of_the_whole_text(seed):
    m = pieces.lattice(PATH)
    text = "".join(random.Random(seed).choices("theandig  \n.é", k=90))
    units = m.prepare([text])[0]
    whole = m.n_best(pieces.SPACE + text.replace(" ", pieces.SPACE), 6)
    assert m.encode(text, 6, units)[1] == pytest.approx([s for s, _ in whole])


def test_a_unit_cut_into_parts_has_the_same_segmentations(monkeypatch):
    m = pieces.lattice(PATH)
    for seed in range(20):
        text = "".join(random.Random(seed).choices("abcdefghij", k=40))
        monkeypatch.setattr(pieces, "LONG_UNIT", 256)
        m.clear()
        expected = m.encode(text, 4, m.prepare([text])[0])[1]
        monkeypatch.setattr(pieces, "LONG_UNIT", 8)
        m.clear()
        assert m.encode(text, 4, m.prepare([text])[0])[1] == pytest.approx(expected)
    m.clear()


def test_decoded_says_what_decoding_gives(spark):
    """A text that holds the space mark itself comes back with a space."""
    docs = spark.createDataFrame([(1, "a b"), (2, f"a{pieces.SPACE}b"), (3, f"{pieces.SPACE}"), (4, ""), (5, None), (6, " a  b ")], "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    flags = {r["doc_id"]: r["decoded"] for r in pieces.digests(docs, path).collect()}
    best = pieces.encode(docs, path, 1).selectExpr("doc_id", "n_best[0].ids AS ids")
    back = {r["doc_id"]: r["text"] for r in pieces.decode(best, path).collect()}
    assert flags == {r["doc_id"]: back[r["doc_id"]] == (r["text"] or "") for r in docs.collect()}
    assert flags[1] and flags[4] and flags[5] and flags[6] and not flags[2]
