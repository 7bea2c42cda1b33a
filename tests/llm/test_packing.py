import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, got, capacity):
    model = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc_id, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(r["length"] for r in got) // capacity)


def test_odd_rows(spark, odd, nothing):
    got = packing.pack(odd, PATH, 512, 2).collect()
    used, least = check([(r["doc_id"], r["text"]) for r in odd.collect()], got, 512)
    assert used <= least + 2
    assert packing.pack(nothing, PATH).count() == 0


def test_documents(few):
    got = packing.pack(few.repartition(16), PATH).collect()
    used, least = check([(r["doc_id"], r["text"]) for r in few.collect()], got, 4096)
    assert used <= least + 1


@pytest.mark.parametrize("sizes", [[5] * 7, [1, 9, 5, 5, 10], [3, 3, 3, 3], []])
def test_best_fit_keeps_every_item(sizes):
    bins = packing.best_fit([(s, [(k, 0, 0, s, 0, 0)]) for k, s in enumerate(sizes)], 10)
    assert sorted(m[0] for _, own in bins for m in own) == list(range(len(sizes)))
    assert all(sum(m[3] for m in own) == fill <= 10 for fill, own in bins)
    assert len(bins) <= 1.3 * -(-sum(sizes) // 10) + 1


def test_words_and_whole_texts_have_the_same_ids():
    model, ours = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    for text in ["It's THE… »x« 12,5.%$ l'été. <|ENDOFTEXT|> Σας ΟΔΟΣ, x y. z a\x1cb 'tis!! a'.s", "a<|endoftext|>b<|endoftext|>.", "ﬁ ½ İstanbul\n\n#"]:
        assert ours.encode([text.encode()])[0] == struct.pack(f"<{len(e := model.encode(text, add_special_tokens=False).ids)}I", *e)


def test_words_that_hold_the_separator_or_spell_nothing():
    model, ours = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    batch = ["a \x01 b\x01c. d", "", " \t", "\x01", "x!!, X!! é.. ...", "<|startoftext|>\x01 END."]
    for _ in range(2):  # the second time from the cache
        assert ours.encode([t.encode() for t in batch]) == [struct.pack(f"<{len(e := model.encode(t, add_special_tokens=False).ids)}I", *e) for t in batch]
    assert ours.encode([]) == []


def test_a_word_is_kept_once_and_compactly():
    ours = packing.WordTokenizer(PATH)
    batch = [b" ".join(b"w%dq Zt%d,!" % (k, k) for k in range(n)) for n in (20_000, 30_000)]
    ours.encode(batch)
    assert ours.cache_bytes() < 80 * 60_000
    before = ours.cache_bytes()
    ours.encode(batch)
    assert ours.cache_bytes() == before


def test_tasks_leave_no_tokenizer_behind(spark, few):
    def held(batches):
        from tidemark.llm import packing

        assert not packing._tokenizers
        yield from batches

    docs = few.select("doc_id", "text").repartition(4)
    packing.pack(docs, PATH).count()
    assert docs.mapInArrow(held, docs.schema).count()
