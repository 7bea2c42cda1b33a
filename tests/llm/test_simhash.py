import random
import re

import numpy as np
import pytest
import xxhash
from conftest import prose

from tidemark.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(named, distance=4):
    """named: (doc_id, fingerprint) of every row -> sorted (doc_id, fingerprint, component_id)."""
    fps = sorted({f for _, f in named})
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[top(a)] = top(b)
    least = {}
    for i, f in named:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    return sorted(((i, f, least.get(top(f))) for i, f in named), key=str)


def unsigned(rows):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows), key=str)


def test_fingerprints_and_components_equal_brute_force(odd, few, nothing):
    for docs in (odd, few):
        expected = components([(r["doc_id"], plain(r["text"])) for r in docs.collect()])
        assert unsigned(simhash.simhash_components(docs).collect()) == expected
    assert simhash.simhash_components(nothing).collect() == []


def test_long_texts_and_runs(monkeypatch):
    text = prose(4, 30_000, 500)
    whole = simhash.fingerprint(text.encode())
    assert whole == plain(text)
    monkeypatch.setattr(simhash, "RUN", 1000)
    assert simhash.fingerprint(text.encode()) == whole
    assert [simhash.fingerprint(t.encode()) for t in ("", " \n", "One", "one TWO three", "É é a b c")] == [plain(t) for t in ("", " \n", "One", "one TWO three", "É é a b c")]


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 5])
def test_slices_leave_no_pair_out(distance):
    r = random.Random(distance)
    parts = simhash.slices(distance)
    assert sum(m for m, _ in parts) == (1 << 64) - 1 and sum(k + 1 for _, k in parts) == distance + 1
    for _ in range(300):
        d = sum(1 << b for b in r.sample(range(64), distance))
        assert any((d & m).bit_count() <= k for m, k in parts)


def clustered(seed, groups, size, spread):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        at = r.getrandbits(64)
        for _ in range(r.choice([1, 2, size])):
            at ^= sum(1 << b for b in r.sample(range(64), r.randrange(spread + 1)))
            out.append(at)
    return out


def test_trees_meet_every_near_pair_once(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    fps = np.unique(np.array(clustered(1, 150, 12, 5), np.uint64))
    met = set()
    for mask, radius in simhash.slices(4):
        tree = simhash.Tree(fps, len(fps), mask, radius)
        assert tree.shards > 4
        at, shard, home = tree.places(fps)
        assert sorted(at[home]) == list(range(len(fps)))
        for s in range(tree.shards):
            own, all_ = at[(shard == s) & home], at[shard == s]
            met |= {(min(a, b), max(a, b)) for a in own for b in all_ if a != b}
    near = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 4}
    assert near and near <= met and len(met) < len(fps) * (len(fps) - 1) / 2


def test_shards_split_over_tasks_and_dense_groups(spark, monkeypatch):
    """Chains, a dense ball and single fingerprints through many small shards, each split in parts."""
    r = random.Random(9)
    ball = [sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(200)]
    named = list(enumerate(clustered(2, 200, 15, 5) + ball + ball[:20] + [0, 0]))
    r.shuffle(named)
    for size, part, tile, hot in ((16, 10, 7, 3),):
        monkeypatch.setattr(simhash, "SHARD", size)
        monkeypatch.setattr(simhash, "PART", part)
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "HOT", hot)
        given = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in named], "doc_id long, fp long").repartition(3)
        monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
        assert unsigned(simhash.simhash_components(given).collect()) == components(named)


def test_query_digits(spark, sf_dir, few):
    rows = {r["doc_id"]: r for r in simhash.op13_simhash_vantage(spark, sf_dir).collect()}
    assert all(rows[r["doc_id"]]["fingerprint"] == f"{plain(r['text']):016x}" for r in few.collect())
