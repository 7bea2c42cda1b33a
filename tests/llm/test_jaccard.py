import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import jaccard
from tidemark.llm.components import connected_components


def brute(rows, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(jaccard.LOWER).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for t in s:
            where[t].append(k)
    for a, b in {(a, b) for own in where.values() for a in own for b in own if a < b}:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[top(k)].append(rows[k][0])
    return Counter((rows[k][0], len(sets[k]), min((x for x in groups[top(k)] if x is not None), default=None)) for k in range(len(rows)))


def result(docs):
    return Counter(tuple(r) for r in jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("name", ["odd", "few"])
def test_equals_brute_force(name, request):
    docs = request.getfixturevalue(name).select("doc_id", "text")
    assert result(docs) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_at_the_threshold(spark, seed):
    """Copies with so many edits that their distances straddle the threshold, and a passage that unrelated texts share."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(60):
        words = base[:]
        for at in r.sample(range(200), r.randrange(0, 7)):
            words[at] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join([*base[:60], *(f"y{r.randrange(10**6)}" for _ in range(r.randrange(1, 30)))])) for k in range(40)]
    rows += [(200 + k, rows[k][1].upper()) for k in range(5)]
    r.shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


@pytest.mark.parametrize("change", [{"DRAWN": 0}, {"DRAWN": 6, "LEAF": 2, "PIVOTS": 1, "GROW": 2}, {"CELL": 0.25, "DRAWN": 40}, {"DRAWN": 3, "HOT_SETS": 4}], ids=str)
def test_regions_windows_and_rounds_lose_no_link(spark, monkeypatch, change):
    """A chain of near copies around several centres: members of one group lie in several regions."""
    for name, value in change.items():
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(5)
    rows = []
    for g in range(3):
        words = [f"g{g}w{r.randrange(400)}" for _ in range(150)]
        for k in range(45):
            words = words[:]
            for at in r.sample(range(150), r.randrange(0, 5)):
                words[at] = f"x{r.randrange(30)}"
            rows.append((1000 * g + k, " ".join(words)))
    r.shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_every_set_meets_all_that_are_near(few):
    """The rule of regions and replicas by brute force: each pair within reach shares a region."""
    sets = [jaccard.shingles(r["text"].encode()) for r in few.select("text").collect()]
    sets = [x for x in sets if len(x)]
    r = random.Random(3)
    sets += [np.unique(np.concatenate([x[r.randrange(1 + len(x) // 3) :], np.array(r.sample(range(10**9), len(x) // 4), np.uint64)])) for x in sets for _ in range(3) if len(x) > 20]
    pivots = jaccard.Pivots(sets[::25], 80)
    found = [pivots.regions(x) for x in sets]
    met = 0
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(x, sets[j], assume_unique=True))
            if jaccard.linked(common, len(x), len(sets[j]), 80):
                a, b = dict(found[i][1]), dict(found[j][1])
                assert any(abs(a[k] - b[k]) <= 41 for k in a.keys() & b.keys())
                met += 1
    assert met > 20 and len(pivots.centres) > 1


def test_sketches_leave_no_link_out():
    r = random.Random(2)
    dropped = 0
    for n in (1, 3, 20, 90, 400, 3000, 60_000):
        for share in (0.0, 0.5, 0.8, 0.88, 0.9, 1.0):
            own = np.array(r.sample(range(1 << 62), 2 * n), np.uint64)
            a, b = own[:n], np.concatenate([own[: int(n * share)], own[n : 2 * n - int(n * share)]])
            inter = len(np.intersect1d(a, b))
            x, y = jaccard.sketch(a), jaccard.sketch(b)
            may = jaccard.may_link(jaccard.differing_bits(x, y), len(a), len(b), 80)
            few = jaccard.may_link(np.bitwise_count(jaccard.folded(x, 64) ^ jaccard.folded(y, 64)).sum(), len(a), len(b), 80)
            assert few or not jaccard.linked(inter, len(a), len(b), 80)
            assert may or not jaccard.linked(inter, len(a), len(b), 80)
            dropped += not may
    assert dropped > 10
    assert jaccard.may_link(jaccard.differing_bits(jaccard.sketch(own[:500]), jaccard.sketch(own[:620])), 500, 620, 80)


def test_one_doc_id_with_several_texts(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(500)}" for _ in range(80)]
    rows = [(k, " ".join(base[:at] + [f"x{k}"] + base[at + 1 :])) for k, at in enumerate((0, 79, 0, 79, 0, 79))]
    rows += [(k, " ".join(f"y{k} {n}" for n in range(60))) for k in range(6)] + rows[:2]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("drawn", [0, 1024])
def test_rows_without_doc_id_connect_others(spark, monkeypatch, drawn):
    """Near copies whose only connection is a row without doc_id, copies of it, and sets that no row with an id has."""
    monkeypatch.setattr(jaccard, "DRAWN", drawn)
    r = random.Random(4)
    rows = []
    for g in range(4):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(100)]
        steps = [" ".join([*(f"x{g}{k}" for k in range(n)), *base[n:]]) for n in (0, 8, 14)]
        ids = [(10 * g + 1, None, 10 * g + 2), (None, None, 10 * g + 5), (None, None, None), (10 * g + 3, None, None)][g]
        rows += list(zip(ids, steps, strict=True)) + [(None, steps[1])] * g
    r.shuffle(rows)
    expected = brute(rows)
    assert (2, 96, 1) in expected
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected


def test_the_filter_lets_all_wanted_rows_through(spark):
    docs = spark.range(40_000).withColumnRenamed("id", "doc_id")
    wanted = docs.where("doc_id % 5 = 0")
    passed = docs.where(jaccard.probably("doc_id", wanted.select("doc_id")))
    assert passed.where("doc_id % 5 = 0").count() == 8_000
    assert passed.count() < 8_400
    assert docs.where(jaccard.probably("doc_id", wanted.where("doc_id < 0").select("doc_id"))).count() == 0


def test_empty(nothing):
    assert jaccard.jaccard_components(nothing).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (7, 8), (5, 5), (4, None), *((20 + k, 21 + k) for k in range(30))]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{20 + k: 20 for k in range(31)}}
