import math
import random

import numpy as np
import pytest
from oracle import compare, connection

from tidemark.llm import negatives

SCHEMA = "id long, label int, vector array<float>, anchor boolean, block string"


def brute(rows, positives=5, keep=3, low=50, high=95):
    held = []
    for k, (i, label, vector, anchor, *_) in enumerate(rows):
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held.append((k, i, label, [math.floor(256 * float(np.float32(x))) for x in vector], anchor))
    out = []
    for k, i, label, v, anchor in held:
        if not anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other, n) for n, j, other, w, _ in held if n != k)
        for s, j, _, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside[:keep])]
    return sorted(out)


def made(seed, n, labels=3, dim=4, every=5, hot=0.3):
    r = random.Random(seed)
    base = [r.uniform(0, 1) for _ in range(dim)]
    return [(k, r.randrange(labels), base if r.random() < hot else [r.choice([r.uniform(-1, 1), 0.5]) for _ in range(dim)], k % every == 0, "x") for k in range(n)]


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **how).collect())


def test_equals_brute_force_over_many_blocks_and_chunks(spark, monkeypatch):
    for name, size in (("CHUNK", 40), ("BLOCK", 16), ("TILE", 7)):
        monkeypatch.setattr(negatives, name, size)
    rows = made(1, 400)
    assert found(spark, rows, positives=3, keep=5, low=10, high=100) == brute(rows, 3, 5, 10, 100)


def test_nulls_ties_repeated_rows_and_short_vectors(spark):
    rows = made(2, 120, hot=0.6)
    rows += rows[:10] + [(None, 1, [0.1], True, None), (500, None, [0.5] * 4, True, None), (505, 1, None, True, None), (510, 1, [0.5, None], True, None), (515, 1, [float("nan")] * 4, True, None), (520, 1, [float("inf")] * 4, True, None)]
    rows += [(525, 0, [0.5], True, "x"), (530, 1, [], True, "x"), (535, 2, [0.5] * 6, None, None)]
    assert found(spark, rows) == brute(rows)


def test_huge_components_stay_exact(spark):
    r = random.Random(3)
    rows = [(k, k % 2, [r.choice([1e6, 3e6, 2.5e6, 1.0]) * r.choice([1, 0.9, -1]) for _ in range(3)], k % 4 == 0, "x") for k in range(40)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(k, k % 2, [3e38, -3e38], True, "x") for k in range(4)]) is not None


@pytest.mark.parametrize("rows", [[], made(4, 9, labels=1), [(0, 1, [0.5], True, "x")], [(None, None, None, None, None)]])
def test_nothing_to_mine(spark, rows):
    assert found(spark, rows) == []


def test_rows_and_anchors_meet_without_the_driver(spark, monkeypatch):
    for name, size in (("CHUNK", 20), ("BLOCK", 8)):
        monkeypatch.setattr(negatives, name, size)
    plans, run = [], negatives.map_arrow
    monkeypatch.setattr(negatives, "map_arrow", lambda df, *how: plans.append(df._jdf.queryExecution().executedPlan().toString()) or run(df, *how))
    rows = made(5, 200)
    assert found(spark, rows) == brute(rows)
    assert sum("Join" in p or "CartesianProduct" in p for p in plans) == 2
    assert not [step for step in ("Broadcast", "Generate") if any(step in p for p in plans)]


def test_chunks_in_more_parts_than_the_shuffle_has(spark, monkeypatch):
    for name, size in (("CHUNK", 10), ("BLOCK", 1000), ("STREAM", 1)):
        monkeypatch.setattr(negatives, name, size)
    rows = made(6, 200)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    compare(negatives.op12_hard_negatives(spark, sf_dir), negatives.SQL["op12_hard_negatives"], connection(sf_dir))
