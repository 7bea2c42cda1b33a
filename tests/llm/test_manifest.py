import hashlib
import random
import zlib

import pytest
from oracle import compare, connection
from pyspark.sql import functions as F

from tidemark.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """(root, for each node the list of (left, right) up to it)."""
    ways, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for k, p in enumerate(place):
            run, at = runs[p // fanout], p % fanout
            ways[k].append(("".join(run[:at]), "".join(run[at + 1 :])))
            place[k] = p // fanout
        level = [h(*run) for run in runs]
    return level[0], ways


def brute(rows, fanout):
    """rows of (doc_id, source, lang, n_chars, text) in input order -> sorted (doc_id, leaf, subroot, root, path)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf(r)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    held = {g: sorted(by[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in langs}
    subs = {g: tree([x[1] for x in held[g]], fanout) for g in langs}
    root, ways = tree([subs[g][0] for g in langs], fanout)
    out = []
    for g, up in zip(langs, ways, strict=True):
        out += [(d, x, subs[g][0], root, way + up) for (d, x), way in zip(held[g], subs[g][1], strict=True)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in df.collect()), key=str)


@pytest.mark.parametrize("fanout,levels", [(2, 7), (2, 1), (3, 2)])
def test_equals_brute_force_with_nulls_ties_and_repeated_rows(odd, few, fanout, levels):
    for docs in (odd, few.limit(90)) if fanout == 3 else (odd,):
        docs = docs.cache()
        rows = [tuple(r[c] for c in manifest.FIELDS) for r in docs.collect()]
        assert found(manifest.manifest(docs, manifest.FIELDS, "lang", "doc_id", fanout=fanout, levels=levels)) == brute(rows, fanout)
        docs.unpersist()


def test_many_groups_and_one_hot_group_over_many_blocks(spark):
    r = random.Random(5)
    rows = [(k, "s", "hot" if k % 3 else f"g{r.randrange(40)}", k, "t") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert found(manifest.manifest(docs, manifest.FIELDS, "lang", "doc_id", levels=2)) == brute(rows, 2)


def test_no_rows_one_row_and_clashing_names(nothing, spark):
    assert manifest.manifest(nothing, manifest.FIELDS, "lang", "doc_id").collect() == []
    one = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, grp string, rank int, l0 int")
    (row,) = manifest.manifest(one, ["doc_id", "grp"], "grp", "doc_id", {"rank": F.col("rank")}).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf((1, "a")) and row["path"] == [] and row["rank"] == 2


def test_query_finds_each_tampered_row(spark, few, odd, tmp_path):
    long = spark.createDataFrame([(10**9, "word " * 300_000, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    few.unionByName(odd.drop("a")).unionByName(long).write.parquet(str(tmp_path / "documents.parquet"))
    for r in manifest.op11_merkle_manifest(spark, str(tmp_path)).join(few.unionByName(odd.drop("a")).unionByName(long).groupBy("doc_id").agg(F.max("n_chars").alias("n")), "doc_id", "left").collect():
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n"] is not None
        assert r["verified"] == (not hit) == (r["folded_root"] == r["root"])


def test_query_equals_its_sql(spark, sf_dir):
    compare(manifest.op11_merkle_manifest(spark, sf_dir), manifest.SQL["op11_merkle_manifest"], connection(sf_dir))
