"""A Merkle manifest of a table: each level of an aligned block is one hex string, parents are hashes of its fixed-width substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import documents, saved

#: Characters of a digest, children of a node, levels that a block folds. A block has FANOUT ** LEVELS nodes (8 KB of hex).
HEX, FANOUT, LEVELS = 64, 2, 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def digest(values: list[Column]) -> Column:
    """The lowercase hex SHA-256 of the values one after the other, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text)), 256)


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds `rank`, the place of a row in its `grp` by `order` (from 0), and `size`, the rows of its group; grp is never null.

    Rows are range-partitioned by group and order, sorted and written once with their places; a group that spans many
    partitions takes up the count of those before, so no task holds a group and no row comes to the driver.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    held = saved(nodes.repartitionByRange(n, "grp", *order).sortWithinPartitions("grp", *order).withColumn("__at", at), "manifest-ranked")
    parts = held.withColumn("__part", F.shiftright("__at", 33))
    group = Window.partitionBy("grp")
    counts = parts.groupBy("__part", "grp").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", "grp", "__first", before.alias("__before"), F.sum("__n").over(group).alias("size"))
    return parts.join(counts, ["__part", "grp"]).withColumn("rank", F.expr("__at - __first + __before")).drop("__part", "__at", "__first", "__before", *order)


def parents(level: str, fanout: int) -> str:
    """SQL of the next level's string: a digest for every `fanout` digests of this one; null above the only node of a whole group."""
    run = HEX * fanout
    hashed = f"transform(sequence(0, (length({level}) - 1) div {run}), j -> sha2(substring({level}, int(j) * {run} + 1, {run}), 256))"
    return f"CASE WHEN more OR length({level}) > {HEX} THEN array_join({hashed}, '') END"


def folded(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The blocks of each round over nodes (grp, rank, size, digest, and in the first round payload): grp, block, more, members, l0 .. l`levels`, top.

    A round turns each block of fanout ** levels nodes into one, and these are the next round's nodes; groups whose rest
    is one block end with it (`more` is false) and stop at their root.
    """
    width, rounds = fanout**levels, []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most:
        block = F.floor(F.col("rank") / width).cast("long").alias("block")
        named = ["rank", "digest", *(["payload"] if "payload" in nodes.columns else [])]
        blocks = nodes.groupBy("grp", block).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct(*named))).alias("members"))
        blocks = blocks.withColumn("more", F.col("size") > width).withColumn("l0", F.expr("array_join(transform(members, m -> m.digest), '')"))
        for k in range(levels):
            blocks = blocks.withColumn(f"l{k + 1}", F.expr(parents(f"l{k}", fanout)))
        top = F.coalesce(*(f"l{k}" for k in range(levels, -1, -1)))
        rounds.append(saved(blocks.withColumn("top", top), f"manifest-round{len(rounds)}"))
        nodes = rounds[-1].where("more").select("grp", F.col("block").alias("rank"), F.expr(f"(size + {width - 1}) div {width}").alias("size"), F.col("top").alias("digest"))
        most = -(-most // width) if most > width else 0
    return rounds


def flanks(fanout: int, levels: int) -> str:
    """SQL of the siblings of the block's member i, level by level: the substrings left and right of its ancestor in the run."""
    steps = []
    for k in range(levels):
        node, place = f"(i div {fanout**k})", f"(i div {fanout**k} % {fanout})"
        left = f"substring(l{k}, int(({node} - {place}) * {HEX} + 1), int({place} * {HEX}))"
        right = f"substring(l{k}, int(({node} + 1) * {HEX} + 1), int(({fanout - 1} - {place}) * {HEX}))"
        steps.append(f"CASE WHEN l{k + 1} IS NOT NULL THEN named_struct('left', {left}, 'right', {right}) END")
    return f"array_compact(array({', '.join(steps)}))"


def unfolded(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Every node of the first round with `path`, its siblings up to the top and on along `tops`' path.

    `tops` (grp, round, path, and columns to carry) has a row for each group, round being the one that ended it.
    """
    carried = [c for c in tops.columns if c not in ("grp", "round", "path")]
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        ended = tops.where(F.col("round") == k).select("grp", F.lit(0).cast("long").alias("block"), F.col("path").alias("rest"), *carried)
        above = ended if above is None else ended.unionByName(above.select("grp", F.col("rank").alias("block"), F.col("path").alias("rest"), *carried))
        rows = F.expr(f"transform(members, (m, i) -> struct(m.*, concat({flanks(fanout, levels)}, rest) AS path))".replace("m.*", "m.rank AS rank, m.digest AS digest" + (", m.payload AS payload" if k == 0 else "")))
        above = rounds[k].join(above, ["grp", "block"]).select("grp", *carried, F.explode(rows).alias("m")).select("grp", *carried, "m.*")
    return above


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, keep: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row for each row: `order`, the columns of `keep` (expressions of the row), leaf, subroot, root and path.

    A leaf is the digest of `fields`. The leaves of a group ascend by `order`; every `fanout` consecutive nodes, the last run
    perhaps fewer, become their hash until one is left, the subroot; the subroots by group (null first, bytewise) give the root
    likewise. `path` lists, from leaf to root, the hex digests left and right of the way in each run. Nulls in `order` come first,
    ties are ordered by leaf, rows equal in both take the places of their input order; a null group is a group. An empty table
    has no rows. Other columns play no part, whatever their names.
    """
    kept = keep or {}
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"), F.col(order).alias("o"), digest([F.col(c) for c in fields]).alias("digest"),
        F.monotonically_increasing_id().alias("nth"), F.struct(F.col(order).alias("o"), *(v.alias(c) for c, v in kept.items())).alias("payload"),
    )
    # the order of equal rows comes from a scan, so it is written before rows are dealt by it
    leaves = saved(leaves, "manifest-leaves").withColumn("by", F.col("digest"))
    rounds = folded(ranked(leaves, ["o", "by", "nth"]), fanout, levels)
    if not rounds:
        ends = leaves.select("grp", F.col("digest").alias("top"), F.lit(0).alias("round")).limit(0)
    for k, r in enumerate(rounds):
        own = r.where("NOT more").select("grp", "top", F.lit(k).alias("round"))
        ends = own if k == 0 else ends.unionByName(own)
    heads = ends.select(F.lit("").alias("grp"), F.col("grp").alias("o"), F.col("top").alias("digest"), F.struct("grp", "round").alias("payload"))
    above = folded(ranked(heads, ["o"]), fanout, levels)
    none = F.array().cast(PATH).alias("path")
    if not rounds:
        return leaves.select(F.col("payload.o").alias(order), *(F.col(f"payload.{c}") for c in kept), F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), none).limit(0)
    last = above[-1].select("grp", F.lit(len(above) - 1).alias("round"), none, F.col("top").alias("root"))
    groups = saved(unfolded(above, last, fanout, levels).select("payload.*", "path", "root", F.col("digest").alias("subroot")), "manifest-groups")
    found = unfolded(rounds, groups, fanout, levels)
    return found.select(F.col("payload.o").alias(order), *(F.col(f"payload.{c}") for c in kept), F.col("digest").alias("leaf"), "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether the row, n_chars raised by one in a fixed seventh, still folds to the root.

    Null ids come first in their language and are not tampered with; a null n_chars stays, so its row holds. The rest as in `manifest`.
    """
    docs = documents(spark, sf_dir)
    raised = [(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(docs, FIELDS, "lang", "doc_id", {"changed": F.when(hit & F.col("n_chars").isNotNull(), digest(raised))})
    again = fold(F.coalesce("changed", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
SQL = {
    "op11_merkle_manifest": """
WITH RECURSIVE base AS (
  SELECT *, row_number() OVER () AS row_id,
    list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc_open
  FROM documents
), leaves AS (
  SELECT row_id, doc_id, lang,
    sha256(concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    CASE WHEN xor(crc_open, 4294967295) % 7 = 0 THEN
      sha256(concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
        coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-'), coalesce(strlen(text) || ':' || text, '-'))) END AS changed
  FROM base
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS pos FROM leaves
), tree AS (
  SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS nodes FROM placed
  UNION ALL
  SELECT lang, level, pos, node, count(*) OVER (PARTITION BY lang, level) FROM (
    SELECT lang, level + 1 AS level, pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM tree WHERE nodes > 1 GROUP BY ALL)
), subroots AS (
  SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE nodes = 1
), upper_tree AS (
  SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS nodes FROM subroots
  UNION ALL
  SELECT level, pos, node, count(*) OVER (PARTITION BY level) FROM (
    SELECT level + 1 AS level, pos // 2 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM upper_tree WHERE nodes > 1 GROUP BY ALL)
), ways AS (
  SELECT p.row_id, p.doc_id, p.leaf, coalesce(p.changed, p.leaf) AS start, p.pos, s.lang, s.height, s.subroot, s.pos AS upper_pos FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
), walk AS (
  SELECT *, 0 AS level, start AS folded, '' AS proof FROM ways
  UNION ALL
  SELECT w.row_id, w.doc_id, w.leaf, w.start, w.pos, w.lang, w.height, w.subroot, w.upper_pos, w.level + 1,
    sha256(CASE WHEN here.pos % 2 = 0 THEN w.folded || coalesce(sib.node, '') ELSE sib.node || w.folded END), w.proof || coalesce(sib.node, '')
  FROM walk w
  JOIN (SELECT lang, level, pos FROM tree WHERE nodes > 1) here ON here.lang IS NOT DISTINCT FROM w.lang AND here.level = w.level AND here.pos = w.pos >> w.level
  LEFT JOIN tree sib ON sib.lang IS NOT DISTINCT FROM w.lang AND sib.level = w.level AND sib.pos = xor(here.pos, 1)
), inner_done AS (SELECT * FROM walk WHERE level = height
), upper_walk AS (
  SELECT row_id, doc_id, leaf, subroot, upper_pos, 0 AS level, folded, proof FROM inner_done
  UNION ALL
  SELECT w.row_id, w.doc_id, w.leaf, w.subroot, w.upper_pos, w.level + 1,
    sha256(CASE WHEN here.pos % 2 = 0 THEN w.folded || coalesce(sib.node, '') ELSE sib.node || w.folded END), w.proof || coalesce(sib.node, '')
  FROM upper_walk w
  JOIN (SELECT level, pos FROM upper_tree WHERE nodes > 1) here ON here.level = w.level AND here.pos = w.upper_pos >> w.level
  LEFT JOIN upper_tree sib ON sib.level = w.level AND sib.pos = xor(here.pos, 1)
), top AS (SELECT node AS root, level AS height FROM upper_tree WHERE nodes = 1)
SELECT w.doc_id, w.leaf, w.subroot, t.root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.root AS verified
FROM upper_walk w JOIN top t ON w.level = t.height
"""
}
