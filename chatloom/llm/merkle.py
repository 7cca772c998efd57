"""A Merkle tree over a dataset: per language over its documents, then over the languages.

Nodes are numbered inside their group, and every BLOCK consecutive ones share a block. Inside a block, level by level,
lag and lead columns with the fixed offset of the level, masked by slot and by what is left of the run, supply each
node's sibling, and the row of a node's first child hashes the parent. All levels of a block are windows over one order, so a
block is shuffled and sorted once; the blocks' tops are the nodes of the next, BLOCK times smaller round. Sibling paths are
joined from the top down, a block's with that of its top, so no step joins on a key with more than BLOCK rows.

Ties: rows that repeat a doc_id are ordered by leaf; rows that agree in all columns are leaves of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import join_frequent
from chatloom.plans.materialize import materialize

LEVELS = 8
BLOCK = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def _part(value: Column) -> Column:
    """The value with its length in bytes before it, so that no two rows read alike; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return F.sha2(F.concat(*[_part(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp, leaf, and ``given``, the leaf of what an auditor is given: one more character in the rows of which
    TAMPERED divides the CRC-32 of the doc_id."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    more = leaf_digest(n_chars=F.col("n_chars").cast("long") + 1)
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))  # null comes first
    return docs.select("doc_id", group.alias("grp"), leaf_digest().alias("leaf"), F.when(tampered, more).alias("given"))


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """``pos``, the place of every row in its ``grp``, and ``n``, the group's size. The rows are range partitioned by
    group and order; only one count per partition, never a group, comes together."""
    at = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    placed = rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed)
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    # one row per partition of the table
    starts = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("part").alias("_part"), F.coalesce(starts, F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    ranked = placed.join(F.broadcast(counts), part == F.col("_part")).select(*rows.columns, rank.alias("_rank"))
    groups = materialize(ranked.groupBy("grp").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n")))
    out = join_frequent(ranked, groups, "grp", "n")
    return out.withColumn("pos", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


_IN_BLOCK = f"(PARTITION BY grp, shiftright(pos, {LEVELS}) ORDER BY pos"


def _levels(nodes: DataFrame) -> DataFrame:
    """Columns ``_s0`` … of the siblings and ``_n1`` … of the nodes by level, of (grp, pos, n, digest) rows. A row holds the
    nodes it is the first leaf of; a sibling has L or R for its side before it and is ``-`` where a run ends in one
    child, whose parent is the hash of that alone. From the level on that has one node, a group has no siblings."""
    nodes = nodes.withColumnRenamed("digest", "_n0")
    for level in range(LEVELS):
        step, node = 1 << level, f"_n{level}"
        before, after = (f"{f}({node}, {step}) OVER {_IN_BLOCK})" for f in ("lag", "lead"))
        side = f"IF(shiftright(pos, {level}) % 2 = 1, 'L' || {before}, coalesce('R' || {after}, '-'))"
        parent = f"IF(n > {step}, sha2({node} || substring(_s{level}, 2), 256), {node})"
        nodes = nodes.selectExpr("*", f"IF(pos % {step} = 0 AND n > {step}, {side}, NULL) AS _s{level}")
        nodes = nodes.selectExpr("*", f"IF(pos % {2 * step} = 0, {parent}, NULL) AS _n{level + 1}")
    return nodes


def _tops(nodes: DataFrame) -> DataFrame:
    """The tops of the blocks as nodes of the next round."""
    tops = _levels(nodes.select("grp", "pos", "n", "digest")).filter(f"pos % {BLOCK} = 0")
    up = f"shiftright(pos, {LEVELS}) AS pos", f"shiftright(n + {BLOCK - 1}, {LEVELS}) AS n"
    return tops.selectExpr("grp", *up, f"_n{LEVELS} AS digest")


def _paths(nodes: DataFrame) -> DataFrame:
    """``path``: the siblings of the nodes above a row inside its block, by level."""
    # the last first-child row of a level up to here is that of the row's own ancestor
    so_far = f"{_IN_BLOCK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    held = [f"last(_s{level}, true) OVER {so_far} AS _p{level}" for level in range(LEVELS)]
    names = ", ".join(f"_p{level}" for level in range(LEVELS))
    kept = [c for c in nodes.columns if c != "digest"]
    return _levels(nodes).selectExpr(*kept, *held).selectExpr(*kept, f"filter(array({names}), s -> s IS NOT NULL) AS path")


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For (grp, pos, n, digest, …) rows of any number of groups: the rows with their ``path`` up to the top of their
    group, and (grp, digest) of the tops."""
    rounds = [materialize(nodes)]
    while not rounds[-1].filter("n > 1").isEmpty():
        rounds.append(materialize(_tops(rounds[-1])))
    above = rounds.pop()
    tops = above.select(F.col("grp").alias("grp"), F.col("digest").alias("digest"))  # for joins with the rows
    above = above.drop("digest").withColumn("path", F.array().cast("array<string>"))
    while rounds:
        rows = _paths(rounds.pop())
        upper = above.select("grp", F.col("pos").alias("_block"), F.col("path").alias("_upper"))
        rows = rows.withColumn("_block", F.shiftright("pos", LEVELS)).join(upper, ["grp", "_block"])
        above = rows.withColumn("path", F.concat("path", "_upper")).drop("_block", "_upper")
        if rounds:
            above = materialize(above)
    return above, tops


def fold(digest: Column, path: Column) -> Column:
    """The digest at the top of a path."""

    def step(h: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("L"), F.concat(other, h)).otherwise(F.concat(h, other)), 256)

    return F.aggregate(path, digest, step)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, grp, pos, n, leaf, given, path, subroot, root. ``path`` goes from the leaf to the
    root; ``given`` is null where nothing was tampered with.

    Nulls in a column are told from empty texts; a null doc_id comes first in its language, and the null language is the
    first one. A single leaf is its own subroot, a single subroot the root. An empty table gives no rows."""
    rows, tops = tree(number(leaves(docs), ["doc_id", "leaf"]).withColumn("digest", F.col("leaf")))
    named = tops.select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "digest", F.col("digest").alias("subroot"))
    langs, root = tree(number(named, ["lang"]))
    size = rows.groupBy("grp").agg(F.max("n").alias("size"))
    langs = langs.join(F.broadcast(root.select("grp", F.col("digest").alias("root"))), "grp")  # one row
    langs = langs.select(F.col("lang").alias("grp"), "subroot", "root", F.col("path").alias("_upper"))
    langs = materialize(langs.join(size, "grp"))
    out = join_frequent(materialize(rows), langs, "grp", "size").drop("size")
    return out.withColumn("path", F.concat("path", "_upper")).drop("_upper")


def audit(manifest: DataFrame) -> DataFrame:
    """Whether each given document, hashed up with the siblings of its path, still makes the root: doc_id, leaf, subroot,
    root, proof_sha256, folded_root, verified."""
    siblings = F.transform(F.col("path"), lambda s: F.substring(s, 2, 64))
    folded = fold(F.coalesce("given", "leaf"), F.col("path"))
    out = manifest.withColumn("folded_root", folded).withColumn("proof_sha256", F.sha2(F.array_join(siblings, ""), 256))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)
