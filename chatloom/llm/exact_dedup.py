"""Exact deduplication against a minimal perfect hash over the digests of earlier documents.

The distinct digests of the history are dealt into parts of bounded size. Every part gets a minimal perfect hash:
at each level the digests that are alone in their place of a bit array are settled, the others go on to the next
level, and a digest's slot is the number of settled places before its own. A slot holds the full digest, the
winner's doc_id and how often the history has it, so a lookup compares all bytes: a digest the history lacks lands in some
slot or none and is told apart there. Only new documents are looked up, grouped by digest first, so a part sees each
digest once however often it occurs; those that the history lacks are groups of their own. What is known of a document of
the history comes from its slot."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import constants, fresh, join_frequent, mix
from chatloom.plans.materialize import materialize

PART_KEYS = 32_768  # digests in a part, about 1.3 MB
_NO_ID = 2**63 - 1  # stands for no doc_id while in pandas
_LEAST_PARTS = 512  # so that even small tables use every core
#: Runs that are not already one space; replacing these leaves the same text as replacing every run.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with every run of white space made one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), _RUNS, " "), 256))


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    a = constants(4, 977 * level + 1)
    return (mix((keys * a).sum(axis=1, dtype=np.uint64)) >> np.uint64(11)) % np.uint64(size)


def _as_keys(digests: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """The bit arrays of a minimal perfect hash over distinct 32-byte keys."""
    levels = []
    while len(keys):
        place = _level(keys, len(levels), len(keys)).astype(np.int64)
        alone = np.bincount(place, minlength=len(keys)) == 1
        levels.append(alone)
        keys = keys[~alone[place]]
    return levels


def slots(levels: Sequence[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of every key, or -1 when no level settles it; keys never hashed may get any slot."""
    slot = np.full(len(keys), -1, np.int64)
    todo, before = np.arange(len(keys)), 0
    for number, bits in enumerate(levels):
        place = _level(keys[todo], number, len(bits)).astype(np.int64)
        rank = np.cumsum(bits) - 1
        hit = bits[place]
        slot[todo[hit]] = before + rank[place[hit]]
        todo, before = todo[~hit], before + int(bits.sum())
    return slot


def _build(group: pd.DataFrame) -> pd.DataFrame:
    keys = _as_keys(group["digest"])
    levels = perfect_hash(keys)
    order = np.argsort(slots(levels, keys))
    return pd.DataFrame(
        {
            "part": group["part"].iloc[:1],
            "sizes": [[len(x) for x in levels]],
            "bits": [[np.packbits(x).tobytes() for x in levels]],
            "digests": [keys[order].tobytes()],
            "winners": [group["winner"].to_numpy(np.int64)[order].tobytes()],
            "counts": [group["n"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def _look_up(fresh: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    keep, size = fresh["first_id"].to_numpy(np.int64), fresh["group_size"].to_numpy(np.int64)
    member = np.zeros(len(fresh), bool)
    found = []
    if len(index):
        part = index.iloc[0]
        held = np.frombuffer(part["digests"], "<u8").reshape(-1, 4)
        winners, counts = (np.frombuffer(part[c], "<i8").copy() for c in ("winners", "counts"))
        if len(fresh):
            levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(part["sizes"], part["bits"])]
            keys = _as_keys(fresh["digest"])
            slot = slots(levels, keys)
            member = (slot >= 0) & (held[slot] == keys).all(axis=1)
            winners[slot[member]] = np.minimum(winners[slot[member]], keep[member])
            counts[slot[member]] += size[member]
        digests = [held[i].tobytes() for i in range(len(held))]
        found.append(pd.DataFrame({"digest": digests, "keep_id": winners, "group_size": counts, "in_history": True}))
    new = ~member
    found.append(pd.DataFrame({"digest": fresh["digest"][new], "keep_id": keep[new], "group_size": size[new], "in_history": False}))
    return pd.concat(found)


def build_index(history: DataFrame, digests: int | None = None) -> DataFrame:
    """One row per part from (doc_id, digest) rows: the bit arrays, and in slot order digests, smallest doc_ids and numbers of
    rows. ``digests`` is about how many distinct ones there are; it only sets the number of parts, which ``look_up``
    reads back from the index."""
    known = history.filter("doc_id is not null").groupBy("digest")
    winners = materialize(known.agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")))
    n = winners.count() if digests is None else digests
    parts = max(1, min(_LEAST_PARTS, n // 64), -(-n // PART_KEYS))
    dealt = winners.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)))
    schema = "part long, sizes array<int>, bits array<binary>, digests binary, winners binary, counts binary"
    return dealt.groupBy("part").applyInPandas(_build, schema).withColumn("parts", F.lit(parts))


def look_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """For new (doc_id, digest) rows and the history, one row per distinct digest: digest, keep_id, group_size, in_history.
    keep_id is the winner the history holds, or the smallest doc_id of a new group; group_size counts both sides."""
    parts = (index.select("parts").first() or [1])[0]
    first = F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("first_id")
    groups = rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))
    dealt = groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)))
    schema = "digest binary, keep_id long, group_size long, in_history boolean"
    found = dealt.groupBy("part").cogroup(index.drop("parts").groupBy("part")).applyInPandas(_look_up, schema)
    return found.withColumn("keep_id", F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, in_history.

    The lower half of the doc_id range is the history. Texts are equal when their digests are; the row with the
    smallest doc_id stays. Rows that repeat both doc_id and text are one document (they count in group_size). Null
    and empty texts are equal to each other, and to no text of white space, which is one space. A row without doc_id
    stays, and is never the one another row is dropped for; its keep_id is null where its whole group has none. An empty table gives no rows."""
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")))
    ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if ends[0] is None else (int(ends[0]) + int(ends[1]) + 1) // 2
    index = materialize(build_index(rows.filter(F.col("doc_id") <= middle)))
    found = materialize(look_up(rows.filter(F.col("doc_id").isNull() | (F.col("doc_id") > middle)), index))
    each = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n_rows"))
    out = join_frequent(materialize(each), found, "digest", "group_size")
    kept = F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "in_history", "n_rows")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents ``exact_dedup`` keeps, one row each, with the columns of ``docs``."""
    w_id, w_digest, own = fresh(docs, "id", "digest", "own")
    winners = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias(w_id), F.col("digest").alias(w_digest))
    keyed = docs.withColumn(own, text_digest())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(w_id)) & (F.col(own) == F.col(w_digest))
    one = keyed.join(winners, same, "left_semi")
    known = one.filter("doc_id is not null").dropDuplicates(["doc_id", own])
    return known.unionByName(one.filter("doc_id is null")).drop(own)
