"""Seeded order, exact samples and exact splits.

The seeded order is the md5 of the seed and a row's key. A sample or a split of exact size is the set of rows
below a cut in that order; the cut is found from counts of prefixes, so no row is moved and the driver sees only
a bounded table of counts. ``key`` must identify rows (several columns are allowed)."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.config import ManualSplit, NamedSplits, NoSplit
from chatloom.functions.rng import hash_hex, key_columns, u60

SEED = 42
_DIGITS = 3  # hex digits per refinement: at most 4096 counts on the driver at a time
_RANK_DIGITS = 4  # hex digits of a rank bucket: 65,536 even buckets
_FEW_PICKS = 10_000  # picks (a key and two numbers each) that are broadcast
_SMALL_BUCKET = 10_000  # hashes (32 characters each) the driver may look at


def order_hash(key: str | Sequence[str], seed=SEED) -> Column:
    return hash_hex(seed, *key_columns(key))


def order_text(order: str | Sequence[str]) -> Column:
    """Integer columns as hex text of fixed width that sorts like they do."""
    return F.concat(
        *[F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0") for c in key_columns(order)]
    )


def shuffle(df: DataFrame, key: str | Sequence[str], seed=SEED) -> DataFrame:
    return df.orderBy(order_hash(key, seed), *key_columns(key))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique id for sources without one. Ids depend on the scan, so the result is checkpointed: a
    recomputed task must not number its rows differently."""
    from chatloom.plans.materialize import materialize

    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Adds each row's 0-based place in the order the rows stand in, as after a sort. One count per partition is broadcast;
    the rows are checkpointed, so that a recomputed task numbers them alike."""
    from chatloom.plans.materialize import materialize

    placed = materialize(df.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = counts.select("_part", before.alias("_start"))
    rank = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    joined = placed.join(F.broadcast(starts), part == F.col("_part"))
    return joined.select(*df.columns, rank.alias(name))


@dataclass(frozen=True)
class _Prefixes:
    """Counts of order-text prefixes of one length, within one parent prefix."""

    counts: list[tuple[str, int]]

    @staticmethod
    def of(texts: DataFrame, parent: str) -> _Prefixes:
        inside = texts.filter(F.col("_t").startswith(parent)) if parent else texts
        rows = (
            inside.groupBy(F.substring("_t", 1, len(parent) + _DIGITS).alias("p"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        return _Prefixes(sorted((r["p"], r["n"]) for r in rows))

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def holding(self, rank: int) -> tuple[str, int, int]:
        """Prefix holding the rank-th row, the rows before it, and its size."""
        before = 0
        for prefix, n in self.counts:
            if before + n >= rank:
                return prefix, before, n
            before += n
        raise ValueError(f"rank {rank} beyond {before} rows")


class RowOrder:
    """An order of the rows given by a hex text of fixed width: the number of rows, and tests for being among
    the first n. Only counts per prefix, and one small bucket of texts, reach the driver."""

    def __init__(self, df: DataFrame, text: Column, start: str = ""):
        self.text = text
        self._texts = df.select(text.alias("_t"))
        self._top = _Prefixes.of(self._texts, start)
        self.rows = self._top.total

    @classmethod
    def seeded(cls, df: DataFrame, key: str | Sequence[str], seed=SEED) -> RowOrder:
        return cls(df, order_hash(key, seed))

    @classmethod
    def stored(cls, df: DataFrame, order: str | Sequence[str]) -> RowOrder:
        """The order of integer columns; the prefix all rows share is skipped."""
        text = order_text(order)
        ends = df.agg(F.min(text).alias("a"), F.max(text).alias("z")).first()
        return cls(df, text, os.path.commonprefix([ends["a"] or "", ends["z"] or ""]))

    def first(self, n: int) -> Column:
        """True for exactly the first n rows."""
        if n <= 0:
            return F.lit(False)
        if n >= self.rows:
            return F.lit(True)
        return self.text <= F.lit(self._cut(n))

    def _cut(self, rank: int) -> str:
        prefix, before, size = self._top.holding(rank)
        rank -= before
        while size > _SMALL_BUCKET:
            level = _Prefixes.of(self._texts, prefix)
            if level.counts[0][0] == prefix:
                raise ValueError(f"{size} rows share one key; pass columns that identify a row, or use with_row_id")
            prefix, before, size = level.holding(rank)
            rank -= before
        bucket = sorted(r["_t"] for r in self._texts.filter(F.col("_t").startswith(prefix)).collect())
        if rank < len(bucket) and bucket[rank - 1] == bucket[rank]:
            raise ValueError("rows at the cut share one key; pass columns that identify a row, or use with_row_id")
        return bucket[rank - 1]


def sample_exact(df: DataFrame, n: int, key: str | Sequence[str], seed=SEED) -> DataFrame:
    """n random rows, or all of them when there are no more than n."""
    return df.filter(RowOrder.seeded(df, key, seed).first(n))


def _train_size(rows: int, test_size: float) -> int:
    return int(rows * (1 - test_size))


def _labelled(df: DataFrame, train: Column) -> DataFrame:
    return df.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))


def train_test_split(df: DataFrame, test_size: float, key: str | Sequence[str], seed=SEED) -> DataFrame:
    """Adds ``split``: the first int(rows * (1 - test_size)) rows of the seeded order train, the others test."""
    order = RowOrder.seeded(df, key, seed)
    return _labelled(df, order.first(_train_size(order.rows, test_size)))


def sample_then_split(df: DataFrame, n: int, test_size: float, key: str | Sequence[str], seed=SEED) -> DataFrame:
    order = RowOrder.seeded(df, key, seed)
    size = min(n, order.rows)
    return _labelled(df.filter(order.first(size)), order.first(_train_size(size, test_size)))


def apply_split(df: DataFrame, config: ManualSplit | NoSplit, key: str | Sequence[str], seed=SEED) -> DataFrame:
    """A sample no smaller than the data is ignored, and ``test_size`` then splits all rows."""
    if isinstance(config, NamedSplits) or config is None:
        raise ValueError("a manual_split or no_split configuration is required")
    test_size = config.test_size if isinstance(config, ManualSplit) else None
    sample = config.sample_size
    if not sample and not test_size:
        return df.withColumn("split", F.lit("train"))
    order = RowOrder.seeded(df, key, seed)
    sampled = bool(sample) and order.rows > sample
    size = sample if sampled else order.rows
    chosen = df.filter(order.first(sample)) if sampled else df
    if test_size:
        return _labelled(chosen, order.first(_train_size(size, test_size)))
    return chosen.withColumn("split", F.lit("train"))


def head(df: DataFrame, max_samples: int | None, order: str | Sequence[str]) -> DataFrame:
    """The first rows in stored order, which integer columns must carry."""
    return df if not max_samples else df.filter(RowOrder.stored(df, order).first(max_samples))


def sample_results(df: DataFrame, k: int, key: str | Sequence[str], seed=SEED) -> DataFrame:
    """k rows without replacement for inspection; 0 means 3."""
    return df.orderBy(order_hash(key, seed), *key_columns(key)).limit(k or 3)


def with_order_rank(df: DataFrame, key: str | Sequence[str], seed=SEED, name: str = "row_index") -> DataFrame:
    """Adds the row's 0-based rank in the seeded order. The window runs inside hash buckets of even size; the
    bucket starts are at most 16**_RANK_DIGITS rows, which is what makes their broadcast and running sum safe."""
    hashed = df.withColumn("_h", order_hash(key, seed)).withColumn("_bucket", F.substring("_h", 1, _RANK_DIGITS))
    counts = (
        df.select(F.substring(order_hash(key, seed), 1, _RANK_DIGITS).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    starts = counts.select(
        "_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *key_columns(key)))
    return (
        hashed.withColumn("_pos", inside)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(name, F.col("_start") + F.col("_pos") - 1)
        .drop("_h", "_bucket", "_pos", "_start")
    )


def draws(spark: SparkSession, k: int, n: int, seed=SEED) -> DataFrame:
    """k draws with replacement from the ranks 0…n-1."""
    return spark.range(k).select(
        F.col("id").alias("draw"), F.pmod(u60(seed, "draw", F.col("id")), F.lit(n)).alias("row_index")
    )


def sample_with_replacement(df: DataFrame, k: int, key: str | Sequence[str], seed=SEED, rows: int | None = None) -> DataFrame:
    """k rows, each drawn from all rows; adds ``draw``. Ranks are given to the keys alone; the rows are fetched by key."""
    rows = df.count() if rows is None else rows
    if rows == 0 or k <= 0:
        return df.limit(0).withColumn("draw", F.lit(0).cast("bigint"))
    picked = draws(df.sparkSession, k, rows, seed)
    return _fetched(df, key, picked, k, seed)


def _fetched(df: DataFrame, key: str | Sequence[str], picked: DataFrame, n: int, seed) -> DataFrame:
    """The rows of the picked ranks. Of n picks few enough to broadcast, the rows do not move at all."""
    keys = [key] if isinstance(key, str) else list(key)
    ranked = with_order_rank(df.select(*keys), key, seed)
    chosen = ranked.join(F.broadcast(picked) if n <= _FEW_PICKS else picked, "row_index").drop("row_index")
    return df.join(F.broadcast(chosen) if n <= _FEW_PICKS else chosen, keys).select(
        *df.columns, *[c for c in chosen.columns if c not in keys]
    )


def fewshot_samples(df: DataFrame, batches: int, key: str | Sequence[str], m: int = 3, seed=SEED) -> DataFrame:
    """For every batch m distinct rows (fewer when there are fewer): neighbours in the seeded order from a
    random start. Adds ``batch`` and ``example`` (1-based)."""
    rows = df.count()
    m = min(m, rows)
    if m == 0 or batches <= 0:
        return df.limit(0).withColumns({"batch": F.lit(0).cast("bigint"), "example": F.lit(0)})
    picked = (
        df.sparkSession.range(batches)
        .withColumn("example", F.explode(F.sequence(F.lit(1), F.lit(m))))
        .select(
            F.col("id").alias("batch"),
            "example",
            F.pmod(u60(seed, "batch", F.col("id")) + F.col("example") - 1, F.lit(rows)).alias("row_index"),
        )
    )
    return _fetched(df, key, picked, batches * m, seed)
