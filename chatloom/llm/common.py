"""Helpers the operators of this subpackage share: words and their hashes, joins with frequent keys, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.plans.materialize import materialize, scratch_path

#: Words are runs of characters other than space and the controls 9 to 13, as in ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
HOT_KEYS = 1000  # keys that are broadcast: each holds at least 1/HOT_KEYS of all rows, so there are no more
_SLICE = 1 << 20  # bytes split into words at a time
_CACHE = 1 << 20  # hashed words a task remembers


def text_bytes(name: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Tables:
    """Intermediate tables in the shared folder, which go when their last reader is done and not with the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "table")
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Deletes kept tables. The JVM's collection lets Spark drop the shuffle files behind them, too."""
        for frame in frames:
            _, path = self.paths.pop(id(frame), (None, None))
            if path:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.spark._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    counter = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(counter) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered; the memory is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, raw: bytes) -> np.ndarray:
        """The hashes of a text's words in order. A long text is split a slice at a time."""
        if len(raw) <= _SLICE:
            words = raw.split()
            return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return np.concatenate([np.fromiter(map(self.__getitem__, w), np.uint64, len(w)) for w in word_slices(raw)])


def word_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time; slices end at white space."""
    start, view = 0, raw
    while start < len(view):
        end = min(start + _SLICE, len(view))
        while end < len(view) and view[end] not in b" \t\n\v\f\r":
            end += 1
        yield view[start:end].split()
        start = end


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """One hash for every run of n words; a text with fewer words has one hash of all, an empty one none. Runs are put
    together from runs of 1, 2, 4 … words, so the work grows with the logarithm of n."""
    size = len(words)
    if size == 0:
        return words
    if size < n:
        return mix(np.array([gram_hashes(words, size, seed + 1)[0] + np.uint64(size)], np.uint64))
    factors = constants(2 * n.bit_length() + 1, seed)
    level, step, done, length = mix(words ^ factors[-1]), 1, None, 0
    for i in range(n.bit_length()):
        if n >> i & 1:
            rest = len(level) - length
            done = level if done is None else mix(done[:rest] * factors[2 * i] + level[length : length + len(done)])
            length += step
        if 2 * step <= n:
            level = mix(level[:-step] * factors[2 * i + 1] + level[step:])
            step *= 2
    return done[: size - n + 1]


def join_frequent(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """Left join with a table that has one row per key and the number of left rows with that key in ``size``.

    The few keys that hold many rows (at most HOT_KEYS, by their share) are broadcast, so their rows stay where
    they are; the others meet in a shuffle, where none is large. ``left`` is read twice: keep it materialized."""
    total = right.agg(F.sum(size)).first()[0] or 0
    frequent = F.col(size) * HOT_KEYS >= F.lit(total)
    columns = [c for c in right.columns if c != key]
    hot = right.filter(frequent).select(key, F.struct(*columns).alias("_hot"))
    tagged = left.join(F.broadcast(hot), key, "left")
    here = tagged.filter(F.col("_hot").isNotNull()).select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in columns])
    there = tagged.filter(F.col("_hot").isNull()).drop("_hot").join(right.filter(~frequent), key, "left")
    return here.unionByName(there.select(*here.columns))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges (a, b): the smallest vertex that is reachable.

    Large-star and small-star steps in turn: in the first, a vertex's larger neighbours move to its smallest
    neighbour, in the second the smaller ones do, until all are stars. No neighbourhood is collected."""

    def larger(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def smaller(e: DataFrame) -> DataFrame:
        # a > b in every row; a's smallest neighbour takes a and a's other neighbours
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def is_stars(e: DataFrame) -> bool:
        """Whether every vertex is either a centre or has one neighbour, which is a centre."""
        both = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down"))
        both = both.unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = both.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.filter(F.col("up") + F.col("down") > 1).count() == 0

    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        edges = materialize(smaller(larger(edges).filter("a <> b").distinct()))
        if is_stars(edges):
            break
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct()
