"""A Bloom filter of the words of a large table, tested where texts are before their words move.

Words are hashed to blocks of 256 bits, in each of which a word sets one bit of every 32. Tasks fill the blocks of the
words they hold, one row per block that any word falls in; a word that is in the table always passes, another one with the
probability that ``false_share`` states. The filter is as large as the caller allows: a table with more words gets fewer bits
for each, and passes more words that then meet nobody."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 8  # of 32 bits
BITS_PER_WORD = 12
MOST_BYTES = 1 << 26
TESTED = 1 << 18  # words tested at once
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def blocks_for(words: int, most_bytes: int = MOST_BYTES) -> int:
    """How many blocks a filter of so many words has: a power of two, at most ``most_bytes``."""
    wanted = max(1, words * BITS_PER_WORD // (32 * BLOCK_WORDS))
    return 1 << min(math.ceil(math.log2(wanted)), int(math.log2(most_bytes // (4 * BLOCK_WORDS))))


def false_share(words: int, blocks: int) -> float:
    """The share of other words that pass: over the words of a block, which are Poisson distributed."""
    mean = words / blocks
    most, p, out = int(mean + 12 * math.sqrt(mean) + 12), math.exp(-mean), 0.0
    for k in range(most):
        out += p * (1 - (31 / 32) ** k) ** BLOCK_WORDS
        p *= mean / (k + 1)
    return out


def _masks(hashes: np.ndarray) -> np.ndarray:
    """The bits of each word inside its block, from the lower half of its hash."""
    low = hashes.astype(np.uint32)
    return np.uint32(1) << ((low[:, None] * _SALTS) >> np.uint32(27))


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.int64) % blocks


def _hash(word: Column) -> Column:
    return F.xxhash64(word)


class WordFilter:
    def __init__(self, bits: np.ndarray, words: int):
        self.bits, self.words = bits, words

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        mask = _masks(hashes)
        return ((self.bits[_block(hashes, len(self.bits))] & mask) == mask).all(axis=1)


def build(words: DataFrame, column: str = "word", most_bytes: int = MOST_BYTES) -> WordFilter:
    """The filter of a column of distinct words. The driver gets its blocks, which are as many as ``most_bytes`` hold."""
    n = words.count()
    blocks = blocks_for(n, most_bytes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = _block(hashes, blocks)
            order = np.argsort(at, kind="stable")
            kinds, starts = np.unique(at[order], return_index=True)
            if len(kinds):
                bits = np.bitwise_or.reduceat(_masks(hashes[order]), starts, axis=0)
                columns = [pa.array(kinds), *(pa.array(c.astype(np.int64)) for c in bits.T)]
                yield pa.RecordBatch.from_arrays(columns, ["block", *_WORDS])

    parts = words.select(_hash(F.col(column)).alias("h")).mapInArrow(fill, "block long, " + ", ".join(f"{w} long" for w in _WORDS))
    found = parts.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in _WORDS]).toArrow()
    bits = np.zeros((blocks, BLOCK_WORDS), np.uint32)
    if found.num_rows:
        at = found.column("block").to_numpy()
        for i, w in enumerate(_WORDS):
            bits[at, i] = found.column(w).to_numpy().astype(np.uint32)
    return WordFilter(bits, n)


_WORDS = [f"w{i}" for i in range(BLOCK_WORDS)]


def keep_possible(df: DataFrame, column: str, shared) -> DataFrame:
    """The rows with only those words in an array column that a broadcast filter passes, in order."""

    @F.arrow_udf("array<boolean>")
    def passes(hashes: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy().astype(np.int64)
        flat = hashes.flatten().to_numpy().view(np.uint64)
        found = [shared.value.might_hold(flat[i : i + TESTED]) for i in range(0, len(flat), TESTED)]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, bool), *found])))

    tested = df.withColumn("_passed", passes(F.transform(column, _hash)))
    return tested.withColumn(column, F.filter(column, lambda w, i: F.get("_passed", i))).drop("_passed")
