"""The filter of words: nothing in the table is ruled out, and as few others pass as it says."""

import pytest
from pyspark.sql import functions as F

from chatloom.operators import word_filter


@pytest.mark.parametrize("most_bytes,bits", [(word_filter.MOST_BYTES, 12), (1 << 12, 1.6)])
def test_passes_all_words_and_few_others(spark, most_bytes, bits):
    n = 20_000
    words = spark.range(n).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    held = word_filter.build(words.repartition(5), most_bytes=most_bytes)
    assert held.words == n and held.bits.nbytes <= most_bytes and held.bits.nbytes * 8 / n >= bits
    shared = spark.sparkContext.broadcast(held)
    texts = spark.range(0, 4 * n, 20).select("id", F.transform(F.sequence("id", F.col("id") + 19), lambda i: F.concat(F.lit("w"), i)).alias("own"))
    kept = word_filter.keep_possible(texts, "own", shared).select("id", F.explode("own").alias("word"))
    kept = kept.select(F.substring("word", 2, 9).cast("long").alias("i")).select("i").collect()
    inside = sorted(r["i"] for r in kept if r["i"] < n)
    assert inside == list(range(n))
    stated = word_filter.false_share(n, len(held.bits))
    assert abs((len(kept) - n) / (3 * n) - stated) < 0.1 * stated + 0.002
    assert stated < 0.01 or most_bytes < word_filter.MOST_BYTES


def test_empty_tables_and_missing_texts(spark):
    none = spark.createDataFrame([], "word string")
    shared = spark.sparkContext.broadcast(word_filter.build(none))
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, own array<string>")
    got = {r["id"]: r["own"] for r in word_filter.keep_possible(rows, "own", shared).collect()}
    assert got == {1: [], 2: [], 3: None}
    assert word_filter.false_share(0, 1) == 0
