import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.config import ManualSplit, NoSplit
from chatloom.operators import sampling


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def ranked(n, seed=42):
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).withColumn("x", F.col("id") * 2)


def test_sample_is_the_head_of_the_order(rows):
    assert ids(sampling.sample_exact(rows, 150, "id")) == sorted(ranked(1000)[:150])
    assert len(ids(sampling.sample_exact(rows, 5000, "id"))) == 1000
    assert ids(sampling.sample_exact(rows, 0, "id")) == []


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partitioning_does_not_matter(rows, partitions):
    moved = rows.repartition(partitions)
    assert ids(sampling.sample_exact(moved, 77, "id", seed=7)) == sorted(ranked(1000, 7)[:77])
    got = {r["id"]: r["row_index"] for r in sampling.with_order_rank(moved, "id").collect()}
    assert [got[i] for i in ranked(1000)] == list(range(1000))


def test_refinement_of_large_buckets(rows, monkeypatch):
    monkeypatch.setattr(sampling, "_SMALL_BUCKET", 3)
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    for n in (1, 250, 999):
        assert ids(sampling.sample_exact(rows, n, "id")) == sorted(ranked(1000)[:n])


def test_head_follows_stored_order(spark, rows, monkeypatch):
    monkeypatch.setattr(sampling, "_SMALL_BUCKET", 5)
    assert ids(sampling.head(rows, 123, "id")) == list(range(123))
    signed = spark.range(-50, 50)
    assert ids(sampling.head(signed, 60, "id")) == list(range(-50, 10))
    assert sampling.head(rows, None, "id").count() == 1000


def test_shared_keys_are_reported(spark, monkeypatch):
    hot = spark.range(300).select(F.lit(1).alias("k"), "id")
    with pytest.raises(ValueError):
        sampling.sample_exact(hot, 10, "k")
    monkeypatch.setattr(sampling, "_SMALL_BUCKET", 100)
    with pytest.raises(ValueError):
        sampling.sample_exact(hot, 10, "k")
    assert sampling.sample_exact(hot, 10, ["k", "id"]).count() == 10
    assert sampling.sample_exact(sampling.with_row_id(hot.drop("id")), 10, "row_id").count() == 10


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 120), st.floats(0.01, 0.99))
def test_split_sizes(spark, n, test_size):
    got = sampling.train_test_split(spark.range(n), test_size, "id")
    train = ids(got.filter("split = 'train'"))
    assert train == sorted(ranked(n)[: int(n * (1 - test_size))])
    assert len(train) + got.filter("split = 'test'").count() == n


def test_floor_effects(spark):
    assert sampling.train_test_split(spark.range(10), 0.9, "id").filter("split = 'train'").count() == int(10 * (1 - 0.9))


def counts(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_precedence(spark):
    rows = spark.range(100)
    split = lambda c: counts(sampling.apply_split(rows, c, "id"))
    assert split(ManualSplit(40, 0.25)) == {"train": 30, "test": 10}
    assert split(ManualSplit(40)) == {"train": 40}
    assert split(ManualSplit(100, 0.25)) == {"train": 75, "test": 25}
    assert split(ManualSplit(None, 0.25)) == {"train": 75, "test": 25}
    assert split(ManualSplit(500)) == {"train": 100}
    assert split(NoSplit(10)) == {"train": 10} and split(NoSplit()) == {"train": 100}
    with pytest.raises(ValueError):
        sampling.apply_split(rows, None, "id")


def test_sample_then_split(spark):
    got = sampling.sample_then_split(spark.range(100), 10, 0.25, "id")
    assert ids(got.filter("split = 'train'")) == sorted(ranked(100)[:7])
    assert ids(got) == sorted(ranked(100)[:10])


def test_sample_with_replacement(rows):
    got = sampling.sample_with_replacement(rows, 400, "id").collect()
    assert sorted(r["draw"] for r in got) == list(range(400))
    assert len({r["id"] for r in got}) < 400
    assert sampling.sample_with_replacement(rows.limit(0), 5, "id").count() == 0


def test_fewshot_rows_are_distinct(spark):
    got = sampling.fewshot_samples(spark.range(20), 30, "id")
    assert got.count() == 90
    assert got.select("batch", "id").distinct().count() == 90
    assert sampling.fewshot_samples(spark.range(2), 4, "id").count() == 8


def test_shuffle(rows):
    assert [r["id"] for r in sampling.shuffle(rows, "id").collect()] == ranked(1000)
    assert [r["id"] for r in sampling.sample_results(rows, 0, "id").collect()] == ranked(1000)[:3]
