"""Poisson bootstrap: the same weights as a plain loop, whatever the partitioning, and limits that statistics expects."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import intervals, metrics


def weight(key, replicate, seed=42):
    digits = hashlib.md5(f"{seed}:bootstrap:{replicate // 8}:{key}".encode()).hexdigest()
    draw = int(digits[replicate % 8 * 4 : replicate % 8 * 4 + 4], 16)
    return sum(limit <= draw for limit in intervals.poisson_limits())


def test_limits_are_those_of_the_distribution():
    limits = intervals.poisson_limits()
    assert limits == sorted(limits) and len(limits) >= 7
    share = np.diff([0, *limits, 1 << 16]) / (1 << 16)
    assert all(abs(s - math.exp(-1) / math.factorial(k)) < 1e-4 for k, s in enumerate(share))
    assert abs(sum(k * s for k, s in enumerate(share)) - 1) < 1e-3


@pytest.fixture(scope="module")
def scored(spark):
    draw = random.Random(4)
    rows = [(i, draw.random(), draw.choice([0.0, 1.0, None])) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id long, a double, b double")


def test_sums_against_a_loop_and_any_partitioning(scored):
    rows, df = scored
    values = {"a": F.col("a"), "b": F.col("b")}
    for parts in (1, 5):
        got = {r["replicate"]: r for r in intervals.replicate_sums(df.repartition(parts), "id", values, 19).collect()}
        assert set(got) == set(range(-1, 19))
        for k in range(19):
            w = [weight(i, k) for i, _, _ in rows]
            want = sum(w), sum(n * a for n, (_, a, _) in zip(w, rows)), sum(n * (b or 0) for n, (_, _, b) in zip(w, rows))
            assert np.allclose([got[k]["rows"], got[k]["a"], got[k]["b"]], want)
        assert np.allclose(got[-1]["a"], sum(a for _, a, _ in rows)) and got[-1]["rows"] == 300


def test_limits_fit_the_standard_error(scored):
    rows, df = scored
    got = intervals.intervals(df, "id", {"a": F.col("a")}, replicates=400).first()
    a = np.array([x for _, x, _ in rows])
    error = a.std() / math.sqrt(len(a))
    assert abs(got["value"] - a.mean()) < 1e-12 and abs(got["mid"] - a.mean()) < 0.5 * error
    assert abs((got["high"] - got["low"]) / (2 * 1.96 * error) - 1) < 0.2


def test_scores_of_text(spark):
    rows = [(i, f"the cat {i % 3} sat on the mat today", f"the cat {i % 4} sat on the mat now") for i in range(40)] + [(40, None, "x"), (41, None, None)]
    pairs = spark.createDataFrame(rows, "sample_index long, prediction string, reference string")
    got = {r["metric"]: r for r in intervals.score_intervals(pairs, ["exact_match", "rouge", "bleu"], replicates=50).collect()}
    assert set(got) == {"exact_match", "bleu", *metrics.ROUGE}
    assert abs(got["bleu"]["value"] - metrics.bleu(pairs).first()["bleu"]) < 1e-12
    assert abs(got["rougeL"]["value"] - metrics.rouge(pairs).first()["rougeL"]) < 1e-12
    assert all(r["low"] <= r["mid"] <= r["high"] for r in got.values())
    none = intervals.score_intervals(pairs.limit(0), ["exact_match"], replicates=9)
    assert [r for r in none.collect() if r["value"] is not None] == []
    with pytest.raises(ValueError):
        intervals.score_intervals(pairs, ["charm"])
