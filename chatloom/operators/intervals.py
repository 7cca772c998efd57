"""Confidence intervals of scores by a Poisson bootstrap.

Every row takes part in every replicate a number of times that is Poisson distributed with mean 1, read from a hash of its
key. So a replicate needs no sample to be drawn and no number of rows to be known: one scan adds up all replicates at once,
as weighted sums that can be merged in any order, and the same rows give the same interval however they are dealt out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.rng import hash_hex, key_columns
from chatloom.operators import metrics

REPLICATES = 200
CONFIDENCE = 0.95
_PER_HASH = 8  # draws of 16 bits from one md5
_ROWS = 1 << 12


def poisson_limits(bits: int = 16) -> list[int]:
    """A draw of so many bits weighs as many times as there are limits not above it; the last is that of the greatest weight
    the bits can tell apart."""
    limits, term, total, k = [], math.exp(-1), 0.0, 0
    while True:
        total += term
        limit = round(total * 2**bits)
        if limit >= 2**bits:
            return limits
        limits.append(limit)
        k += 1
        term /= k


def _draws(key: str | Sequence[str], replicates: int, seed) -> Column:
    """Hex text with four digits per replicate."""
    blocks = range(-(-replicates // _PER_HASH))
    return F.concat(*[hash_hex(seed, "bootstrap", block, *key_columns(key)) for block in blocks])


def replicate_sums(
    rows: DataFrame, key: str | Sequence[str], values: Mapping[str, Column], replicates: int = REPLICATES, seed=42
) -> DataFrame:
    """One row per replicate, numbered from 0, and one of the rows as they are, -1: ``rows``, the sum of weights, and the weighted
    sum of each value; a null counts as 0. Only hashes and values reach Python, and as many sums as there are replicates
    leave each task."""
    names, limits = list(values), np.array(poisson_limits())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates + 1, len(names) + 1))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                digits = bytes.fromhex("".join(part.column(0).to_pylist()))
                draws = np.frombuffer(digits, ">u2").reshape(part.num_rows, -1)[:, :replicates]
                weights = np.searchsorted(limits, draws, side="right").astype(np.float64)
                columns = [np.ones(part.num_rows)]
                columns += [c.fill_null(0).to_numpy(zero_copy_only=False) for c in part.columns[1:]]
                x = np.column_stack(columns)
                total[:replicates] += weights.T @ x
                total[replicates] += x.sum(axis=0)
        numbers = pa.array([*range(replicates), -1], pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, *(pa.array(c) for c in total.T)], ["replicate", "rows", *names])

    given = rows.select(
        _draws(key, replicates, seed).alias("_draws"), *[c.cast("double").alias(f"_{i}") for i, c in enumerate(values.values())]
    )
    fields = ", ".join(f"`{n}` double" for n in ("rows", *names))
    parts = given.mapInArrow(sums, f"replicate int, {fields}")
    return parts.groupBy("replicate").agg(*[F.sum(f"`{n}`").alias(n) for n in ("rows", *names)])


def intervals(
    rows: DataFrame,
    key: str | Sequence[str],
    values: Mapping[str, Column],
    scores: Mapping[str, Callable[[Callable[[str], Column]], Column]] | None = None,
    replicates: int = REPLICATES,
    confidence: float = CONFIDENCE,
    seed=42,
) -> DataFrame:
    """``metric, value, low, mid, high``: each score of all rows, and between what limits ``confidence`` of its replicates lie.

    A score is the mean of a value of the same name, or what ``scores`` makes of the sums: a function of one that gives the
    sum of a value by name, or of ``rows``. A replicate without rows has no score, and an empty table has none."""
    made = scores or {n: (lambda total, n=n: total(n) / total("rows")) for n in values}
    sums = replicate_sums(rows, key, values, replicates, seed)
    given = F.col("rows") > 0

    def total(name: str) -> Column:
        return F.when(given, F.col(f"`{name}`"))

    named = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), f(total).alias("x")) for n, f in made.items()]))
    each = sums.select("replicate", named.alias("s")).select("replicate", "s.metric", "s.x")
    drawn = F.when(F.col("replicate") >= 0, F.col("x"))
    tail = (1 - confidence) / 2
    return each.groupBy("metric").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("x"))).alias("value"),
        *[F.percentile(drawn, p).alias(n) for n, p in (("low", tail), ("mid", 0.5), ("high", 1 - tail))],
    )


def _bleu(order: int = 4) -> tuple[Callable[[Column], dict[str, Column]], Callable]:
    fields = ["p_len", "r_len", *[f"{x}{n}" for n in range(1, order + 1) for x in "mt"]]

    def values(counts: Column) -> dict[str, Column]:
        return {f"bleu_{f}": counts[f] for f in fields}

    def score(total: Callable[[str], Column]) -> Column:
        matched, possible = ([total(f"bleu_{x}{n}") for n in range(1, order + 1)] for x in "mt")
        log_mean = sum((F.log(m / t) for m, t in zip(matched, possible)), F.lit(0.0)) / order
        ratio = total("bleu_p_len") / total("bleu_r_len")
        penalty = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - 1 / ratio))
        return F.when(F.least(*matched) == 0, F.lit(0.0)).otherwise(F.exp(log_mean) * penalty)

    return values, score


def score_intervals(pairs: DataFrame, names: Sequence[str], key: str = "sample_index", **options) -> DataFrame:
    """Intervals of text scores of (prediction, reference) pairs: exact_match, accuracy, rouge (its four scores), meteor
    (if the pairs have the column), bleu."""
    p, r = F.col("prediction"), F.col("reference")
    values: dict[str, Column] = {}
    scores: dict[str, Callable] = {}
    for name in names:
        if name in ("exact_match", "accuracy"):
            found = {name: metrics._equal()}
        elif name == "rouge":
            found = metrics.rouge_columns(p, r)
        elif name in metrics.ROUGE:
            found = {name: metrics.rouge_columns(p, r)[name]}
        elif name == "meteor":
            found = {name: F.col("meteor")}
        elif name == "bleu":
            pairs = pairs.withColumn("_bleu", metrics.bleu_counts(p, r))
            of, score = _bleu()
            values |= of(F.col("_bleu"))
            scores[name] = score
            continue
        else:
            raise ValueError(f"no interval for {name!r}")
        values |= found
        scores |= {n: (lambda total, n=n: total(n) / total("rows")) for n in found}
    return intervals(pairs, key, values, scores, **options)
