"""Quality classification by ordinal regression: a cumulative-link model on hashed text.

All grades share one weight per hashed feature; ordered thresholds cut the common score into grades:
P(grade > k) = sigmoid(score - threshold_k). The expected grade is the sum of these tails, and the last tail is the
probability of the best grade, by which documents are selected. Features are the words present in a text, without case and
outer signs, how longer words begin, and the shapes words take (signs around them, capitals, the word repeated), each
shape by the share of words that have it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import word_slices

BITS = 18
SAMPLE = 8192  # labelled rows the fit sees
LEAST_DOCUMENTS = 20  # sampled documents a feature must occur in
RIDGE = 1.0
STEPS = 60
KEEP = 0.6
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LIGHT = b".,;:!?\"'()"
_STARTS = (5, 6, 8)  # bytes


class Features(dict):
    """Hashed features of texts; what words give is remembered, up to a bound."""

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], bytes | None]:
        if len(self) >= 1 << 19:
            self.clear()
        core = word.strip(_SIGNS)
        shape = None
        if not core:
            shape = b"signs"
        elif (ends := word.strip(_LIGHT)) != core:
            shape = b"marked " + bytes(sorted(set(ends) - set(core)))
        elif word.endswith((b"!!", b"??")):
            shape = b"loud"
        elif len(core) > 3 and core.isupper():
            shape = b"capitals"
        low = core.lower()
        starts = [xxhash.xxh3_64_intdigest(low[:n], n) for n in _STARTS if len(low) > n]
        found = (xxhash.xxh3_64_intdigest(low), *starts)
        value = self[word] = (tuple(h >> (64 - BITS) for h in found), shape)
        return value

    def of(self, raw: bytes) -> np.ndarray:
        """The distinct features of a whole text in order."""
        found, shapes, words, before = set(), Counter(), 0, None
        for part in word_slices(raw):
            for word, n in Counter(part).items():
                features, shape = self[word]
                found.update(features)
                if shape:
                    shapes[shape] += n
            shapes[b"again"] += sum(map(bytes.__eq__, part, part[1:])) + (bool(part) and part[0] == before)
            words += len(part)
            before = part[-1] if part else before
        for shape, n in shapes.items():
            for tenth in range(1, 10 * n // max(1, words) + 1):
                found.add(xxhash.xxh3_64_intdigest(b"%b >= %d / 10" % (shape, tenth), 1) >> (64 - BITS))
        return np.array(sorted(found), "<u4")


def grade(quality: str = "quality", toxic: str = "toxic"):
    """0 for bad texts, 1 for sound but toxic ones, 2 for sound and clean ones; null where a rating is missing."""
    bad, harmful = F.col(quality) == 0, F.col(toxic) == 1
    return F.when(F.col(quality).isNull() | F.col(toxic).isNull(), None).when(bad, 0).when(harmful, 1).otherwise(2)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -60, 60)))


def _minimize(value, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps; ``value`` gives loss and gradient."""
    x, (loss, grad) = start, value(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, alphas = -grad, []
        for s, y in reversed(moves):
            a = s @ direction / (s @ y)
            alphas.append(a)
            direction = direction - a * y
        if moves:
            s, y = moves[-1]
            direction = direction * (s @ y) / (y @ y)
        else:
            direction = direction / max(1.0, np.linalg.norm(grad))
        for (s, y), a in zip(moves, reversed(alphas)):
            direction = direction + (a - y @ direction / (s @ y)) * s
        slope, length = grad @ direction, 1.0
        while length > 1e-6:
            new_loss, new_grad = value(x + length * direction)
            if new_loss <= loss + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = length * direction, new_grad - grad
        if s @ y > 1e-12:
            moves = (moves + [(s, y)])[-memory:]
        done = loss - new_loss < 1e-7 * max(1.0, abs(loss))
        x, loss, grad = x + s, new_loss, new_grad
        if done:
            break
    return x


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, ridge: float = RIDGE) -> Model:
    """Penalized likelihood over feature rows and grades 0 to n_grades - 1."""
    counts = np.zeros(1 << BITS, np.int64)
    for r in rows:
        counts[r] += 1
    common = np.flatnonzero(counts >= min(LEAST_DOCUMENTS, max(1, len(rows) // 50)))
    place = np.full(1 << BITS, -1, np.int32)
    place[common] = np.arange(len(common))
    # most features are rare words, so what is left is much smaller than the rows
    kept = [(c := place[r])[c >= 0] for r in rows]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in kept])
    column = np.concatenate(kept)
    del kept
    cuts, n = n_grades - 1, len(common)

    def thresholds(free: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[free[0], np.exp(np.clip(free[1:], -30, 30))])

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = x[:n], thresholds(x[n:])
        score = np.bincount(owner, w[column], len(rows))
        edges = np.r_[-np.inf, t, np.inf]
        low, high = edges[grades] - score, edges[grades + 1] - score
        f_low, f_high = 1 / (1 + np.exp(-np.clip(low, -60, 60))), 1 / (1 + np.exp(-np.clip(high, -60, 60)))
        p = np.maximum(f_high - f_low, 1e-12)
        d_low, d_high = f_low * (1 - f_low) / p, f_high * (1 - f_high) / p
        by_cut = np.zeros(cuts + 2)
        np.add.at(by_cut, grades, d_low)
        np.add.at(by_cut, grades + 1, -d_high)
        g_t = by_cut[1:-1]
        free = np.cumsum(g_t[::-1])[::-1]
        free[1:] = free[1:] * np.exp(np.clip(x[n + 1 :], -30, 30))
        g_w = np.bincount(column, (d_high - d_low)[owner], n) + ridge * w
        return float(-np.log(p).sum() + ridge / 2 * (w @ w)), np.r_[g_w, free]

    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 0.5)[:-1] / (len(rows) + 0.5 * n_grades)
    first = np.log(share / (1 - share))
    start = np.r_[np.zeros(n), first[:1], np.log(np.maximum(np.diff(first), 1e-3))]
    best = _minimize(value, start, STEPS)
    weights = np.zeros(1 << BITS, np.float32)
    weights[common] = best[:n]
    return Model(weights, thresholds(best[n:]))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        sets = [features.of((t.as_py() or "").encode("utf-8", "surrogatepass")).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["draw", "grade", "set"])


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, n_grades: int = 3) -> Model | None:
    """Learns from the documents that ``ratings`` (doc_id, grade) rates: about ``sample`` of them, picked by hash of
    the doc_id. Only their features reach the driver. Null and contradicting ratings are left out; None where
    there are none."""
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("_rated"))
    rated = rated.agg(F.min("grade").alias("grade"), F.max("grade").alias("most")).filter("grade = most").drop("most")
    total = rated.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64("_rated", F.lit(3)), F.lit(1 << 30))
    picked = rated.withColumn("draw", draw).filter(F.col("draw") <= int(min(1.0, sample / total) * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("_rated"), F.col("text").cast("string").alias("text"))
    # at most about `sample` narrow rows by the filter above, so they may go to the texts
    rows = texts.join(F.broadcast(picked), "_rated").select("draw", F.col("grade").cast("long").alias("grade"), "text")
    found = rows.mapInArrow(_featurize, "draw long, grade long, set binary").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("draw", "ascending"), ("grade", "ascending")])
    sets = [np.frombuffer(s.as_buffer(), "<u4") for s in found["set"]]
    return fit_rows(sets, found["grade"].to_numpy().astype(np.int64), n_grades)


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, expected_grade, tail_prob (of the best grade), kept.

    A document is kept when tail_prob is at least ``keep``. Null and empty texts have no features, so the thresholds
    alone grade them. Without a model all are kept with null figures. Repeated rows are graded each by itself, a
    null doc_id stays null, and an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), shared.value
        names = ["doc_id", "score", "expected_grade", "tail_prob", "kept"]
        for batch in batches:
            n = batch.num_rows
            if model is None:
                columns = [pa.nulls(n, pa.float64())] * 3 + [pa.array([True] * n, pa.bool_())]
            else:
                sets = (features.of((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1))
                scores = np.array([float(model.weights[s].sum(dtype=np.float64)) for s in sets])
                tails = model.tails(scores)
                columns = [pa.array(x) for x in (scores, tails.sum(axis=1), tails[:, -1], tails[:, -1] >= keep)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, expected_grade double, tail_prob double, kept boolean")


def keep_good(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The documents whose best grade is likely enough, with the columns of ``docs``. The verdict travels with the row,
    so rows are neither joined nor shuffled."""
    model = fit(docs, ratings, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), shared.value
        for batch in batches:
            if model is not None and batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text"))
                sets = (features.of((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts)
                scores = np.array([float(model.weights[s].sum(dtype=np.float64)) for s in sets])
                batch = batch.filter(pa.array(model.tails(scores)[:, -1] >= keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)
