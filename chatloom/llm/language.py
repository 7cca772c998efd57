"""Language identification with a string kernel.

Two texts are as similar as the n-grams of 1 to 3 characters (lower case) they both have: the blended-spectrum
presence kernel, |X and Y| / sqrt(|X| |Y|) over hashed n-gram sets. Landmark texts give a Nystroem approximation of its
feature space, in which a ridge regression per language (target 1 or -1) is solved. As the kernel is a product
of presence vectors, landmarks, projection and weights fold into one matrix of n-grams by languages, and a
batch of texts is scored by one product with it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1 << 16
ORDER = 3
SAMPLE = 2400  # labelled rows the fit sees, dealt evenly to the languages
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"
_SLICE = 1 << 20
_FACTORS = np.array([[2654435761, 0, 0], [2246822519, 3266489917, 0], [668265263, 374761393, 2869860233]], np.uint32)


def ngrams(text: str) -> np.ndarray:
    """The hashed n-grams of the whole text in order."""
    seen = np.zeros(BINS, bool)
    text = text.lower()
    for start in range(0, max(1, len(text)), _SLICE):
        part = text[start : start + _SLICE + ORDER - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)
        for n in range(1, ORDER + 1):
            size = len(codes) - n + 1
            if size > 0:
                mixed = codes[:size] * _FACTORS[n - 1, 0]
                for i in range(1, n):
                    mixed = mixed + codes[i : i + size] * _FACTORS[n - 1, i]
                mixed ^= mixed >> np.uint32(15)
                seen[(mixed * np.uint32(2246822519)) >> np.uint32(16)] = True
    return np.flatnonzero(seen).astype(np.uint16)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text is a multiple of 5; false without doc_id."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # n-grams by languages

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Texts by languages; every text must have an n-gram."""
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        sums = np.add.reduceat(self.weights[np.concatenate(sets)], starts, axis=0)
        return sums / np.sqrt([len(s) for s in sets])[:, None]


def fit_sets(sets: list[np.ndarray], labels: list[str]) -> Model:
    """The model for n-gram sets and their languages; the first texts of every language serve as landmarks."""
    languages = sorted(set(labels))
    each = max(1, LANDMARKS // max(1, len(languages)))
    taken, chosen = dict.fromkeys(languages, 0), []
    for i, label in enumerate(labels):
        if taken[label] < each:
            taken[label] += 1
            chosen.append(i)
    known = np.unique(np.concatenate([sets[i] for i in chosen]))  # the only n-grams the kernel looks at
    place = np.full(BINS, -1)
    place[known] = np.arange(len(known))
    present = _rows([sets[i] for i in chosen], place, len(known))
    kernel = present @ present.T
    values, vectors = np.linalg.eigh(kernel.astype(np.float64))
    good = values > 1e-6 * values.max()
    project = vectors[:, good] / np.sqrt(values[good])
    step = 256
    features = np.concatenate(
        [(_rows(sets[s : s + step], place, len(known)) @ present.T) @ project for s in range(0, len(sets), step)]
    )
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    gram = features.T @ features + RIDGE * len(sets) * np.eye(features.shape[1])
    ridge = np.linalg.solve(gram, features.T @ target)
    weights = np.zeros((BINS, len(languages)), np.float32)
    weights[known] = present.T @ (project @ ridge)
    return Model(languages, weights)


def _rows(sets: list[np.ndarray], place: np.ndarray, width: int) -> np.ndarray:
    """Presence vectors of length 1 over all n-grams, at the known ones."""
    rows = np.zeros((len(sets), width), np.float32)
    for row, s in enumerate(sets):
        at = place[s]
        rows[row, at[at >= 0]] = 1 / np.sqrt(len(s))
    return rows


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from (doc_id, text, lang) rows that have a lang and are not held out: about ``sample`` of them, as many
    for every language but one at least, picked by hash. Every language is learned; each takes a column of BINS weights. Texts are turned to n-gram sets, of bounded size, before they reach the driver.
    None where there is nothing to learn from."""
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return None
    each = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.3 * each / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    picked = known.withColumn("draw", draw).filter(F.col("draw") <= share[F.col("lang")] * float(1 << 30))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngrams(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["draw", "lang", "set"])

    rows = picked.select("draw", "lang", "text").mapInArrow(featurize, "draw long, lang string, set binary").collect()
    per: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["lang"], bytes(r["set"]))):
        if len(r["set"]):
            per.setdefault(r["lang"], []).append(np.frombuffer(bytes(r["set"]), np.uint16))
    kept = [(s, lang) for lang, found in sorted(per.items()) for s in found[:each]]
    return fit_sets([s for s, _ in kept], [lang for _, lang in kept]) if kept else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1, from the ridge value -1 to 1).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text without a model. Repeated rows are
    predicted each by itself; a null doc_id stays null and is not held out. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            at, sets = [], []

            def flush() -> None:
                if at:
                    values = model.scores(sets)
                    best = values.argmax(axis=1)
                    for row, k, v in zip(at, best.tolist(), values[np.arange(len(at)), best].tolist()):
                        names[row], scores[row] = model.languages[k], min(1.0, max(0.0, (v + 1) / 2))
                    at.clear()
                    sets.clear()

            for row, value in enumerate(batch.column(2)):
                text = value.as_py()
                if model is not None and text and any(map(str.isalpha, text)):
                    at.append(row)
                    sets.append(ngrams(text))
                    if len(at) == 256:
                        flush()
            flush()
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
