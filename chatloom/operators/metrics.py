"""Scores of (prediction, reference) texts.

Every score is a per-row expression and a plain aggregate, so any set of metrics is one scan without a shuffle
of texts; only scores per class group, and they combine before they move."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.columns import let, stretches
from chatloom.functions.stemming import porter_stems
from chatloom.functions.text import ngrams, tokens_13a, tokens_rouge, tokens_words
from chatloom.operators import lexical

# The metrics of each task.
TASK_METRICS = {
    "conversation": ("bertscore", "rouge"),
    "qa": ("exact_match", "bertscore"),
    "summarization": ("rouge", "bertscore"),
    "translation": ("bleu", "meteor"),
    "classification": ("accuracy", "recall", "precision", "f1"),
    "general": ("bertscore", "rouge"),
}


def metric_suite(task_type: str | None = None, metrics: Sequence[str] = ()) -> tuple[str, ...]:
    """A task's metrics (an unknown task is general); without a task, the metrics asked for."""
    if task_type:
        return TASK_METRICS.get(task_type, TASK_METRICS["general"])
    return tuple(metrics)


# ---- equality and classes -------------------------------------------------------------------------------


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _equal() -> Column:
    """1 or 0 for every pair: a missing text equals a missing one and nothing else."""
    return _text("prediction").eqNullSafe(_text("reference")).cast("double")


def exact_match(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(_equal()).alias("exact_match"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(_equal()).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _class_scores(positive=1) -> dict[str, Column]:
    """Scores as sums over the pairs, so that no text moves. A missing prediction is a miss, never a hit."""
    label = F.lit(str(positive))
    p, r = _text("prediction").eqNullSafe(label), _text("reference").eqNullSafe(label)
    tp, fp, fn = (F.coalesce(F.sum(F.when(test, F.lit(1))), F.lit(0)) for test in (p & r, p & ~r, ~p & r))
    right = F.avg(_equal())
    scores = {"exact_match": right, "accuracy": right, "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)}
    return scores | {"f1": _ratio(2 * tp, 2 * tp + fp + fn), "_seen": tp + fp + fn}


def precision_recall(pairs: DataFrame, positive=1) -> DataFrame:
    scores = _class_scores(positive)
    return pairs.agg(scores["precision"].alias("precision"), scores["recall"].alias("recall"))


def f1_binary(pairs: DataFrame, positive=1) -> DataFrame:
    return pairs.agg(_class_scores(positive)["f1"].alias("f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    """``p, r, n``: how often each label was predicted where each was right; the scores of all classes come
    from it. Labels are counted where they are before they move."""
    return pairs.groupBy(_text("prediction").alias("p"), _text("reference").alias("r")).agg(F.count(F.lit(1)).alias("n"))


def _per_class(counted: DataFrame) -> DataFrame:
    p, r, n = F.col("p"), F.col("r"), F.col("n")
    both = F.when(p.eqNullSafe(r), F.array(F.struct(p.alias("class"), (2 * n).alias("w"), (2 * n).alias("n"))))
    none = F.lit(0).cast("bigint")
    apart = F.array(
        F.struct(p.alias("class"), none.alias("w"), n.alias("n")), F.struct(r.alias("class"), none.alias("w"), n.alias("n"))
    )
    return (
        counted.select(F.explode(both.otherwise(apart)).alias("c"))
        .filter(F.col("c.class").isNotNull())
        .groupBy(F.col("c.class").alias("class"))
        .agg((F.sum("c.w") / F.sum("c.n")).alias("f1"))
    )


def f1_per_class(pairs: DataFrame) -> DataFrame:
    """``class, f1`` for every label that is predicted or referenced. A missing label is no class, but costs the class
    on the other side."""
    return _per_class(confusion(pairs))


def f1_macro(pairs: DataFrame) -> DataFrame:
    return f1_per_class(pairs).agg(F.avg("f1").alias("f1"))


def is_binary(pairs: DataFrame) -> bool:
    """Whether the references hold no more than two labels: the least, the greatest, and no other."""
    r = _text("reference")
    ends = pairs.agg(F.min(r).alias("a"), F.max(r).alias("z")).first()
    return ends["a"] is None or pairs.filter(r.isNotNull() & ~r.isin(ends["a"], ends["z"])).isEmpty()


def f1(pairs: DataFrame, positive=1) -> DataFrame:
    """Binary F1 for up to two reference labels, else the mean over classes."""
    return f1_binary(pairs, positive) if is_binary(pairs) else f1_macro(pairs)


# ---- n-gram overlap -------------------------------------------------------------------------------------


def _numbered(items: Column) -> Column:
    """Items made unique by their occurrence number, so that set operations respect multiplicity."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )
        return let(
            starts,
            lambda st: F.flatten(
                F.transform(
                    st,
                    lambda at, k: F.transform(
                        F.sequence(F.lit(1), F.coalesce(F.get(st, k + 1), F.size(s)) - at),
                        lambda j: F.concat(F.get(s, at), F.lit("\n"), j.cast("string")),
                    ),
                )
            ),
        )

    empty = F.array().cast("array<string>")
    return let(F.sort_array(items), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def overlap(a: Column, b: Column) -> Column:
    """Common items, each as often as the side that has fewer of it. Items are sorted and numbered only where both sides
    repeat some: else each common item counts once."""

    def single(items: Column) -> Column:
        return F.size(F.array_distinct(items)) == F.size(items)

    def counted(both: Column) -> Column:
        a, b = both["a"], both["b"]
        once = F.when(single(a) | single(b), F.size(F.array_intersect(a, b)))
        return once.otherwise(F.size(F.array_intersect(_numbered(a), _numbered(b))))

    return let(F.struct(a.alias("a"), b.alias("b")), counted)


def _given(text: Column) -> Column:
    """A missing text scores as an empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def _matches(p: list[str], r: list[str], n: int) -> int:
    """Common n-grams, each as often as the side that has fewer of it. Only the shorter side's are kept."""
    p, r = (p, r) if len(p) <= len(r) else (r, p)
    left = Counter(zip(*(p[i:] for i in range(n))))
    found = 0
    for gram in filter(left.__contains__, zip(*(r[i:] for i in range(n)))):
        if left[gram]:
            left[gram] -= 1
            found += 1
    return found


def bleu_counts(prediction: Column, reference: Column, order: int = 4) -> Column:
    """``struct<p_len, r_len, m1, t1, …>``: lengths, matched and possible n-grams of one pair."""
    names = ["p_len", "r_len", *(f"{x}{n}" for n in range(1, order + 1) for x in "mt")]

    @F.arrow_udf(", ".join(f"{name} long" for name in names))
    def counts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for part in lexical.parts(batches):
            rows = []
            for p, r in zip(*part):
                orders = ((_matches(p, r, n), max(len(p) - n + 1, 0)) for n in range(1, order + 1))
                rows.append((len(p), len(r), *(x for pair in orders for x in pair)))
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return counts(tokens_13a(_given(prediction)), tokens_13a(_given(reference)))


def bleu_expr(counts: str, order: int = 4) -> Column:
    """Corpus BLEU over the summed counts: geometric mean of the precisions times the brevity penalty, without
    smoothing."""
    matched = [F.sum(f"{counts}.m{n}") for n in range(1, order + 1)]
    total = [F.sum(f"{counts}.t{n}") for n in range(1, order + 1)]
    any_zero = F.least(*matched) == 0
    log_mean = sum((F.log(m / t) for m, t in zip(matched, total)), F.lit(0.0)) / order
    ratio = F.sum(f"{counts}.p_len") / F.sum(f"{counts}.r_len")
    penalty = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - 1 / ratio))
    return F.when(any_zero | any_zero.isNull(), F.lit(0.0)).otherwise(F.exp(log_mean) * penalty)


def bleu(pairs: DataFrame) -> DataFrame:
    counts = pairs.select(bleu_counts(F.col("prediction"), F.col("reference")).alias("_bleu"))
    return counts.agg(bleu_expr("_bleu").alias("bleu"))


def _f_measure(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """Harmonic mean of hits/n_pred and hits/n_ref."""
    return F.when(hits > 0, 2 * hits / (n_pred + n_ref)).otherwise(F.lit(0.0))


def rouge_n(prediction: Column, reference: Column, n: int) -> Column:
    def score(both: Column) -> Column:
        p, r = ngrams(both["p"], n), ngrams(both["r"], n)
        return _f_measure(overlap(p, r), F.size(p), F.size(r))

    return let(F.struct(tokens_rouge(_given(prediction)).alias("p"), tokens_rouge(_given(reference)).alias("r")), score)


# ---- longest common subsequence -------------------------------------------------------------------------


def _lcs_rows(a, b) -> list[int]:
    """Bit-parallel LCS table of a against b: bit i of row j is 0 where taking a[i] lengthens the best common
    subsequence with b[:j]. One machine word covers 64 cells."""
    places: dict = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row, rows = full, [full]
    for t in b:
        used = row & places.get(t, 0)
        row = ((row + used) | (row - used)) & full
        rows.append(row)
    return rows


def _lcs_length(a, b) -> int:
    return len(a) - _lcs_rows(a, b)[-1].bit_count() if len(a) else 0


def _lcs_positions(ref, can) -> set[int]:
    """Positions in ref of the common subsequence that backtracking from the ends finds."""
    rows, found, i, j = _lcs_rows(ref, can), set(), len(ref), len(can)

    def length(i: int, j: int) -> int:
        return i - (rows[j] & ((1 << i) - 1)).bit_count()

    while i and j:
        if ref[i - 1] == can[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found


def _summary_hits(ref_sentences, can_sentences) -> int:
    left_ref = Counter(t for s in ref_sentences for t in s)
    left_can = Counter(t for s in can_sentences for t in s)
    hits = 0
    for ref in ref_sentences:
        union = set().union(*(_lcs_positions(ref, can) for can in can_sentences)) if len(can_sentences) else set()
        for i in sorted(union):
            if left_ref[ref[i]] > 0 and left_can[ref[i]] > 0:
                hits += 1
                left_ref[ref[i]] -= 1
                left_can[ref[i]] -= 1
    return hits


def lcs_length(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def length(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")

    return length(a, b)


def summary_hits(predicted: Column, referenced: Column) -> Column:
    @F.pandas_udf("int")
    def hits(predicted: pd.Series, referenced: pd.Series) -> pd.Series:
        rows = zip(referenced, predicted)
        return pd.Series([_summary_hits([list(s) for s in r], [list(s) for s in p]) for r, p in rows], dtype="int32")

    return hits(predicted, referenced)


def rouge_l(prediction: Column, reference: Column) -> Column:
    p, r = tokens_rouge(_given(prediction)), tokens_rouge(_given(reference))
    return _f_measure(lcs_length(p, r), F.size(p), F.size(r))


def _sentences(text: Column) -> Column:
    lines = F.filter(F.split(_given(text), "\n"), lambda s: s != "")
    return F.transform(lines, tokens_rouge)


def rouge_lsum(prediction: Column, reference: Column) -> Column:
    """Line by line: a reference line is covered by the union of its common subsequences with all predicted lines."""
    p, r = _sentences(prediction), _sentences(reference)
    return _f_measure(summary_hits(p, r), F.size(F.flatten(p)), F.size(F.flatten(r)))


ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def rouge_columns(prediction: Column, reference: Column) -> dict[str, Column]:
    return {
        "rouge1": rouge_n(prediction, reference, 1),
        "rouge2": rouge_n(prediction, reference, 2),
        "rougeL": rouge_l(prediction, reference),
        "rougeLsum": rouge_lsum(prediction, reference),
    }


def rouge(pairs: DataFrame) -> DataFrame:
    """Mean F-measure of every pair; no resampling, so the result does not vary."""
    scored = pairs.select(*[c.alias(n) for n, c in rouge_columns(F.col("prediction"), F.col("reference")).items()])
    return scored.agg(*[F.avg(n).alias(n) for n in ROUGE])


# ---- meteor ---------------------------------------------------------------------------------------------

# METEOR's weight of recall, penalty exponent and penalty weight.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def _match_known(left: list, right: list, known: dict) -> list[tuple[int, int]]:
    """Pairs of positions, each left word, from the last on, taking the last right word among its synonyms that is free."""
    places: dict = {}
    for at, word, _ in right:
        places.setdefault(word, []).append(at)
    pairs = []
    for at, word, _ in reversed(left):
        free = [places[s] for s in set(known[word]) if places.get(s)]
        if free:
            pairs.append((at, max(free, key=lambda ends: ends[-1]).pop()))
    return pairs


def _match_equal(left: list, right: list, form: int) -> list[tuple[int, int]]:
    """Pairs of positions, each left word, from the last on, taking the last equal right word; used words are removed."""
    last: dict = {}
    for item in right:
        last.setdefault(item[form], []).append(item)
    pairs, used = [], set()
    for item in reversed(left):
        if last.get(item[form]):
            other = last[item[form]].pop()
            pairs.append((item[0], other[0]))
            used.add(other[0])
    taken = {i for i, _ in pairs}
    left[:] = [x for x in left if x[0] not in taken]
    right[:] = [x for x in right if x[0] not in used]
    return pairs


def _meteor(p_words, p_stems, r_words, r_stems, known) -> float:
    left = list(zip(range(len(p_words)), p_words, p_stems))
    right = list(zip(range(len(r_words)), r_words, r_stems))
    pairs = _match_equal(left, right, 1) + _match_equal(left, right, 2)
    if known:
        left = [x for x in left if x[1] in known]
        pairs += _match_known(left, right, known)
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, r = len(pairs) / len(p_words), len(pairs) / len(r_words)
    mean = p * r / (ALPHA * p + (1 - ALPHA) * r)
    return (1 - GAMMA * (chunks / len(pairs)) ** BETA) * mean


def meteor_score(p_words: Column, p_stems: Column, r_words: Column, r_stems: Column, known: Column, shared=None) -> Column:
    """The score from words and stems of both sides. Synonyms of the prediction's words come from ``known``, or from a
    broadcast dictionary where that is null."""

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        synonyms = {} if shared is None else shared.value
        for part in lexical.parts(batches):
            rows = ((*r, synonyms if k is None else {x["word"]: x["synonyms"] for x in k}) for *r, k in zip(*part))
            yield pa.array([_meteor(*r) for r in rows], pa.float64())

    return score(p_words, p_stems, r_words, r_stems, known)


def with_meteor(pairs: DataFrame, key: str = "sample_index", lexicon: DataFrame | None = None, out: str = "meteor") -> DataFrame:
    """Adds each pair's score. Words match when equal, then by stem, then through the lexicon."""
    tokens = pairs.withColumns({"_p": tokens_words(_given(F.col("prediction"))), "_r": tokens_words(_given(F.col("reference")))})
    known, shared = F.lit(None).cast(lexical.KNOWN), None
    if lexicon is not None:
        shared = lexical.dictionary(lexical.merge_words(lexicon))
        if shared is None:
            tokens, known = lexical.with_synonyms(tokens, key, "_p", lexicon), F.col("known")
    p, r = F.col("_p"), F.col("_r")
    score = meteor_score(p, porter_stems(p), r, porter_stems(r), known, shared)
    return tokens.withColumn(out, score).select(*pairs.columns, out)


def meteor(pairs: DataFrame, key: str = "sample_index", lexicon: DataFrame | None = None) -> DataFrame:
    return with_meteor(pairs, key, lexicon).agg(F.avg("meteor").alias("meteor"))


# ---- bertscore ------------------------------------------------------------------------------------------

Embedder = Callable[[pd.Series], pd.Series]  # texts to lists of token vectors
# Token vectors are many times larger than their texts, so the embedder gets no more texts at once than these.
EMBED_ROWS = 64
EMBED_CHARS = 2**16
COSINES = 2**20


def _greedy(p: np.ndarray, r: np.ndarray) -> tuple[float, float, float]:
    """Cosines are held for as many tokens at once as COSINES allow, so two long texts need no full matrix."""
    if len(p) == 0 or len(r) == 0:
        return 0.0, 0.0, 0.0
    p, r = p / np.linalg.norm(p, axis=1, keepdims=True), r / np.linalg.norm(r, axis=1, keepdims=True)
    found, best = [], np.full(len(r), -np.inf)
    step = max(1, COSINES // len(r))
    for start in range(0, len(p), step):
        sim = p[start : start + step] @ r.T
        found.append(sim.max(axis=1))
        best = np.maximum(best, sim.max(axis=0))
    precision, recall = float(np.concatenate(found).mean()), float(best.mean())
    total = precision + recall
    return precision, recall, 2 * precision * recall / total if total else 0.0


def bertscore_columns(prediction: Column, reference: Column, load: Callable[[], Embedder]) -> Column:
    """``struct<precision, recall, f1, error>``: every token's best cosine with the other side, averaged. Token vectors
    live only inside the task, those of a few texts at a time. Where the embedder fails, the rows it was asked about have an
    error and no score."""

    @F.pandas_udf("precision double, recall double, f1 double, error string")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        embed = None
        for predicted, referenced in batches:
            rows = []
            for start, end in stretches((predicted.str.len() + referenced.str.len()).to_numpy(), EMBED_ROWS, EMBED_CHARS):
                try:
                    embed = embed or load()
                    asked = (s.iloc[start:end].reset_index(drop=True) for s in (predicted, referenced))
                    rows += [
                        (*_greedy(np.asarray(list(p), dtype="float64"), np.asarray(list(r), dtype="float64")), None)
                        for p, r in zip(*map(embed, asked), strict=True)
                    ]
                except Exception as e:  # noqa: BLE001 - the caller's model; one failing metric must not end the others
                    rows += [(None, None, None, f"{type(e).__name__}: {e}"[:500])] * (end - start)
            yield pd.DataFrame(rows, columns=["precision", "recall", "f1", "error"]).astype({"error": object})

    return score(_given(prediction), _given(reference))


def _bert_means(column: str) -> dict[str, Column]:
    """Means without value when any pair has an error."""
    return {f: F.when(F.count(f"{column}.error") == 0, F.avg(f"{column}.{f}")) for f in ("precision", "recall", "f1")}


def bertscore(pairs: DataFrame, load: Callable[[], Embedder]) -> DataFrame:
    """``precision_mean, recall_mean, f1_mean, error``."""
    scored = pairs.select(bertscore_columns(F.col("prediction"), F.col("reference"), load).alias("_b"))
    means = [c.alias(f"{f}_mean") for f, c in _bert_means("_b").items()]
    return scored.agg(*means, F.max("_b.error").alias("error"))


# ---- suite ----------------------------------------------------------------------------------------------


RESULT = "metric string, value double, error string"
CLASS_METRICS = ("exact_match", "accuracy", "precision", "recall", "f1")


def _stacked(one: DataFrame, found: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row of values and errors as ``metric, value, error`` rows."""
    entries = [
        F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"), e.cast("string").alias("error"))
        for n, (v, e) in found.items()
    ]
    return one.select(F.explode(F.array(*entries)).alias("m")).select("m.metric", "m.value", "m.error")


def _class_part(pairs: DataFrame, wanted: Sequence[str], positive) -> DataFrame:
    """The scores of classes, from one scan. Scores of a positive label that never occurs say so."""
    scores = _class_scores(positive)
    names = [n for n in wanted if n in CLASS_METRICS]
    macro = "f1" in names and not is_binary(pairs)
    if macro:
        names.remove("f1")
    one = pairs.agg(*[scores[n].alias(n) for n in {*names, "_seen"}])
    missing = F.lit(f"label {str(positive)!r} occurs in no prediction and no reference; pass the positive label")
    none, found = F.lit(None), {}
    for name in names:
        if name in ("exact_match", "accuracy"):
            found[name] = (F.col(name), none)
        else:
            found[name] = (F.when(F.col("_seen") > 0, F.col(name)), F.when(F.col("_seen") == 0, missing))
    parts = [_stacked(one, found)] if found else []
    if macro:
        parts.append(_per_class(confusion(pairs)).agg(F.avg("f1").alias("f1")).select(F.lit("f1").alias("metric"), F.col("f1").alias("value"), none.cast("string").alias("error")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def evaluate_metrics(
    pairs: DataFrame,
    task_type: str | None = None,
    metrics: Sequence[str] = (),
    *,
    key: str = "sample_index",
    embedder: Callable[[], Embedder] | None = None,
    lexicon: DataFrame | None = None,
    positive=1,
) -> DataFrame:
    """``metric, value, error``: all text metrics from one scan of the pairs, all class metrics from another. A metric
    that cannot be computed has no value and says why; the others keep theirs. ``positive`` is the label that binary
    precision, recall and F1 are about."""
    wanted = metric_suite(task_type, metrics)
    p, r = F.col("prediction"), F.col("reference")
    rows, aggregates, failures, errors = {}, {}, {}, {}
    for name in wanted:
        if name in CLASS_METRICS:
            continue
        if name == "bleu":
            rows["_bleu"] = bleu_counts(p, r)
            aggregates[name] = bleu_expr("_bleu")
        elif name == "rouge":
            rows.update(rouge_columns(p, r))
            aggregates.update({n: F.avg(n) for n in ROUGE})
        elif name == "meteor":
            aggregates[name] = F.avg("meteor")
        elif name == "bertscore" and embedder is not None:
            rows["_bert"] = bertscore_columns(p, r, embedder)
            aggregates.update({f"bertscore_{f}_mean": c for f, c in _bert_means("_bert").items()})
            failures = {f"bertscore_{f}_mean": F.col("_bert_error") for f in ("precision", "recall", "f1")}
        elif name == "bertscore":
            errors[name] = "no embedder given"
        else:
            errors[name] = "unknown metric"
    scored = with_meteor(pairs, key, lexicon) if "meteor" in wanted else pairs
    parts = []
    if aggregates:
        error = [F.max("_bert.error").alias("_bert_error")] if failures else []
        one = scored.withColumns(rows).agg(*[c.alias(n) for n, c in aggregates.items()], *error)
        parts.append(_stacked(one, {n: (F.col(n), failures.get(n, F.lit(None))) for n in aggregates}))
    if any(n in CLASS_METRICS for n in wanted):
        parts.append(_class_part(pairs, wanted, positive))
    if errors:
        parts.append(pairs.sparkSession.createDataFrame([(n, None, e) for n, e in errors.items()], RESULT))
    if not parts:
        return pairs.sparkSession.createDataFrame([], RESULT)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
