"""Caller-supplied models in Arrow batches. A model is given as a loader: it runs once per Python task and
returns a function from a pandas Series of texts to a Series of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.columns import settle
from chatloom.functions.rng import hash_hex
from chatloom.functions.text import is_blank, strip

Generator = Callable[[pd.Series], pd.Series]
Loader = Callable[[], Generator]


def _answers(model, inputs: tuple[pd.Series, ...], retries: int) -> pd.DataFrame:
    """Texts and errors of one batch. A batch that fails is asked again row by row, a bounded number of times,
    so that one bad row costs only itself."""
    try:
        out = pd.Series(list(model(*inputs)), dtype=object)
        return pd.DataFrame({"text": out, "error": pd.Series([None] * len(out), dtype=object)})
    except Exception:  # noqa: BLE001 - any model failure becomes an error column
        pass
    rows = []
    for i in range(len(inputs[0])):
        row, error = None, None
        for _ in range(1 + retries):
            try:
                row, error = list(model(*[s.iloc[i : i + 1].reset_index(drop=True) for s in inputs]))[0], None
                break
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        rows.append((row, error))
    return pd.DataFrame(rows, columns=["text", "error"], dtype=object)


def ask(load: Loader | Sequence[Loader], *inputs: Column, batch_size: int = 32, retries: int = 2) -> Column:
    """``struct<text, error>`` of the model's answer; a null first input is not asked. Of several models, each further one is
    asked about the answer of the one before, in the same task, so that the answers in between go nowhere; the first error
    counts."""
    loads = [load] if callable(load) else list(load)

    def one(models, parts):
        """Texts and errors of one small batch."""
        errors = np.full(len(parts[0]), None, object)
        for model in models:
            texts, at = np.full(len(errors), None, object), np.flatnonzero(parts[0].notna())
            if len(at):
                done = _answers(model, tuple(p.iloc[at].reset_index(drop=True) for p in parts), retries)
                texts[at], errors[at] = done["text"], done["error"]
            parts = (pd.Series(texts, dtype=object),)
        return texts, errors

    def run(batches):
        models = [load() for load in loads]
        for batch in batches:
            parts = batch if isinstance(batch, tuple) else (batch,)
            rows = np.flatnonzero(parts[0].notna().to_numpy())
            texts, errors = np.full(len(parts[0]), None, object), np.full(len(parts[0]), None, object)
            for start in range(0, len(rows), batch_size):
                at = rows[start : start + batch_size]
                texts[at], errors[at] = one(models, tuple(p.iloc[at].reset_index(drop=True) for p in parts))
            yield pd.DataFrame({"text": texts, "error": errors})

    if len(inputs) == 1:

        @F.pandas_udf("text string, error string")
        def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from run(batches)

    else:

        @F.pandas_udf("text string, error string")
        def answer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            yield from run(batches)

    return answer(*inputs)


def generate(df: DataFrame, prompt_col: str, load: Loader, *, out: str = "generated", batch_size: int = 32, retries: int = 2) -> DataFrame:
    """Adds the generated text and ``<out>_error``; an empty answer is kept as empty text."""
    asked = settle(df, "_asked", F.col(prompt_col)).withColumn(
        "_answer", ask(load, F.col("_asked"), batch_size=batch_size, retries=retries)
    )
    answered = asked.withColumns({out: F.col("_answer.text"), f"{out}_error": F.col("_answer.error")})
    return answered.drop("_answer", "_asked")


def back_translate(df: DataFrame, column: str, forward: Loader, backward: Loader, *, out: str = "augmented", batch_size: int = 32) -> DataFrame:
    """To another language and back. An empty result gives the stripped original, a failure the original."""
    back = settle(df, "_asked", _non_blank(column)).withColumn(
        "_back", ask((forward, backward), F.col("_asked"), batch_size=batch_size, retries=0)
    )
    return _with_fallback(back, column, out, F.col("_back.error")).drop("_asked")


def paraphrase(df: DataFrame, column: str, load: Loader, *, out: str = "augmented", batch_size: int = 32) -> DataFrame:
    """The model is asked ``paraphrase: <text>``; an empty result gives the stripped original, a failure the original."""
    asked = settle(df, "_asked", F.concat(F.lit("paraphrase: "), _non_blank(column)))
    back = asked.withColumn("_back", ask(load, F.col("_asked"), batch_size=batch_size, retries=0))
    return _with_fallback(back, column, out, F.col("_back.error")).drop("_asked")


def _non_blank(column: str) -> Column:
    return F.when(~is_blank(F.col(column)), F.col(column))


def _with_fallback(df: DataFrame, column: str, out: str, error: Column) -> DataFrame:
    result = strip(F.col("_back.text"))
    text = (
        F.when(F.coalesce(is_blank(F.col(column)), F.lit(True)) | error.isNotNull(), F.col(column))
        .when(F.coalesce(result, F.lit("")) == "", strip(F.col(column)))
        .otherwise(result)
    )
    return df.withColumns({out: text, f"{out}_error": error}).drop("_back")


def first_changed(text: Column, seed, key: list[Column], candidates: dict[str, Column]) -> Column:
    """Among the methods' results, taken in a random order per row, the first that is new and not blank; the
    text itself when there is none. A ready result costs nothing more, which suits the lexical method."""
    tried = F.array_sort(
        F.array(
            *[
                F.struct(hash_hex(seed, "method", *key, name).alias("h"), F.lit(name).alias("name"), c.alias("text"))
                for name, c in sorted(candidates.items())
            ]
        )
    )
    good = F.filter(tried, lambda c: c["text"].isNotNull() & (c["text"] != text) & ~is_blank(c["text"]))
    return F.coalesce(F.get(good, F.lit(0))["text"], text)


def method_order(seed, key: list[Column], names: list[str]) -> Column:
    """Method names in the row's random order."""
    ranked = F.array_sort(
        F.array(*[F.struct(hash_hex(seed, "method", *key, n).alias("h"), F.lit(n).alias("name")) for n in sorted(names)])
    )
    return F.transform(ranked, lambda c: c["name"])


def first_results(texts: list, ready: list, order: list, chains: dict[str, list[Generator]]) -> list:
    """For every text the first method's result, in its own order of methods, that is new and not blank; the text
    itself when there is none. A method without a chain of models has its result in ``ready``."""
    result: list = [None] * len(texts)
    for stage in range(max((len(o) for o in order), default=0)):
        for name in sorted({o[stage] for o in order if len(o) > stage}):
            rows = [
                i
                for i, o in enumerate(order)
                if result[i] is None and len(o) > stage and o[stage] == name and (texts[i] or "").strip()
            ]
            if not rows:
                continue
            if name in chains:
                answers = pd.Series([texts[i] for i in rows], dtype=object)
                if name == "paraphrasing":
                    answers = "paraphrase: " + answers
                for model in chains[name]:
                    answers = _answers(model, (answers.fillna(""),), 0)["text"]
            else:
                answers = [ready[i] for i in rows]
            for i, a in zip(rows, answers):
                if isinstance(a, str) and a.strip() and a != texts[i]:
                    result[i] = a
    return [t if r is None else r for t, r in zip(texts, result)]


def try_methods(text: Column, lexical: Column | None, order: Column, loaders: dict[str, tuple[Loader, ...]]) -> Column:
    """Like first_changed for methods that call models: stage by stage, each model sees in one batch the rows
    whose turn it is and which have no result yet. A method of several loaders chains them."""

    @F.pandas_udf("string")
    def choose(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        chains = {name: [load() for load in chain] for name, chain in loaders.items()}
        for texts, ready, order in batches:
            yield pd.Series(first_results(list(texts), list(ready), list(order), chains), dtype=object)

    none = F.lit(None).cast("string")
    return choose(text, none if lexical is None else lexical, order)
