"""Growing a dataset to a target size: originals first, then synthetic and lexically or model-edited rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.config import AugmentationConfig
from chatloom.functions import messages as M
from chatloom.functions.columns import settle
from chatloom.functions.rng import key_columns
from chatloom.functions.text import clean_chars, words
from chatloom.operators import lexical, sampling, synthesis
from chatloom.operators.generation import Loader, first_results

EDA, BACK_TRANSLATION, PARAPHRASING, SYNTHESIS = "eda", "back_translation", "paraphrasing", "synthesis"


def target_extra(rows: int, factor: float) -> int:
    """Rows to add: int(rows * factor) - rows, none for a factor up to 1."""
    return max(0, int(rows * factor) - rows) if factor > 1.0 else 0


def synthesis_split(extra: int, ratio: float = 0.5) -> tuple[int, int]:
    """How many of the extra rows are synthetic and how many are edited."""
    synthetic = int(extra * ratio)
    return synthetic, extra - synthetic


def enabled_methods(config: AugmentationConfig, models: dict[str, object]) -> list[str]:
    """Requested methods that can run: lexical always, the others when their model is given. Lexical editing is
    the default when none is requested."""
    asked = [
        name
        for name, on in (
            (EDA, config.use_eda),
            (BACK_TRANSLATION, config.use_back_translation),
            (PARAPHRASING, config.use_paraphrasing),
            (SYNTHESIS, config.use_synthesis and SYNTHESIS in models),
        )
        if on
    ] or [EDA]
    return [name for name in asked if name == EDA or name in models]


def augment_messages(
    df: DataFrame,
    key: str | Sequence[str],
    lexicon: DataFrame | None,
    *,
    methods: Sequence[str] = (EDA,),
    models: dict[str, tuple[Loader, ...]] | None = None,
    alphas: dict[str, float] | None = None,
    seed=sampling.SEED,
) -> DataFrame:
    """Edits the text parts of user and assistant messages; everything else stays. All texts of a row are edited in
    one call, where the row is, so nothing is taken apart or moved, and a count of the rows edits none."""
    keys = [key] if isinstance(key, str) else list(key)
    if M.is_legacy(df.schema["messages"].dataType):
        df = df.withColumn("messages", M.wrap_legacy(F.col("messages")))

    def own_text(m: Column, p: Column) -> Column:
        return F.when(m["role"].isin("user", "assistant") & (p["type"] == "text"), p["text"])

    texts = F.transform("messages", lambda m: F.transform(m["content"], lambda p: own_text(m, p)))
    rows, shared = df, None
    if EDA in methods:
        merged = lexical.merge_words(lexicon)
        shared = lexical.dictionary(merged)
        if shared is None:  # too large to broadcast: the words meet it in a shuffle, and come back to the row
            said = F.flatten(F.transform("messages", lambda m: words(clean_chars(M.message_text(m)))))
            rows = lexical.with_synonyms(df.withColumn("_words", F.array_distinct(said)), keys, "_words", merged).drop("_words")
    known = F.col("known") if "known" in rows.columns and "known" not in df.columns else F.array().cast(lexical.KNOWN)
    edit = _editor(shared, methods, models or {}, alphas or lexical.rates(), seed)
    ident = F.concat_ws(":", *[c.cast("string") for c in key_columns(keys)])
    rows = settle(rows, "_texts", texts).withColumn("_new", edit(F.col("_texts"), ident, known))

    def part(p: Column, i: Column, j: Column) -> Column:
        return p.withField("text", F.coalesce(F.get(F.get(F.col("_new"), i), j), p["text"]))

    edited = F.transform(
        "messages",
        lambda m, i: F.struct(
            m["role"].alias("role"), F.transform(m["content"], lambda p, j: part(p, i, j)).alias("content")
        ),
    )
    return rows.withColumn("messages", F.when(F.col("messages").isNotNull(), edited)).select(*df.columns)


def _editor(shared, methods: Sequence[str], models: dict, alphas: dict[str, float], seed):
    """Edits nested lists of texts, each by the first method, in an order drawn from its key, that changes it."""
    chains = {m: models[m] for m in methods if m in models and m not in (EDA, SYNTHESIS)}
    names = sorted([*chains, *([EDA] if EDA in methods else [])])

    @F.pandas_udf("array<array<string>>")
    def edit(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded = {name: [load() for load in chain] for name, chain in chains.items()}
        for rows, keys, known in batches:
            places, texts, idents, ready = [], [], [], []
            for r, (row, key, own) in enumerate(zip(rows, keys, known)):
                synonyms = shared.value if shared is not None else {k["word"]: list(k["synonyms"]) for k in own}
                for i, content in enumerate(row if row is not None else ()):
                    for j, text in enumerate(content if content is not None else ()):
                        if text is not None and text.strip():
                            ident = f"{key}:{i}:{j}"
                            places.append((r, i, j))
                            texts.append(text)
                            idents.append(ident)
                            ready.append(lexical.edit_text(text, synonyms, alphas, seed, ident) if EDA in methods else None)
            order = [sorted(names, key=lambda n: (lexical.order_text(seed, ident, n), n)) for ident in idents]
            out = [None if row is None else [[None] * (0 if c is None else len(c)) for c in row] for row in rows]
            for (r, i, j), new in zip(places, first_results(texts, ready, order, loaded)):
                out[r][i][j] = new
            yield pd.Series(out, dtype=object)

    # called so, the planner leaves the call where it is instead of moving it into the lambdas that read it, where it
    # can't run; a column nobody reads is still left out
    return edit.asNondeterministic()


def _with_origin(df: DataFrame, origin: str) -> DataFrame:
    return df.withColumn("origin", F.lit(origin))


def extra_rows(
    df: DataFrame,
    key: str | Sequence[str],
    config: AugmentationConfig,
    lexicon: DataFrame | None = None,
    models: dict[str, object] | None = None,
    errors: list[str] | None = None,
) -> DataFrame | None:
    """The rows that bring the dataset to its target size, with ``origin`` (synthetic, augmented) and ``draw``
    (number of an augmented row, else null); None when there is nothing to add. Synthetic rows a model failed to give
    are made up for by edited ones, and said in ``errors``; an edited row that could not be changed is still added. So
    sizes are exact.
    ``models``: ``synthesis`` a loader; ``back_translation`` a pair of loaders; ``paraphrasing`` one loader."""
    models = dict(models or {})
    methods = enabled_methods(config, models)
    rows = df.count()
    edited, parts = target_extra(rows, config.augmentation_factor), []
    editors = [m for m in methods if m != SYNTHESIS]
    if edited and SYNTHESIS in methods and "messages" in df.columns:
        synthetic, edited = synthesis_split(edited, config.synthesis_ratio)
        if synthetic:
            made = _synthetic(df, synthetic, key, config, models[SYNTHESIS])
            parts.append(made)
            if short := synthetic - made.count():  # what the model failed to give is made up for by editing
                edited, editors = edited + short, editors or [EDA]
                if errors is not None:
                    errors.append(f"synthesis gave {synthetic - short} of {synthetic} rows")
    if EDA in editors and lexicon is None:
        lexicon = df.sparkSession.createDataFrame([], "word string, synonyms array<string>")
    if edited and editors:
        drawn = sampling.sample_with_replacement(df, edited, key, config.seed, rows)
        if "messages" in df.columns:
            drawn = augment_messages(
                drawn,
                "draw",
                lexicon,
                methods=editors,
                models={k: v if isinstance(v, tuple) else (v,) for k, v in models.items()},
                alphas=lexical.rates(
                    config.eda_synonym_rate, config.eda_insert_rate, config.eda_swap_rate, config.eda_delete_rate
                ),
                seed=config.seed,
            )
        parts.append(_with_origin(drawn, "augmented"))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _synthetic(df: DataFrame, n: int, key, config: AugmentationConfig, load: Loader) -> DataFrame:
    new = synthesis.synthesize(
        df,
        n,
        key,
        load,
        system_message=config.system_message,
        max_batch_size=config.max_batch_size,
        custom_prompt=config.custom_prompt or "",
        seed=config.seed,
    )
    messages = F.transform("messages", _as_content(df.schema["messages"].dataType))
    return _with_origin(new.select(messages.alias("messages")), "synthetic").withColumn("draw", F.lit(None).cast("bigint"))


def as_originals(df: DataFrame) -> DataFrame:
    return _with_origin(df, "original").withColumn("draw", F.lit(None).cast("bigint"))


def augment(
    df: DataFrame,
    key: str | Sequence[str],
    config: AugmentationConfig,
    lexicon: DataFrame | None = None,
    models: dict[str, object] | None = None,
    errors: list[str] | None = None,
) -> DataFrame:
    """The rows themselves (``origin`` = original) followed by their extra rows."""
    extra = extra_rows(df, key, config, lexicon, models, errors)
    originals = as_originals(df)
    return originals if extra is None else originals.unionByName(extra, allowMissingColumns=True)


def extra_split_rows(
    df: DataFrame,
    key: str | Sequence[str],
    config: AugmentationConfig,
    lexicon: DataFrame | None = None,
    models: dict[str, object] | None = None,
    errors: list[str] | None = None,
) -> DataFrame | None:
    """Extra rows per chosen split, each grown by itself. By default only train grows; ``splits="all"`` grows
    test data too."""
    names = sorted(r["split"] for r in df.select("split").distinct().collect())
    result = None
    for name in (n for n in names if config.splits == "all" or n in config.splits):
        extra = extra_rows(df.filter(F.col("split") == name).drop("split"), key, config, lexicon, models, errors)
        if extra is not None:
            extra = extra.withColumn("split", F.lit(name))
            result = extra if result is None else result.unionByName(extra, allowMissingColumns=True)
    return result


def augment_splits(
    df: DataFrame,
    key: str | Sequence[str],
    config: AugmentationConfig,
    lexicon: DataFrame | None = None,
    models: dict[str, object] | None = None,
    errors: list[str] | None = None,
) -> DataFrame:
    extra = extra_split_rows(df, key, config, lexicon, models, errors)
    originals = as_originals(df)
    return originals if extra is None else originals.unionByName(extra, allowMissingColumns=True)


def augmentation_report(augmented: DataFrame, methods: Sequence[str], errors: Sequence[str] = ()) -> DataFrame:
    """One row: sizes before and after, methods, whether synthesis took part, and the share of the goal reached."""
    sizes = augmented.agg(
        F.count_if(F.col("origin") == "original").alias("original_count"),
        F.count(F.lit(1)).alias("final_count"),
    )
    return sizes.select(
        "original_count",
        "final_count",
        F.lit(",".join(methods)).alias("methods_used"),
        F.lit(SYNTHESIS in methods).alias("synthesis_used"),
        F.lit(",".join(errors)).alias("errors"),
        F.least(F.lit(1.0), F.col("final_count") / F.greatest(F.lit(1), F.col("original_count"))).alias("success_rate"),
    )


def _as_content(dtype: T.ArrayType):
    """Parsed messages in the shape the dataset has: parts with or without an image field, or plain text."""
    content = dtype.elementType["content"].dataType
    if isinstance(content, T.StringType):
        return lambda m: F.struct(m["role"].alias("role"), M.message_text(m).alias("content"))
    vision = "image" in content.elementType.names
    return lambda m: F.struct(
        m["role"].alias("role"), F.transform(m["content"], lambda p: M.text_part(p["text"], vision)).alias("content")
    )
