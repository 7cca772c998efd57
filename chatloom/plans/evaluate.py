"""The evaluation job: stored examples, model answers, scores and samples to look at."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.config import EvaluationConfig
from chatloom.operators import evaluation, metrics, sampling
from chatloom.operators.convert import render_images
from chatloom.operators.generation import Loader
from chatloom.plans.materialize import materialize
from chatloom.sources.processed import read_processed


@dataclass(frozen=True)
class Evaluation:
    metrics: DataFrame  # metric, value, error
    samples: DataFrame  # key columns, input, prediction, reference
    answers: DataFrame
    num_samples: int  # rows taken from the evaluation split
    num_evaluated: int  # rows that had something to ask
    f1_per_class: DataFrame | None = None  # class, f1; only where the suite has F1


def evaluate_rows(
    rows: DataFrame,
    key: str | Sequence[str],
    load: Loader,
    config: EvaluationConfig,
    *,
    embedder: Callable | None = None,
    lexicon: DataFrame | None = None,
    batch_size: int = 16,
    seed=sampling.SEED,
) -> Evaluation:
    """The model is asked once: its answers are stored before the scores and the samples read them."""
    keys = [key] if isinstance(key, str) else list(key)
    taken = sampling.head(rows, config.max_samples, keys)
    asked = evaluation.prepare_eval(taken, keep=keys)
    vision = "image" in rows.schema["messages"].dataType.elementType["content"].dataType.elementType.names
    if vision:
        asked = evaluation.extract_images(asked, "input")
    answered = evaluation.batch_generate(asked, load, batch_size=batch_size, images_col="images" if vision else None)
    answers = materialize(answered.withColumn("prediction", F.coalesce("prediction", F.lit(""))))
    scores = metrics.evaluate_metrics(
        answers.withColumn("sample_index", F.concat_ws(":", *[F.col(k).cast("string") for k in keys])),
        config.task_type,
        config.metrics,
        embedder=embedder,
        lexicon=lexicon,
        positive=config.positive,
    )
    wants_f1 = "f1" in metrics.metric_suite(config.task_type, config.metrics)
    shown = answers.withColumn("input", render_images(F.col("input"))) if vision else answers
    samples = sampling.sample_results(
        shown.select(*keys, "input", "prediction", "reference"), config.num_sample_results, keys, seed
    )
    per_class = metrics.f1_per_class(answers) if wants_f1 else None
    return Evaluation(scores, samples, answers, taken.count(), answers.count(), per_class)


def evaluate_dataset(
    spark: SparkSession, base: str, processed_id: str, key: str | Sequence[str], load: Loader, config: EvaluationConfig, **options
) -> Evaluation:
    """Evaluates the stored evaluation split of a processed dataset."""
    _, rows = read_processed(spark, base, processed_id)
    if rows is None:
        raise ValueError(f"no evaluation split for dataset {processed_id}")
    return evaluate_rows(rows, key, load, config, **options)
