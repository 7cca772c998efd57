"""Reading back a processed dataset by its id."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from chatloom.operators import catalog

log = logging.getLogger(__name__)

# Names a split may have.
TRAIN_NAMES = ("train", "training")
EVAL_NAMES = ("test", "validation", "eval", "evaluation")


def choose_splits(names: Sequence[str]) -> tuple[str, str | None]:
    """Names of the train and the evaluation split, in any letter case; of several fitting names the last one
    counts. Without a train name the first split is train."""
    if not names:
        raise FileNotFoundError("the dataset has no splits")
    train = [n for n in names if n.lower() in TRAIN_NAMES]
    evaluation = [n for n in names if n.lower() in EVAL_NAMES]
    if not train:
        log.warning("no train split, using %s", names[0])
    if not evaluation:
        log.warning("no evaluation split, using train only")
    return (train[-1] if train else names[0]), (evaluation[-1] if evaluation else None)


def read_processed(spark: SparkSession, base: str, processed_id: str) -> tuple[DataFrame, DataFrame | None]:
    entry = catalog.manifest(spark, base).filter(catalog.is_id(processed_id)).first()
    if entry is None:
        raise FileNotFoundError(f"no dataset {processed_id}")
    paths = {s["split_name"]: s["path"] for s in entry["splits"]}
    train, evaluation = choose_splits(list(paths))
    read = spark.read.parquet
    return read(paths[train]), read(paths[evaluation]) if evaluation else None
