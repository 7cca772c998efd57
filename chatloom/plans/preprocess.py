"""The preparation job: source, split, conversion, growth, and the written dataset with its manifest row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from chatloom.config import NamedSplits, PreprocessingConfig, as_mappings, detect_modality, image_columns
from chatloom.operators import augment, catalog, convert, sampling
from chatloom.sources import files


def load_splits(
    spark: SparkSession,
    path: str,
    config: PreprocessingConfig,
    key: str | Sequence[str],
    reader: Mapping | None = None,
    images: str | None = None,
) -> DataFrame:
    """Rows with a ``split`` column. A split asked for by name is read from a table partitioned by split. ``reader``
    holds options of the file reader (schema, multi_line, lines, columns). ``images`` is a folder: columns of paths
    that an image mapping names are then replaced by the files found there."""
    rows = _split_rows(spark, path, config, key, reader or {})
    if images is not None:
        loaded = files.read_images(spark, images)
        for column in image_columns(as_mappings(config.field_mappings)):
            if dict(rows.dtypes).get(column) == "string":
                rows = files.attach_images(rows, column, loaded)
    return rows


def _split_rows(spark: SparkSession, path: str, config: PreprocessingConfig, key, reader: Mapping) -> DataFrame:
    if config.split is None:
        raise ValueError("a split configuration is required")
    if isinstance(config.split, NamedSplits):
        return files.read_named_splits(spark, path, config.split.train_split, config.split.test_split)
    named = config.split.split
    rows = files.read_single_split(spark, path, named) if named else files.read_any(spark, path, **reader)
    return sampling.apply_split(rows, config.split, key)


def prepare(rows: DataFrame, mode: str, config: PreprocessingConfig, key: str | Sequence[str]) -> DataFrame:
    """Chat examples with ``split`` and the key columns."""
    return convert.to_chat(
        rows,
        mode,
        config.field_mappings,
        keep=[key] if isinstance(key, str) else list(key),
        normalize_whitespace=config.normalize_whitespace,
        null_text=config.null_text,
        include_system=config.include_system,
    )


def process_dataset(
    spark: SparkSession,
    path: str,
    base: str,
    name: str,
    mode: str,
    config: PreprocessingConfig,
    *,
    key: str | Sequence[str],
    user_id: str,
    dataset_id: str = "",
    dataset_source: str = "upload",
    dataset_subset: str = "default",
    lexicon: DataFrame | None = None,
    models: dict[str, object] | None = None,
    reader: Mapping | None = None,
    images: str | None = None,
    errors: list[str] | None = None,
) -> DataFrame:
    """Runs the whole job and returns the manifest row. Converted rows are written first; extra rows are drawn
    from what was written and appended, so growth neither converts the source again nor reads more of the
    stored columns than it needs. Rows go to a new folder and are listed last, so a run that fails leaves an earlier
    dataset of the same configuration as it was. What growth could not do as asked is added to ``errors``."""
    if not name:
        raise ValueError("dataset name is required")
    source = {"dataset_id": dataset_id, "dataset_source": dataset_source, "dataset_subset": dataset_subset}
    described = {"name": name, "user": user_id, "mode": mode, "path": path, "key": key, **source, **asdict(config)}
    processed_id = catalog.new_id(described)
    target = catalog.new_version(spark, base, processed_id, described)
    chat = prepare(load_splits(spark, path, config, key, reader, images), mode, config, key)
    if config.augmentation is None:
        catalog.write_rows(chat, target)
    else:
        catalog.write_rows(augment.as_originals(chat), target)
        stored = catalog.read_rows(spark, target).drop("origin", "draw")
        extra = augment.extra_split_rows(stored, key, config.augmentation, lexicon, models, errors)
        if extra is not None:
            # files of one dataset share one schema: what synthetic rows lack is null
            same = augment.as_originals(stored).limit(0).unionByName(extra, allowMissingColumns=True)
            catalog.write_rows(same, target, mode="append")
    modality = detect_modality(as_mappings(config.field_mappings))
    return catalog.register_processed(spark, base, processed_id, name, user_id=user_id, modality=modality, path=target, **source)
