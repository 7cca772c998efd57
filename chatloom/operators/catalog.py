"""Writing processed datasets, and the manifest tables that list them. A manifest is a log of commits: writers at the same
time lose nothing, and readers see each entry as a whole, the old one or the new one."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.functions.rng import key_columns
from chatloom.operators.commit_log import CommitLog
from chatloom.schemas import MANIFEST, RAW_MANIFEST
from chatloom.sources import files

PREVIEW_ROWS = 5


def _folder(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _folder(spark, path)
    return fs.exists(jpath)


def _files(spark: SparkSession, path: str) -> Iterator[str]:
    fs, jpath = _folder(spark, path)
    listing = fs.listFiles(jpath, True)
    while listing.hasNext():
        name = listing.next().getPath().getName()
        if not name.startswith((".", "_")):
            yield name


def _has_files(spark: SparkSession, path: str) -> bool:
    return next(_files(spark, path), None) is not None


def _delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _folder(spark, path)
    fs.delete(jpath, True)


def dataset_path(base: str, processed_id: str) -> str:
    return posixpath.join(base, "processed_datasets", processed_id)


def manifest_path(base: str) -> str:
    return posixpath.join(base, "manifest")


def is_id(processed_id: str) -> Column:
    return F.col("processed_dataset_id") == processed_id


def _digest(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def new_id(config: Mapping) -> str:
    """Eight hex digits of the configuration, so that a rerun replaces its own output and nothing else."""
    return _digest(config)[:8]


def new_version(spark: SparkSession, base: str, processed_id: str, config: Mapping) -> str:
    """A new folder for the rows of a dataset. It is named by the whole configuration too: an id that is in use for
    another one is an error, not a replacement."""
    folder, mark = dataset_path(base, processed_id), _digest(config)[8:40]
    if _exists(spark, folder):
        fs, jpath = _folder(spark, folder)
        for status in fs.listStatus(jpath):
            if not status.getPath().getName().startswith(mark):
                raise ValueError(f"dataset {processed_id} exists with another configuration; drop it or pass another id")
    return posixpath.join(folder, f"{mark}-{uuid.uuid4().hex[:8]}")


def _drop_other_versions(spark: SparkSession, path: str) -> None:
    fs, jpath = _folder(spark, posixpath.dirname(path))
    for status in fs.listStatus(jpath):
        if status.getPath().getName() != posixpath.basename(path):
            fs.delete(status.getPath(), True)


def manifest_log(spark: SparkSession, base: str) -> CommitLog:
    return CommitLog(spark, manifest_path(base), MANIFEST, "processed_dataset_id")


def raw_log(spark: SparkSession, base: str) -> CommitLog:
    return CommitLog(spark, posixpath.join(base, "raw_manifest"), RAW_MANIFEST, "dataset_id")


def manifest(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The list of datasets, as of a version if one is given."""
    return manifest_log(spark, base).read(version)


def _split_order(name: str) -> tuple[bool, str]:
    return name.lower() not in ("train", "training"), name


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per split below ``path``; splits without rows get none."""
    if "split" not in df.columns:
        raise ValueError("a split column is required")
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows written so far, with ``split`` as text."""
    return spark.read.parquet(path).withColumn("split", F.col("split").cast("string"))


def register_processed(
    spark: SparkSession,
    base: str,
    processed_id: str,
    name: str,
    *,
    user_id: str,
    dataset_id: str = "",
    dataset_source: str = "upload",
    dataset_subset: str = "default",
    modality: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Lists the written rows of a dataset and returns its manifest row. Rows are counted from the files, which
    takes their footers and not a second run of the plan. The entry is the last thing written: until then an earlier
    version of the dataset stays as it was, and afterwards its files go."""
    path, counts = path or dataset_path(base, processed_id), {}
    if _exists(spark, path) and _has_files(spark, path):
        per_split = read_rows(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
        counts = {r["split"]: r["n"] for r in per_split.collect()}
    if not counts:
        _delete(spark, path)
        raise ValueError("cannot write the dataset: all splits are empty")
    names = sorted(counts, key=_split_order)
    splits = [(n, counts[n], posixpath.join(path, f"split={n}")) for n in names]
    row = (
        processed_id, name, user_id, dataset_id, dataset_source, dataset_subset,
        datetime.now(timezone.utc).replace(tzinfo=None), sum(counts.values()), modality, splits,
    )
    manifest_log(spark, base).commit(put=[row])
    if path != dataset_path(base, processed_id):
        _drop_other_versions(spark, path)
    return spark.createDataFrame([row], MANIFEST)


def write_processed(
    df: DataFrame, base: str, name: str, *, user_id: str, config: Mapping | None = None, processed_id: str | None = None, **described
) -> DataFrame:
    """Writes a dataset and returns its manifest row."""
    if not name:
        raise ValueError("dataset name is required")
    whole = {"name": name, "user": user_id, "config": config or {}, **described}
    processed_id = processed_id or new_id(whole)
    path = new_version(df.sparkSession, base, processed_id, whole)
    write_rows(df, path)
    return register_processed(df.sparkSession, base, processed_id, name, user_id=user_id, path=path, **described)


def dataset_summary(df: DataFrame, modality: str = "text") -> DataFrame:
    """One row: number of examples, number of rows per split, modality."""
    per_split = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return per_split.agg(
        F.sum("n").alias("num_examples"),
        F.sort_array(F.collect_list(F.struct(F.col("split").alias("split_name"), F.col("n").alias("num_rows")))).alias("splits"),
    ).withColumn("modality", F.lit(modality))


@dataclass(frozen=True)
class Profile:
    columns: list[str]
    num_examples: int
    sample: list[dict]
    size_bytes: int | None = None


def profile(df: DataFrame, path: str | None = None) -> Profile:
    """Columns, number of rows, the first rows, and the size of the files when their path is given."""
    size = files.file_sizes(df.sparkSession, path) if path else None
    sample = [r.asDict(recursive=True) for r in df.limit(PREVIEW_ROWS).collect()]
    return Profile(df.columns, df.count(), sample, size)


def preview(df: DataFrame, order: str | list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first n rows of every split. Each task keeps only its own first n before they meet."""
    first = Window.partitionBy("split").orderBy(*key_columns(order))
    return df.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_r")


def list_datasets(manifest_df: DataFrame, user_id: str) -> DataFrame:
    """A user's datasets with their split names; a missing modality is text."""
    return manifest_df.filter(F.col("user_id") == user_id).select(
        "dataset_name",
        "dataset_subset",
        "dataset_source",
        "dataset_id",
        "processed_dataset_id",
        "num_examples",
        "created_at",
        F.transform("splits", lambda s: s["split_name"]).alias("splits"),
        F.coalesce("modality", F.lit("text")).alias("modality"),
    )


def find_dataset(manifest_df: DataFrame, processed_id: str, user_id: str) -> DataFrame:
    """The entry if the user owns it, else no row."""
    return manifest_df.filter(is_id(processed_id) & (F.col("user_id") == user_id))


def get_dataset(spark: SparkSession, base: str, processed_id: str, user_id: str) -> DataFrame:
    found = find_dataset(manifest(spark, base), processed_id, user_id)
    if found.isEmpty():
        raise LookupError(f"dataset {processed_id} not found or not owned by {user_id}")
    return found


def dataset_exists(spark: SparkSession, base: str, processed_id: str) -> bool:
    return _exists(spark, dataset_path(base, processed_id))


def split_previews(spark: SparkSession, base: str, processed_id: str, user_id: str, n: int = PREVIEW_ROWS) -> list[dict]:
    """Every split of a dataset with its size, path and first rows; a split that cannot be read has no rows."""
    entry = get_dataset(spark, base, processed_id, user_id).first()
    result = []
    for split in entry["splits"]:
        try:
            rows = spark.read.parquet(split["path"])
            if entry["modality"] == "vision":
                rows = _displayable(rows)
            samples = [r.asDict(recursive=True) for r in rows.limit(n).collect()]
        except Exception:  # noqa: BLE001 - files may be gone
            samples = []
        result.append({**split.asDict(), "samples": samples})
    return result


def _displayable(df: DataFrame) -> DataFrame:
    from chatloom.operators.convert import render_images

    lists = [c for c in ("messages", "prompt") if c in df.columns]
    return df.withColumns({c: render_images(F.col(c)) for c in lists})


def drop_dataset(spark: SparkSession, base: str, processed_id: str, user_id: str) -> int:
    """Deletes the files of an owned dataset and then its entry; raw files stay. Returns the number of files."""
    get_dataset(spark, base, processed_id, user_id)
    path = dataset_path(base, processed_id)
    n = sum(1 for _ in _files(spark, path)) if _exists(spark, path) else 0
    if n:
        _delete(spark, path)
        manifest_log(spark, base).commit(remove=[processed_id])
    return n


# ---- raw files ------------------------------------------------------------------------------------------


def raw_manifest(spark: SparkSession, base: str) -> DataFrame:
    return raw_log(spark, base).read()


def register_raw(spark: SparkSession, base: str, path: str, user_id: str, dataset_id: str | None = None) -> DataFrame:
    """Lists a raw file or folder, where it is, and returns its manifest row."""
    kind = files.extension(path)
    dataset_id = dataset_id or hashlib.sha256(f"{user_id}:{path}".encode()).hexdigest()[:32]
    row = (
        dataset_id, user_id, files.safe_name(path), path, files.CONTENT_TYPES[kind],
        files.file_sizes(spark, path), datetime.now(timezone.utc).replace(tzinfo=None),
    )
    raw_log(spark, base).commit(put=[row])
    return spark.createDataFrame([row], RAW_MANIFEST)


def get_raw(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> DataFrame:
    owned = (F.col("dataset_id") == dataset_id) & (F.col("user_id") == user_id)
    found = raw_manifest(spark, base).filter(owned)
    if found.isEmpty():
        raise LookupError(f"source dataset {dataset_id} not found or not owned by {user_id}")
    return found


def drop_raw(spark: SparkSession, base: str, dataset_id: str, user_id: str) -> None:
    """Removes the entry of an owned raw dataset; the files stay."""
    get_raw(spark, base, dataset_id, user_id)
    raw_log(spark, base).commit(remove=[dataset_id])
