"""From raw documents to packed sequences: a quality classifier, exact and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, read back from Parquet; all but the
last return the columns of ``documents``. No stage fails on nulls, and an empty table stays one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import exact_dedup, mixing, near_dedup, ordinal, packing
from chatloom.plans.materialize import scratch_path

#: The classifier, the near duplicates and the packer run Python on whole texts, which SQL can't express.
ORACLE_SQL = None


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, grade) of the labelled documents."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ordinal.grade().alias("grade"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is likely enough; the others go. A null text counts as empty; a row is judged by its text
    alone, so repeated rows stay or go together, and all stay where nothing is rated."""
    return ordinal.keep_good(docs, ratings(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts, that with the smallest doc_id. Null and empty texts are equal; rows that
    repeat doc_id and text are one; rows without doc_id stay."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id. Texts without words and rows without
    doc_id stay."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's weight asks for. A null source is one of its own, texts without words
    weigh one token, of rows that repeat a doc_id the longest counts, and rows without doc_id stay as they are."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. A null or empty text is its end token alone; repeated rows are
    packed each by itself."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage's result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
