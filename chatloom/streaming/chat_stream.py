"""Conversion of arriving files. Conversion keeps no state, so each row is converted once, on arrival."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chatloom.operators import convert


def chat_stream(
    spark: SparkSession, path: str, schema, mode: str, mappings: Mapping, *, file_format: str = "parquet",
    keep: Sequence[str] = (), **options
) -> DataFrame:
    rows = spark.readStream.format(file_format).schema(schema).load(path)
    return convert.to_chat(rows, mode, mappings, keep=keep, **options)


def write_stream(chat: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends everything that has arrived to parquet and stops."""
    writer = chat.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start(out)
