"""Target schemas of the nested chat layouts and of the dataset manifest."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])


def part_type(vision: bool) -> T.StructType:
    fields = [T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]
    if vision:
        fields.append(T.StructField("image", IMAGE))
    return T.StructType(fields)


def message_type(vision: bool = False) -> T.StructType:
    return T.StructType(
        [
            T.StructField("role", T.StringType()),
            T.StructField("content", T.ArrayType(part_type(vision))),
        ]
    )


def messages_type(vision: bool = False) -> T.ArrayType:
    return T.ArrayType(message_type(vision))


SPLIT_ENTRY = T.StructType(
    [
        T.StructField("split_name", T.StringType()),
        T.StructField("num_rows", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("processed_dataset_id", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("dataset_source", T.StringType()),
        T.StructField("dataset_subset", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("num_examples", T.LongType()),
        T.StructField("modality", T.StringType()),
        T.StructField("splits", T.ArrayType(SPLIT_ENTRY)),
    ]
)

RAW_MANIFEST = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
