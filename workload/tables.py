"""Inputs of the workload: the given tables and what Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.messages import text_part
from chatloom.sources.files import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The documents for work that is heavy per text."""
    return spread(table(spark, sf, "documents").select(*(columns or ("*",))))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """The conversation turns for work that is heavy per text."""
    return spread(table(spark, sf, "conversations"))


def long_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of every tenth conversation in a row, as a few long conversations that grow with the table."""
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") % 10).alias("conv_id"),
        (F.floor(F.col("conv_id") / 10) * 1000 + F.col("turn")).alias("turn"),
        "role",
        "text",
    )


def conversation_rows(spark: SparkSession, sf: str, turns: DataFrame | None = None) -> DataFrame:
    """conv_id, messages: whole conversations, each of which is one example and so one row."""
    rows = table(spark, sf, "conversations") if turns is None else turns
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            F.transform(
                "turns",
                lambda t: F.struct(t["role"].alias("role"), F.array(text_part(t["text"])).alias("content")),
            ).alias("messages"),
        )
    )


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn (prediction) with the assistant turn right after it (reference)."""
    user = turns(spark, sf).filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prediction"))
    reply = table(spark, sf, "conversations").filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference")
    )
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("sample_index"), "prediction", "reference"
    )


def flat_messages(df: DataFrame, column: str, *ids: str) -> DataFrame:
    """One row per message part, as scalar columns."""
    return (
        df.select(*ids, F.posexplode(column).alias("pos", "m"))
        .select(*ids, "pos", F.col("m.role").alias("role"), F.posexplode("m.content").alias("part_pos", "p"))
        .select(
            *ids,
            F.col("pos").cast("bigint").alias("pos"),
            "role",
            F.col("part_pos").cast("bigint").alias("part_pos"),
            F.col("p.type").alias("part_type"),
            F.col("p.text").alias("text"),
        )
    )


PAIRS_SQL = """
pairs AS (
  SELECT u.conv_id * 1000000 + u.turn AS sample_index, u.text AS prediction, a.text AS reference
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""
