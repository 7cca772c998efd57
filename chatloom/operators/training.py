"""Trainer-side preparation: standard chat layout, rendered text, label masks, token metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions import messages as M
from chatloom.functions.columns import let
from chatloom.functions.text import strip

# Markers of the chat template and the label trainers ignore.
BOS = "<bos>"
TURN_START = "<start_of_turn>"
TURN_END = "<end_of_turn>"
IMAGE_START = "<start_of_image>"
IGNORE = -100
IMAGE_SOFT_TOKEN = 262144
ROLE_NAMES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "model": "assistant", "system": "system"}


def standardize_conversations(df: DataFrame) -> DataFrame:
    """``messages`` (or ``conversations``) with ``role``/``content`` keys: ``from``/``value`` pairs are renamed and
    role names mapped to user, assistant and system."""
    column = "messages" if "messages" in df.columns else "conversations"
    if column not in df.columns:
        raise ValueError("a messages or conversations column is required")
    names = df.schema[column].dataType.elementType.names
    role, content = ("from", "value") if "from" in names else ("role", "content")
    mapping = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])

    def one(m: Column) -> Column:
        return F.struct(F.coalesce(F.try_element_at(mapping, m[role]), m[role]).alias("role"), m[content].alias("content"))

    result = df.withColumn("messages", F.transform(column, one))
    return result if column == "messages" else result.drop(column)


def _content_text(m: Column, legacy: bool) -> Column:
    if legacy:
        return strip(F.coalesce(m["content"], F.lit("")))
    part = F.transform(
        F.coalesce(m["content"], F.array()),
        lambda p: F.when(p["type"] == "image", F.lit(IMAGE_START))
        .when(p["type"] == "text", strip(F.coalesce(p["text"], F.lit(""))))
        .otherwise(F.lit("")),
    )
    return F.array_join(part, "")


def _first_text(m: Column, legacy: bool) -> Column:
    return m["content"] if legacy else F.get(m["content"], F.lit(0))["text"]


def chat_text(messages: Column, dtype: T.DataType, add_generation_prompt: bool = False, bos: bool = False) -> Column:
    """The conversation as one text of marked turns. A leading system message becomes the start of the first
    turn; assistant turns are named model."""
    legacy = M.is_legacy(dtype)
    first = F.get(messages, F.lit(0))
    has_system = F.coalesce(first["role"] == "system", F.lit(False))
    prefix = F.when(has_system, F.concat(F.coalesce(_first_text(first, legacy), F.lit("")), F.lit("\n\n"))).otherwise(F.lit(""))
    turns = F.when(has_system, F.slice(messages, F.lit(2), F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)

    def turn(m: Column, i: Column) -> Column:
        role = F.when(m["role"] == "assistant", F.lit("model")).otherwise(m["role"])
        lead = F.when(i == 0, prefix).otherwise(F.lit(""))
        return F.concat(
            F.lit(TURN_START), role, F.lit("\n"), lead, _content_text(m, legacy), F.lit(TURN_END + "\n")
        )

    text = F.array_join(F.transform(turns, turn), "")
    return F.concat(
        F.lit(BOS if bos else ""), text, F.lit(f"{TURN_START}model\n" if add_generation_prompt else "")
    )


def render_chat(df: DataFrame, add_generation_prompt: bool = False, out: str = "text") -> DataFrame:
    """Adds the training text of ``messages`` or ``conversations``, without the leading ``<bos>``."""
    column = "messages" if "messages" in df.columns else "conversations"
    if column not in df.columns:
        raise ValueError("a messages or conversations column is required")
    return df.withColumn(out, chat_text(F.col(column), df.schema[column].dataType, add_generation_prompt))


def require_messages(df: DataFrame) -> DataFrame:
    """The same rows; a missing column, or a row without messages, is an error."""
    if "messages" not in df.columns:
        raise ValueError("dataset is missing 'messages'")
    missing = F.raise_error(F.lit("a row is missing 'messages'")).cast(df.schema["messages"].dataType)
    return df.withColumn("messages", F.when(F.size("messages") > 0, F.col("messages")).otherwise(missing))


def mask_labels(ids: Column, ignore_ids: Sequence[int]) -> Column:
    """Labels for all tokens except padding, image-start and image tokens."""
    ignored = [int(i) for i in dict.fromkeys([*ignore_ids, IMAGE_SOFT_TOKEN])]
    return F.transform(ids, lambda x: F.when(x.isin(ignored), F.lit(IGNORE)).otherwise(x).cast("int"))


def _marker_starts(ids: Column, marker: Sequence[int]) -> Column:
    """0-based positions at which the marker starts."""
    last = F.size(ids) - len(marker)

    def starts(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(ids, i + j) == int(t) for j, t in enumerate(marker)])

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), starts)).otherwise(F.array().cast("array<int>"))


def mask_non_response(ids: Column, instruction: Sequence[int], response: Sequence[int]) -> Column:
    """Labels only inside answers: after a response marker and up to the next instruction marker. The markers
    cut the tokens into runs, and each run is kept or masked as a whole."""

    def event(at: Column, opens: bool) -> Column:
        return F.struct(at.alias("at"), F.lit(0 if opens else 1).alias("closes"))

    def labels(ids: Column) -> Column:
        opened = F.transform(_marker_starts(ids, response), lambda i: event(i + len(response), True))
        closed = F.transform(_marker_starts(ids, instruction), lambda i: event(i, False))
        start = F.array(event(F.lit(0), False))
        return let(F.sort_array(F.concat(start, opened, closed)), lambda events: _runs(ids, events))

    def _runs(ids: Column, events: Column) -> Column:
        def run(e: Column, k: Column) -> Column:
            end = F.coalesce(F.get(events, k + 1)["at"], F.size(ids))
            kept = F.transform(F.sequence(e["at"], end - 1), lambda i: F.get(ids, i))
            masked = F.array_repeat(F.lit(IGNORE), end - e["at"])
            return F.when((e["closes"] == 0) & (end > e["at"]), kept).otherwise(masked)

        return F.flatten(F.transform(events, run))

    return let(ids.cast("array<int>"), labels)


def argmax_tokens(logits: Column) -> Column:
    """0-based position of the first largest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def _row_counts(predictions: Column, labels: Column) -> tuple[Column, Column]:
    """Correct and counted tokens of a row; ignored labels do not count."""
    pairs = F.arrays_zip(predictions.alias("p"), labels.alias("l"))
    counted = F.aggregate(labels, F.lit(0).cast("bigint"), lambda n, x: n + F.when(x != IGNORE, 1).otherwise(0))
    correct = F.aggregate(
        pairs,
        F.lit(0).cast("bigint"),
        lambda n, x: n + F.when((x["l"] != IGNORE) & (x["p"] == x["l"]), 1).otherwise(0),
    )
    return correct, counted


def perplexity(loss: Column) -> Column:
    """2 ** loss, and 1 for a loss that is not positive."""
    return F.when(loss > 0, F.pow(F.lit(2.0), loss)).otherwise(F.lit(1.0))


def token_accuracy(df: DataFrame, predictions: str = "predictions", labels: str = "labels") -> DataFrame:
    """One row: share of counted tokens predicted right, 0 when none counts."""
    correct, counted = _row_counts(F.col(predictions), F.col(labels))
    sums = df.select(correct.alias("c"), counted.alias("n")).agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    return sums.select(F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(F.lit(0.0)).alias("accuracy"))


def batched_token_metrics(
    df: DataFrame, batch: str = "batch_id", predictions: str = "predictions", labels: str = "labels", loss: str = "loss"
) -> DataFrame:
    """One row over all batches: accuracy over tokens, mean of the batch losses (a batch's loss is repeated on
    its rows or given once), and the perplexity of that mean. Rows of a batch are combined before they move."""
    correct, counted = _row_counts(F.col(predictions), F.col(labels))
    per_batch = (
        df.select(F.col(batch), correct.alias("c"), counted.alias("n"), F.col(loss).alias("loss"))
        .groupBy(batch)
        .agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.max("loss").alias("loss"))
    )
    total = per_batch.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.avg("loss").alias("loss"))
    return total.select(
        F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(F.lit(0.0)).alias("accuracy"),
        F.when(F.col("loss").isNotNull(), F.pow(F.lit(2.0), F.col("loss"))).otherwise(F.lit(1.0)).alias("perplexity"),
        F.coalesce("loss", F.lit(0.0)).alias("loss"),
    )
