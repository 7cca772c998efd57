"""From chat examples to (prediction, reference) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions import images
from chatloom.functions import messages as M
from chatloom.functions.columns import settle
from chatloom.functions.text import strip
from chatloom.operators.generation import Loader, ask
from chatloom.operators.training import chat_text


def prepare_eval(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``input``: the user and system messages before the first assistant message; ``reference``: that message's
    text, empty when there is none. Rows without input are dropped; count before and after to report both."""
    legacy = M.is_legacy(df.schema["messages"].dataType)
    first = F.array_position(F.transform("messages", lambda m: m["role"]), "assistant")
    before = F.when(first > 0, F.slice("messages", F.lit(1), (first - 1).cast("int"))).otherwise(F.col("messages"))
    asked = F.filter(before, lambda m: m["role"].isin("user", "system"))
    answer = F.transform(
        F.filter(F.array(F.get("messages", (first - 1).cast("int"))), lambda m: m["role"].isNotNull()),
        lambda m: strip(M.message_text(m, legacy)),
    )
    reference = F.coalesce(F.get(answer, F.lit(0)), F.lit(""))
    pair = F.struct(asked.alias("input"), reference.alias("reference"))
    return df.select(
        *keep, F.explode(F.filter(F.array(pair), lambda p: F.size(p["input"]) > 0)).alias("_pair")
    ).select(*keep, "_pair.input", "_pair.reference")


def has_image(messages: Column) -> Column:
    return F.exists(
        messages, lambda m: F.exists(F.coalesce(m["content"], F.array()), lambda p: p["type"] == "image")
    )


def infer_modality(df: DataFrame, column: str = "messages") -> DataFrame:
    """One row: vision when any message of any row has an image part, else text."""
    if M.is_legacy(df.schema[column].dataType):
        seen = F.lit(False)
    else:
        seen = F.coalesce(F.bool_or(has_image(F.col(column))), F.lit(False))
    return df.agg(F.when(seen, F.lit("vision")).otherwise(F.lit("text")).alias("modality"))


def extract_images(df: DataFrame, column: str = "messages", out: str = "images", required: bool = True) -> DataFrame:
    """Adds the image payloads of a conversation in order. Text payloads lose a data-URL header and get missing
    base64 padding. A conversation without images is an error unless ``required`` is off."""
    part = df.schema[column].dataType.elementType["content"].dataType.elementType
    as_text = "image" in part.names and isinstance(part["image"].dataType, T.StringType)

    def payload(p: Column) -> Column:
        if as_text:
            body = F.when(p["image"].contains(","), F.split_part(p["image"], F.lit(","), F.lit(2))).otherwise(p["image"])
            return images.decode_base64(body, pad=True)
        return p["image"]["bytes"]

    found = F.filter(
        F.flatten(F.transform(column, lambda m: F.transform(F.filter(m["content"], lambda p: p["type"] == "image"), payload))),
        lambda b: b.isNotNull(),
    )
    if required:
        missing = F.raise_error(F.lit("no image in a vision conversation")).cast("array<binary>")
        found = F.when(F.size(found) > 0, found).otherwise(missing)
    return df.withColumn(out, found)


def batch_generate(
    df: DataFrame, load: Loader, *, column: str = "input", out: str = "prediction", batch_size: int = 16, images_col: str | None = None
) -> DataFrame:
    """Adds the model's stripped answer to every conversation and ``<out>_error``. The model gets the rendered
    prompts, and for vision the list of payloads as a second Series."""
    prompt = chat_text(F.col(column), df.schema[column].dataType, add_generation_prompt=True)
    inputs = ("_prompt",) if images_col is None else ("_prompt", images_col)
    asked = settle(df, "_prompt", prompt).withColumn("_answer", ask(load, *map(F.col, inputs), batch_size=batch_size))
    answered = asked.withColumns({out: strip(F.col("_answer.text")), f"{out}_error": F.col("_answer.error")})
    return answered.drop("_answer", "_prompt")


def unaligned(predictions: DataFrame, references: DataFrame, key: str = "sample_index") -> DataFrame:
    """Keys found on one side only."""
    p = predictions.select(key, F.lit(True).alias("_p"))
    r = references.select(key, F.lit(True).alias("_r"))
    both = p.join(r, key, "full_outer").filter(F.col("_p").isNull() | F.col("_r").isNull())
    return both.select(key, F.when(F.col("_p").isNull(), F.lit("prediction")).otherwise(F.lit("reference")).alias("missing"))


def align(predictions: DataFrame, references: DataFrame, key: str = "sample_index", check: bool = True) -> DataFrame:
    """Pairs by key. Unequal sides are an error, found by a join of the keys alone."""
    if check and not unaligned(predictions, references, key).isEmpty():
        raise ValueError("predictions and references do not have the same keys")
    return predictions.join(references, key)
