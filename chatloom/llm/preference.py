"""Preference formatting: two conversations that share their first turns become one prompt and two masked completions.

The longest common prefix of turns is rendered once; what follows is rendered for either side as segments, of
which only an assistant's words (and its end mark) are trained on. All in one row per pair, without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|start|>", "<|message|>", "<|end|>\n"
TRAINED = "assistant"


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role,text>> from (conv_id, turn, role, text) rows, by turn, then role and text. Null
    roles and texts are empty; a null turn comes first; repeated rows stay. Rows without conv_id belong to no
    conversation. An example is one row, so a conversation must fit in one."""
    clean = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select(
        "conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def shortened(turns: Column) -> Column:
    """The turns with the last answer cut to the first half of its words (one at least): a worse answer to the same turns."""
    last = F.size(turns) - F.array_position(F.transform(F.reverse(turns), lambda t: t["role"]), TRAINED)
    words = lambda t: F.split(t["text"], " ")
    half = lambda t: F.array_join(F.slice(words(t), 1, F.greatest(F.lit(1), F.floor(F.size(words(t)) / 2).cast("int"))), " ")
    return F.transform(
        turns,
        lambda t, i: F.when(i == last, F.struct(t["role"].alias("role"), half(t).alias("text"))).otherwise(t),
    )


def common_turns(chosen: Column, rejected: Column) -> Column:
    """The number of equal first turns; the last turn of either side never counts, so that both keep a completion."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    differ = F.array_position(same, F.lit(False))
    shortest = F.least(F.size(chosen), F.size(rejected))
    return F.greatest(F.lit(0), F.least(F.when(differ > 0, differ - 1).otherwise(shortest), shortest - 1)).cast("int")


def _opening(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    """Turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), t["text"], F.lit(END))), "")


def segments(turns: Column) -> Column:
    """Turns as array<struct<text, trained>>; the texts joined are the rendered turns."""
    piece = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                piece(_opening(t), F.lit(False)), piece(F.concat(t["text"], F.lit(END)), t["role"] == TRAINED)
            ),
        )
    )


def format_preferences(pairs: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """One row per pair: key, n_prompt_turns, prompt, chosen and rejected (segments), identical.

    Both sides are array<struct<role,text>>; a null one is empty. Null roles and texts are empty texts. Where one
    side is the start of the other, or both are equal (``identical``), the prompt stops before the last turn of the
    shorter. Two empty sides give an empty prompt and no segments. Ties and repeated rows are formatted each by itself,
    a null key stays null, other columns are left out, and an empty table gives no rows."""
    blank = F.lit("")
    clean = lambda c: F.transform(
        F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")),
        lambda t: F.struct(F.coalesce(t["role"], blank).alias("role"), F.coalesce(t["text"], blank).alias("text")),
    )
    rows = pairs.select(F.col(key).alias("_key"), clean(chosen).alias("_c"), clean(rejected).alias("_r"))
    rows = rows.withColumn("_n", common_turns(F.col("_c"), F.col("_r")))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.lit(0), F.size(c) - F.col("_n")))
    return rows.select(
        F.col("_key").alias(key),
        F.col("_n").cast("long").alias("n_prompt_turns"),
        render(F.slice(F.col("_c"), 1, F.col("_n"))).alias("prompt"),
        segments(rest(F.col("_c"))).alias("chosen"),
        segments(rest(F.col("_r"))).alias("rejected"),
        (F.col("_c") == F.col("_r")).alias("identical"),
    )
