"""Mixing sources to target weights: temperature, bisection and budgeted block permutations, all in DataFrame functions.

A source with a share p of the tokens gets a weight proportional to p**alpha. Lowering alpha from 1 evens the sources
out: entropy and repetition of small sources both rise. alpha is the largest value at which the entropy target is met,
raised again as far as the repetition limit asks; both are found by sectioning [0, 1] into sixteenths, again
and again, with sums over the sources as the only thing that reaches the driver.

A source's quota of the token budget is realised by passes over its documents, each pass a permutation of its own. A
document's start in its source's stream is the sum of all tokens before it, from windows inside even hash buckets
plus the buckets' starts, so the largest source needs no large window. The stream is cut where the quota ends, and
into as many blocks as the budget has: a block holds every source at its weight, in one permutation of the block."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.llm.common import WORD, fresh, join_frequent
from chatloom.plans.materialize import materialize

ENTROPY = 0.95  # of the entropy of equal weights
REPEATS = 2.0  # passes over a source, at most
BLOCK_TOKENS = 1 << 18
_SECTIONS = 16
_ROUNDS = 5  # to 16**-5 of alpha
_BUCKET_DIGITS = 4  # of an md5 in hex: 65,536 even buckets in each pass of a source


def word_tokens(text: str = "text") -> Column:
    """The words of a text as its tokens, 1 at least, so that empty texts take part in permutations too."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD))).cast("long")


def _figures(sources: DataFrame, alphas: list[float], total: float, budget: float) -> dict[float, tuple[float, float]]:
    """Entropy and most repetition at each alpha: H = ln S - sum(p**a ln p**a) / S with S = sum(p**a)."""
    share = F.col("size") / F.lit(total)
    rows = sources.select("size", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("a"))
    power = F.pow(share, F.col("a"))
    sums = rows.groupBy("a").agg(
        F.sum(power).alias("s"),
        F.sum(power * F.col("a") * F.log(share)).alias("e"),
        F.max(F.pow(share, F.col("a") - 1)).alias("most"),
    )
    return {
        r["a"]: (math.log(r["s"]) - r["e"] / r["s"], r["most"] / r["s"] * budget / total) for r in sums.collect()
    }


def _last(sources: DataFrame, total: float, budget: float, low: float, holds) -> float:
    """The largest alpha in [low, 1] on the grid at which ``holds(entropy, repetition)``; low where it never does.
    ``holds`` must change once, from true to false, as alpha rises."""
    width = 1.0 - low
    for _ in range(_ROUNDS):
        width /= _SECTIONS
        grid = [low + i * width for i in range(1, _SECTIONS + 1)]
        found = _figures(sources, grid, total, budget)
        low = max([low, *(a for a in grid if holds(*found[a]))])
    return low


def exponent(sources: DataFrame, budget: float, entropy: float = ENTROPY, repeats: float | None = REPEATS) -> float:
    """alpha for (source, size) rows. 1 where the shares as they are meet the target."""
    head = sources.agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("k")).first()
    if not head["k"]:
        return 1.0
    total, target = float(head["t"]), entropy * math.log(head["k"])
    natural, evened = (_figures(sources, [a], total, budget)[a] for a in (1.0, 0.0))
    alpha = 1.0 if natural[0] >= target - 1e-9 else _last(sources, total, budget, 0.0, lambda h, _: h >= target)
    if repeats is None or _figures(sources, [alpha], total, budget)[alpha][1] <= repeats:
        return alpha
    # repetition falls as alpha rises: the smallest grid value within the limit, which alpha = 1 is if any is
    over = _last(sources, total, budget, alpha, lambda _, r: r > repeats)
    return min(1.0, over + (1.0 - alpha) / _SECTIONS**_ROUNDS)


def mix(
    docs: DataFrame,
    budget: int | None = None,
    entropy: float = ENTROPY,
    repeats: float | None = REPEATS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per realised copy of a document: doc_id, source, tokens, epoch (pass, from 1), block, slot (place in the
    block, from 1).

    ``budget`` is the number of tokens to realise, all of the documents' by default. A source's last document may pass
    the end of its quota. A null source counts as the empty one, null and empty texts as one token. Rows without doc_id
    take no part. Rows that repeat a doc_id are one document: the one with the most tokens, then the first source.
    An empty table gives no rows."""
    rows = docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(word_tokens().alias("tokens"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).alias("d"),
    )
    rows = rows.groupBy("doc_id").agg(
        F.max("d.tokens").alias("tokens"), F.min(F.struct(-F.col("d.tokens"), F.col("d.source").alias("source"))).alias("d")
    )
    rows = materialize(rows.select("doc_id", F.col("d.source").alias("source"), "tokens"))
    sources = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("docs")))
    total = sources.agg(F.sum("size")).first()[0] or 0
    budget = total if budget is None else budget
    alpha = exponent(sources, budget, entropy, repeats)
    powers = sources.withColumn("p", F.pow(F.col("size") / F.lit(float(max(1, total))), F.lit(alpha)))
    whole = powers.agg(F.sum("p")).first()[0] or 1.0
    quota = F.greatest(F.lit(1), F.round(F.col("p") / F.lit(whole) * F.lit(float(budget)))).cast("long")
    weights = powers.select("source", "size", "docs", quota.alias("quota"))

    passes = F.explode(F.sequence(F.lit(1), F.ceil(F.col("quota") / F.col("size")).cast("int")))
    copies = join_frequent(rows, weights, "source", "docs").withColumn("epoch", passes)
    copies = copies.withColumn("draw", F.md5(F.concat_ws("-", "epoch", "doc_id")))
    copies = materialize(copies.withColumn("bucket", F.substring("draw", 1, _BUCKET_DIGITS)))
    bucket = ["source", "epoch", "bucket"]
    held = copies.groupBy(*bucket).agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*bucket, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*bucket).orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, bucket)
    start = (F.col("epoch") - 1) * F.col("size") + F.col("before") + F.col("inside")
    placed = placed.withColumn("start", start).filter("start < quota")

    blocks = max(1, -(-int(budget) // block_tokens))
    block = F.expr(f"cast(start as decimal(19,0)) * cast({blocks} as decimal(18,0)) div cast(quota as decimal(19,0))")
    order = Window.partitionBy("block").orderBy(F.md5(F.concat_ws("-", F.lit("block"), "draw")), "doc_id")
    out = placed.select("doc_id", "source", "tokens", "epoch", block.cast("long").alias("block"), "draw")
    return out.withColumn("slot", F.row_number().over(order)).select(
        "doc_id", "source", "tokens", F.col("epoch").cast("long").alias("epoch"), "block", F.col("slot").cast("long").alias("slot")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The copies ``mix`` realises, with the columns of ``docs``; rows without doc_id stay as they are. Of rows that repeat a
    doc_id, the one that ``mix`` counts is copied: most tokens, then the first source, then by a hash of the text."""
    key, row, copy = fresh(docs, "key", "row", "copy")
    copies = mix(docs, **options).select(F.col("doc_id").alias(copy))
    first = F.struct(-word_tokens(), F.coalesce(F.col("source").cast("string"), F.lit("")), F.xxhash64(F.col("text").cast("string")))
    known = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(key))
    known = known.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), first).alias(row))
    out = known.join(copies, F.col(key) == F.col(copy)).select(*[F.col(row)[c].alias(c) for c in docs.columns])
    return out.unionByName(docs.filter("doc_id is null"))
