"""Trainer-side preparation. Token ids are derived from the words of the texts; embeddings stand in for logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import training
from workload.tables import conversation_rows, documents, long_turns, table


def _ids(text):
    words = F.split(text, " ")
    return F.transform(
        words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(1000)).cast("int")
    )


def _tokens(spark, sf):
    return documents(spark, sf, "doc_id", "n_chars", "text").select("doc_id", "n_chars", _ids(F.col("text")).alias("ids"))


def _flat(df, column, *ids):
    # the outer form: from the plain one the planner derives a test that computes the column a second time, in the scan
    flat = df.select(*ids, F.posexplode_outer(column).alias("i", column)).filter(F.col("i").isNotNull())
    return flat.withColumn("i", F.col("i").cast("bigint"))


def chat_render(spark, sf):
    return training.render_chat(conversation_rows(spark, sf)).select("conv_id", "text")


def chat_render_long(spark, sf):
    """Conversations of hundreds of turns, each as one text."""
    return training.render_chat(conversation_rows(spark, sf, long_turns(spark, sf))).select("conv_id", "text")


def chat_render_prompt(spark, sf):
    return training.render_chat(conversation_rows(spark, sf), add_generation_prompt=True).select("conv_id", "text")


def standardize(spark, sf):
    """Turns as ``from``/``value`` pairs with foreign role names, brought to the standard layout."""
    turns = table(spark, sf, "conversations")
    source = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    shared = turns.select(
        "conv_id", "turn", F.array(F.struct(source.alias("from"), F.col("text").alias("value"))).alias("conversations")
    )
    done = training.standardize_conversations(shared)
    return done.select("conv_id", "turn", F.explode("messages").alias("m")).select("conv_id", "turn", "m.role", "m.content")


def mask_labels(spark, sf):
    tokens = _tokens(spark, sf).withColumn("label", training.mask_labels(F.col("ids"), [0, 7, 500]))
    return _flat(tokens, "label", "doc_id")


def mask_non_response(spark, sf):
    """Ids below 60 open an answer and ids from 60 to 119 close it, brought down to one marker id each."""
    folded = F.transform("ids", lambda x: F.when(x < 60, 0).when(x < 120, 1).otherwise(x).cast("int"))
    tokens = _tokens(spark, sf).withColumn("label", training.mask_non_response(folded, [1], [0]))
    return _flat(tokens, "label", "doc_id")


def _predicted(spark, sf):
    tokens = _tokens(spark, sf)
    return tokens.select(
        "doc_id",
        F.pmod("doc_id", F.lit(32)).alias("batch_id"),
        F.transform("ids", lambda x: F.when(x % 7 == 0, x + 1).otherwise(x)).alias("predictions"),
        training.mask_labels(F.transform("ids", lambda x: F.when(x % 10 == 0, 0).otherwise(x)), [0]).alias("labels"),
        (F.pmod("doc_id", F.lit(32)) / 8).alias("loss"),
        (F.col("n_chars") / 10000).alias("row_loss"),
    )


def token_accuracy(spark, sf):
    return training.token_accuracy(_predicted(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


def perplexity(spark, sf):
    rows = _predicted(spark, sf)
    return rows.select("doc_id", F.round(training.perplexity(F.col("row_loss")), 6).alias("perplexity"))


def batched_token_metrics(spark, sf):
    done = training.batched_token_metrics(_predicted(spark, sf))
    return done.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "perplexity", "loss")])


def argmax(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", training.argmax_tokens(F.col("embedding")).alias("token"))


QUERIES = {
    "chat_render": chat_render,
    "chat_render_prompt": chat_render_prompt,
    "chat_render_long": chat_render_long,
    "standardize": standardize,
    "mask_labels": mask_labels,
    "mask_non_response": mask_non_response,
    "token_accuracy": token_accuracy,
    "perplexity": perplexity,
    "batched_token_metrics": batched_token_metrics,
    "argmax": argmax,
}

_RENDER = f"""
WITH c AS (SELECT conv_id, turn, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
s AS (SELECT conv_id, text || chr(10) || chr(10) AS prefix FROM c WHERE pos = 1 AND role = 'system'),
m AS (SELECT c.*, s.prefix, (prefix IS NULL AND pos = 1) OR (prefix IS NOT NULL AND pos = 2) AS leads
      FROM c LEFT JOIN s USING (conv_id) WHERE NOT (pos = 1 AND role = 'system')),
r AS (SELECT conv_id, string_agg('<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10) ||
        CASE WHEN leads THEN coalesce(prefix, '') ELSE '' END || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || '<end_of_turn>' || chr(10), '' ORDER BY pos) AS body
      FROM m GROUP BY 1)
SELECT conv_id, body{{suffix}} AS text FROM r"""

_IDS = """
t AS (SELECT doc_id, n_chars, list_transform(string_split(text, ' '), lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 1000)::INTEGER) AS ids
      FROM documents)"""

_FLAT = f"""
WITH {_IDS}, f AS (SELECT doc_id, n_chars, generate_subscripts(ids, 1) - 1 AS i, unnest(ids) AS x FROM t)"""

_COUNTS = f"""{_FLAT},
b AS (SELECT doc_id % 32 AS batch_id, count(*) FILTER (x % 10 <> 0) AS n,
             count(*) FILTER (x % 10 <> 0 AND x % 7 <> 0) AS c FROM f GROUP BY 1)"""

ORACLES = {
    "chat_render": _RENDER.format(suffix=""),
    "chat_render_long": "WITH longs AS (SELECT conv_id % 10 AS conv_id, conv_id // 10 * 1000 + turn AS turn, role, text"
    " FROM conversations), " + _RENDER.format(suffix="").replace("FROM conversations", "FROM longs").lstrip().removeprefix("WITH"),
    "chat_render_prompt": _RENDER.format(suffix=" || '<start_of_turn>model' || chr(10)"),
    "standardize": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "mask_labels": f"{_FLAT} SELECT doc_id, i, CASE WHEN x IN (0, 7, 500, 262144) THEN -100 ELSE x END AS label FROM f",
    "mask_non_response": f"""{_FLAT},
        g AS (SELECT doc_id, i, CASE WHEN x < 60 THEN 0 WHEN x < 120 THEN 1 ELSE x END AS x FROM f),
        w AS (SELECT doc_id, i, x, max(CASE WHEN x = 0 THEN i + 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
                max(CASE WHEN x = 1 THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS closed FROM g)
        SELECT doc_id, i, CASE WHEN opened IS NOT NULL AND (closed IS NULL OR closed < opened) THEN x ELSE -100 END AS label FROM w""",
    "token_accuracy": f"{_COUNTS} SELECT round(sum(c)::DOUBLE / sum(n), 6) AS accuracy FROM b",
    "perplexity": "SELECT doc_id, round(CASE WHEN n_chars > 0 THEN pow(2.0::DOUBLE, n_chars / 10000) ELSE 1 END, 6) AS perplexity FROM documents",
    "batched_token_metrics": f"""{_COUNTS}
        SELECT round(sum(c)::DOUBLE / sum(n), 6) AS accuracy, round(pow(2.0::DOUBLE, avg(batch_id / 8)), 6) AS perplexity,
               round(avg(batch_id / 8), 6) AS loss FROM b""",
    "argmax": "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS token FROM embeddings",
}
