"""Registered queries of this subpackage, and the SQL each must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import (
    embedding_dedup,
    exact_dedup,
    language,
    merkle,
    mixing,
    near_dedup,
    oracles,
    ordinal,
    packing,
    preference,
    quality_cascade,
    spelling,
    suffix_dedup,
    token_counts,
)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_docs(spark, sf).select("doc_id", "text"))


def op2_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation against itself with a shortened last answer; texts by digest, masks by trained characters."""
    chats = preference.assemble(spark.read.parquet(f"{sf}/conversations.parquet"))
    pairs = chats.select("conv_id", F.col("turns").alias("chosen"), preference.shortened(F.col("turns")).alias("rejected"))
    out = preference.format_preferences(pairs, "conv_id")

    def text(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: s["text"]), "")

    def trained(c: str) -> Column:
        return F.length(F.array_join(F.transform(F.filter(c, lambda s: s["trained"]), lambda s: s["text"]), "")).cast("long")

    return out.select(
        "conv_id",
        "n_prompt_turns",
        "identical",
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2(text("chosen"), 256).alias("chosen_sha256"),
        F.sha2(text("rejected"), 256).alias("rejected_sha256"),
        trained("chosen").alias("chosen_trained"),
        trained("rejected").alias("rejected_trained"),
    )


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "text")
    return ordinal.score(docs, ordinal.fit(docs, corpus_pipeline.ratings(spark, sf)))


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_docs(spark, sf).select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_dedup(_docs(spark, sf).select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf).select("doc_id", "text", "source"))


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "text", "lang")
    return language.predict(docs.drop("lang"), language.fit(docs))


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_docs(spark, sf).select("doc_id", "text"), path, keep_ids=False).drop("ids")


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(_docs(spark, sf).select("doc_id", "text"), path)


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_cascade.cascade(_docs(spark, sf).select("doc_id", "text"))


def op11_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_dedup.near_vectors(vectors)


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audit(merkle.manifest(_docs(spark, sf).select("doc_id", "source", "lang", "n_chars", "text")))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf).select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_chat_formatting,
        op3_quality_classifier,
        op4_exact_dedup,
        op5_minhash_near_dedup,
        op6_mixing,
        op7_language_id,
        op8_packing,
        op9_token_counts,
        op10_quality_rules,
        op11_embedding_near_dedup,
        op12_merkle_manifest,
        op13_spelling_variants,
    )
} | {"pipeline": corpus_pipeline.run}

_LEAST = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"

ORACLES = {
    "op1_suffix_array_dedup": """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
r AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 50], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)),
m AS (
  SELECT doc_id, i, count(*) OVER g > 1 AS again, row_number() OVER (g ORDER BY doc_id, i) > 1 AS later
  FROM r WINDOW g AS (PARTITION BY run)),
c AS (
  SELECT doc_id, p, bool_or(later) AS later
  FROM (SELECT doc_id, later, unnest(range(i, i + 50)) AS p FROM m WHERE again) GROUP BY doc_id, p),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM c)
SELECT doc_id, min(p) AS start, count(*) AS n_words, count(*) FILTER (later) AS n_later FROM g GROUP BY doc_id, island""",
    "op2_chat_formatting": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT *, max(i) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS answer FROM t),
r AS (
  SELECT *, CASE WHEN i = answer
    THEN array_to_string(string_split(text, ' ')[1:greatest(1, len(string_split(text, ' ')) // 2)], ' ') ELSE text END AS other
  FROM l),
n AS (
  SELECT conv_id, least(coalesce(min(i) FILTER (other <> text) - 1, count(*)), count(*) - 1) AS n,
    count(*) FILTER (other <> text) = 0 AS identical FROM r GROUP BY conv_id),
p AS (
  SELECT r.*, n.n, n.identical, '<|start|>' || role || '<|message|>' || text || '<|end|>' || chr(10) AS x,
    '<|start|>' || role || '<|message|>' || other || '<|end|>' || chr(10) AS y FROM r JOIN n USING (conv_id))
SELECT conv_id, n AS n_prompt_turns, identical,
  sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (i <= n), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (i > n), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(y, '' ORDER BY i) FILTER (i > n), '')) AS rejected_sha256,
  coalesce(sum(length(text) + 8) FILTER (i > n AND role = 'assistant'), 0)::BIGINT AS chosen_trained,
  coalesce(sum(length(other) + 8) FILTER (i > n AND role = 'assistant'), 0)::BIGINT AS rejected_trained
FROM p GROUP BY conv_id, n, identical""",
    "op6_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
    greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::BIGINT AS tokens
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT source, sum(tokens)::BIGINT AS size FROM d GROUP BY source),
v AS (SELECT list(size / total) AS p, any_value(total) AS total, count(*) AS k
  FROM (SELECT size, sum(size) OVER () AS total FROM s)),
even AS (
  SELECT 0 AS step, 0 AS lo, 1048576 AS hi FROM v UNION ALL
  SELECT step + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid - 1 END FROM (
    SELECT e.*, (lo + hi + 1) // 2 AS mid, ((lo + hi + 1) // 2) / 1048576.0::DOUBLE AS a,
      ln(list_sum(list_transform(p, lambda x: pow(x, a)))) - list_sum(list_transform(p, lambda x: pow(x, a) * a * ln(x)))
        / list_sum(list_transform(p, lambda x: pow(x, a))) >= {mixing.ENTROPY} * ln(k) - (CASE WHEN mid = 1048576 THEN 1e-9 ELSE 0 END) AS good
    FROM even e, v WHERE lo < hi)),
a1 AS (SELECT lo / 1048576.0::DOUBLE AS a FROM even ORDER BY step DESC LIMIT 1),
often AS (
  SELECT 0 AS step, -1 AS lo, 1048576 AS hi FROM v UNION ALL
  SELECT step + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid - 1 END FROM (
    SELECT o.*, (lo + hi + 1) // 2 AS mid, a1.a + (1 - a1.a) * (((lo + hi + 1) // 2) / 1048576.0::DOUBLE) AS t,
      list_max(list_transform(p, lambda x: pow(x, t - 1))) / list_sum(list_transform(p, lambda x: pow(x, t))) > {mixing.REPEATS} AS over
    FROM often o, v, a1 WHERE lo < hi)),
alpha AS (
  SELECT least(1.0, CASE WHEN lo < 0 THEN a1.a ELSE a1.a + (1 - a1.a) * ((lo + 1) / 1048576.0::DOUBLE) END) AS a
  FROM often, a1 ORDER BY step DESC LIMIT 1),
q AS (
  SELECT source, size, greatest(1, round(pow(size / total, a) / sum(pow(size / total, a)) OVER () * total))::BIGINT AS quota
  FROM s, v, alpha),
c AS (
  SELECT d.doc_id, d.source, d.tokens, q.size, q.quota, e AS epoch, md5(e || '-' || d.doc_id) AS draw
  FROM d JOIN q USING (source), unnest(range(1, ceil(q.quota / q.size)::BIGINT + 1)) AS u(e)),
o AS (
  SELECT *, (epoch - 1) * size + coalesce(sum(tokens) OVER (
    PARTITION BY source, epoch ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
b AS (
  SELECT o.*, (start * greatest(1, ceil(v.total / {mixing.BLOCK_TOKENS}.0))::BIGINT // quota)::BIGINT AS block
  FROM o, v WHERE start < quota)
SELECT doc_id, source, tokens, epoch::BIGINT AS epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY md5('block-' || draw), doc_id) AS slot FROM b""",
    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LEAST}) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op5_minhash_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[i:i + 4], ' ') END AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM w UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c
  ON c.id = w.doc_id""",
    "op10_quality_rules": """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g)
    WHERE c > 1) GROUP BY doc_id),
l AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, t, words, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 25 * n_words AND NOT 10 * n_symbols > 3 * n_words
  AND NOT 100 * (length(t) - length(replace(t, '!!', ''))) / 2 > 30 * n_words
  AND NOT 100 * n_dup_lines > 50 * (length(t) - length(replace(t, chr(10), '')) + 1)
  AND NOT 100 * len(list_filter(words, lambda x: regexp_matches(x, '\\p{L}'))) < 60 * n_words
  AND NOT (length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) > 20
    AND 2 * length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) > word_chars)
  AND NOT 100 * len(list_filter(list_zip(words[:-2], words[2:]), lambda x: x[1] = x[2])) > 30 * n_words AS kept
FROM f""",
    "op11_embedding_near_dedup": oracles.EMBEDDINGS,
    "op12_merkle_manifest": oracles.MERKLE,
    "op13_spelling_variants": oracles.SPELLING,
}
