"""Lexical augmentation over whole texts. The lexicon is derived from the benchmark items: a word's synonyms are made
from itself and from the next word, in order, that has the same first three letters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatloom.functions.text import clean_chars, words
from chatloom.operators import lexical
from chatloom.plans.materialize import materialize
from workload.tables import documents, table
from workload.tables import turns as all_turns

SEED = 42
STOP_SQL = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)


def _raw_lexicon(spark, sf):
    """Words of the benchmark items, each with two synonyms; spelled with a leading capital and an underscore to be cleaned."""
    w = (
        table(spark, sf, "benchmark")
        .select(F.explode(F.array_distinct(words(clean_chars(F.col("text"))))).alias("w"))
        .filter(F.length("w") >= 4)
        .distinct()
    )
    follows = F.lead("w").over(Window.partitionBy(F.substring("w", 1, 3)).orderBy("w"))

    def spelled(c):
        return F.concat(F.initcap(c), F.lit("_"), F.substring(c, 1, 2))

    both = w.withColumn("next", follows)
    return both.select(F.col("w").alias("word"), F.array_compact(F.array(spelled("w"), spelled("next"))).alias("synonyms"))


def lexicon(spark, sf):
    """The lexicon as a stored table, as users have it."""
    return materialize(lexical.normalize_lexicon(_raw_lexicon(spark, sf)))


def synonyms(spark, sf):
    return lexical.normalize_lexicon(_raw_lexicon(spark, sf)).select("word", F.explode("synonyms").alias("synonym"))


def clean(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return lexical.clean_column(docs, "text").select("doc_id", "clean")


def _turn_words(spark, sf):
    turns = all_turns(spark, sf)
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_key"), words(clean_chars(F.col("text"))).alias("words")
    )


def random_delete(spark, sf):
    docs = documents(spark, sf, "doc_id", "text").select("doc_id", words(clean_chars(F.col("text"))).alias("words"))
    kept = lexical.random_delete(F.col("words"), 0.1, SEED, F.col("doc_id"))
    return docs.select("doc_id", F.array_join(kept, " ").alias("text"))


def synonym_replace(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    done = lexical.replace_synonyms(docs, "text", "doc_id", lexicon(spark, sf), 0.1, SEED)
    return done.select("doc_id", F.col("replaced").alias("text"))


def synonym_replace_by_join(spark, sf):
    """As for a lexicon too large for one task: its words are told by a filter first."""
    docs = documents(spark, sf, "doc_id", "text")
    done = lexical.replace_synonyms(docs, "text", "doc_id", lexicon(spark, sf), 0.1, SEED, by_join=True)
    return done.select("doc_id", F.col("replaced").alias("text"))


def random_swap(spark, sf):
    turns = _turn_words(spark, sf)
    n = lexical.edits(F.size("words"), 0.1)
    swapped = lexical.random_swap(F.col("words"), n, SEED, F.col("turn_key"))
    return turns.select("turn_key", F.array_join(swapped, " ").alias("text"))


def random_insert(spark, sf):
    turns = _turn_words(spark, sf)
    known = lexical.with_synonyms(turns, "turn_key", "words", lexicon(spark, sf))
    n = lexical.edits(F.size("words"), 0.1)
    longer = lexical.random_insert(F.col("words"), F.col("known"), n, SEED, F.col("turn_key"))
    return known.select("turn_key", F.array_join(longer, " ").alias("text"))


def eda_candidates(spark, sf):
    """Nine augmented versions of every turn."""
    turns = all_turns(spark, sf)
    return lexical.eda_explode(turns, "text", ["conv_id", "turn"], lexicon(spark, sf)).select(
        "conv_id", "turn", "candidate", "op", "augmented"
    )


def eda_counts(spark, sf):
    """How many versions each operation gave."""
    docs = documents(spark, sf, "doc_id", "text")
    return (
        lexical.eda_explode(docs, "text", "doc_id", lexicon(spark, sf), num_aug=3)
        .groupBy("op")
        .agg(F.count(F.lit(1)).alias("versions"))
    )


def eda_one(spark, sf):
    turns = all_turns(spark, sf)
    done = lexical.eda_one(turns, "text", ["conv_id", "turn"], lexicon(spark, sf))
    return done.select("conv_id", "turn", "augmented")


def eda_documents(spark, sf):
    """One augmented version of every document, whatever its length."""
    docs = documents(spark, sf, "doc_id", "text")
    return lexical.eda_one(docs, "text", "doc_id", lexicon(spark, sf)).select("doc_id", "augmented")


QUERIES = {
    "clean_chars": clean,
    "synonyms": synonyms,
    "synonym_replace": synonym_replace,
    "synonym_replace_by_join": synonym_replace_by_join,
    "random_insert": random_insert,
    "random_swap": random_swap,
    "random_delete": random_delete,
    "eda_candidates": eda_candidates,
    "eda_counts": eda_counts,
    "eda_one": eda_one,
    "eda_documents": eda_documents,
}


def _clean(c: str) -> str:
    letters = f"regexp_replace(lower(regexp_replace({c}, '[’'']', '', 'g')), '[^a-z ]', ' ', 'g')"
    return f"regexp_replace(regexp_replace({letters}, ' +', ' ', 'g'), '^ ', '')"


def _words(c: str) -> str:
    return f"list_filter(string_split({_clean(c)}, ' '), lambda w: w <> '')"


def _u32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


_LEXICON = f"""
w AS (SELECT DISTINCT w FROM (SELECT unnest({_words('text')}) AS w FROM benchmark) WHERE length(w) >= 4),
lex AS (SELECT w AS word, list_sort(list_distinct(list_filter([w || ' ' || w[1:2], n || ' ' || n[1:2]], lambda x: x IS NOT NULL))) AS synonyms
        FROM (SELECT w, lead(w) OVER (PARTITION BY w[1:3] ORDER BY w) AS n FROM w))"""

_TURNS = f"""
turns AS (SELECT conv_id || '-' || turn AS turn_key, {_words('text')} AS words FROM conversations)"""

_EDITS = "greatest(1, floor(len(words) * 0.1::DOUBLE))::INTEGER"

# Recursive members over a table (turn_key, words): one step per swap or insertion.
_SWAPS = f"""
sw AS (SELECT turn_key, words, 0 AS step, {_EDITS} AS n FROM {{source}}
  UNION ALL
  SELECT turn_key, CASE WHEN j IS NULL THEN words ELSE list_transform(words, lambda w, p:
           CASE WHEN p = i + 1 THEN words[j + 1] WHEN p = j + 1 THEN words[i + 1] ELSE w END) END, step + 1, n
  FROM (SELECT *, list_filter([{_u32("'42:with:' || turn_key || ':' || step || ':0'")} % len(words),
            {_u32("'42:with:' || turn_key || ':' || step || ':1'")} % len(words),
            {_u32("'42:with:' || turn_key || ':' || step || ':2'")} % len(words)], lambda d: d <> i)[1] AS j
        FROM (SELECT *, {_u32("'42:swap:' || turn_key || ':' || step")} % len(words) AS i
              FROM sw WHERE step < n AND len(words) > 0)))"""

_INSERTS = f"""
own AS (SELECT turn_key, list(word) AS known, list(synonyms[1]) AS firsts
        FROM (SELECT DISTINCT turn_key, unnest(words) AS word FROM {{source}}) JOIN lex USING (word) GROUP BY turn_key),
ins AS (SELECT turn_key, words, 0 AS step, {_EDITS} AS n, coalesce(known, []) AS known, coalesce(firsts, []) AS firsts
      FROM {{source}} LEFT JOIN own USING (turn_key)
  UNION ALL
  SELECT turn_key, CASE WHEN hit IS NULL THEN words ELSE
           list_concat(list_concat(list_slice(words, 1, at_pos), [firsts[list_position(known, hit)]]), list_slice(words, at_pos + 1, len(words))) END,
         step + 1, n, known, firsts
  FROM (SELECT *, {_u32("'42:at:' || turn_key || ':' || step")} % len(words) AS at_pos,
          list_filter(list_transform(range(9), lambda t: words[{_u32("'42:insert:' || turn_key || ':' || step || ':' || t")} % len(words) + 1]),
            lambda w: list_contains(known, w))[1] AS hit
        FROM ins WHERE step < n AND len(words) > 0))"""


def _deletes(key: str) -> str:
    """The words kept of a list ``words``."""
    kept = f"list_filter(words, lambda w, i: {_u32(f"'42:delete:' || {key} || ':' || (i - 1)")} / 4294967296.0::DOUBLE > 0.1::DOUBLE)"
    return f"""CASE WHEN len(words) <= 1 THEN words WHEN len({kept}) > 0 THEN {kept}
        ELSE [words[{_u32(f"'42:keep:' || {key}")} % len(words) + 1]] END"""


def _replaces(source: str, key: str) -> str:
    """CTEs that end in ``merged(key, text)``: the texts of ``source`` with synonyms."""
    return f"""
distinct_words AS (SELECT DISTINCT {key}, unnest(words) AS word FROM {source}),
cand AS (SELECT {key}, word, synonyms[{_u32(f"'42:which:' || {key} || ':' || word")} % len(synonyms) + 1] AS synonym,
           row_number() OVER (PARTITION BY {key} ORDER BY md5('42:synonym:' || {key} || ':' || word)) AS r
         FROM distinct_words JOIN lex USING (word) WHERE word NOT IN ({STOP_SQL})),
chosen AS (SELECT {key}, word, synonym FROM cand JOIN {source} USING ({key}) WHERE r <= {_EDITS}),
placed AS (SELECT {key}, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM {source}),
merged AS (SELECT {key}, string_agg(coalesce(synonym, word), ' ' ORDER BY i) AS text
           FROM placed LEFT JOIN chosen USING ({key}, word) GROUP BY {key})"""


def augmented(table: str, ids: tuple[str, ...], num_aug: int) -> str:
    """CTEs ``t`` (texts), ``plans`` (chosen operations) and ``done`` (the edited texts)."""
    key, cols = " || ':' || ".join(ids), ", ".join(ids)
    return f"""
        WITH RECURSIVE {_LEXICON},
        t AS (SELECT {cols}, text AS original, {_words('text')} AS words FROM {table}),
        plans AS (SELECT {cols}, op, rep, {key} || ':' || rep AS turn_key, words, candidate FROM (
            SELECT *, (row_number() OVER (PARTITION BY {cols} ORDER BY md5('42:pick:' || {key} || ':' || op || ':' || rep)) - 1)::INTEGER AS candidate
            FROM t, (VALUES ('synonym'), ('insert'), ('swap'), ('delete')) o(op), range({num_aug // 4 + 1}) r(rep) WHERE len(words) > 0)
          WHERE candidate < {num_aug}),
        to_swap AS (SELECT turn_key, words FROM plans WHERE op = 'swap'),
        to_insert AS (SELECT turn_key, words FROM plans WHERE op = 'insert'),
        to_replace AS (SELECT turn_key, words FROM plans WHERE op = 'synonym'),
        {_SWAPS.format(source='to_swap')}, {_INSERTS.format(source='to_insert')}, {_replaces('to_replace', 'turn_key')},
        done AS (SELECT turn_key, 'swap' AS op, array_to_string(words, ' ') AS text FROM sw WHERE step = n
          UNION ALL SELECT turn_key, 'insert', array_to_string(words, ' ') FROM ins WHERE step = n
          UNION ALL SELECT turn_key, 'synonym', text FROM merged
          UNION ALL SELECT turn_key, 'delete', array_to_string({_deletes('turn_key')}, ' ') FROM plans WHERE op = 'delete')"""


ORACLES = {
    "clean_chars": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "synonyms": f"WITH {_LEXICON} SELECT word, unnest(synonyms) AS synonym FROM lex",
    "random_delete": f"""
        WITH t AS (SELECT doc_id, {_words('text')} AS words FROM documents)
        SELECT doc_id, array_to_string({_deletes('doc_id')}, ' ') AS text FROM t""",
    "synonym_replace": f"""
        WITH {_LEXICON}, t AS (SELECT doc_id, {_words('text')} AS words FROM documents), {_replaces('t', 'doc_id')}
        SELECT doc_id, coalesce(text, '') AS text FROM t LEFT JOIN merged USING (doc_id)""",
    "random_swap": f"""
        WITH RECURSIVE {_TURNS}, {_SWAPS.format(source='turns')}
        SELECT turn_key, array_to_string(words, ' ') AS text FROM sw WHERE step = n OR len(words) = 0""",
    "random_insert": f"""
        WITH RECURSIVE {_LEXICON}, {_TURNS}, {_INSERTS.format(source='turns')}
        SELECT turn_key, array_to_string(words, ' ') AS text FROM ins WHERE step = n OR len(words) = 0""",
    "eda_counts": f"""
        WITH t AS (SELECT doc_id FROM documents WHERE len({_words('text')}) > 0),
        ranked AS (SELECT doc_id, op, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42:pick:' || doc_id || ':' || op || ':0')) AS r
                   FROM t, (VALUES ('synonym'), ('insert'), ('swap'), ('delete')) o(op))
        SELECT op, count(*) AS versions FROM ranked WHERE r <= 3 GROUP BY op
        UNION ALL SELECT 'original', count(*) FROM t""",
    "eda_one": f"""{augmented('conversations', ('conv_id', 'turn'), 1)}
        SELECT conv_id, turn, coalesce(done.text, original) AS augmented
        FROM t LEFT JOIN plans USING (conv_id, turn) LEFT JOIN done USING (turn_key, op)""",
    "eda_documents": f"""{augmented('documents', ('doc_id',), 1)}
        SELECT doc_id, coalesce(done.text, original) AS augmented
        FROM t LEFT JOIN plans USING (doc_id) LEFT JOIN done USING (turn_key, op)""",
    "eda_candidates": f"""{augmented('conversations', ('conv_id', 'turn'), 9)}
        SELECT conv_id, turn, candidate, op, done.text AS augmented FROM plans JOIN done USING (turn_key, op)
        UNION ALL SELECT conv_id, turn, 9, 'original', array_to_string(words, ' ') FROM t WHERE len(words) > 0""",
}
ORACLES["synonym_replace_by_join"] = ORACLES["synonym_replace"]
