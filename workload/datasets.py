"""Written datasets, manifests, growth of datasets, and the whole preparation and evaluation jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.config import AugmentationConfig, EvaluationConfig, ManualSplit, NoSplit, PreprocessingConfig
from chatloom.operators import augment, catalog, sampling, synthesis
from chatloom.operators.commit_log import CommitLog
from chatloom.plans import evaluate as evaluation_plan
from chatloom.plans import preprocess
from chatloom.plans.materialize import scratch_path
from chatloom.sources import files
from chatloom.sources.processed import read_processed as read_back
from workload.evaluation import ORACLES as EVALUATION
from workload.lexical import augmented, lexicon
from workload.tables import PAIRS_SQL, conversation_rows, table

MAPPINGS = {
    "system_field": {"type": "template", "value": "Language: {lang}"},
    "user_field": {"type": "template", "value": "Continue the text from {source}."},
    "assistant_field": {"type": "column", "value": "text"},
}


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _by_language(spark, sf):
    """Documents as a table whose splits are the languages."""
    path = scratch_path(spark, "splits")
    _docs(spark, sf).select("doc_id", F.col("lang").alias("split")).write.partitionBy("split").parquet(path)
    return path


def read_named_splits(spark, sf):
    return files.read_named_splits(spark, _by_language(spark, sf), "en", "fr")


def read_single_split(spark, sf):
    return files.read_single_split(spark, _by_language(spark, sf), "de")


def split_summary(spark, sf):
    rows = _docs(spark, sf).withColumn("split", F.col("source"))
    done = catalog.dataset_summary(rows).select("num_examples", "modality", F.explode("splits").alias("s"))
    return done.select("num_examples", "modality", "s.split_name", "s.num_rows")


def preview(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "text", F.col("source").alias("split"))
    return catalog.preview(rows, "doc_id")


def profile(spark, sf):
    """Number of rows, column names and the sampled ids, as the profile says."""
    found = catalog.profile(_docs(spark, sf).orderBy("doc_id"))
    rows = [(found.num_examples, i, name, [r["doc_id"] for r in found.sample]) for i, name in enumerate(found.columns)]
    done = spark.createDataFrame(rows, "num_examples long, position int, name string, ids array<long>")
    return done.withColumn("ids", F.array_join("ids", ","))


def read_csv(spark, sf):
    """Documents written as CSV, with line breaks and quotes inside the texts."""
    path = scratch_path(spark, "csv") + ".csv"
    rows = _docs(spark, sf).select("doc_id", "source", "n_chars", "text")
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_any(spark, path, schema="doc_id long, source string, n_chars long, text string")


def read_text(spark, sf):
    path = scratch_path(spark, "text") + ".txt"
    table(spark, sf, "events").select("props").write.text(path)
    return files.read_any(spark, path)


def _event_json(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))


_EVENT = "event_id long, event_type string, value double"


def read_jsonl(spark, sf):
    """Files of lines, one of which is no JSON, the only one of its file."""
    path = scratch_path(spark, "lines") + ".jsonl"
    _event_json(spark, sf).select("value").write.text(path)
    spark.createDataFrame([("no json",)], "value string").write.mode("append").text(path)
    return files.read_any(spark, path, schema=_EVENT)


def read_json(spark, sf):
    """A folder with files of lines and files that are one array each."""
    path = scratch_path(spark, "mixed") + ".json"
    rows = _event_json(spark, sf)
    rows.filter("user_id % 2 = 0").select("value").write.text(f"{path}/lines")
    arrays = rows.filter("user_id % 2 = 1").groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value")
    )
    arrays.write.partitionBy("part").text(f"{path}/arrays")
    return files.read_any(spark, path, schema=_EVENT).select("event_id", "event_type", "value")


def commit_log(spark, sf):
    """Documents per language listed one by one, then the long ones of all at once, less the last language; as it was
    before that and as it is."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n", T.LongType())])
    log = CommitLog(spark, scratch_path(spark, "log"), schema, "lang")
    long = F.count(F.when(F.col("n_chars") > 500, 1))
    counts = _docs(spark, sf).filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), long.alias("long"))
    counts = sorted(tuple(r) for r in counts.collect())  # one row per language
    for lang, n, _ in counts:
        before = log.commit(put=[(lang, n)])
    log.commit(put=[(lang, n) for lang, _, n in counts[:-1]], remove=[counts[-1][0]])
    states = log.read(before).withColumn("state", F.lit("before")), log.read().withColumn("state", F.lit("now"))
    return states[0].unionByName(states[1])


def process_two_sources(spark, sf):
    """Two files under one name: two datasets, both there afterwards, and a second run of one replaces only that one."""
    base, config = scratch_path(spark, "base"), PreprocessingConfig(field_mappings=MAPPINGS, split=NoSplit())
    paths = {}
    for lang in ("en", "fr", "en"):
        if lang not in paths:
            paths[lang] = scratch_path(spark, lang) + ".parquet"
            _docs(spark, sf).filter(F.col("lang") == lang).write.parquet(paths[lang])
        preprocess.process_dataset(spark, paths[lang], base, "docs", "language_modeling", config, key="doc_id", user_id="user1")
    listed = catalog.manifest(spark, base).select("num_examples", F.explode("splits").alias("s"))
    stored = [(r["num_examples"], spark.read.parquet(r["path"]).count()) for r in listed.select("num_examples", "s.path").collect()]
    return spark.createDataFrame(stored, "num_examples long, stored long")


def drop_dataset(spark, sf):
    """Two datasets, of which the owner drops one."""
    base, kept = scratch_path(spark, "base"), []
    for lang in ("de", "es"):
        rows = _docs(spark, sf).filter(F.col("lang") == lang).withColumn("split", F.lit("train"))
        entry = catalog.write_processed(rows, base, lang, user_id="user1").first()
        kept.append(entry["processed_dataset_id"])
    catalog.drop_dataset(spark, base, kept[0], "user1")
    left = catalog.list_datasets(catalog.manifest(spark, base), "user1").select("dataset_name", "num_examples")
    return left.withColumn("first_exists", F.lit(catalog.dataset_exists(spark, base, kept[0])))


def register_raw(spark, sf):
    """A raw file listed, found by its owner."""
    base = scratch_path(spark, "base")
    entry = catalog.register_raw(spark, base, f"{sf}/documents.parquet", "user1").first()
    found = catalog.get_raw(spark, base, entry["dataset_id"], "user1")
    return found.select("user_id", "filename", "content_type", (F.col("size_bytes") > 0).alias("has_size"))


def _manifest(spark, sf):
    """Each source as a dataset, each language as a split; owners and gaps derived from the source name."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    per_split = _docs(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return per_split.groupBy("source").agg(
        F.sum("n").alias("num_examples"),
        F.sort_array(F.collect_list(F.struct(F.col("lang").alias("split_name"), F.col("n").alias("num_rows"), F.lit("").alias("path")))).alias("splits"),
    ).select(
        F.substring(F.md5("source"), 1, 8).alias("processed_dataset_id"),
        F.col("source").alias("dataset_name"),
        F.concat(F.lit("user"), (number % 3).cast("string")).alias("user_id"),
        F.col("source").alias("dataset_id"),
        F.lit("upload").alias("dataset_source"),
        F.lit("default").alias("dataset_subset"),
        F.lit(None).cast("timestamp").alias("created_at"),
        "num_examples",
        F.when(number % 2 == 0, F.lit("vision")).alias("modality"),
        "splits",
    )


def list_datasets(spark, sf):
    listed = catalog.list_datasets(_manifest(spark, sf), "user1")
    return listed.select("dataset_name", "processed_dataset_id", "num_examples", F.array_join("splits", ",").alias("splits"), "modality")


def get_dataset(spark, sf):
    """The same entry asked for by its owner and by someone else."""
    import hashlib

    entry = hashlib.md5(b"src1").hexdigest()[:8]
    m = _manifest(spark, sf)
    asked = [catalog.find_dataset(m, entry, u).select(F.lit(u).alias("asked_by"), "dataset_name", "num_examples") for u in ("user1", "user2")]
    return asked[0].unionByName(asked[1])


def write_processed(spark, sf):
    """Documents written by split; the manifest row as one row per split."""
    rows = sampling.train_test_split(_docs(spark, sf), 0.1, "doc_id")
    entry = catalog.write_processed(rows, scratch_path(spark, "base"), "documents", user_id="user1")
    return entry.select("dataset_name", "num_examples", F.explode("splits").alias("s")).select(
        "dataset_name", "num_examples", "s.split_name", "s.num_rows"
    )


def _processed(spark, sf):
    base = scratch_path(spark, "base")
    config = PreprocessingConfig(field_mappings=MAPPINGS, split=ManualSplit(test_size=0.25))
    entry = preprocess.process_dataset(
        spark, f"{sf}/documents.parquet", base, "docs", "language_modeling", config, key="doc_id", user_id="user1"
    )
    return base, entry.first()["processed_dataset_id"]


def process_dataset(spark, sf):
    """The whole preparation job, read back by id."""
    train, test = read_back(spark, *_processed(spark, sf))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"][0]["text"])), "|")
    return both.select("split", "doc_id", text.alias("text"))


def _echo(texts: pd.Series) -> pd.Series:
    """Stand-in model: the prompt's text after the last line break of its first turn, without markers."""
    return texts.str.replace(r"(?s)^<start_of_turn>user\n|<end_of_turn>.*$", "", regex=True)


def _evaluated(spark, sf):
    """The whole evaluation job on the stored test split, with a model that repeats the question."""
    base, processed_id = _processed(spark, sf)
    config = EvaluationConfig(metrics=("exact_match", "bleu"))
    return evaluation_plan.evaluate_dataset(spark, base, processed_id, "doc_id", lambda: _echo, config)


def evaluate_dataset(spark, sf):
    return _evaluated(spark, sf).answers.select("doc_id", "prediction", "reference")


def evaluate_dataset_scores(spark, sf):
    """The scores of the same job, and how many rows they are about."""
    done = _evaluated(spark, sf)
    scores = done.metrics.select("metric", F.round("value", 6).alias("value"))
    return scores.withColumn("rows", F.lit(done.num_evaluated).cast("bigint"))


def _grown(spark, sf, factor=1.5):
    rows = conversation_rows(spark, sf)
    config = AugmentationConfig(augmentation_factor=factor, use_eda=True)
    return augment.augment(rows, "conv_id", config, lexicon(spark, sf))


def augment_counts(spark, sf):
    return _grown(spark, sf, 1.75).groupBy("origin").agg(F.count(F.lit(1)).alias("rows"))


def augment_draws(spark, sf):
    """Which conversations were drawn, and every text after its edit."""
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"][0]["text"])), "|")
    return _grown(spark, sf).select("conv_id", "draw", "origin", said.alias("said"))


def augment_splits(spark, sf):
    rows = sampling.train_test_split(conversation_rows(spark, sf), 0.3, "conv_id")
    config = AugmentationConfig(augmentation_factor=2.0, use_eda=True)
    grown = augment.augment_splits(rows, "conv_id", config, lexicon(spark, sf))
    return grown.groupBy("split", "origin").agg(F.count(F.lit(1)).alias("rows"))


def augment_report(spark, sf):
    return augment.augmentation_report(_grown(spark, sf), ["eda"])


def synthesis_prompts(spark, sf):
    done = synthesis.synthesis_prompts(conversation_rows(spark, sf), 95, "conv_id", custom_prompt=" Be brief. ")
    return done


def _fenced(spark, sf):
    """Conversations written as a model would: a fence per turn pair, with a remark in between."""
    turns = table(spark, sf, "conversations")
    said = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", r"[\n`]", " "), F.lit("\nok\n"))
    return turns.select(
        "conv_id",
        "turn",
        F.concat(F.lit("Here it is:\n```\n  "), said, F.lit("Assistant: noted\n```\nAnything else?")).alias("generated"),
    )


def parse_conversations(spark, sf):
    parsed = synthesis.parse_conversations(_fenced(spark, sf), "generated", keep=["conv_id", "turn"])
    return parsed.select("conv_id", "turn", "block", F.posexplode("messages").alias("pos", "m")).select(
        "conv_id", "turn", F.col("block").cast("bigint").alias("block"), F.col("pos").cast("bigint").alias("pos"),
        "m.role", F.col("m.content")[0]["text"].alias("text"),
    )


def _author(prompts: pd.Series) -> pd.Series:
    """Stand-in model: as many conversations as the prompt asks for."""
    asked = prompts.str.extract(r"Write (\d+) more")[0].astype(int)
    return asked.map(lambda n: "\n".join(f"```\nUser: question {i}\nAssistant: answer {i}\n```" for i in range(n)))


def synthesize(spark, sf):
    rows = conversation_rows(spark, sf)
    n = rows.count() // 3
    made = synthesis.synthesize(rows, n, "conv_id", lambda: _author, system_message="Be kind.")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"][0]["text"])), "|")
    return made.select("batch", F.col("block").cast("bigint").alias("block"), text.alias("text"))


def augment_with_models(spark, sf):
    """Half synthetic, half edited by a stand-in paraphraser; counts per origin."""
    rows = conversation_rows(spark, sf)
    config = AugmentationConfig(augmentation_factor=2.0, use_paraphrasing=True, use_synthesis=True)
    models = {"synthesis": lambda: _author, "paraphrasing": lambda: (lambda t: t.str.lower())}
    grown = augment.augment(rows, "conv_id", config, models=models)
    return grown.groupBy("origin").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {
    "read_named_splits": read_named_splits,
    "read_single_split": read_single_split,
    "split_summary": split_summary,
    "preview": preview,
    "profile": profile,
    "read_csv": read_csv,
    "commit_log": commit_log,
    "read_text": read_text,
    "read_jsonl": read_jsonl,
    "read_json": read_json,
    "process_two_sources": process_two_sources,
    "drop_dataset": drop_dataset,
    "register_raw": register_raw,
    "list_datasets": list_datasets,
    "get_dataset": get_dataset,
    "write_processed": write_processed,
    "process_dataset": process_dataset,
    "evaluate_dataset": evaluate_dataset,
    "evaluate_dataset_scores": evaluate_dataset_scores,
    "augment_counts": augment_counts,
    "augment_draws": augment_draws,
    "augment_splits": augment_splits,
    "augment_report": augment_report,
    "synthesis_prompts": synthesis_prompts,
    "parse_conversations": parse_conversations,
    "synthesize": synthesize,
    "augment_with_models": augment_with_models,
}

_CONV = f"""
conv AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles,
                string_agg(CASE WHEN role <> 'system' THEN upper(role[1]) || role[2:] || ': ' || text || chr(10) ELSE '' END, '' ORDER BY turn) AS said
         FROM conversations GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || conv_id )) - 1 AS row_index FROM conv),
total AS (SELECT count(*) AS n FROM conv)"""

_RANKED_DOCS = """
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS row_index FROM documents),
total AS (SELECT count(*) AS n FROM documents)"""

_U60 = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


#: Every message of the drawn conversations.
_DRAWN = f"""(
    WITH {_CONV}, draws AS (
      SELECT d AS draw, {_U60.format("'42:draw:' || d")} % n AS row_index
      FROM total, range((SELECT floor(n * 1.5)::BIGINT - n FROM total)) t(d)),
    said AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
    SELECT draw, pos, 0 AS part, conv_id, role, text FROM draws JOIN ranked USING (row_index) JOIN said USING (conv_id))"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _asking(value: str) -> str:
    before, after = value.split("{n}")
    return f"{_text(before)} || asked || {_text(after)}"


ORACLES = {
    "read_named_splits": "SELECT doc_id, CASE lang WHEN 'en' THEN 'train' ELSE 'test' END AS split FROM documents WHERE lang IN ('en', 'fr')",
    "read_single_split": "SELECT doc_id FROM documents WHERE lang = 'de'",
    "split_summary": """SELECT (SELECT count(*) FROM documents) AS num_examples, 'text' AS modality, source AS split_name, count(*) AS num_rows
        FROM documents GROUP BY source""",
    "preview": """SELECT doc_id, text, source AS split FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5""",
    "commit_log": """WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 500) AS l FROM documents
        WHERE lang IS NOT NULL GROUP BY lang)
        SELECT lang, n, 'before' AS state FROM c
        UNION ALL SELECT lang, l, 'now' FROM c WHERE lang < (SELECT max(lang) FROM c)""",
    "read_csv": "SELECT doc_id, source, n_chars, text FROM documents",
    "read_text": "SELECT props AS text FROM events",
    "read_jsonl": "SELECT event_id, event_type, value FROM events UNION ALL SELECT NULL, NULL, NULL",
    "read_json": "SELECT event_id, event_type, value FROM events",
    "process_two_sources": f"""SELECT count(*) AS num_examples, count(*) AS stored FROM documents
        WHERE lang IN ('en', 'fr') AND {_WS.format('text')} <> '' GROUP BY lang""",
    "drop_dataset": "SELECT 'es' AS dataset_name, count(*) AS num_examples, false AS first_exists FROM documents WHERE lang = 'es'",
    "register_raw": """SELECT 'user1' AS user_id, 'documents.parquet' AS filename, 'application/octet-stream' AS content_type,
        true AS has_size FROM documents LIMIT 1""",
    "profile": """SELECT (SELECT count(*) FROM documents) AS num_examples, position::INTEGER AS position, name,
          (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5)) AS ids
        FROM (VALUES (0, 'doc_id'), (1, 'text'), (2, 'lang'), (3, 'source'), (4, 'n_chars')) t(position, name)""",
    "list_datasets": r"""SELECT source AS dataset_name, substr(md5(source), 1, 8) AS processed_dataset_id, count(*) AS num_examples,
          string_agg(DISTINCT lang, ',' ORDER BY lang) AS splits,
          CASE WHEN regexp_extract(source, '\d+')::INTEGER % 2 = 0 THEN 'vision' ELSE 'text' END AS modality
        FROM documents WHERE regexp_extract(source, '\d+')::INTEGER % 3 = 1 GROUP BY source""",
    "get_dataset": "SELECT 'user1' AS asked_by, source AS dataset_name, count(*) AS num_examples FROM documents WHERE source = 'src1' GROUP BY source",
    "write_processed": f"""WITH {_RANKED_DOCS}
        SELECT 'documents' AS dataset_name, (SELECT n FROM total) AS num_examples,
               CASE WHEN row_index < floor(n * (1 - 0.1::DOUBLE)) THEN 'train' ELSE 'test' END AS split_name, count(*) AS num_rows
        FROM ranked, total GROUP BY ALL""",
    "process_dataset": f"""WITH {_RANKED_DOCS}
        SELECT CASE WHEN row_index < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split, doc_id,
               'system=Language: ' || lang || '|user=Continue the text from ' || source || '.|assistant=' || {_WS.format('text')} AS text
        FROM ranked, total WHERE {_WS.format('text')} <> ''""",
    "evaluate_dataset": f"""WITH {_RANKED_DOCS}
        SELECT doc_id, 'Language: ' || lang || chr(10) || chr(10) || 'Continue the text from ' || source || '.' AS prediction,
               {_WS.format('text')} AS reference
        FROM ranked, total WHERE row_index >= floor(n * 0.75) AND {_WS.format('text')} <> ''""",
    "augment_counts": f"""WITH {_CONV} SELECT 'original' AS origin, n AS rows FROM total
        UNION ALL SELECT 'augmented', floor(n * 1.75)::BIGINT - n FROM total""",
    "augment_draws": f"""{augmented(_DRAWN, ('draw', 'pos', 'part'), 1)}
        SELECT conv_id, NULL::BIGINT AS draw, 'original' AS origin, string_agg(role || '=' || text, '|' ORDER BY turn) AS said
        FROM conversations GROUP BY conv_id
        UNION ALL
        SELECT conv_id, d.draw, 'augmented', string_agg(role || '=' ||
          CASE WHEN role IN ('user', 'assistant') THEN coalesce(nullif(done.text, ''), d.text) ELSE d.text END, '|' ORDER BY d.pos)
        FROM {_DRAWN} d LEFT JOIN plans USING (draw, pos, part) LEFT JOIN done USING (turn_key, op) GROUP BY conv_id, d.draw""",
    "augment_splits": f"""WITH {_CONV}, s AS (SELECT floor(n * 0.7::DOUBLE)::BIGINT AS train, n FROM total)
        SELECT 'train' AS split, 'original' AS origin, train AS rows FROM s
        UNION ALL SELECT 'train', 'augmented', train FROM s UNION ALL SELECT 'test', 'original', n - train FROM s""",
    "augment_report": f"""WITH {_CONV} SELECT n AS original_count, floor(n * 1.5)::BIGINT AS final_count, 'eda' AS methods_used,
        false AS synthesis_used, '' AS errors, 1.0::DOUBLE AS success_rate FROM total""",
    "synthesis_prompts": f"""WITH {_CONV},
        picks AS (SELECT b AS batch, e AS example, ({_U60.format("'42:batch:' || b")} + e - 1) % n AS row_index
                  FROM total, range(10) t(b), range(1, 4) s(e)),
        p AS (SELECT batch, least(10, 95 - batch * 10) AS asked,
                     string_agg('Example ' || example || ':' || chr(10) || said, chr(10) ORDER BY example) AS examples
              FROM picks JOIN ranked USING (row_index) GROUP BY batch)
        SELECT batch, asked AS num_samples, {_asking(synthesis.INTRO)} || examples || {_text(synthesis.CUSTOM.replace('{custom}', 'Be brief.'))} ||
               {_asking(synthesis.GUIDELINES)} || {_text(synthesis.FORMAT)} AS prompt FROM p""",
    "parse_conversations": r"""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\n`]', ' ', 'g'), ' ' || chr(9) || chr(13)) AS text
              FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, 1::BIGINT AS block, 0::BIGINT AS pos, 'user' AS role, text FROM t
        UNION ALL SELECT conv_id, turn, 1, 1, 'assistant', 'noted' FROM t""",
    "synthesize": f"""WITH {_CONV}, w AS (SELECT n // 3 AS k FROM total)
        SELECT g // 10 AS batch, (g % 10) * 2 + 1 AS block,
               'system=Be kind.|user=question ' || (g % 10) || '|assistant=answer ' || (g % 10) AS text
        FROM w, range((SELECT k FROM w)) t(g)""",
    "augment_with_models": f"""WITH {_CONV} SELECT 'original' AS origin, n AS rows FROM total
        UNION ALL SELECT 'synthetic', n // 2 FROM total UNION ALL SELECT 'augmented', n - n // 2 FROM total""",
}

_ANSWERED = f"pairs AS (SELECT doc_id AS sample_index, prediction, reference FROM ({ORACLES['evaluate_dataset']}))"
ORACLES["evaluate_dataset_scores"] = f"""
    SELECT metric, round(value, 6) AS value, (SELECT count(*) FROM ({ORACLES['evaluate_dataset']})) AS rows FROM (
      SELECT 'bleu' AS metric, bleu AS value FROM ({EVALUATION['bleu'].replace(PAIRS_SQL, _ANSWERED)})
      UNION ALL SELECT 'exact_match', avg((prediction = reference)::INTEGER) FROM ({ORACLES['evaluate_dataset']}))"""
