"""Evaluation data and scores."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chatloom.functions.columns import settle
from chatloom.functions.rng import index_below
from chatloom.operators import evaluation, generation, intervals, metrics
from workload.lexical import lexicon
from workload.tables import PAIRS_SQL, conversation_rows, flat_messages, long_turns, table, turn_pairs

LANGS = ("de", "en", "es", "fr")


def messages_from_turns(spark, sf):
    return flat_messages(conversation_rows(spark, sf), "messages", "conv_id")


def _prepared(spark, sf):
    return evaluation.prepare_eval(conversation_rows(spark, sf), keep=["conv_id"])


def eval_prepare(spark, sf):
    return flat_messages(_prepared(spark, sf), "input", "conv_id")


def eval_reference(spark, sf):
    return _prepared(spark, sf).select("conv_id", "reference")


def _prepared_long(spark, sf):
    return evaluation.prepare_eval(conversation_rows(spark, sf, long_turns(spark, sf)), keep=["conv_id"])


def eval_prepare_long(spark, sf):
    """Conversations of hundreds of turns are one example each."""
    return flat_messages(_prepared_long(spark, sf), "input", "conv_id")


def eval_reference_long(spark, sf):
    return _prepared_long(spark, sf).select("conv_id", "reference")


def modality(spark, sf):
    return evaluation.infer_modality(conversation_rows(spark, sf))


def _answers(spark, sf):
    turns = table(spark, sf, "conversations")
    index = F.col("conv_id") * 1000000 + F.col("turn")
    p = turns.filter("role = 'user'").select(index.alias("sample_index"), F.col("text").alias("prediction"))
    r = turns.filter("role = 'assistant'").select((index - 1).alias("sample_index"), F.col("text").alias("reference"))
    return p, r


def align(spark, sf):
    return evaluation.align(*_answers(spark, sf), check=False)


def unaligned(spark, sf):
    return evaluation.unaligned(*_answers(spark, sf))


def _first_words(texts: pd.Series) -> pd.Series:
    return texts.str.split().map(lambda w: " ".join(w[:5])).str.lower()


def batch_generate(spark, sf):
    """A stand-in model that answers with the first five words of the prompt in small letters."""
    done = evaluation.batch_generate(_prepared(spark, sf), lambda: _first_words)
    return done.select("conv_id", "prediction", "prediction_error")


def back_translate(spark, sf):
    """Stand-in models: one turns the words round, the other turns them back and drops the last."""
    turns = table(spark, sf, "conversations")
    there = lambda: (lambda t: t.map(lambda s: " ".join(reversed(s.split()))))
    back = lambda: (lambda t: t.map(lambda s: " ".join(list(reversed(s.split()))[:-1])))
    return generation.back_translate(turns, "text", there, back).select("conv_id", "turn", "augmented", "augmented_error")


def paraphrase(spark, sf):
    """A stand-in model that answers in small letters."""
    turns = table(spark, sf, "conversations")
    return generation.paraphrase(turns, "text", lambda: (lambda t: t.str.lower())).select("conv_id", "turn", "augmented")


def method_choice(spark, sf):
    """Two stand-in models in an order drawn per turn: one changes only texts of odd length, the other every text."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    odd = lambda: (lambda t: t.map(lambda s: s + "!" if len(s) % 2 else s))
    small = lambda: (lambda t: t.map(lambda s: s[:20]))
    order = generation.method_order(42, [F.col("conv_id"), F.col("turn")], ["back_translation", "paraphrasing"])
    ready = settle(turns, "_order", order)
    chosen = generation.try_methods(F.col("text"), None, F.col("_order"), {"back_translation": (odd,), "paraphrasing": (small,)})
    return ready.select("conv_id", "turn", chosen.alias("augmented"))


def _quality(spark, sf):
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return labels.select((F.col("n_chars") > 500).cast("int").alias("prediction"), F.col("quality").alias("reference"))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def exact_match(spark, sf):
    return _rounded(metrics.exact_match(_quality(spark, sf)))


def accuracy(spark, sf):
    return _rounded(metrics.accuracy(_languages(spark, sf)))


def precision_recall(spark, sf):
    return _rounded(metrics.precision_recall(_quality(spark, sf)))


def f1_binary(spark, sf):
    return _rounded(metrics.f1(_quality(spark, sf)))


def _languages(spark, sf):
    guess = F.element_at(F.array(*map(F.lit, LANGS)), index_below(4, 42, F.col("doc_id")) + 1)
    return table(spark, sf, "documents").select(guess.alias("prediction"), F.col("lang").alias("reference"))


def f1_per_class(spark, sf):
    return _rounded(metrics.f1_per_class(_languages(spark, sf)))


def f1_macro(spark, sf):
    return _rounded(metrics.f1(_languages(spark, sf)))


def bleu(spark, sf):
    return _rounded(metrics.bleu(turn_pairs(spark, sf)))


def _rouge(spark, sf, n):
    pairs = turn_pairs(spark, sf)
    score = metrics.rouge_n(F.col("prediction"), F.col("reference"), n)
    return pairs.select("sample_index", F.round(score, 6).alias(f"rouge{n}"))


def rouge1(spark, sf):
    return _rouge(spark, sf, 1)


def rouge2(spark, sf):
    return _rouge(spark, sf, 2)


def rouge_l(spark, sf):
    score = metrics.rouge_l(F.col("prediction"), F.col("reference"))
    return turn_pairs(spark, sf).select("sample_index", F.round(score, 6).alias("rougeL"))


def rouge_intervals(spark, sf):
    """ROUGE-1 of all pairs with the limits of 200 bootstrap replicates."""
    found = intervals.score_intervals(turn_pairs(spark, sf), ["rouge1"])
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("value", "low", "mid", "high")])


def rouge_mean(spark, sf):
    return _rounded(metrics.rouge(turn_pairs(spark, sf)))


def meteor(spark, sf):
    scored = metrics.with_meteor(turn_pairs(spark, sf), lexicon=lexicon(spark, sf))
    return scored.select("sample_index", F.round("meteor", 6).alias("meteor"))


def _byte_vectors(texts: pd.Series) -> pd.Series:
    """Stand-in embedder: a token's vector is the 16 bytes of its md5, centred."""
    return texts.map(
        lambda t: [np.frombuffer(hashlib.md5(w.encode()).digest(), dtype="uint8") - 127.5 for w in t.split()]
    )


def bertscore(spark, sf):
    score = metrics.bertscore_columns(F.col("prediction"), F.col("reference"), lambda: _byte_vectors)
    scored = turn_pairs(spark, sf).select("sample_index", score.alias("s"))
    return scored.select("sample_index", *[F.round(f"s.{n}", 6).alias(n) for n in ("precision", "recall", "f1")])


def evaluate_translation(spark, sf):
    return _rounded(metrics.evaluate_metrics(turn_pairs(spark, sf), "translation", lexicon=lexicon(spark, sf)))


def evaluate_classification(spark, sf):
    """The classification suite over the labelled documents, one row per metric."""
    return _rounded(metrics.evaluate_metrics(_quality(spark, sf), "classification")).select("metric", "value")


def _with_nulls(spark, sf):
    """Labelled documents; every seventh prediction and every eleventh reference is missing."""
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return labels.select(
        F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") > 500).cast("int")).alias("prediction"),
        F.when(F.col("doc_id") % 11 != 0, F.col("quality")).alias("reference"),
    )


def scores_with_nulls(spark, sf):
    """Missing labels stay in the denominators."""
    return _rounded(metrics.evaluate_metrics(_with_nulls(spark, sf), metrics=metrics.CLASS_METRICS))


def f1_text_labels(spark, sf):
    """Text labels, with the positive one named and with the default, which does not occur."""
    named = F.when(F.col("prediction") == 1, "good").otherwise("bad"), F.when(F.col("reference") == 1, "good").otherwise("bad")
    pairs = _quality(spark, sf).select(named[0].alias("prediction"), named[1].alias("reference"))
    asked = [(p, metrics.evaluate_metrics(pairs, metrics=("precision", "f1"), positive=p)) for p in ("good", 1)]
    parts = [d.select(F.lit(str(p)).alias("positive"), "metric", F.round("value", 6).alias("value"), F.col("error").isNotNull().alias("failed")) for p, d in asked]
    return parts[0].unionByName(parts[1])


def _no_model():
    raise OSError("no model here")


def suite_with_failing_metric(spark, sf):
    """An embedder that cannot be loaded costs only its own scores."""
    pairs = turn_pairs(spark, sf)
    done = metrics.evaluate_metrics(pairs, metrics=("bertscore", "exact_match", "unheard_of"), embedder=_no_model)
    return done.select("metric", "value", "error")


QUERIES = {
    "scores_with_nulls": scores_with_nulls,
    "f1_text_labels": f1_text_labels,
    "suite_with_failing_metric": suite_with_failing_metric,
    "messages_from_turns": messages_from_turns,
    "eval_prepare": eval_prepare,
    "eval_reference": eval_reference,
    "eval_prepare_long": eval_prepare_long,
    "eval_reference_long": eval_reference_long,
    "modality": modality,
    "align": align,
    "unaligned": unaligned,
    "batch_generate": batch_generate,
    "back_translate": back_translate,
    "paraphrase": paraphrase,
    "method_choice": method_choice,
    "exact_match": exact_match,
    "accuracy": accuracy,
    "precision_recall": precision_recall,
    "f1_binary": f1_binary,
    "f1_per_class": f1_per_class,
    "f1_macro": f1_macro,
    "bleu": bleu,
    "rouge1": rouge1,
    "rouge2": rouge2,
    "rouge_l": rouge_l,
    "rouge_mean": rouge_mean,
    "rouge_intervals": rouge_intervals,
    "meteor": meteor,
    "bertscore": bertscore,
    "evaluate_translation": evaluate_translation,
    "evaluate_classification": evaluate_classification,
}

_LONG = """longs AS (SELECT conv_id % 10 AS conv_id, conv_id // 10 * 1000 + turn AS turn, role, text FROM conversations),"""

_ASKED = """
c AS (SELECT conv_id, turn, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
f AS (SELECT conv_id, min(pos) FILTER (role = 'assistant') AS first FROM c GROUP BY 1),
asked AS (SELECT c.*, first, row_number() OVER (PARTITION BY c.conv_id ORDER BY pos) - 1 AS in_pos
          FROM c JOIN f USING (conv_id)
          WHERE role IN ('user', 'system') AND (first IS NULL OR pos < first))"""

_QUALITY = """
q AS (SELECT (n_chars > 500)::INTEGER AS p, quality AS r FROM labels JOIN documents USING (doc_id))"""

_LANGUAGES = """
q AS (SELECT ['de','en','es','fr'][('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 4 + 1] AS p, lang AS r
      FROM documents),
classes AS (SELECT DISTINCT unnest([p, r]) AS class FROM q),
per AS (SELECT class, 2.0::DOUBLE * count(*) FILTER (p = class AND r = class) /
          (count(*) FILTER (p = class) + count(*) FILTER (r = class)) AS f1 FROM q, classes GROUP BY class)"""


def _bleu_tokens(c: str) -> str:
    t = f"replace(replace(replace({c}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{entity}', '{sign}')"
    t = f"' ' || {t} || ' '"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"


def _rouge_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"


def _grams(tokens, orders: str) -> str:
    return f"""WITH {PAIRS_SQL},
t AS (SELECT sample_index, {tokens('prediction')} AS p, {tokens('reference')} AS r FROM pairs),
o AS (SELECT unnest({orders}) AS n),
pg AS (SELECT sample_index, n, gram, count(*) AS c FROM
        (SELECT sample_index, n, unnest(list_transform(range(1, (len(p) - n + 2)::BIGINT), lambda i: array_to_string(list_slice(p, i, i + n - 1), ' '))) AS gram FROM t, o)
       GROUP BY ALL),
rg AS (SELECT sample_index, n, gram, count(*) AS c FROM
        (SELECT sample_index, n, unnest(list_transform(range(1, (len(r) - n + 2)::BIGINT), lambda i: array_to_string(list_slice(r, i, i + n - 1), ' '))) AS gram FROM t, o)
       GROUP BY ALL),
hits AS (SELECT sample_index, n, sum(least(pg.c, rg.c))::BIGINT AS m FROM pg JOIN rg USING (sample_index, n, gram) GROUP BY ALL)"""


def _rouge_sql(n: int) -> str:
    return f"""{_grams(_rouge_tokens, f'[{n}]')}
SELECT sample_index, round(CASE WHEN m > 0 THEN 2.0::DOUBLE * m / (len(p) + len(r) - {2 * (n - 1)}) ELSE 0 END, 6) AS rouge{n}
FROM t LEFT JOIN hits USING (sample_index)"""


ORACLES = {
    "scores_with_nulls": """WITH q AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN (n_chars > 500)::INTEGER END AS p,
            CASE WHEN doc_id % 11 <> 0 THEN quality END AS r FROM labels JOIN documents USING (doc_id)),
        s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (p IS NOT DISTINCT FROM r) AS same,
                count(*) FILTER (p = 1 AND r = 1)::DOUBLE AS tp, count(*) FILTER (p = 1) AS pp, count(*) FILTER (r = 1) AS rr FROM q)
        SELECT metric, round(value, 6) AS value, NULL::VARCHAR AS error FROM (
          SELECT 'exact_match' AS metric, same / n AS value FROM s UNION ALL SELECT 'accuracy', same / n FROM s
          UNION ALL SELECT 'precision', tp / pp FROM s UNION ALL SELECT 'recall', tp / rr FROM s
          UNION ALL SELECT 'f1', 2 * tp / (pp + rr) FROM s)""",
    "f1_text_labels": f"""WITH {_QUALITY},
        s AS (SELECT count(*) FILTER (p = 1 AND r = 1)::DOUBLE AS tp, count(*) FILTER (p = 1) AS pp, count(*) FILTER (r = 1) AS rr FROM q)
        SELECT 'good' AS positive, 'precision' AS metric, round(tp / pp, 6) AS value, false AS failed FROM s
        UNION ALL SELECT 'good', 'f1', round(2 * tp / (pp + rr), 6), false FROM s
        UNION ALL SELECT '1', unnest(['precision', 'f1']), NULL, true FROM s""",
    "suite_with_failing_metric": f"""WITH {PAIRS_SQL}
        SELECT 'exact_match' AS metric, avg((prediction = reference)::INTEGER) AS value, NULL::VARCHAR AS error FROM pairs
        UNION ALL SELECT unnest(['bertscore_precision_mean', 'bertscore_recall_mean', 'bertscore_f1_mean']), NULL, 'OSError: no model here'
        UNION ALL SELECT 'unheard_of', NULL, 'unknown metric'""",
    "messages_from_turns": f"WITH {_ASKED} SELECT conv_id, pos, role, 0::BIGINT AS part_pos, 'text' AS part_type, text FROM c",
    "eval_prepare": f"WITH {_ASKED} SELECT conv_id, in_pos AS pos, role, 0::BIGINT AS part_pos, 'text' AS part_type, text FROM asked",
    "eval_reference": f"""WITH {_ASKED}
        SELECT f.conv_id, coalesce(trim(c.text, ' ' || chr(9) || chr(10) || chr(13)), '') AS reference
        FROM f LEFT JOIN c ON c.conv_id = f.conv_id AND c.pos = f.first
        WHERE EXISTS (FROM asked a WHERE a.conv_id = f.conv_id)""",
    "eval_prepare_long": f"WITH {_LONG} {_ASKED.replace('FROM conversations', 'FROM longs')} SELECT conv_id, in_pos AS pos, role, 0::BIGINT AS part_pos, 'text' AS part_type, text FROM asked",
    "eval_reference_long": f"""WITH {_LONG} {_ASKED.replace('FROM conversations', 'FROM longs')}
        SELECT f.conv_id, coalesce(trim(c.text, ' ' || chr(9) || chr(10) || chr(13)), '') AS reference
        FROM f LEFT JOIN c ON c.conv_id = f.conv_id AND c.pos = f.first
        WHERE EXISTS (FROM asked a WHERE a.conv_id = f.conv_id)""",
    "modality": "SELECT 'text' AS modality FROM conversations LIMIT 1",
    "align": f"WITH {PAIRS_SQL} SELECT * FROM pairs",
    "unaligned": """WITH p AS (SELECT conv_id * 1000000 + turn AS k FROM conversations WHERE role = 'user'),
        r AS (SELECT conv_id * 1000000 + turn - 1 AS k FROM conversations WHERE role = 'assistant')
        SELECT coalesce(p.k, r.k) AS sample_index, CASE WHEN p.k IS NULL THEN 'prediction' ELSE 'reference' END AS missing
        FROM p FULL JOIN r ON p.k = r.k WHERE p.k IS NULL OR r.k IS NULL""",
    "exact_match": f"WITH {_QUALITY} SELECT round(avg((p = r)::INTEGER), 6) AS exact_match FROM q",
    "accuracy": f"WITH {_LANGUAGES} SELECT round(avg((p = r)::INTEGER), 6) AS accuracy FROM q",
    "precision_recall": f"""WITH {_QUALITY} SELECT
        round(count(*) FILTER (p = 1 AND r = 1)::DOUBLE / count(*) FILTER (p = 1), 6) AS precision,
        round(count(*) FILTER (p = 1 AND r = 1)::DOUBLE / count(*) FILTER (r = 1), 6) AS recall FROM q""",
    "f1_binary": f"""WITH {_QUALITY} SELECT
        round(2.0::DOUBLE * count(*) FILTER (p = 1 AND r = 1) / (count(*) FILTER (p = 1) + count(*) FILTER (r = 1)), 6) AS f1 FROM q""",
    "f1_per_class": f"WITH {_LANGUAGES} SELECT class, round(f1, 6) AS f1 FROM per",
    "f1_macro": f"WITH {_LANGUAGES} SELECT round(avg(f1), 6) AS f1 FROM per",
    "bleu": f"""{_grams(_bleu_tokens, '[1,2,3,4]')},
        lens AS (SELECT sum(len(p))::DOUBLE AS pl, sum(len(r))::DOUBLE AS rl FROM t),
        total AS (SELECT n, sum(greatest(len(p) - n + 1, 0))::DOUBLE AS possible FROM t, o GROUP BY n),
        prec AS (SELECT n, coalesce((SELECT sum(m) FROM hits h WHERE h.n = total.n), 0)::DOUBLE / possible AS x FROM total)
        SELECT round(CASE WHEN min(x) > 0 THEN exp(avg(ln(greatest(x, 1e-300)))) *
            any_value(CASE WHEN pl > rl THEN 1 ELSE exp(1 - rl / pl) END) ELSE 0 END, 6) AS bleu
        FROM prec, lens""",
    "rouge_intervals": f"""{_grams(_rouge_tokens, '[1]')},
        s AS (SELECT sample_index, CASE WHEN m > 0 THEN 2.0::DOUBLE * m / (len(p) + len(r)) ELSE 0 END AS x
              FROM t LEFT JOIN hits USING (sample_index)),
        d AS (SELECT x, b, ('0x' || substr(md5('42:bootstrap:' || (b // 8) || ':' || sample_index), (b % 8 * 4 + 1)::BIGINT, 4))::INTEGER AS draw
              FROM s, range({intervals.REPLICATES}) u(b)),
        w AS (SELECT x, b, len(list_filter({intervals.poisson_limits()}, lambda l: l <= draw)) AS k FROM d),
        v AS (SELECT b, sum(k * x) / nullif(sum(k), 0) AS v FROM w GROUP BY b)
        SELECT 'rouge1' AS metric, (SELECT round(avg(x), 6) FROM s) AS value, round(quantile_cont(v, 0.025), 6) AS low,
          round(quantile_cont(v, 0.5), 6) AS mid, round(quantile_cont(v, 0.975), 6) AS high FROM v""",
    "rouge1": _rouge_sql(1),
    "rouge2": _rouge_sql(2),
    "rouge_l": f"""WITH RECURSIVE {PAIRS_SQL},
        t AS (SELECT sample_index, {_rouge_tokens('prediction')} AS p, {_rouge_tokens('reference')} AS r FROM pairs),
        dp AS (SELECT sample_index, j, 0 AS i, 0::BIGINT AS v FROM t, unnest(range(0, len(r) + 1)) u(j)
          UNION ALL
          SELECT sample_index, j, i + 1, max(best) OVER (PARTITION BY sample_index ORDER BY j)::BIGINT
          FROM (SELECT dp.sample_index, j, i, greatest(v, CASE WHEN j > 0 AND p[i + 1] = r[j]
                    THEN lag(v) OVER (PARTITION BY dp.sample_index ORDER BY j) + 1 ELSE 0 END) AS best
                FROM dp JOIN t USING (sample_index) WHERE i < len(p)) step)
        SELECT sample_index, round(CASE WHEN v > 0 THEN 2.0::DOUBLE * v / (len(p) + len(r)) ELSE 0 END, 6) AS "rougeL"
        FROM dp JOIN t USING (sample_index) WHERE i = len(p) AND j = len(r)""",
    "bertscore": rf"""WITH {PAIRS_SQL},
        w AS (SELECT sample_index, list_filter(regexp_split_to_array(prediction, '\s+'), lambda x: x <> '') AS p,
                     list_filter(regexp_split_to_array(reference, '\s+'), lambda x: x <> '') AS r FROM pairs),
        vocab AS (SELECT DISTINCT unnest(list_concat(p, r)) AS token FROM w),
        vec AS (SELECT token, list_transform(range(16), lambda k:
                  ('0x' || substr(md5(token), (2 * k + 1)::INTEGER, 2))::INTEGER - 127.5::DOUBLE) AS v FROM vocab),
        pt AS (SELECT sample_index, i, v FROM (SELECT sample_index, generate_subscripts(p, 1) AS i, unnest(p) AS token FROM w) JOIN vec USING (token)),
        rt AS (SELECT sample_index, j, v FROM (SELECT sample_index, generate_subscripts(r, 1) AS j, unnest(r) AS token FROM w) JOIN vec USING (token)),
        sim AS (SELECT sample_index, i, j, list_cosine_similarity(pt.v, rt.v) AS s FROM pt JOIN rt USING (sample_index)),
        pr AS (SELECT sample_index, avg(m) AS p FROM (SELECT sample_index, i, max(s) AS m FROM sim GROUP BY ALL) GROUP BY 1),
        re AS (SELECT sample_index, avg(m) AS r FROM (SELECT sample_index, j, max(s) AS m FROM sim GROUP BY ALL) GROUP BY 1)
        SELECT sample_index, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1
        FROM pr JOIN re USING (sample_index)""",
    "batch_generate": rf"""WITH {_ASKED},
        s AS (SELECT conv_id, any_value(text) AS system FROM asked WHERE in_pos = 0 AND role = 'system' GROUP BY 1),
        p AS (SELECT conv_id, string_agg('<start_of_turn>' || role || chr(10) ||
                CASE WHEN in_pos = (system IS NOT NULL)::INTEGER THEN coalesce(system || chr(10) || chr(10), '') ELSE '' END ||
                trim(text, ' ' || chr(9) || chr(10) || chr(13)) || '<end_of_turn>' || chr(10), '' ORDER BY in_pos) || '<start_of_turn>model' || chr(10) AS prompt
              FROM asked LEFT JOIN s USING (conv_id) WHERE in_pos > 0 OR role <> 'system' GROUP BY 1)
        SELECT conv_id, lower(array_to_string(list_slice(list_filter(regexp_split_to_array(prompt, '\s+'), lambda w: w <> ''), 1, 5), ' ')) AS prediction,
               NULL::VARCHAR AS prediction_error FROM p""",
    "evaluate_classification": f"""WITH {_QUALITY},
        s AS (SELECT count(*) FILTER (p = 1 AND r = 1)::DOUBLE AS tp, count(*) FILTER (p = 1) AS pp, count(*) FILTER (r = 1) AS rr,
                     avg((p = r)::INTEGER) AS acc FROM q)
        SELECT metric, round(value, 6) AS value FROM (
          SELECT 'accuracy' AS metric, acc AS value FROM s UNION ALL SELECT 'precision', tp / pp FROM s
          UNION ALL SELECT 'recall', tp / rr FROM s UNION ALL SELECT 'f1', 2 * tp / (pp + rr) FROM s)""",
    "method_choice": """SELECT conv_id, turn, CASE WHEN length(text) % 2 = 1
          AND md5('42:method:' || conv_id || ':' || turn || ':back_translation') < md5('42:method:' || conv_id || ':' || turn || ':paraphrasing')
          THEN text || '!' ELSE ('paraphrase: ' || text)[1:20] END AS augmented FROM conversations""",
    "paraphrase": """SELECT conv_id, turn, lower(trim('paraphrase: ' || text, ' ' || chr(9) || chr(10) || chr(13))) AS augmented FROM conversations""",
    "back_translate": r"""WITH w AS (SELECT conv_id, turn, text,
          list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM conversations)
        SELECT conv_id, turn, CASE WHEN len(t) > 1 THEN array_to_string(list_slice(t, 1, len(t) - 1), ' ')
            ELSE trim(text, ' ' || chr(10)) END AS augmented, NULL::VARCHAR AS augmented_error FROM w""",
}
