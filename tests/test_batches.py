"""Python steps hold few rows as objects at a time, and texts meet each of them once."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.functions.columns import stretches
from chatloom.functions.text import clean_chars
from chatloom.operators import generation, lexical, metrics


def python_steps(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("EvalPython")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"It's the {i % 7} quick brown FOX, over the lazy dog's back {i}!") for i in range(700)] + [(1000, None), (1001, "12")]
    return spark.createDataFrame(rows, "id long, text string").coalesce(1)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("quick", ["fast"]), ("dogs", ["hounds"]), ("the", ["ye"])], "word string, synonyms array<string>")


def test_stretches():
    assert list(stretches([1] * 5, 2, 100)) == [(0, 2), (2, 4), (4, 5)]
    assert list(stretches([5, 1, 1, 9, 1], 10, 6)) == [(0, 2), (2, 3), (3, 4), (4, 5)] and list(stretches([], 2, 2)) == []


def test_an_embedder_gets_few_texts_at_once(spark):
    def load():
        def embed(texts):
            if len(texts) > metrics.EMBED_ROWS or texts.str.len().sum() > 2 * metrics.EMBED_CHARS:
                raise MemoryError("too many texts")
            return texts.map(lambda t: [np.array([len(w), 1.0]) for w in t.split()])

        return embed

    rows = [(i, "a bb ccc", "a bb ccc") for i in range(1000)] + [(2000 + i, "word " * 10000, "word") for i in range(20)]
    df = spark.createDataFrame(rows, "sample_index long, prediction string, reference string").coalesce(1)
    got = metrics.bertscore(df, load).first()
    assert got["error"] is None and got["f1_mean"] == pytest.approx(1.0)


def test_cosines_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    p, r = rng.normal(size=(50, 8)), rng.normal(size=(31, 8))
    whole = metrics._greedy(p, r)
    monkeypatch.setattr(metrics, "COSINES", 100)
    assert metrics._greedy(p, r) == pytest.approx(whole)


def test_both_models_of_a_back_translation_answer_in_one_task(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(100, None)], "id long, t string").coalesce(1)
    tell = lambda: (lambda t: t.map(lambda s: f"{s} {os.getpid()}"))
    done = generation.back_translate(df, "t", tell, tell)
    assert python_steps(done) == 1
    got = {r["id"]: r["augmented"] for r in done.collect()}
    assert got.pop(100) is None and all(len(set(t.split()[2:])) == 1 and len(t.split()) == 4 for t in got.values())


def test_the_first_error_of_a_chain_counts(spark):
    def second():
        raise_for = {"bad"}

        def model(t):
            if t.isin(raise_for).any():
                raise ValueError("not this one")
            return t.str.upper()

        return model

    first = lambda: (lambda t: t.str.strip())
    df = spark.createDataFrame([(1, " a "), (2, "bad "), (3, "b"), (4, " ")], "id long, t string").coalesce(1)
    got = {r["id"]: tuple(r)[2:] for r in generation.back_translate(df, "t", first, second).collect()}
    assert got == {1: ("A", None), 2: ("bad ", "ValueError: not this one"), 3: ("B", None), 4: (" ", None)}


def test_lexical_edits_are_one_python_step(texts, lexicon):
    one = lexical.eda_one(texts, "text", "id", lexicon)
    replaced = lexical.replace_synonyms(texts, "text", "id", lexicon)
    assert python_steps(one) == 1 and python_steps(replaced) == 1
    assert "array<struct<word" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_edits_are_those_of_the_column_functions(texts, lexicon, monkeypatch):
    in_task = {r["id"]: r["augmented"] for r in lexical.eda_one(texts, "text", "id", lexicon).collect()}
    replaced = {r["id"]: r["replaced"] for r in lexical.replace_synonyms(texts, "text", "id", lexicon).collect()}
    joined = {r["id"]: r["replaced"] for r in lexical.replace_synonyms(texts, "text", "id", lexicon, by_join=True).collect()}
    words = texts.select("id", F.filter(F.split(clean_chars(F.coalesce("text", F.lit(""))), " "), lambda w: w != "").alias("words"))
    known = lexical.with_synonyms(words, "id", "words", lexicon)
    new = lexical.synonym_replace(F.col("words"), F.col("known"), lexical.edits(F.size("words"), 0.1), 42, F.col("id"))
    assert replaced == joined == {r["id"]: r["t"] for r in known.select("id", F.array_join(new, " ").alias("t")).collect()}
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 1)
    assert in_task == {r["id"]: r["augmented"] for r in lexical.eda_one(texts, "text", "id", lexicon).collect()}


def test_frequent_words_never_leave_their_texts(texts, lexicon):
    words = texts.withColumn("_own", F.array_distinct(F.split(clean_chars(F.coalesce("text", F.lit(""))), " ")))
    hot, rest = lexical._known_from_join(words, ["id"], lexicon)
    assert set(hot.value) == {"quick", "dogs", "the"} and rest.count() == 0


def test_clean_chars(spark):
    df = spark.createDataFrame([("  It’s  A-b\n'c' 9! é😀z ",), ("",), ("12",), (None,)], "t string").coalesce(1)
    assert [r["c"] for r in df.select(clean_chars(F.col("t")).alias("c")).collect()] == ["its a b c z ", "", "", None]


def test_meteor_is_one_python_step(spark, lexicon):
    rows = [(1, "the quick dogs run", "ye fast hounds run"), (2, "quick quick quick", "fast fast"), (3, "", "a"), (4, None, None)]
    df = spark.createDataFrame(rows, "sample_index long, prediction string, reference string")
    done = metrics.with_meteor(df, lexicon=lexicon)
    assert python_steps(done) == 1
    got = {r["sample_index"]: r["meteor"] for r in done.collect()}
    assert got[1] == pytest.approx(1 - 0.5 / 4**3) and got[3] == got[4] == 0.0 and 0 < got[2] < 1


def test_known_words_take_the_last_free_place():
    left = [(0, "a", "a"), (1, "b", "b"), (2, "a", "a")]
    right = [(0, "x", "x"), (1, "y", "y"), (2, "x", "x"), (3, "z", "z")]
    assert metrics._match_known(left, right, {"a": ["x", "y"], "b": ["x"]}) == [(2, 2), (1, 0), (0, 1)]


def test_bleu_counts_of_long_texts_sort_nothing(spark):
    rows = [("a b a b c", "a b c a b a b"), ("", "a"), (None, None), ("x " * 3000, "x " * 2000)]
    df = spark.createDataFrame(rows, "prediction string, reference string").coalesce(1)
    counts = df.select(metrics.bleu_counts(F.col("prediction"), F.col("reference")).alias("b"))
    assert "array_sort" not in counts._jdf.queryExecution().optimizedPlan().toString() and python_steps(counts) == 1
    got = [tuple(r["b"]) for r in counts.collect()]
    assert got[0] == (5, 7, 5, 5, 4, 4, 3, 3, 1, 2) and got[1] == (0, 1, 0, 0, 0, 0, 0, 0, 0, 0) and got[2] == (0,) * 10
    assert got[3] == (3000, 2000, 2000, 3000, 1999, 2999, 1998, 2998, 1997, 2997)
