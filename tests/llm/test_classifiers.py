import math
import random
import zlib

import numpy as np
import pytest

from chatloom.llm import language, ordinal, quality_cascade
from chatloom.llm.quality_cascade import Rule, Text

SF = "/root/testdata/sf0.01"


# rules


def test_measures_against_plain_counting():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", "cc", " ", " ", "\n", "\t", "#", "é", "|"]) for _ in range(draw.randint(0, 120)))
        words = text.encode().split()
        t = Text(text)
        assert t.word_chars == sum(len(w.decode()) for w in words)
        lines, dup = set(), 0
        for line in text.split("\n"):
            dup += line in lines and bool(line.strip(" \t\n\v\f\r"))
            lines.add(line)
        assert t.duplicate_lines() == dup
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
        assert t.repeated_words() == len(covered)


def test_cascade_edges(edge_docs, edge_rows, no_docs):
    got = {r["doc_id"]: r for r in quality_cascade.cascade(edge_docs).collect() if r["doc_id"] is not None}
    assert got[1]["kept"] and got[2]["kept"] and got[12]["kept"]
    assert not got[3]["kept"] and not got[3]["base_failed"]  # all capitals
    assert got[5]["n_words"] == got[6]["n_words"] == got[7]["word_chars"] == 0 and got[5]["base_failed"]
    assert got[11]["n_repeat_words"] == got[11]["n_words"] == 60_000
    assert quality_cascade.cascade(edge_docs).count() == len(edge_rows)
    assert quality_cascade.cascade(no_docs).count() == 0


def test_order_is_by_rejections_per_cost_and_never_changes_the_verdict(spark, edge_docs):
    rules = [Rule(n, lambda t: False) for n in "abc"]
    assert [r.name for r in quality_cascade.ordered(rules, {"a": (1.0, 0.1), "b": (1e-3, 0.1), "c": (1e-3, 0.5)})] == ["c", "b", "a"]
    assert quality_cascade.ordered(rules, {}) == rules
    forward = {r["doc_id"]: r["kept"] for r in quality_cascade.cascade(edge_docs).collect()}
    backward = {r["doc_id"]: r["kept"] for r in quality_cascade.cascade(edge_docs, quality_cascade.RULES[::-1]).collect()}
    assert forward == backward


def test_a_rejected_text_is_not_shown_to_later_rules(spark):
    from chatloom.llm import quality_cascade as module

    prose = "this is a sentence of more than ten words that nobody should reject at all"
    docs = spark.createDataFrame([(1, prose), (2, prose + " bad")], "doc_id long, text string").coalesce(1)

    def costly(text):
        if b"bad" in text.words and len(text.words) < 100:
            raise ValueError("shown")
        return False

    order = [Rule("cheap", lambda t: b"bad" in t.words), Rule("costly", costly)]
    found = module.measure(docs.filter("doc_id = 1"), order)
    assert set(found) == {"cheap", "costly"}
    original = module.measure
    module.measure = lambda *a, **b: {"cheap": (1e-6, 0.9), "costly": (1.0, 0.0)}
    try:
        got = {r["doc_id"]: r["kept"] for r in module.cascade(docs, order).collect()}
    finally:
        module.measure = original
    assert got == {1: True, 2: False}


# language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.predict(docs.drop("lang"), language.fit(docs))
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.98 * len(rows)


def test_one_product_equals_the_kernel_machine():
    """Folding landmarks, projection and weights gives the scores of the kernel computed text by text."""
    draw = random.Random(1)
    texts = ["".join(draw.choices("abcde" if i % 2 else "defgh", k=60)) for i in range(40)]
    sets, labels = [language.ngrams(t) for t in texts], ["x" if i % 2 else "y" for i in range(40)]
    model = language.fit_sets(sets, labels)
    marks = [s for lab in "xy" for s, other in zip(sets, labels) if other == lab]

    def kernel(a, b):
        return len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))

    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    rows = np.array([[kernel(a, b) for b in marks] for a in sets])
    # with every text a landmark the approximation is exact: plain kernel ridge regression
    target = np.where(np.array(labels)[:, None] == np.array(["x", "y"])[None, :], 1.0, -1.0)
    order = [lab for lab in "xy" for other in labels if other == lab]
    own = np.where(np.array(order)[:, None] == np.array(["x", "y"])[None, :], 1.0, -1.0)
    plain = rows @ np.linalg.solve(k + language.RIDGE * len(sets) * np.eye(len(k)), own)
    assert np.allclose(model.scores(sets), plain, atol=1e-3)
    assert (model.scores(sets).argmax(axis=1) == target.argmax(axis=1)).all()


def test_every_language_is_learned(spark):
    rows = [(1000 * k + i, f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]} " * 5, f"l{k}") for k in range(300) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.fit(docs).languages) == 300


def test_language_edges(edge_docs, edge_rows, no_docs):
    model = language.fit(edge_docs)
    got = language.predict(edge_docs, model).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (5, 6, 7, 10))
    assert by_id[1]["lang_pred"] != "und" and not by_id[None]["held_out"]
    assert language.fit(no_docs) is None
    assert {r["lang_pred"] for r in language.predict(edge_docs, None).collect()} == {"und"}
    assert language.predict(no_docs, model).count() == 0
    assert (language.ngrams("ab" * 700_000) == language.ngrams("abab")).all()


# quality


@pytest.fixture(scope="module")
def rated(spark):
    folder = "/root/testdata/sf0.1"  # the smaller tables have a handful of each kind of junk
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(8)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels.select("doc_id", ordinal.grade().alias("grade"))


def test_junk_goes_and_clean_stays(rated):
    docs, ratings = rated
    even, odd = ratings.filter("doc_id % 2 = 0"), ratings.filter("doc_id % 2 = 1")
    rows = ordinal.score(docs, ordinal.fit(docs, even)).join(odd, "doc_id").collect()
    clean, junk = [r for r in rows if r["grade"] == 2], [r for r in rows if r["grade"] == 0]
    assert sum(r["kept"] for r in clean) > 0.98 * len(clean) > 500
    assert sum(not r["kept"] for r in junk) > 0.9 * len(junk) > 50
    assert all(0 <= r["tail_prob"] <= r["expected_grade"] <= 2 for r in rows)
    grades = [np.mean([r["expected_grade"] for r in rows if r["grade"] == g]) for g in (0, 1, 2)]
    assert grades[0] < grades[1] < grades[2]


def test_thresholds_are_ordered_and_gradients_fit():
    draw = np.random.default_rng(0)
    rows = [np.unique(draw.integers(0, 50, 8)).astype("<u4") for _ in range(400)]
    grades = np.array([min(2, int((r < 12).sum())) for r in rows])
    model = ordinal.fit_rows(rows, grades, 3)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(np.array([model.weights[r].sum() for r in rows]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails > 0.5).sum(axis=1) == grades) > 0.9
    assert np.allclose(ordinal.fit_rows(rows, grades, 3).weights, model.weights)


def test_likelihood_and_gradient_by_brute_force(monkeypatch):
    """The likelihood row by row from its definition, its gradient by finite differences, and a fit that plain gradient
    descent does not improve."""
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 30, 6)).astype("<u4") for _ in range(150)]
    grades = np.array([min(2, int((r < 9).sum() + draw.integers(0, 2)) // 2) for r in rows])
    seen, minimize = {}, ordinal._minimize

    def spy(value, start, *rest):
        seen.update(value=value, start=start)
        return minimize(value, start, *rest)

    monkeypatch.setattr(ordinal, "_minimize", spy)
    model = ordinal.fit_rows(rows, grades, 3)
    x = seen["start"] + draw.normal(0, 0.3, len(seen["start"]))
    columns = sorted({int(c) for r in rows for c in r if model.weights[c] != 0})
    n = len(x) - 2
    assert len(columns) == n

    def loss(x):
        weight, t = dict(zip(columns, x[:n])), [x[n], x[n] + math.exp(x[n + 1])]
        total = ordinal.RIDGE / 2 * float(x[:n] @ x[:n])
        for r, g in zip(rows, grades):
            s = sum(weight.get(int(c), 0.0) for c in r)
            below = [0.0, *(1 / (1 + math.exp(s - e)) for e in t), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total

    value, gradient = seen["value"](x)
    assert abs(value - loss(x)) < 1e-6 * value
    step = np.eye(len(x)) * 1e-5
    assert np.allclose(gradient, [(loss(x + d) - loss(x - d)) / 2e-5 for d in step], rtol=1e-4, atol=1e-4)
    best = np.r_[model.weights[columns].astype(float), model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])]
    descended = best
    for _ in range(200):
        descended = descended - 0.01 * seen["value"](descended)[1]
    assert loss(best) - loss(descended) < 1e-3 * loss(best)


def test_minimizer_finds_a_minimum():
    target = np.arange(5.0)
    found = ordinal._minimize(lambda x: (float(((x - target) ** 2).sum()), 2 * (x - target)), np.zeros(5), 50)
    assert np.allclose(found, target, atol=1e-3)


def test_quality_edges(spark, rated, edge_docs, edge_rows, no_docs):
    docs, ratings = rated
    model = ordinal.fit(docs, ratings)
    got = ordinal.score(edge_docs, model).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["kept"] and not by_id[11]["kept"]
    assert by_id[5]["score"] == by_id[6]["score"] == by_id[7]["score"]
    kept = ordinal.keep_good(edge_docs, spark.createDataFrame([(1, 2), (1, 0), (None, 1), (2, None)], "doc_id long, grade int"))
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows)  # contradicting ratings teach nothing
    assert ordinal.score(no_docs, model).count() == 0
    assert ordinal.fit(no_docs, ratings) is None
    assert all(r["kept"] and r["score"] is None for r in ordinal.score(edge_docs, None).collect())
    long = b"alpha beta " * 200_000
    assert (ordinal.Features().of(long) == ordinal.Features().of(b"alpha beta " * 20)).all()
