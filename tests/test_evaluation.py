import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatloom.operators import evaluation, lexical, metrics, training

WORDS = "the cat sat on a mat and dog ran fast running runs cats".split()


def sentences(n, seed, lines=1, length=12):
    r = random.Random(seed)
    return ["\n".join(" ".join(r.choice(WORDS) for _ in range(r.randint(1, length))) for _ in range(r.randint(1, lines))) for _ in range(n)]


@pytest.fixture(scope="module")
def samples():
    rows = list(zip(range(60), sentences(60, 1, 3), sentences(60, 2, 3)))
    return rows + [(60, "", "x y"), (61, "same words here now", "same words here now"), (62, "...", "!!!")]


@pytest.fixture(scope="module")
def pairs(spark, samples):
    return spark.createDataFrame(samples, "sample_index long, prediction string, reference string")


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def f_measure(hits, p, r):
    return 2 * hits / (p + r) if hits else 0.0


def row_scores(pairs, column):
    return {r["sample_index"]: r["s"] for r in pairs.select("sample_index", column.alias("s")).collect()}


def rouge_tokens(t):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()


@pytest.mark.parametrize("n", [1, 2])
def test_rouge_n(pairs, samples, n):
    got = row_scores(pairs, metrics.rouge_n(F.col("prediction"), F.col("reference"), n))
    for i, p, r in samples:
        a, b = grams(rouge_tokens(p), n), grams(rouge_tokens(r), n)
        assert got[i] == pytest.approx(f_measure(sum((a & b).values()), sum(a.values()), sum(b.values())))


def test_rouge_l(pairs, samples):
    got = row_scores(pairs, metrics.rouge_l(F.col("prediction"), F.col("reference")))
    for i, p, r in samples:
        a, b = rouge_tokens(p), rouge_tokens(r)
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for x in range(len(a)):
            for y in range(len(b)):
                table[x + 1, y + 1] = table[x, y] + 1 if a[x] == b[y] else max(table[x, y + 1], table[x + 1, y])
        assert got[i] == pytest.approx(f_measure(table[-1, -1], len(a), len(b)))


def test_rouge_lsum_of_one_line_is_rouge_l(spark):
    one = spark.createDataFrame(list(zip(range(30), sentences(30, 3), sentences(30, 4))), "sample_index long, prediction string, reference string")
    p, r = F.col("prediction"), F.col("reference")
    assert row_scores(one, metrics.rouge_lsum(p, r)) == row_scores(one, metrics.rouge_l(p, r))


def test_rouge_lsum_known_example(spark):
    # published example: reference w1..w5, candidate lines "w1 w2 w6 w7 w8" and "w1 w3 w8 w9 w5" cover w1 w2 w3 w5
    df = spark.createDataFrame([(0, "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5")], "sample_index long, prediction string, reference string")
    assert row_scores(df, metrics.rouge_lsum(F.col("prediction"), F.col("reference")))[0] == pytest.approx(2 * 4 / (10 + 5))


def test_rouge_means(pairs, samples):
    got = metrics.rouge(pairs).first().asDict()
    p, r = F.col("prediction"), F.col("reference")
    for name, column in metrics.rouge_columns(p, r).items():
        assert got[name] == pytest.approx(np.mean(list(row_scores(pairs, column).values())))


def corpus_bleu(samples):
    hits, total, lengths = [0] * 4, [0] * 4, [0, 0]
    for _, p, r in samples:
        p = p.replace("\n", " ").replace(".", " . ").replace("!", " ! ").split()
        r = r.replace("\n", " ").replace(".", " . ").replace("!", " ! ").split()
        lengths = [lengths[0] + len(p), lengths[1] + len(r)]
        for n in range(4):
            a, b = grams(p, n + 1), grams(r, n + 1)
            hits[n] += sum((a & b).values())
            total[n] += sum(a.values())
    if not min(hits):
        return 0.0
    bp = 1.0 if lengths[0] > lengths[1] else math.exp(1 - lengths[1] / lengths[0])
    return bp * math.exp(sum(math.log(h / t) for h, t in zip(hits, total)) / 4)


def test_bleu(spark, pairs, samples):
    assert metrics.bleu(pairs).first()["bleu"] == pytest.approx(corpus_bleu(samples))
    assert metrics.bleu(pairs.filter("sample_index = 61")).first()["bleu"] == pytest.approx(1.0)
    assert metrics.bleu(pairs.filter("sample_index = 60")).first()["bleu"] == 0.0


STEMS = {"running": "run", "runs": "run", "cats": "cat"}
SYNONYMS = {"dog": {"cat"}, "fast": {"mat", "on"}, "ran": {"running"}}


def slow_meteor(p, r):
    p, r = p.split(), r.split()
    left, right, found = list(enumerate(p)), list(enumerate(r)), []
    stem = lambda w: STEMS.get(w, w)
    for fits in (lambda a, b: a == b, lambda a, b: stem(a) == stem(b), lambda a, b: b in SYNONYMS.get(a, ())):
        for a in list(reversed(left)):
            match = next((b for b in reversed(right) if fits(a[1], b[1])), None)
            if match:
                left.remove(a)
                right.remove(match)
                found.append((a[0], match[0]))
    if not found:
        return 0.0
    found.sort()
    chunks = 1 + sum(1 for a, b in zip(found, found[1:]) if (b[0] - a[0], b[1] - a[1]) != (1, 1))
    precision, recall = len(found) / len(p), len(found) / len(r)
    mean = precision * recall / (0.9 * precision + 0.1 * recall)
    return mean * (1 - 0.5 * (chunks / len(found)) ** 3)


def test_meteor(spark, pairs, samples):
    lexicon = spark.createDataFrame([(w, sorted(s)) for w, s in SYNONYMS.items()], "word string, synonyms array<string>")
    words_only = pairs.filter("sample_index < 62")
    got = {r["sample_index"]: r["meteor"] for r in metrics.with_meteor(words_only, lexicon=lexicon).collect()}
    for i, p, r in samples[:62]:
        assert got[i] == pytest.approx(slow_meteor(p, r)), (p, r)
    plain = {r["sample_index"]: r["meteor"] for r in metrics.with_meteor(words_only).collect()}
    assert plain[61] == pytest.approx(1 - 0.5 * (1 / 4) ** 3)


VECTORS = {"a": [1.0, 0.0], "b": [0.0, 2.0], "c": [1.0, 1.0]}


def embedder():
    return lambda texts: texts.map(lambda t: [VECTORS[w] for w in t.split()])


def test_bertscore(spark):
    df = spark.createDataFrame([(0, "a b", "c"), (1, "a", "a"), (2, "", "a")], "sample_index long, prediction string, reference string")
    score = metrics.bertscore_columns(F.col("prediction"), F.col("reference"), embedder)
    got = {r["sample_index"]: tuple(r["s"])[:3] for r in df.select("sample_index", score.alias("s")).collect()}
    half = math.sqrt(0.5)
    assert got[0] == pytest.approx((half, half, half)) and got[1] == pytest.approx((1, 1, 1)) and got[2] == (0, 0, 0)
    assert metrics.bertscore(df, embedder).first()["f1_mean"] == pytest.approx((half + 1) / 3)


def test_classes(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("d", "c")]
    df = spark.createDataFrame(rows, "prediction string, reference string")
    got = {r["class"]: r["f1"] for r in metrics.f1_per_class(df).collect()}
    want = {k: f_measure(sum(p == r == k for p, r in rows), sum(p == k for p, _ in rows), sum(r == k for _, r in rows)) for k in "abcd"}
    assert got == pytest.approx(want)
    assert metrics.f1(df).first()["f1"] == pytest.approx(sum(want.values()) / 4)
    binary = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (1, 1)], "prediction int, reference int")
    assert metrics.f1(binary).first()["f1"] == pytest.approx(2 / 3)
    assert metrics.precision_recall(binary).first().asDict() == pytest.approx({"precision": 2 / 3, "recall": 2 / 3})
    none = spark.createDataFrame([(0, 0)], "prediction int, reference int")
    assert metrics.precision_recall(none).first().asDict() == {"precision": 0.0, "recall": 0.0}


def test_suite(spark, pairs):
    got = {r["metric"]: (r["value"], r["error"]) for r in metrics.evaluate_metrics(pairs, metrics=["exact_match", "bleu", "rouge", "meteor", "bertscore", "nope", "f1"]).collect()}
    assert set(got) == {"exact_match", "bleu", "rouge1", "rouge2", "rougeL", "rougeLsum", "meteor", "bertscore", "nope", "f1"}
    assert got["bertscore"] == (None, "no embedder given") and got["nope"] == (None, "unknown metric")
    assert all(0 <= v <= 1 for v, _ in got.values() if v is not None)
    assert metrics.metric_suite("translation") == ("bleu", "meteor") and metrics.metric_suite("odd") == ("bertscore", "rouge")
    assert metrics.metric_suite("qa", ["bleu"]) == ("exact_match", "bertscore") and metrics.metric_suite(None, ["bleu"]) == ("bleu",)


SCHEMA = "id int, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def test_prepare_eval(spark):
    def m(role, *texts):
        return (role, [("text", t) for t in texts])

    rows = [(1, [m("system", "s"), m("tool", "t"), m("user", "u"), m("assistant", " a", "b "), m("user", "later")]),
            (2, [m("user", "u")]), (3, [m("assistant", "a"), m("user", "u")]), (4, [])]
    got = {r["id"]: r for r in evaluation.prepare_eval(spark.createDataFrame(rows, SCHEMA), ["id"]).collect()}
    assert set(got) == {1, 2}
    assert [x["role"] for x in got[1]["input"]] == ["system", "user"] and got[1]["reference"] == "a b"
    assert got[2]["reference"] == ""
    legacy = spark.createDataFrame([(1, [("user", "u"), ("assistant", " x ")])], "id int, messages array<struct<role:string,content:string>>")
    assert evaluation.prepare_eval(legacy, ["id"]).first()["reference"] == "x"
    assert evaluation.infer_modality(legacy).first()["modality"] == "text"


def test_images(spark):
    df = spark.createDataFrame([(1, [("user", [("image", None, "data:image/png;base64,aGk"), ("text", "t", None)])])],
                               "id int, messages array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>")
    assert evaluation.infer_modality(df).first()["modality"] == "vision"
    assert bytes(evaluation.extract_images(df).first()["images"][0]) == b"hi"
    empty = df.withColumn("messages", F.filter("messages", lambda m: F.lit(False)))
    assert evaluation.extract_images(empty, required=False).first()["images"] == []
    with pytest.raises(Exception, match="no image"):
        evaluation.extract_images(empty).collect()
    shown = evaluation.batch_generate(evaluation.extract_images(df), lambda: (lambda prompts, images: pd.Series([f"{len(i)}:{p.count('<start_of_image>')}" for p, i in zip(prompts, images)])), column="messages", images_col="images")
    assert shown.first()["prediction"] == "1:1"


def test_align(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "sample_index int, prediction string")
    r = spark.createDataFrame([(2, "x"), (1, "y")], "sample_index int, reference string")
    assert {tuple(x) for x in evaluation.align(p, r).collect()} == {(1, "a", "y"), (2, "b", "x")}
    with pytest.raises(ValueError):
        evaluation.align(p, r.filter("sample_index = 1"))


def test_overlap_respects_multiplicity(spark):
    rows = [([*a], [*b]) for a, b in combinations(["", "a", "aab", "bbba", "abcabc", "cc"], 2)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", metrics.overlap(F.col("a"), F.col("b")).alias("n")).collect():
        assert r["n"] == sum((Counter(r["a"]) & Counter(r["b"])).values())


def test_missing_predictions_count(spark):
    rows = [(0, "a", "a"), (1, None, "a"), (2, "b", "a"), (3, None, "b")]
    df = spark.createDataFrame(rows, "sample_index long, prediction string, reference string")
    assert metrics.exact_match(df).first()[0] == 0.25
    got = metrics.precision_recall(df, "a").first()
    assert (got["precision"], got["recall"]) == (1.0, pytest.approx(1 / 3))
    per_class = {r["class"]: r["f1"] for r in metrics.f1_per_class(df).collect()}
    assert per_class == {"a": pytest.approx(0.5), "b": 0.0}
    done = {r["metric"]: r["value"] for r in metrics.evaluate_metrics(df, metrics=("rouge", "bleu", "meteor")).collect()}
    assert done["rouge1"] == 0.25 and done["rougeLsum"] == 0.25 and done["meteor"] > 0


def test_a_failing_metric_costs_only_itself(spark):
    df = spark.createDataFrame([(0, "a", "a")], "sample_index long, prediction string, reference string")

    def broken():
        raise RuntimeError("no weights")

    got = {r["metric"]: r for r in metrics.evaluate_metrics(df, metrics=("bertscore", "rouge"), embedder=broken).collect()}
    assert got["bertscore_f1_mean"]["value"] is None and "no weights" in got["bertscore_f1_mean"]["error"]
    assert got["rouge1"]["value"] == 1.0 and got["rouge1"]["error"] is None


def test_text_labels_need_a_positive_one(spark):
    df = spark.createDataFrame([(0, "yes", "yes"), (1, "no", "no")], "sample_index long, prediction string, reference string")
    got = metrics.evaluate_metrics(df, metrics=("f1", "accuracy")).collect()
    assert {r["metric"]: r["value"] for r in got} == {"f1": None, "accuracy": 1.0}
    assert metrics.evaluate_metrics(df, metrics=("f1",), positive="yes").first()["value"] == 1.0


def test_chat_text(spark):
    df = spark.createDataFrame([(1, [("system", [("text", "S")]), ("user", [("text", " hi "), ("image", None)]), ("assistant", [("text", "yo")])])], SCHEMA)
    want = "<start_of_turn>user\nS\n\nhi<start_of_image><end_of_turn>\n<start_of_turn>model\nyo<end_of_turn>\n"
    assert training.render_chat(df).first()["text"] == want
    assert training.render_chat(df, add_generation_prompt=True).first()["text"] == want + "<start_of_turn>model\n"
    with pytest.raises(ValueError):
        training.render_chat(df.drop("messages"))
    with pytest.raises(ValueError):
        training.require_messages(df.drop("messages"))
    with pytest.raises(Exception, match="missing 'messages'"):
        training.require_messages(spark.createDataFrame([(1, [])], SCHEMA)).collect()
    assert training.require_messages(df).count() == 1


def test_standardize(spark):
    df = spark.createDataFrame([([("human", "q"), ("gpt", "a"), ("critic", "c")],)], "conversations array<struct<`from`:string,value:string>>")
    got = training.standardize_conversations(df).first()["messages"]
    assert [(m["role"], m["content"]) for m in got] == [("user", "q"), ("assistant", "a"), ("critic", "c")]




@pytest.mark.parametrize("instruction,response", [([1], [2]), ([1, 3], [2, 3]), ([1, 1, 2], [2, 2])])
def test_response_masks(spark, instruction, response):
    r = random.Random(5)
    rows = [(i, [r.choice([1, 2, 3, 4]) for _ in range(r.randint(0, 30))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, ids array<int>")
    got = df.select("id", training.mask_non_response(F.col("ids"), instruction, response).alias("l")).collect()
    for x in got:
        ids = rows[x["id"]][1]
        starts = {i + len(response) for i in range(len(ids)) if ids[i : i + len(response)] == response}
        stops = {i for i in range(len(ids)) if ids[i : i + len(instruction)] == instruction}
        inside, want = False, []
        for i, t in enumerate(ids):
            inside = (inside or i in starts) and i not in stops
            want.append(t if inside else -100)
        assert x["l"] == want


def test_token_metrics(spark):
    rows = [(0, [1, 2, 3], [1, 5, -100], 1.0), (0, [4], [4], 1.0), (1, [7, 7], [-100, 7], 3.0)]
    df = spark.createDataFrame(rows, "batch_id int, predictions array<int>, labels array<int>, loss double")
    assert training.token_accuracy(df).first()["accuracy"] == 0.75
    assert training.batched_token_metrics(df).first().asDict() == {"accuracy": 0.75, "perplexity": 4.0, "loss": 2.0}
    none = df.withColumn("labels", F.transform("labels", lambda x: F.lit(-100))).withColumn("loss", F.lit(None).cast("double"))
    assert training.batched_token_metrics(none).first().asDict() == {"accuracy": 0.0, "perplexity": 1.0, "loss": 0.0}
    assert training.token_accuracy(none).first()["accuracy"] == 0.0
    losses = spark.createDataFrame([(3.0,), (0.0,), (-1.0,)], "l double")
    assert [r[0] for r in losses.select(training.perplexity(F.col("l"))).collect()] == [8.0, 1.0, 1.0]
    masked = spark.createDataFrame([([5, 0, 262144, 9],)], "i array<int>").select(training.mask_labels(F.col("i"), [0, 9]))
    assert masked.first()[0] == [5, -100, -100, -100]
    assert spark.createDataFrame([([0.1, 0.9, 0.9],)], "l array<float>").select(training.argmax_tokens(F.col("l"))).first()[0] == 1
