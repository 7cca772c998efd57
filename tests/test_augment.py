import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatloom.config import AugmentationConfig
from chatloom.functions.text import words
from chatloom.operators import augment, generation, lexical, synthesis

TEXT = "the quick brown fox jumps over the lazy dog near a quick river bank today"


@pytest.fixture(scope="module")
def lexicon(spark):
    raw = [("quick", ["Fast", "swift-footed", "quick"]), ("dog", ["hound"]), ("the", ["ye"]), ("lazy", ["Idle_one", "123"])]
    return lexical.normalize_lexicon(spark.createDataFrame(raw, "word string, synonyms array<string>"))


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(TEXT.split()[i % 5 :])) for i in range(40)] + [(100, "word"), (101, "123 !"), (102, "")]
    return spark.createDataFrame(rows, "id int, text string")


def chats(spark, n=20):
    def parts(*texts):
        return [("text", t) for t in texts]

    rows = [(i, [("system", parts("Be kind.")), ("user", parts(TEXT, "and more")), ("assistant", parts(f"the dog {i}"))]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")


def test_lexicon(lexicon):
    got = {r["word"]: r["synonyms"] for r in lexicon.collect()}
    assert got == {"quick": ["fast", "swift footed"], "dog": ["hound"], "the": ["ye"], "lazy": ["idle one"]}


def edited(df, column):
    return {r["id"]: (r["words"], r["o"]) for r in df.select("id", "words", column.alias("o")).collect()}


@pytest.fixture(scope="module")
def tokens(texts, lexicon):
    return lexical.with_synonyms(texts.withColumn("words", words(F.col("text"))), "id", "words", lexicon)


def test_large_lexicon_joins_by_shuffle(texts, lexicon, tokens, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 1)
    other = lexical.with_synonyms(texts.withColumn("words", words(F.col("text"))), "id", "words", lexicon)
    assert sorted(map(str, other.collect())) == sorted(map(str, tokens.collect()))


def test_rows_of_one_word_are_merged_on_both_paths(spark, texts, monkeypatch):
    twice = spark.createDataFrame([("quick", ["swift"]), ("quick", ["fast"]), ("dog", ["hound"])], "word string, synonyms array<string>")
    split = texts.withColumn("words", words(F.col("text")))
    small = sorted(map(str, lexical.with_synonyms(split, "id", "words", twice).collect()))
    assert any("swift" in r and "fast" in r for r in small)
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 1)
    assert sorted(map(str, lexical.with_synonyms(split, "id", "words", twice).collect())) == small
    monkeypatch.setattr(lexical, "FREQUENT", 0)  # no word is broadcast
    assert sorted(map(str, lexical.with_synonyms(split, "id", "words", twice).collect())) == small


def test_missing_synthetic_rows_are_made_up_for(spark, lexicon):
    config, errors = AugmentationConfig(2.0, use_eda=True, use_synthesis=True), []
    grown = augment.extra_rows(chats(spark, 10), "id", config, lexicon, {"synthesis": failing}, errors)
    assert grown.count() == 10 and errors == ["synthesis gave 0 of 5 rows"]


def test_synonyms_replace_every_occurrence(tokens):
    got = edited(tokens, lexical.synonym_replace(F.col("words"), F.col("known"), F.lit(2), 42, F.col("id")))
    back = {"fast": "quick", "swift": "quick", "hound": "dog", "idle": "lazy"}
    changed = set()
    for before, after in got.values():
        plain = [back.get(w, w) for w in after if w not in ("footed", "one")]
        assert plain == (before or [""]) and "ye" not in after
        changed.add(len({w for w in after if w in back}))
        assert not ({"quick"} & set(after) and {"fast", "swift"} & set(after))
    assert 2 in changed and max(changed) == 2


def test_swap_is_a_permutation(tokens):
    got = edited(tokens, lexical.random_swap(F.col("words"), F.lit(3), 42, F.col("id")))
    assert all(sorted(a) == sorted(b) for a, b in got.values())
    assert any(a != b for a, b in got.values()) and got[100][1] == ["word"]


def test_insert_adds_first_synonyms(tokens):
    got = edited(tokens, lexical.random_insert(F.col("words"), F.col("known"), F.lit(2), 42, F.col("id")))
    for before, after in got.values():
        rest = list(after)
        for w in before:
            rest.remove(w)
        assert set(rest) <= {"fast", "hound", "ye", "idle one"} and len(rest) <= 2
    assert any(len(a) == len(b) + 2 for b, a in got.values())


def test_delete_is_a_subsequence(tokens):
    for p in (0.0, 0.3, 1.0):
        got = edited(tokens, lexical.random_delete(F.col("words"), p, 42, F.col("id")))
        for before, after in got.values():
            rest = iter(before)
            assert all(w in rest for w in after)
            assert len(after) == len(before) if p == 0 or len(before) <= 1 else after
            assert p < 1 or len(before) <= 1 or len(after) == 1


@pytest.mark.parametrize("num_aug", [1, 5, 9])
def test_eda_candidates(texts, lexicon, num_aug):
    rows = lexical.eda_explode(texts, "text", "id", lexicon, num_aug).collect()
    per = {}
    for r in rows:
        per.setdefault(r["id"], []).append((r["candidate"], r["op"], r["augmented"]))
    assert set(per) == {*range(40), 100}
    for i, found in per.items():
        found.sort()
        assert len(found) == num_aug + 1 and found[-1][1] == "original"
        assert found[-1][2] == ("word" if i == 100 else " ".join(TEXT.split()[i % 5 :]))


def test_fraction_of_candidates_and_disabled_operations(texts, lexicon):
    few = lexical.eda_explode(texts, "text", "id", lexicon, 0.5).filter("op <> 'original'").count()
    assert 0 < few < 41
    only = lexical.eda_explode(texts, "text", "id", lexicon, 4, lexical.rates(synonym=0, insert=0, swap=0))
    assert {r["op"] for r in only.collect()} == {"delete", "original"}
    none = lexical.eda_one(texts, "text", "id", lexicon, lexical.rates(0, 0, 0, 0)).collect()
    assert all(r["augmented"] == r["text"] for r in none)


def test_one_version_per_text_whatever_the_partitioning(texts, lexicon):
    got = {r["id"]: r["augmented"] for r in lexical.eda_one(texts, "text", "id", lexicon).collect()}
    again = {r["id"]: r["augmented"] for r in lexical.eda_one(texts.repartition(7), "text", "id", lexicon).collect()}
    assert got == again and got[101] == "123 !" and got[102] == "" and got[0] != TEXT


@pytest.mark.parametrize("factor,extra", [(1.0, 0), (0.5, 0), (1.04, 0), (1.5, 10), (2.25, 25)])
def test_sizes(spark, lexicon, factor, extra):
    grown = augment.augment(chats(spark), "id", AugmentationConfig(factor), lexicon)
    assert grown.filter("origin = 'original'").count() == 20
    assert grown.filter("origin = 'augmented'").count() == extra == augment.target_extra(20, factor)


def test_messages_keep_their_shape(spark, lexicon):
    before = chats(spark)
    after = {r["id"]: r["messages"] for r in augment.augment_messages(before, "id", lexicon).collect()}
    assert len(after) == 20
    for r in before.collect():
        new = after[r["id"]]
        assert [(m["role"], len(m["content"])) for m in new] == [(m["role"], len(m["content"])) for m in r["messages"]]
        assert new[0] == r["messages"][0]
    assert sum(after[r["id"]] != r["messages"] for r in before.collect()) > 15


def test_legacy_and_empty_messages(spark, lexicon):
    df = spark.createDataFrame([(1, [("user", "the quick dog")]), (2, [])], "id int, messages array<struct<role:string,content:string>>")
    got = {r["id"]: r["messages"] for r in augment.augment_messages(df, "id", lexicon).collect()}
    assert got[2] == [] and got[1][0]["content"][0]["type"] == "text"


def test_rows_without_messages_are_repeated(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, answer string")
    got = augment.augment(df, "id", AugmentationConfig(3.0))
    assert got.count() == 6 and {r["answer"] for r in got.collect()} == {"a", "b"}


def test_only_chosen_splits_grow(spark, lexicon):
    df = chats(spark).withColumn("split", F.when(F.col("id") < 15, "train").otherwise("test"))
    sizes = lambda c: {(r["split"], r["origin"]): r["count"] for r in augment.augment_splits(df, "id", c, lexicon).groupBy("split", "origin").count().collect()}
    assert sizes(AugmentationConfig(2.0)) == {("train", "original"): 15, ("train", "augmented"): 15, ("test", "original"): 5}
    assert sizes(AugmentationConfig(2.0, splits="all"))[("test", "augmented")] == 5


def test_methods_and_report(spark, lexicon):
    enabled = augment.enabled_methods
    assert enabled(AugmentationConfig(), {}) == ["eda"]
    assert enabled(AugmentationConfig(use_synthesis=True), {}) == ["eda"]
    assert enabled(AugmentationConfig(use_synthesis=True, use_paraphrasing=True), {"synthesis": 1, "paraphrasing": 1}) == ["paraphrasing", "synthesis"]
    assert augment.synthesis_split(11, 0.5) == (5, 6)
    row = augment.augmentation_report(augment.augment(chats(spark), "id", AugmentationConfig(1.5), lexicon), ["eda"]).first()
    assert row.asDict() == {"original_count": 20, "final_count": 30, "methods_used": "eda", "synthesis_used": False, "errors": "", "success_rate": 1.0}


def upper():
    return lambda t: t.str.upper()


def failing():
    def model(texts):
        raise RuntimeError("down")

    return model


def picky():
    def model(texts):
        if (texts == "bad").any():
            raise ValueError("bad text")
        return texts.str.upper()

    return model


def test_generate_survives_bad_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "c")], "id int, p string").coalesce(1)
    got = {r["id"]: (r["generated"], r["generated_error"]) for r in generation.generate(df, "p", picky, batch_size=2).collect()}
    assert got[1] == ("A", None) and got[4] == ("C", None) and got[3] == (None, None)
    assert got[2][0] is None and "bad text" in got[2][1]


def test_retries_are_bounded(spark):
    def flaky():
        calls = {"n": 0}

        def model(texts):
            calls["n"] += 1
            if calls["n"] < 3:
                raise RuntimeError("not yet")
            return texts

        return model

    df = spark.createDataFrame([("x",)], "p string")
    assert generation.generate(df, "p", flaky, retries=2).first()["generated"] == "x"
    assert generation.generate(df, "p", flaky, retries=0).first()["generated_error"] == "RuntimeError: not yet"


def test_back_translation_and_paraphrase(spark):
    df = spark.createDataFrame([(1, " hello "), (2, "  "), (3, None)], "id int, t string")
    done = lambda d: {r["id"]: r["augmented"] for r in d.collect()}
    blank = lambda: (lambda t: t * 0)
    assert done(generation.back_translate(df, "t", upper, lambda: (lambda t: t + "!"))) == {1: "HELLO !", 2: "  ", 3: None}
    assert done(generation.back_translate(df, "t", upper, failing)) == {1: " hello ", 2: "  ", 3: None}
    assert done(generation.back_translate(df, "t", upper, blank))[1] == "hello"
    assert done(generation.paraphrase(df, "t", upper))[1] == "PARAPHRASE:  HELLO"


def test_methods_are_tried_until_one_changes_the_text(spark, lexicon):
    df = chats(spark, 6)
    same = lambda: (lambda t: t.str.removeprefix("paraphrase: "))
    models = {"paraphrasing": (same,), "back_translation": (upper, upper)}
    got = augment.augment_messages(df, "id", None, methods=["paraphrasing", "back_translation"], models=models).collect()
    assert all(m["content"][0]["text"].isupper() for r in got for m in r["messages"] if m["role"] != "system")
    mixed = augment.augment_messages(df, "id", lexicon, methods=["eda", "paraphrasing"], models={"paraphrasing": (failing,)})
    texts = [m["content"][0]["text"] for r in mixed.collect() for m in r["messages"] if m["role"] == "user"]
    assert any(t != TEXT for t in texts)


PROMPT = """Here are sample dialogues from a training set. Write 2 more dialogues that could stand beside them: alike in tone, length and layout, but about other things.

Example 1:
User: hi
Assistant: yo


Now write the 2 dialogues. Only a user and an assistant speak, in turns as in the samples. No subject may come twice, nothing may contradict itself, and every answer must be of real use to the user.

Put every dialogue between fences, laid out like this:
```
User: (what the user writes)
Assistant: (what the assistant answers)
```
"""


def test_prompt_text(spark):
    df = spark.createDataFrame([(1, [("system", "s"), ("user", "hi"), ("assistant", "yo")])], "id int, messages array<struct<role:string,content:string>>")
    got = synthesis.synthesis_prompts(df, 5, "id", max_batch_size=3).orderBy("batch").collect()
    assert [r["num_samples"] for r in got] == [3, 2] and got[1]["prompt"] == PROMPT


def test_parsing(spark):
    text = "x\n```\nUser: a\nnote\n Assistant:  b \n```\n```\nUser: lonely\n```\n```json\nnothing\n```User: c\nAssistant:d\nUser: e"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    flat = lambda d: [[(m["role"], m["content"][0]["text"]) for m in r["messages"]] for r in d.orderBy("block").collect()]
    assert flat(synthesis.parse_conversations(df, "t")) == [
        [("user", "a"), ("assistant", "b")], [("user", "c"), ("assistant", "d"), ("user", "e")],
    ]
    assert [len(c) for c in flat(synthesis.parse_conversations(df, "t", "sys"))] == [3, 4]


def test_synthesis_is_bounded(spark):
    made = synthesis.synthesize(chats(spark), 7, "id", failing, max_batch_size=3)
    assert made.count() == 0
    author = lambda: (lambda p: pd.Series(["```\nUser: a\nAssistant: b\n```" * 9] * len(p)))
    assert synthesis.synthesize(chats(spark), 7, "id", author, max_batch_size=3).count() == 7
