import json

import pytest
from pyspark.sql import functions as F

from chatloom.config import AugmentationConfig, EvaluationConfig, ManualSplit, NamedSplits, NoSplit, PreprocessingConfig
from chatloom.operators import catalog
from chatloom.plans import evaluate, preprocess
from chatloom.sources import files, processed
from chatloom.streaming.chat_stream import chat_stream, write_stream

MAPPINGS = {
    "user_field": {"type": "column", "value": "q"},
    "assistant_field": {"type": "template", "value": "{a}."},
}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "x.CSV", 'id,q\n1,"two\nlines, ""quoted"""\n2,plain\n')
    got = files.read_any(spark, path)
    assert got.dtypes[0] == ("id", "int")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    assert files.read_csv(spark, path, "id long, q string").dtypes[0] == ("id", "bigint")


def test_json(spark, tmp_path):
    rows = [{"id": 1, "m": {"role": "user", "content": "x"}}, {"id": 2, "m": None}]
    lines = "\n".join(map(json.dumps, rows))
    for name, text in (("a.json", json.dumps(rows)), ("b.json", json.dumps(rows, indent=2)), ("c.json", lines), ("d.jsonl", lines)):
        got = files.read_any(spark, write(tmp_path / name, text)).orderBy("id").collect()
        assert [r["id"] for r in got] == [1, 2] and got[0]["m"]["role"] == "user"


def test_json_files_are_told_one_by_one(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    write(folder / "a.json", json.dumps([{"id": 1}, {"id": 2}]))
    write(folder / "b.json", "no json\n" + "\n".join(json.dumps({"id": i}) for i in range(3, 9)))
    write(folder / "c.json", json.dumps({"id": 9}, indent=2))
    got = files.read_any(spark, str(folder), schema="id int").collect()
    assert sorted(r["id"] or 0 for r in got) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert files.read_any(spark, str(folder / "b.json"), schema="id int", lines=True).count() == 7


def test_text_and_unknown(spark, tmp_path):
    got = files.read_any(spark, write(tmp_path / "x.txt", "a\n\nb\n"))
    assert got.columns == ["text"] and [r["text"] for r in got.collect()] == ["a", "", "b"]
    for bad in ("x.xlsx", "x.pdf", "noext"):
        with pytest.raises(ValueError):
            files.read_any(spark, str(tmp_path / bad))


def test_images(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(b"\x89PNG one")
    rows = spark.createDataFrame([(1, str(tmp_path / "one.png")), (2, "nowhere.png")], "id int, img string")
    got = {r["id"]: r["img"] for r in files.attach_images(rows, "img", files.read_images(spark, str(tmp_path))).collect()}
    assert bytes(got[1]["bytes"]) == b"\x89PNG one" and got[2] is None
    assert files.file_sizes(spark, str(tmp_path)) == 8


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "src")
    spark.range(40).selectExpr(
        "id", "concat('question ', id) as q", "if(id % 10 = 0, '', concat('answer ', id)) as a",
        "case when id < 20 then 'Train' when id < 30 then 'dev' else 'other' end as split",
    ).write.partitionBy("split").parquet(path)
    return path


def test_splits(spark, table):
    got = files.read_named_splits(spark, table, "Train", "dev").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 20, "test": 10}
    one = files.read_single_split(spark, table, "other")
    assert one.count() == 10 and "split" not in one.columns
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()
    for call in (lambda: files.read_single_split(spark, table, None), lambda: files.read_named_splits(spark, table, "", "dev")):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("names,want", [
    (["train", "test"], ("train", "test")), (["TRAIN", "Validation"], ("TRAIN", "Validation")),
    (["train", "training", "test", "eval"], ("training", "eval")), (["a", "b"], ("a", None)), (["x", "test"], ("x", "test")),
])
def test_split_names(names, want):
    assert processed.choose_splits(names) == want


def test_no_splits():
    with pytest.raises(FileNotFoundError):
        processed.choose_splits([])


def test_write_list_read_drop(spark, tmp_path):
    base = str(tmp_path / "base")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("test"))
    entry = catalog.write_processed(df, base, "mine", user_id="u", config={"x": 1}).first()
    again = catalog.write_processed(df, base, "mine", user_id="u", config={"x": 1}).first()
    other = catalog.write_processed(df, base, "other", user_id="v", modality="vision").first()
    assert entry["processed_dataset_id"] == again["processed_dataset_id"] != other["processed_dataset_id"]
    assert [(s["split_name"], s["num_rows"]) for s in entry["splits"]] == [("train", 7), ("test", 3)]
    pid = entry["processed_dataset_id"]
    listed = catalog.list_datasets(catalog.manifest(spark, base), "u").collect()
    assert [(r["dataset_name"], r["num_examples"], r["splits"], r["modality"]) for r in listed] == [("mine", 10, ["train", "test"], "text")]
    train, test = processed.read_processed(spark, base, pid)
    assert sorted(r["id"] for r in test.collect()) == [7, 8, 9] and train.count() == 7
    shown = catalog.split_previews(spark, base, pid, "u", 2)
    assert [(s["split_name"], len(s["samples"])) for s in shown] == [("train", 2), ("test", 2)]
    with pytest.raises(LookupError):
        catalog.get_dataset(spark, base, pid, "v")
    with pytest.raises(LookupError):
        catalog.drop_dataset(spark, base, pid, "v")
    assert catalog.drop_dataset(spark, base, pid, "u") > 0 and not catalog.dataset_exists(spark, base, pid)
    assert [r["dataset_name"] for r in catalog.manifest(spark, base).collect()] == ["other"]
    with pytest.raises(FileNotFoundError):
        processed.read_processed(spark, base, pid)


def test_empty_splits(spark, tmp_path):
    df = spark.range(3).withColumn("split", F.lit("train"))
    with pytest.raises(ValueError):
        catalog.write_processed(df.limit(0), str(tmp_path), "n", user_id="u")
    with pytest.raises(ValueError):
        catalog.write_processed(df, str(tmp_path), "", user_id="u")
    with pytest.raises(ValueError):
        catalog.write_processed(df.drop("split"), str(tmp_path), "n", user_id="u")


def test_raw_files(spark, tmp_path):
    base, path = str(tmp_path / "base"), write(tmp_path / "my file.csv", "a\n1\n")
    row = catalog.register_raw(spark, base, path, "u").first()
    assert (row["filename"], row["content_type"], row["size_bytes"]) == ("my_file.csv", "text/csv", 4)
    assert catalog.get_raw(spark, base, row["dataset_id"], "u").first()["path"] == path
    with pytest.raises(LookupError):
        catalog.get_raw(spark, base, row["dataset_id"], "v")
    catalog.drop_raw(spark, base, row["dataset_id"], "u")
    assert catalog.raw_manifest(spark, base).count() == 0
    seen = catalog.profile(files.read_any(spark, path), path)
    assert (seen.columns, seen.num_examples, seen.sample, seen.size_bytes) == (["a"], 1, [{"a": 1}], 4)


def test_preview_keeps_only_what_it_shows(spark):
    df = spark.range(100).withColumn("split", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    got = catalog.preview(df, "id", 2)
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 4]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_preparation_job(spark, table, tmp_path):
    base = str(tmp_path / "base")
    config = PreprocessingConfig(MAPPINGS, split=NamedSplits("Train", "dev"), augmentation=AugmentationConfig(1.5, use_eda=True))
    lexicon = spark.createDataFrame([("answer", ["reply"])], "word string, synonyms array<string>")
    entry = preprocess.process_dataset(spark, table, base, "n", "language_modeling", config, key="id", user_id="u", lexicon=lexicon).first()
    assert {s["split_name"]: s["num_rows"] for s in entry["splits"]} == {"train": 30, "test": 10}
    train, _ = processed.read_processed(spark, base, entry["processed_dataset_id"])
    assert train.filter("origin = 'augmented'").count() == 10
    single = PreprocessingConfig(MAPPINGS, split=ManualSplit(test_size=0.2, split="other"))
    assert preprocess.load_splits(spark, table, single, "id").filter("split = 'train'").count() == 8
    with pytest.raises(ValueError):
        preprocess.load_splits(spark, table, PreprocessingConfig(MAPPINGS), "id")
    part = spark.read.parquet(table).drop("split")
    part.write.parquet(str(tmp_path / "flat.parquet"))
    whole = preprocess.load_splits(spark, str(tmp_path / "flat.parquet"), PreprocessingConfig(MAPPINGS, split=NoSplit(5)), "id")
    assert whole.count() == 5 and whole.filter("split = 'train'").count() == 5


def test_synthetic_rows_share_the_schema(spark, table, tmp_path):
    base = str(tmp_path / "base")
    growth = AugmentationConfig(2.0, use_synthesis=True, synthesis_ratio=1.0)
    config = PreprocessingConfig(MAPPINGS, split=NoSplit(split="dev"), augmentation=growth)
    author = lambda: (lambda p: p.map(lambda _: "```\nUser: a\nAssistant: b\n```" * 10))
    entry = preprocess.process_dataset(
        spark, table, base, "n", "language_modeling", config, key="id", user_id="u", models={"synthesis": author}
    ).first()
    rows = spark.read.parquet(entry["splits"][0]["path"])
    grown = {r["origin"]: (r["count"], r["ids"]) for r in rows.groupBy("origin").agg(F.count("*").alias("count"), F.count("id").alias("ids")).collect()}
    assert grown == {"original": (10, 10), "synthetic": (10, 0)}


def test_evaluation_job(spark, table, tmp_path):
    base = str(tmp_path / "base")
    config = PreprocessingConfig(MAPPINGS, split=NamedSplits("Train", "dev"))
    entry = preprocess.process_dataset(spark, table, base, "n", "language_modeling", config, key="id", user_id="u").first()

    def model():
        return lambda prompts: prompts.str.extract(r"question (\d+)")[0].map(lambda n: f"answer {n}." if int(n) % 2 else "no")

    done = evaluate.evaluate_dataset(
        spark, base, entry["processed_dataset_id"], "id", model,
        EvaluationConfig(metrics=("exact_match", "rouge"), max_samples=6, num_sample_results=2),
    )
    scores = {r["metric"]: r["value"] for r in done.metrics.collect()}
    assert scores["exact_match"] == 0.5 and done.num_samples == 6 and done.num_evaluated == 6
    assert sorted(r["id"] for r in done.answers.collect()) == [20, 21, 22, 23, 24, 25]
    assert done.samples.count() == 2 and set(done.samples.columns) == {"id", "input", "prediction", "reference"}
    only_train = preprocess.process_dataset(
        spark, table, base, "t", "language_modeling", PreprocessingConfig(MAPPINGS, split=NoSplit(split="other")), key="id", user_id="u"
    ).first()["processed_dataset_id"]
    with pytest.raises(ValueError):
        evaluate.evaluate_dataset(spark, base, only_train, "id", model, EvaluationConfig())


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(25).selectExpr("id", "'q' as q", "if(id = 3, '', 'a') as a")
    rows.write.parquet(src)
    chat = chat_stream(spark, src, rows.schema, "language_modeling", {**MAPPINGS, "assistant_field": {"type": "column", "value": "a"}}, keep=["id"])
    for _ in range(2):  # the second run finds nothing new
        write_stream(chat, out, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(out).count() == 24


def test_one_name_for_two_sources(spark, tmp_path):
    base, config = str(tmp_path / "base"), PreprocessingConfig(field_mappings=MAPPINGS, split=NoSplit())
    ids = []
    for name, n in (("x", 4), ("y", 6), ("x", 4)):
        path = str(tmp_path / f"{name}.parquet")
        spark.range(n).selectExpr("id", "concat('q', id) as q", "concat('a', id) as a").write.mode("overwrite").parquet(path)
        entry = preprocess.process_dataset(spark, path, base, "same", "language_modeling", config, key="id", user_id="u")
        ids.append(entry.first()["processed_dataset_id"])
    assert ids[0] == ids[2] != ids[1]
    listed = {r["processed_dataset_id"]: r for r in catalog.manifest(spark, base).collect()}
    assert {i: spark.read.parquet(r["splits"][0]["path"]).count() for i, r in listed.items()} == {ids[0]: 4, ids[1]: 6}


def test_an_id_is_not_taken_over(spark, tmp_path):
    rows = spark.range(3).selectExpr("id", "'train' as split")
    catalog.write_processed(rows, str(tmp_path), "one", user_id="u", processed_id="id")
    with pytest.raises(ValueError, match="another configuration"):
        catalog.write_processed(rows, str(tmp_path), "two", user_id="u", processed_id="id")


def test_a_failed_rerun_leaves_the_dataset(spark, tmp_path):
    good = spark.range(3).selectExpr("id", "'train' as split")
    catalog.write_processed(good, str(tmp_path), "one", user_id="u", processed_id="id")
    with pytest.raises(Exception):
        catalog.write_processed(good.selectExpr("raise_error('x') as id", "split"), str(tmp_path), "one", user_id="u", processed_id="id")
    entry = catalog.manifest(spark, str(tmp_path)).first()
    assert spark.read.parquet(entry["splits"][0]["path"]).count() == 3
