import os
import random

import pytest

import corpus_pipeline

from chatloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean prose with exact copies, near copies, junk and labels."""
    draw = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "bdfglmnprst" for b in ("an", "el", "or", "ist", "une", "aro")]
    docs, labels = [], []
    for i in range(300):
        words = draw.choices(vocabulary, k=draw.randint(30, 120))
        kind = i % 10
        if kind == 9:
            words = [w + "###" for w in words]
        text = " ".join(words)
        if kind == 7:
            text = docs[-1][1]
        if kind == 8:
            text = docs[-2][1] + " tail"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(kind != 9), 0))
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages_take_effect(spark, folder, tmp_path):
    path, docs = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    names, kept = frame.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, frame, path).write.parquet(f"{tmp_path}/{number}")
        frame = spark.read.parquet(f"{tmp_path}/{number}")
        assert frame.columns == names
        kept.append([r["doc_id"] for r in frame.collect()])
    quality, exact, near, mixed = kept
    assert sorted(quality) == [i for i in range(300) if i % 10 != 9]
    assert sorted(exact) == [i for i in quality if i % 10 != 7] or sorted(exact) == sorted(set(quality) - {i for i in range(300) if i % 10 == 7})
    assert sorted(near) == [i for i in range(300) if i % 10 < 7]
    assert set(mixed) <= set(near)
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, path).collect()
    assert sorted(r["doc_id"] for r in pieces if r["start"] == 0) == sorted(mixed)


def test_run_equals_its_stages(spark, folder):
    path, _ = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
    whole = sorted((r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, path).filter("start = 0").collect())
    by_stage = sorted((r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.STAGES[-1][1](spark, frame, path).filter("start = 0").collect())
    assert whole == by_stage


@pytest.mark.parametrize("number", range(5))
def test_stages_on_edges(spark, folder, edge_docs, no_docs, number):
    path, _ = folder
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, no_docs, path).count() == 0
    out = stage(spark, edge_docs, path)
    if number < 4:
        assert out.columns == edge_docs.columns
    assert out.count() > 0


def test_registration():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]) if n[:2] == "op" else 0)[0] == "pipeline"
    assert len(QUERIES) == 11 and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
@pytest.mark.parametrize("name", ["op3_quality_classifier", "op7_language_id", "op8_packing", "op9_token_counts", "pipeline"])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
