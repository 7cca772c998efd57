"""The long conversations of the workload: ten, whatever the size of the table, which hold all of its turns."""

import pytest
from pyspark.sql import functions as F

from workload import evaluation, tables, training

N = 400


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    roles = [("system", -1), ("user", 0), ("assistant", 1)]
    rows = [(i, t + 1, role, f"turn {t} of {i}") for i in range(N) for role, t in roles if t >= 0 or i < 10]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_a_long_conversation_is_a_tenth_of_the_table(spark, sf):
    rows = tables.conversation_rows(spark, sf, tables.long_turns(spark, sf)).select("conv_id", F.size("messages").alias("n"))
    assert {r["conv_id"]: r["n"] for r in rows.collect()} == {i: 2 * N // 10 + 1 for i in range(10)}


def test_no_turn_is_left_out(spark, sf):
    texts = {r["conv_id"]: r["text"] for r in training.chat_render_long(spark, sf).collect()}
    assert sorted(texts) == list(range(10))
    assert all(texts[i % 10].count(f"turn {t} of {i}<end_of_turn>") == 1 for i in range(N) for t in (0, 1))
    asked = [tuple(r) for r in evaluation.eval_prepare_long(spark, sf).select("conv_id", "pos", "text").collect()]
    assert sorted(asked) == [(i, p, f"turn {p - 1} of {i}") for i in range(10) for p in (0, 1)]
    answers = {r["conv_id"]: r["reference"] for r in evaluation.eval_reference_long(spark, sf).collect()}
    assert answers == {i: f"turn 1 of {i}" for i in range(10)}
