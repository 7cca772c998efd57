import base64
import json

import pytest
from pyspark.sql import functions as F

from chatloom.config import FieldMapping, as_mappings, detect_modality, validate_mappings
from chatloom.functions import images
from chatloom.operators import convert

COL = lambda v: {"type": "column", "value": v}
TPL = lambda v: {"type": "template", "value": v}
IMG = lambda v: {"type": "image", "value": v}
PNG = bytes.fromhex("89504E470D0A1A0A") + bytes(range(120))
JPEG = bytes.fromhex("FFD8FFE0") + bytes(200)


def simple(messages):
    return [(m["role"], [p["text"] for p in m["content"]]) for m in messages]


def qa(spark):
    return spark.createDataFrame(
        [(1, "What  is\tML?", " A field. "), (2, "", "x"), (3, "q", None), (4, None, "a")], "id int, question string, answer string"
    )


def chat(df, mode, mappings, **options):
    return {r["id"]: r for r in convert.to_chat(df, mode, mappings, keep=["id"], **options).collect()}


def test_language_modeling(spark):
    got = chat(qa(spark), "language_modeling", {
        "system_field": TPL("You are  helpful."), "user_field": COL("question"), "assistant_field": TPL("Answer: {answer}"),
    })
    assert set(got) == {1, 3}
    assert simple(got[1]["messages"]) == [
        ("system", ["You are  helpful."]), ("user", ["What is ML?"]), ("assistant", ["Answer: A field."]),
    ]
    assert simple(got[3]["messages"])[2] == ("assistant", ["Answer:"])


def test_null_text_can_read_none(spark):
    mappings = {"user_field": COL("question"), "assistant_field": COL("answer")}
    assert set(chat(qa(spark), "language_modeling", mappings)) == {1}
    got = chat(qa(spark), "language_modeling", mappings, null_text="None")
    assert set(got) == {1, 3, 4}
    assert simple(got[4]["messages"])[0] == ("user", ["None"])


def test_whitespace_switch(spark):
    got = chat(qa(spark), "language_modeling", {"user_field": COL("question"), "assistant_field": COL("answer")},
               normalize_whitespace=False)
    assert simple(got[1]["messages"]) == [("user", ["What  is\tML?"]), ("assistant", [" A field. "])]


def test_prompt_only(spark):
    got = chat(qa(spark), "prompt_only", {
        "system_field": TPL("S"), "user_field": COL("question"), "answer": COL("answer"), "hint": TPL("{nope}  x"),
    })
    assert set(got) == {1, 2, 3, 4}  # a system message alone is a prompt
    assert simple(got[2]["prompt"]) == [("system", ["S"])]
    assert (got[1]["answer"], got[3]["answer"], got[1]["hint"]) == ("A field.", "", "{nope} x")


def test_preference(spark):
    df = spark.createDataFrame([(1, "q", "good", ""), (2, "", "a", "b")], "id int, q string, c string, r string")
    mappings = {"system_field": TPL("S"), "user_field": COL("q"), "chosen_field": COL("c"), "rejected_field": COL("r")}
    got = chat(df, "preference", mappings)
    assert set(got) == {1}
    assert simple(got[1]["prompt"]) == [("user", ["q"])]
    assert simple(got[1]["chosen"]) == [("assistant", ["good"])] and got[1]["rejected"] == []
    got = chat(df, "preference", mappings, include_system=True)
    assert set(got) == {1} and simple(got[1]["prompt"]) == [("system", ["S"]), ("user", ["q"])]


def test_failed_templates(spark):
    got = chat(qa(spark), "language_modeling", {
        "system_field": TPL("{nope}"), "user_field": [TPL("{nope}"), COL("question")], "assistant_field": TPL("raw {nope}"),
    })
    assert simple(got[1]["messages"]) == [("user", ["What is ML?"]), ("assistant", ["raw {nope}"])]


JSON_CASES = [
    ('{"role": "user", "content": "hi  there"}', ("user", ["hi  there"])),
    (' {"role":"assistant","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]} ', ("assistant", ["a", "b"])),
    ('{"role":"user","content":["a","b"]}', ("user", ["a", "b"])),
    ('{"role":"user","content":5}', ("user", ["5"])),
    ('{"role":"user","content":true}', ("user", ["True"])),
    ('{"role":"user","content":null}', ("user", ["None"])),
    ('{"role":"user","content":"[1]"}', ("user", ["[1]"])),
    ('{"role":"user","extra":1,"content":"x"}', ("user", ["x"])),
    ('{"role":"user","content":"broken}', ("user", ['{"role":"user","content":"broken}'])),
    ('{"content":"c","role":"assistant"}', ("user", ['{"content":"c","role":"assistant"}'])),
    ('{"a":{"role":"user","content":"x"}}', ("user", ['{"a":{"role":"user","content":"x"}}'])),
]


def test_json_messages(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(JSON_CASES)], "id int, m string")
    got = chat(df, "prompt_only", {"user_field": COL("m")})
    assert [simple(got[i]["prompt"]) for i in range(len(JSON_CASES))] == [[want] for _, want in JSON_CASES]
    listed = chat(df, "prompt_only", {"user_field": [TPL("Q:"), COL("m")]})
    assert simple(listed[1]["prompt"]) == [("user", ["Q:", "a", "b"])]


def test_struct_messages(spark):
    df = spark.createDataFrame(
        [(1, ("assistant", "x"), ("user", [("text", "y"), ("text", " ")])), (2, None, None)],
        "id int, s struct<role:string,content:string>, l struct<role:string,content:array<struct<type:string,text:string>>>",
    )
    got = chat(df, "language_modeling", {"user_field": COL("l"), "assistant_field": COL("s")})
    assert simple(got[1]["messages"]) == [("user", ["y", " "]), ("assistant", ["x"])] and 2 not in got
    listed = chat(df, "prompt_only", {"user_field": [COL("s"), COL("l")]})
    assert simple(listed[1]["prompt"]) == [("user", ["x", "y"])]


def test_vision(spark):
    b64 = base64.b64encode(PNG).decode()
    rows = [(1, "look", PNG, b64), (2, "data", None, "data:image/jpeg;base64," + base64.b64encode(JPEG).decode()),
            (3, "bad", b"nothing", "not an image"), (4, "", JPEG, None)]
    df = spark.createDataFrame(rows, "id int, t string, raw binary, s string")
    got = chat(df, "prompt_only", {"user_field": [COL("t"), IMG("raw"), IMG("s")]})
    kinds = {i: [p["type"] for p in r["prompt"][0]["content"]] for i, r in got.items()}
    assert kinds == {1: ["text", "image", "image"], 2: ["text", "image"], 3: ["text"], 4: ["image"]}
    assert bytes(got[1]["prompt"][0]["content"][2]["image"]["bytes"]) == PNG
    single = chat(df, "prompt_only", {"user_field": IMG("raw")})
    assert set(single) == {1, 4}
    shown = convert.to_chat(df, "prompt_only", {"user_field": [COL("t"), IMG("raw")]}, keep=["id"])
    urls = shown.filter("id = 1").select(convert.render_images(F.col("prompt")).alias("p")).first()["p"]
    assert urls[0]["content"][1]["image"] == "data:image/png;base64," + b64


def test_image_text(spark):
    long = base64.b64encode(bytes(150)).decode()
    cases = {"data:image/png;base64,xx": True, long: True, long[:-1]: False, base64.b64encode(bytes(20)).decode(): False,
             "é" * 200: False, "plain words " * 20: len(("plainwords" * 20)) % 4 == 0}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r["c"]: r["o"] for r in df.select("c", images.is_base64_image(F.col("c")).alias("o")).collect()}
    assert got == cases
    url = spark.createDataFrame([(base64.b64encode(JPEG).decode().rstrip("="),)], "c string")
    assert url.select(convert.image_text_url(F.col("c")).alias("u")).first()["u"].startswith("data:image/jpeg;base64,/9j/")


def test_validation():
    def check(raw, mode=None):
        validate_mappings(as_mappings(raw), ["a", "b"], mode)

    check({"user_field": [COL("a"), IMG("b")], "assistant_field": TPL("{zzz}")}, "language_modeling")
    for raw, mode in [
        ({"user_field": COL("zz")}, None),
        ({"user_field": COL("a"), "assistant_field": [COL("a")]}, None),
        ({"user_field": COL("a"), "assistant_field": IMG("a")}, None),
        ({"user_field": COL("a")}, "language_modeling"),
        ({"user_field": COL("a"), "chosen_field": COL("a")}, "preference"),
        ({"assistant_field": COL("a")}, "prompt_only"),
        ({"user_field": COL("a")}, "other"),
        ({"user_field": {"type": "other", "value": "a"}}, None),
    ]:
        with pytest.raises(ValueError):
            check(raw, mode)
    assert detect_modality(as_mappings({"user_field": [COL("a"), IMG("b")]})) == "vision"
    assert detect_modality({"user_field": FieldMapping("column", "a")}) == "text"


def test_split_column_survives_and_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("id", "'q' as q", "'a' as a", "'unused' as u", "'train' as split").write.parquet(path)
    out = convert.to_chat(spark.read.parquet(path), "language_modeling", {"user_field": COL("q"), "assistant_field": TPL("{a}")})
    assert out.columns == ["split", "messages"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<q:string,a:string,split:string>" in plan and "Python" not in plan


def test_drop_failed(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "id int, messages array<string>")
    assert [r["id"] for r in convert.drop_failed(df, "messages").collect()] == [1]


def test_json_text_keeps_every_character(spark):
    text = 'quote " backslash \\ newline \n tab \t ünïcode 漢'
    df = spark.createDataFrame([(1, json.dumps({"role": "user", "content": text}))], "id int, m string")
    assert simple(chat(df, "prompt_only", {"user_field": COL("m")})[1]["prompt"]) == [("user", [text])]
