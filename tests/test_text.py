import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions import text
from chatloom.functions.stemming import porter_stems
from chatloom.functions.templates import TemplateFailure, compile_template


def column(spark, values, dtype, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_float_text_is_python_text(spark):
    values = [0.0, 1.0, -1.5, 0.1, 1e10, 123456789.25, -2.5e15, 1e16, 1.5e22, 1e-4, 0.00012, 1e-5, 2.5e-7, 1e100,
              float("inf"), float("-inf"), float("nan"), 0.001, 9999999.0, 12345678.9, None]
    got = column(spark, values, "double", lambda c: text.py_text(c, T.DoubleType(), "None"))
    assert got == [str(v) for v in values]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=200, max_size=200))
def test_float_text_property(spark, values):
    got = column(spark, values, "double", lambda c: text.py_text(c, T.DoubleType()))
    assert [float(g) for g in got] == values
    assert all(("e" in g) == ("e" in str(v)) for g, v in zip(got, values))


def test_other_types(spark):
    assert column(spark, [True, False, None], "boolean", lambda c: text.py_text(c, T.BooleanType())) == ["True", "False", ""]
    stamps = [datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 4, 5, 120)]
    assert column(spark, stamps, "timestamp", lambda c: text.py_text(c, T.TimestampType())) == [str(s) for s in stamps]


SPACES = [" a  b\t\nc　", "", "  ", "x", " y z\x0b"]


def test_whitespace(spark):
    once = column(spark, SPACES, "string", text.normalize_ws)
    assert once == [re.sub(r"\s+", " ", s).strip() for s in SPACES]
    assert column(spark, once, "string", text.normalize_ws) == once
    assert column(spark, SPACES, "string", text.strip) == [s.strip() for s in SPACES]
    assert column(spark, SPACES, "string", text.is_blank) == [not s.strip() for s in SPACES]


def test_clean_chars(spark):
    texts = ["Don’t stop-me, it's 5 o'clock!\nNow\ttoo", "  A  b", "123", "Été fini"]
    assert column(spark, texts, "string", text.clean_chars) == [
        "dont stop me its oclock now too", "a b", "", "t fini",
    ]


def test_tokenisers(spark):
    assert column(spark, ['Hi, "you" cost 3.5-4 (US$1,000) a.b'], "string", text.tokens_13a) == [
        ["Hi", ",", '"', "you", '"', "cost", "3.5", "-", "4", "(", "US", "$", "1,000", ")", "a", ".", "b"]
    ]
    assert column(spark, ["It's a T-1000!"], "string", text.tokens_rouge) == [["it", "s", "a", "t", "1000"]]
    assert column(spark, ["Well, Été!"], "string", text.tokens_words) == [["well", ",", "été", "!"]]


SPECS = ["{a}", "x{a:>8}|{b:<4}|{a:^7}", "{a:*^9}{{raw}}", "{a:.2}", "{a:#>6.3}", "{b!s:>5}", "{a:05}", "none", "{a:s}"]


@pytest.mark.parametrize("template", SPECS)
def test_templates_match_format(spark, template):
    rows = [("héllo", "12"), ("", "x"), ("a long value", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = df.select("i", compile_template(template, {"a": F.col("a"), "b": F.col("b")}).alias("o")).orderBy("i").collect()
    assert [g["o"] for g in got] == [template.format(a=a, b=b) for a, b in rows]


@pytest.mark.parametrize("template", ["{missing}", "{a", "a}", "{a:d}", "{a:=5}"])
def test_unrenderable_templates(spark, template):
    with pytest.raises(TemplateFailure):
        compile_template(template, {"a": F.lit("x")})


@pytest.mark.parametrize("template", ["{}", "{0}", "{a.b}", "{a[0]}", "{a!r}"])
def test_rejected_templates(spark, template):
    with pytest.raises(ValueError) as e:
        compile_template(template, {"a": F.lit("x")})
    assert not isinstance(e.value, TemplateFailure)


STEMS = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled
motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss
fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration
valenci:valenc digitizer:digit radicalli:radic differentli:differ vileli:vile analogousli:analog
vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope
callousness:callous formaliti:formal sensitiviti:sensit triplicate:triplic formative:form formalize:formal
electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer
airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac
adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ angulariti:angular
homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control
roll:roll yes:ye generalizations:gener oscillators:oscil a:a by:by"""


def test_porter_examples(spark):
    pairs = [p.split(":") for p in STEMS.split()]
    df = spark.createDataFrame([([p[0] for p in pairs],)], "w array<string>")
    got = df.select(porter_stems(F.col("w")).alias("s")).first()["s"]
    assert got == [p[1] for p in pairs]
