"""Large files by ranges: every record is read once and whole, wherever the ranges are cut."""

import csv
import gzip
import io
import json
import random

import pytest

from chatloom.sources import files, ranges


@pytest.fixture
def cut(spark):
    """Sets the size of ranges, in bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield to
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


ODD = ["", "plain", "with, comma", 'a "quoted" word', "two\nlines", '"', '""', "\n", ",\n\"\n,", "ends with quote\"", "é✓", "x" * 90, " padded "]


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def as_csv(rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "text"])
    w.writerows(rows)
    return out.getvalue()


def read_rows(df):
    return sorted((r["id"], r["text"] or "") for r in df.collect())


@pytest.mark.parametrize("size", [13, 61, 1 << 20])
def test_csv_records_over_any_border(spark, tmp_path, cut, size):
    draw = random.Random(1)
    rows = [(i, draw.choice(ODD)) for i in range(30)]
    path = write(tmp_path / "a.csv", as_csv(rows))
    cut(size)
    df = files.read_csv(spark, path, schema="id long, text string")
    assert read_rows(df) == sorted(rows)
    if size < 100:
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 5


def test_csv_breaks_at_every_border(spark, tmp_path, cut):
    """One quoted break moved over a border byte by byte."""
    cut(32)
    for shift in range(0, 34, 7):
        rows = [(1, "a" * shift + "\n\"\nb"), (2, "c\n" * 8 + "d"), (3, "e")]
        path = write(tmp_path / f"{shift}.csv", as_csv(rows))
        assert read_rows(files.read_csv(spark, path, schema="id long, text string")) == rows


def test_csv_folder_names_types_and_line_ends(spark, tmp_path, cut):
    cut(40)
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", "﻿" + as_csv([(1, "x\ny"), (2, "z")], "\r\n"))
    write(folder / "b.csv", as_csv([(3, "header only once"), (4, "id,text")]))
    (folder / "c.csv.gz").write_bytes(gzip.compress(as_csv([(5, 'packed\n"two"')]).encode()))
    df = files.read_csv(spark, str(folder))
    assert df.dtypes == [("id", "int"), ("text", "string")]
    assert read_rows(df) == [(1, "x\ny"), (2, "z"), (3, "header only once"), (4, "id,text"), (5, 'packed\n"two"')]
    short = files.read_csv(spark, write(tmp_path / "short.csv", "id,text\n1\n\n2,b,more\n"), schema="id long, text string")
    assert read_rows(short) == [(1, ""), (2, "b")]
    assert files.read_csv(spark, write(tmp_path / "head.csv", "id,text\n"), schema="id long, text string").count() == 0
    assert files.read_csv(spark, write(tmp_path / "head2.csv", "id,text\n")).columns == ["id", "text"]


def test_a_quote_inside_of_a_field_opens_nothing():
    scan = ranges.csv_scan()
    assert scan('5" nail,b') == ((0, 0), (1, 0)) or scan('5" nail,b')[0] == (0, 0)
    assert scan('"open,b')[0] == (1, 0) and scan('closed",b')[1] == (0, 0)
    assert scan('"a""b",c')[0] == (0, 0) and scan('"a"b,c')[0] == (0, 0) and scan('a,"b')[0] == (1, 0)


OBJECTS = [
    {"id": 0}, {"id": 1, "text": "}"}, {"id": 2, "text": '"{['}, {"id": 3, "text": "\\"}, {"id": 4, "text": '\\"}'},
    {"id": 5, "text": "line\nbreak"}, {"id": 6, "text": "é✓"}, {"id": 7, "inner": [{"a": [1, 2]}, {"a": []}]}, {"id": 8, "text": ""},
]


@pytest.mark.parametrize("size", [17, 1 << 20])
def test_json_by_structure(spark, tmp_path, cut, size):
    rows = [dict(o, id=9 * k + o["id"]) for k in range(2) for o in OBJECTS]
    want = sorted((r["id"], r.get("text"), len(r.get("inner", []))) for r in rows)
    cut(size)
    schema = "id long, text string, inner array<struct<a:array<int>>>"
    for name, text in (
        ("a", json.dumps(rows)), ("b", json.dumps(rows, indent=2)), ("c", json.dumps(rows, separators=(",", ":")) + "\n"),
        ("d", "\n".join(map(json.dumps, rows))), ("e", "\n".join(json.dumps(r, indent=1) for r in rows)), ("f", " \n[" + ",\n".join(map(json.dumps, rows)) + "\n]\n"),
    ):
        df = files.read_json(spark, write(tmp_path / f"{name}{size}.json", text), schema=schema)
        assert sorted((r["id"], r["text"], len(r["inner"] or [])) for r in df.collect()) == want, name


def test_json_documents_that_begin_on_their_first_line(spark, tmp_path):
    one = files.read_json(spark, write(tmp_path / "one.json", '{"a": 1,\n "b": 2}'))
    assert [tuple(r) for r in one.collect()] == [(1, 2)]
    nested = files.read_json(spark, write(tmp_path / "nested.json", '{"data": [\n {"a":1},\n {"a":2}]}'))
    assert [[x["a"] for x in r["data"]] for r in nested.collect()] == [[1, 2]]
    packed = tmp_path / "packed.json.gz"
    packed.write_bytes(gzip.compress(b'[{"a": 1},\n {"a": 2}]'))
    assert sorted(r["a"] for r in files.read_json(spark, str(packed)).collect()) == [1, 2]
    assert files.read_json(spark, write(tmp_path / "none.json", "[]"), schema="a int").count() == 0


@pytest.mark.parametrize("size", [25, 1 << 20])
def test_a_bad_element_costs_only_itself(spark, tmp_path, cut, size):
    cut(size)
    path = write(tmp_path / f"bad{size}.json", '[{"id": 1}, 5, {"id": }, "a } string", {"id": 2},, nonsense, [{"id": 7}], {"id": 3}]')
    got = [r["id"] for r in files.read_json(spark, path, schema="id int").collect()]
    assert sorted(x for x in got if x is not None) == [1, 2, 3, 7]
    assert sum(x is None for x in got) == 4
    broken = write(tmp_path / f"broken{size}.json", '[{"id": 1}, {"id": 2}, {"id": 3')
    assert sorted(str(r["id"]) for r in files.read_json(spark, broken, schema="id int").collect()) == ["1", "2", "None"]


def _no_starts(effects):
    raise AssertionError("a file in one range needs no first scan")


def test_files_in_one_range_are_scanned_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "_starts", _no_starts)
    (tmp_path / "a.json").write_text('[{"a": 1}, 5,\n {"a": "}[\\""}\n]')
    (tmp_path / "b.json").write_text('\ufeff\n{"a": 2}\n{"a":\n {"b": 3}}')
    (tmp_path / "c.json").write_text('{"a": 4}{"a": 5')
    (tmp_path / "d.json").write_bytes(b"")
    got = sorted(r["text"] for r in ranges.json_elements(spark, str(tmp_path)).collect())
    assert got == sorted(['{"a": 1}', '{"a": "}[\\""}', "5", '{"a": 2}', '{"a":\n {"b": 3}}', '{"a": 4}', '{"a": 5'])
