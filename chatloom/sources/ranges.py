"""Records of large text files, read by many tasks although a record may hold the separator that ranges are cut at.

Spark's line reader deals a file out in byte ranges, cut at line breaks for CSV and at closing braces for JSON. Whether such a
piece ends a record depends on what stands before it: on open quotes, and in JSON on the depth of open brackets. So a first
scan makes of every range what it does to either state it may start in, the functions of a file's ranges are
composed in order, which is one small row per range, and a second scan cuts each range knowing its true start. What is
left of a record at the borders of ranges is put together in a shuffle of these few fragments alone."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a piece does, by the state before it, outside (0) or inside (1) of quotes: the state after it, and by how much the
#: depth changes.
Scan = Callable[[str], tuple[tuple[int, int], tuple[int, int]]]

NEVER = 1 << 40
_STARTS = "file string, block long, quoted int, depth long, base long, owner long, cut boolean"


def csv_scan(sep: str = ",") -> Scan:
    """Quotes count where a field begins, and are doubled inside quotes; what follows a closing quote is literal."""

    def quoted_after(line: str, quoted: bool) -> int:
        at = 0
        while True:
            if quoted:
                at = line.find('"', at)
                if at < 0:
                    return 1
                if line[at + 1 : at + 2] == '"':
                    at += 2
                    continue
            elif line[at : at + 1] == '"':
                quoted, at = True, at + 1
                continue
            quoted = False
            at = line.find(sep, at)
            if at < 0:
                return 0
            at += len(sep)

    def scan(line: str) -> tuple[tuple[int, int], tuple[int, int]]:
        if '"' not in line:
            return (0, 0), (1, 0)
        return (quoted_after(line, False), 0), (quoted_after(line, True), 0)

    return scan


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def json_scan(piece: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """Brackets count outside of strings."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    flips = (len(parts) - 1) % 2

    def depth(outside: str) -> int:
        return outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")

    return (flips, depth("".join(parts[::2]))), (1 - flips, depth("".join(parts[1::2])))


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    lines = spark.read.option("lineSep", sep).option("recursiveFileLookup", True).text(path)
    meta = F.col("_metadata")
    return lines.select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"),
        meta["file_size"].alias("size"),
        ((meta["file_block_start"] == 0) & (meta["file_block_length"] >= meta["file_size"])).alias("alone"),
        F.col("value").alias("piece"),
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], bool]]:
    """(key, pieces, last) of rows whose last column is the piece and whose others are the key, which is one per range and
    begins with file and block; a range comes in several parts, of which ``last`` marks the last."""
    held: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changed = np.zeros(n, bool)
        changed[0] = True
        for c in batch.columns[:2]:
            changed[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(changed).tolist()
        pieces = batch.column(batch.num_columns - 1).to_pylist()
        for start, end in zip(starts, [*starts[1:], n]):
            key = tuple(c[start].as_py() for c in batch.columns[:-1])
            if held:
                yield (*held, held[0] != key)
            held = (key, pieces[start:end])
    if held:
        yield (*held, True)


_BLANK = "\ufeff \t\r\n"


def _head(head: str, pieces: list[str]) -> str:
    """The start of the first piece that is not blank, if ``head``, that of the pieces before, was blank."""
    for piece in pieces:
        if len(head) >= 64 or head.strip(_BLANK):
            break
        head = piece[:64] if piece.strip(_BLANK) else ""
    return head


def _effects(scan: Scan, sep: str):
    """What each range does to both states: state and depth after it, least depth at the end of a piece outside of quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[list[int]] = []
        head, octets = "", 0
        for key, pieces, last in _ranges(batches):
            state = state or [[0, 0, NEVER], [1, 0, NEVER]]
            head = _head(head, pieces)
            for piece in pieces:
                octets += len(piece.encode()) + len(sep)
                effect = scan(piece + sep)
                for way in state:
                    way[0], delta = effect[way[0]]
                    way[1] += delta
                    if not way[0]:
                        way[2] = min(way[2], way[1])
            if last:
                row = [*key, head.lstrip(_BLANK)[:1], octets, *state[0], *state[1]]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], _EFFECT_NAMES)
                state, head, octets = [], "", 0

    return run


_EFFECT_NAMES = ["file", "block", "size", "head", "octets", "end0", "delta0", "least0", "end1", "delta1", "least1"]
_EFFECTS = "file string, block long, size long, head string, octets long, " + ", ".join(
    f"end{s} long, delta{s} long, least{s} long" for s in (0, 1)
)


def _starts(effects: pd.DataFrame) -> pd.DataFrame:
    """The true start of each range of one file; ``owner`` is the range in which the record begins that is open there."""
    effects = effects.sort_values("block")
    first = effects[effects["head"] != ""]["head"]
    base = int(len(first) > 0 and first.iloc[0] == "[")
    quoted, depth, owner, rows = 0, 0, int(effects["block"].iloc[0]), []
    for r in effects.itertuples():
        rows.append((r.file, r.block, quoted, depth, base, owner, False))
        end, delta, least = (r.end1, r.delta1, r.least1) if quoted else (r.end0, r.delta0, r.least0)
        if not (quoted or depth > base) or depth + least <= base:
            owner = r.block
        quoted, depth = end, depth + delta
    if effects["octets"].sum() == effects["size"].iloc[0] + 1:  # nothing closes the last piece
        rows[-1] = (*rows[-1][:-1], True)
    return pd.DataFrame(rows, columns=["file", "block", "quoted", "depth", "base", "owner", "cut"])


def _cut(scan: Scan, sep: str, closing: bool):
    """(file, owner, block, at, first, whole, text) of whole records, and of what a range has of those that cross its borders.
    A range without a known start is a whole file. With ``closing``, the separator belongs to the record that it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_pieces = None, []
        for key, pieces, last in _ranges(batches):
            file, block, size, quoted, depth, base, owner, cut = key
            alone = quoted is None
            if now is None:
                foreign = not alone and bool(quoted or depth > base)  # the first record began before this range
                mine, now, at = owner if foreign else block, (0, 0) if alone else (quoted, depth), 0
                head, octets = "", 0
            if alone:
                head = _head(head, pieces)
                octets += sum(len(p.encode()) for p in pieces) + len(pieces) * len(sep)
                base, cut = int(head.lstrip(_BLANK)[:1] == "["), octets == size + 1
            rows = []
            for i, piece in enumerate(pieces):
                end = cut and last and i == len(pieces) - 1
                open_pieces.append(piece + sep if closing and not end else piece)
                if end and closing:
                    continue
                state, delta = scan(piece + sep)[now[0]]
                now = (state, now[1] + delta)
                if not state and now[1] <= base:
                    text = ("" if closing else sep).join(open_pieces)
                    rows.append((file, mine, block, at, block == 0 and at == 0, not foreign, text))
                    open_pieces, foreign, mine, at = [], False, block, at + 1
            if last:
                if open_pieces:
                    text = ("" if closing else sep).join(open_pieces)
                    rows.append((file, mine, block, at, block == 0 and at == 0, False, text))
                now, open_pieces = None, []
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CUT_TYPES)], _CUT_NAMES)

    return run


_CUT = "file string, owner long, block long, at long, first boolean, whole boolean, text string"
_CUT_NAMES = ["file", "owner", "block", "at", "first", "whole", "text"]
_CUT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]


def records(spark: SparkSession, path: str, scan: Scan, sep: str, closing: bool) -> DataFrame:
    """(file, first, text) of every record of the files: ``first`` is that of a file. Ranges are as large as
    ``spark.sql.files.maxPartitionBytes`` makes them; a compressed file is one range."""
    pieces = _pieces(spark, path, sep)
    # a file that is one range starts outside of everything: only the others need the first scan
    effects = pieces.filter("not alone").drop("alone").mapInArrow(_effects(scan, sep), _EFFECTS)
    starts = effects.groupBy("file").applyInPandas(_starts, _STARTS)
    # one row per range
    placed = pieces.join(F.broadcast(starts), ["file", "block"], "left")
    placed = placed.select("file", "block", "size", "quoted", "depth", "base", "owner", "cut", "piece")
    cut = placed.mapInArrow(_cut(scan, sep, closing), _CUT)
    part = F.struct("block", F.col("whole").alias("w"), "text", "first")
    parts = cut.filter("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(part)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "" if closing else sep)
    joined = parts.select("file", F.exists("p", lambda x: x["first"]).alias("first"), text.alias("text"))
    return cut.filter("whole").select("file", "first", "text").unionByName(joined)


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, first, text) of the records of CSV files, blank ones left out."""
    found = records(spark, path, csv_scan(sep), "\n", closing=False)
    text = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "^﻿", "")
    return found.select("file", "first", text.alias("text")).filter("trim(text) <> ''")


def _elements(text: str) -> list[str]:
    """A stretch that ends in an object, taken apart at what stands before that: other values, and words that are none."""
    out, depth, quoted, start, at = [], 0, False, 0, 0
    while at < len(text):
        c = text[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            if c == "{" and not depth:
                out.append(text[start:at])
                start = at
            depth += 1
        elif c in "}]":
            depth -= 1
        elif not depth and c in ",\n":
            out.append(text[start:at])
            start = at + 1
        at += 1
    return [x for x in (p.strip("﻿ \t\r\n,") for p in [*out, text[start:]]) if x]


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the rows of JSON files: the elements of an array, or the objects that follow each other, over as many
    lines as they like. What is no object costs only itself: it is a row of its own, which no parser will take (but for an
    array inside of the array, whose objects Spark's parser takes). An object
    with unbalanced brackets or quotes takes along what follows it, and a file that ends inside of one, this one."""
    found = records(spark, path, json_scan, "}", closing=True)
    opened = F.regexp_replace("text", r"^[\s\x{FEFF}]*\[", "")
    text = F.when(F.col("first"), opened).otherwise(F.col("text"))
    found = found.select("file", F.regexp_replace(text, r"^[\s,\x{FEFF}]+", "").alias("text"))
    found = found.filter(~F.col("text").rlike(r"^[\s,\]}\x{FEFF}]*$"))
    plain = F.col("text").startswith("{")
    mixed = F.udf(_elements, "array<string>", useArrow=True)
    return found.filter(plain).unionByName(found.filter(~plain).select("file", F.explode(mixed("text")).alias("text")))
