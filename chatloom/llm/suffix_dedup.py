"""Repeated passages by sparse suffix arrays.

Only the suffixes at content-selected positions are retained: of every run of ``LEAST`` words the one that starts
at the smallest hash of ``GRAM`` words inside it (its minimiser). Equal runs select the same position, so a repeat is seen
from a retained suffix in each place it occurs. Retained suffixes whose first words occur once in the corpus are
dropped by counts of their keys alone. Those that are left are extended to the left, a word at a time, as far as
their position is the minimiser; the suffixes of one key are then sorted, at every extension, by their first ``LEAST``
words (as hashes), and neighbours compared. Equal neighbours are a match, and matches that touch join left and right to the
longest repeated passages.

A key that occurs more than ``CROWD`` times is sorted in pieces; each piece hands on one row per distinct run, and a
second step compares those."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import WordHashes, gram_hashes, join_frequent, text_bytes
from chatloom.plans.materialize import materialize

LEAST = 50  # words of a repeat
GRAM = 20  # words at the start of a retained suffix
CROWD = 4096


_STRETCH = 1 << 18  # runs whose minimisers are found together


def retained(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every run of LEAST words the retained position that stands for it, and the hashes of all GRAM words. Of
    equal hashes the leftmost counts: a hash gives its upper bits, its place the lower ones, to one number that is
    least in its run."""
    grams = gram_hashes(words, GRAM, 3)
    width = LEAST - GRAM + 1
    best, low = [], np.uint64(2 * _STRETCH - 1)
    for start in range(0, len(grams) - width + 1, _STRETCH):
        part = grams[start : start + _STRETCH + width - 1]
        least, span = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < width:
            least = np.minimum(least[: len(part) - width + 1], least[width - span :])
        best.append((least & low).astype(np.int64) + start)
    return np.concatenate(best), grams


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        keys, ids, at = [], [], []
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = hashes.of(raw.as_py())
            if len(words) >= LEAST:
                positions, grams = retained(words)
                positions = np.unique(positions)
                keys.append(grams[positions])
                at.append(positions)
                ids.append(np.full(len(positions), doc_id, np.int64))
        if keys:
            columns = [np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(at)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc_id", "position"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, raw, found array<struct<position,key,n>>) to one row per retained suffix with the hashes of its
    left extensions, the longest first."""
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for doc_id, raw, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = hashes.of(raw.as_py())
            if len(words) < LEAST:
                continue
            positions, _ = retained(words)
            runs = gram_hashes(words, LEAST, 9)
            for f in found:
                start, end = np.searchsorted(positions, [f["position"], f["position"] + 1])
                if start < end:
                    rows.append((f["key"], f["n"], doc_id, int(start), runs[start:end].tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "doc_id", "start", "runs"])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the extensions of each (key, piece) and compares neighbours. Gives stretches of runs (doc_id, first, last,
    later), where ``later`` tells that an earlier place has the same run, and for pieces of crowded keys the first
    place of every distinct run (doc_id, first, run, copies), to be compared with other pieces."""
    held: list[pa.RecordBatch] = []

    def out(batch: pa.RecordBatch) -> pa.RecordBatch:
        # one entry per extension; runs of different keys differ, so all groups are sorted at once
        data = batch.column(5).to_pylist()
        sizes = np.array([len(d) // 8 for d in data])
        runs = np.frombuffer(b"".join(data), np.uint64)
        row = np.repeat(np.arange(len(data)), sizes)
        piece = np.repeat(batch.column(1).to_numpy(), sizes)
        doc = np.repeat(batch.column(3).to_numpy(), sizes)
        at = np.repeat(batch.column(4).to_numpy(), sizes) + np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((at, doc, runs, piece))
        new = np.ones(len(runs), bool)
        new[1:] = (np.diff(runs[order]) != 0) | (np.diff(piece[order]) != 0)
        copies = np.diff(np.r_[np.flatnonzero(new), len(runs)])
        first, many = np.zeros(len(runs), bool), np.zeros(len(runs), np.int64)
        first[order], many[order] = new, np.repeat(copies, copies)
        crowded = np.repeat(batch.column(2).to_numpy(), sizes) > CROWD
        state = np.where(first & crowded, 0, np.where(many == 1, 0, np.where(first, 1, 2)))
        edge = np.ones(len(runs), bool)
        edge[1:] = (np.diff(row) != 0) | (np.diff(state) != 0)
        starts = np.flatnonzero(edge)
        ends = np.r_[starts[1:], len(runs)] - 1
        keep = state[starts] > 0
        starts, ends = starts[keep], ends[keep]
        open_ = np.flatnonzero(first & crowded)
        both = np.r_[starts, open_]
        blank = len(starts)
        columns = [
            pa.array(doc[both]),
            pa.array(at[both]),
            pa.array(np.r_[at[ends], at[open_]]),
            pa.array(np.r_[state[starts] == 2, np.zeros(len(open_), bool)]),
            pa.array(runs[both].view(np.int64), mask=np.r_[np.ones(blank, bool), np.zeros(len(open_), bool)]),
            pa.array(many[both]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "first", "last", "later", "run", "copies"])

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        now = joined() if len(held) > 1 else batch
        key, piece = now.column(0).to_numpy(), now.column(1).to_numpy()
        cut = int(np.flatnonzero((key != key[-1]) | (piece != piece[-1])).max(initial=-1)) + 1
        held = [now.slice(cut)]
        if cut:
            yield out(now.slice(0, cut))
    if held:
        yield out(joined())


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the stretches of each document to spans of words."""
    for batch in batches:
        rows = []
        for doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans: list[list[int]] = []
            removed = 0
            for s in sorted((f["first"], f["last"] + LEAST, f["later"]) for f in found):
                if not spans or s[0] > spans[-1][1]:
                    spans.append([s[0], s[1], 0])
                    removed = s[0]
                spans[-1][1] = max(spans[-1][1], s[1])
                if s[2]:
                    spans[-1][2] += max(0, s[1] - max(removed, s[0]))
                    removed = max(removed, s[1])
            rows += [(doc_id, a, b - a, n) for a, b, n in spans]
        columns = list(zip(*rows)) if rows else [()] * 4
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_words", "n_later"])


def stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, later): stretches of runs of LEAST words, by the first word of their first and last run,
    that occur twice or more; ``later`` when another place, earlier by doc_id and position, has the same run."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    keys = materialize(texts.mapInArrow(_keys, "key long, doc_id long, position long"))
    counts = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = join_frequent(keys, counts, "key", "n").filter("n is not null")
    found = again.groupBy("doc_id").agg(F.collect_set(F.struct("position", "key", "n")).alias("found"))
    with_text = texts.join(found, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "raw", "found")
    suffixes = with_text.mapInArrow(_extend, "key long, n long, doc_id long, start long, runs binary")
    piece = F.pmod(F.xxhash64("doc_id", "start"), F.ceil(F.col("n") / CROWD))
    dealt = suffixes.withColumn("piece", piece).select("key", "piece", "n", "doc_id", "start", "runs")
    dealt = dealt.repartition("key", "piece").sortWithinPartitions("key", "piece")
    schema = "doc_id long, first long, last long, later boolean, run long, copies long"
    compared = materialize(dealt.mapInArrow(_matches, schema))
    near = compared.filter("run is null").select("doc_id", "first", "last", "later")
    firsts = compared.filter("run is not null").select("run", "doc_id", "first", "copies")
    runs = firsts.groupBy("run").agg(F.sum("copies").alias("all"), F.min(F.struct("doc_id", "first")).alias("earliest"))
    far = firsts.join(runs.filter("all > 1"), "run").select(
        "doc_id", "first", F.col("first").alias("last"), (F.struct("doc_id", "first") != F.col("earliest")).alias("later")
    )
    return near.unionByName(far)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per repeated passage: doc_id, start, n_words, n_later.

    A passage is a longest stretch of words covered by runs of LEAST words that occur at two places or more, in one
    document or several. start counts words from 0; n_later is the number of its words that a run covers which
    also occurs earlier (by doc_id, then position), the ones to remove if one copy is to stay. Null, empty and
    shorter texts have no passages. Rows that repeat a doc_id are one document, rows without doc_id take no part,
    and an empty table gives no rows."""
    per_doc = stretches(docs).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "later")).alias("found"))
    return per_doc.mapInArrow(_spans, "doc_id long, start long, n_words long, n_later long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    word = regex.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
    for batch in batches:
        texts = []
        for raw, found in zip(batch.column(1), batch.column(2).to_pylist()):
            raw = raw.as_py()
            if found:
                gone = np.zeros(max(f["last"] for f in found) + LEAST, bool)
                for f in found:
                    gone[f["first"] : f["last"] + LEAST] = True
                kept = []
                for i, m in enumerate(word.finditer(raw)):
                    if i == 0:
                        kept.append(raw[: m.start()])
                    if i >= len(gone) or not gone[i]:
                        kept.append(m.group())
                raw = b"".join(kept)
            texts.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without the words that also occur earlier in a repeated passage; the first copy stays whole.
    A text that is cut is a string, others come back as they are (null as empty). One row per doc_id."""
    later = stretches(docs).filter("later").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    return texts.dropDuplicates(["doc_id"]).join(later, "doc_id", "left").mapInArrow(_cut, "doc_id long, text string")
