"""Token counts without token ids: every distinct pre-token is counted once and joined to the documents' frequencies.

A sentencepiece model with no piece that holds the space mark after another character never merges across the
start of a run of spaces, so a text falls into pre-tokens (a run of marks and what follows up to the next one),
and, where no piece holds a line break, at line breaks too. A document's count is the sum over its pre-tokens of pieces
times frequency.

The pre-tokens that make up a share of 2**-SHARE of the corpus or more are found first: each has that share in what
some task has read, so tasks pass on only those. There can't be more than 2**SHARE of them, whatever the corpus; the
short ones are tokenized, broadcast and summed where the texts are. All others meet in one shuffle by pre-token, where
none is frequent: there each distinct one is tokenized once, and its pieces go to its documents' sums."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.plans.materialize import materialize

SHARE = 20
SHORT = 64
SALTS = 64  # tasks that a longer pre-token is dealt to
LIMIT = 4096
_HELD = 1 << 19  # distinct pre-tokens a task counts before it passes them on
MARK = "▁"
_HEAD = "\n\n"  # starts the keys of rows about a document or a task; no pre-token has two line breaks


def _pieces(processor) -> list[str]:
    ids = range(processor.get_piece_size())
    return [processor.id_to_piece(i) for i in ids if not (processor.is_byte(i) or processor.is_control(i))]


def splitter(processor) -> Callable[[str], list[str]]:
    """Splits a text into pre-tokens whose counts add up to the text's. Raises where the model's pieces would
    join across them."""
    pieces = _pieces(processor)
    if any(MARK in p.lstrip(MARK) for p in pieces) or processor.encode("a b") != processor.encode("a" + MARK + "b"):
        raise ValueError("pieces of this model join words; their counts can't be summed")
    if any("\n" in p for p in pieces):
        raise ValueError("pieces of this model join lines; their counts can't be summed")

    def split(text: str) -> list[str]:
        # one pre-token per word: the space before a word belongs to it, further spaces are words of their own
        # together with it, and a line break ends a pre-token and is one itself
        if not text:
            return []
        out = []
        marked = " " + text.replace(MARK, " ")
        if "  " not in marked:
            lines = marked.split("\n")
            out = lines[0].split(" ")[1:]
            if len(lines) > 1:
                out.extend(["\n"] * (len(lines) - 1))
                for line in lines[1:]:
                    first, *rest = line.split(" ")
                    if first:
                        out.append("\n" + first)
                    out.extend(rest)
            return out
        for at, line in enumerate(marked.split("\n")):
            if at:
                out.append("\n")
            spaces = 0
            parts = line.split(" ")
            if parts[0]:
                out.append("\n" + parts[0])
            for part in parts[1:]:
                if part:
                    out.append(" " * spaces + part)
                    spaces = 0
                else:
                    spaces += 1
            if spaces:
                out.append(" " * spaces + "\n ")
        return out

    return split


def counter(processor) -> Callable[[list[str]], list[int]]:
    """The number of pieces of every pre-token: a plain one stands after one space, one that starts with a line
    break is what follows that break, and one that ends with a break and a space is a run of spaces alone."""
    lead, line = len(processor.encode("a")), len(processor.encode("a\n"))

    def count(pretokens: list[str]) -> list[int]:
        texts, less = [], []
        for p in pretokens:
            if p == "\n":
                texts.append("a\n")
                less.append(lead)
            elif p.endswith("\n "):
                texts.append("a" + p[:-2])
                less.append(lead)
            elif p.startswith("\n"):
                texts.append("a" + p)
                less.append(line)
            else:
                texts.append("a " + p)
                less.append(lead)
        return [len(ids) - n for ids, n in zip(processor.encode(texts, num_threads=1), less)]

    return count


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``model`` is the path of a sentencepiece model, read by the driver. Null and empty texts have no tokens. Rows
    that repeat both doc_id and text share a sum and come back as often as they came; rows that share a doc_id but not
    the text, and rows without doc_id, are counted apart. An empty table gives no rows."""
    with open(model, "rb") as f:
        proto = f.read()
    splitter(_processor(proto))  # refuses models whose pieces join words, before any job
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(proto)

    def corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = splitter(_processor(shared.value)), Counter()

        def out() -> pa.RecordBatch:
            least = max(2, held.total() >> SHARE)
            found = [(p, n) for p, n in held.items() if n >= least and len(p) <= SHORT]
            found.append((_HEAD, held.total()))
            held.clear()
            names, counts = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(split(text.as_py() or ""))
                if len(held) >= _HELD:
                    yield out()
        yield out()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(_processor(shared.value))
        for batch in batches:
            counts = pa.array(count(batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["pretoken", "pieces"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(corpus, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    least = (counted.filter(F.col("pretoken") == _HEAD).agg(F.sum("n")).first()[0] or 0) >> SHARE
    top = counted.filter((F.col("n") >= max(2, least)) & (F.col("pretoken") != _HEAD)).select("pretoken")
    table = top.mapInArrow(tokenize, "pretoken string, pieces long").toArrow()
    frequent = sc.broadcast(table.combine_chunks())

    # only where rows share a doc_id, or have none, their texts must tell them apart; else that would be most of what moves
    per_id = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    shared_ids = not per_id.filter("doc_id is null or count > 1").isEmpty()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(_processor(shared.value))
        known = dict(zip(*(c.to_pylist() for c in frequent.value.columns)))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        number = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 6
            rows.clear()
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, ["pretoken", "salt", "doc_id", "version", "n", "n_bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer() if text.is_valid else b""
                version = xxhash.xxh3_128_digest(raw) if shared_ids else b""
                number += 1
                total = 0
                for pretoken, n in Counter(split(text.as_py() or "")).items():
                    pieces = known.get(pretoken)
                    if pieces is None:
                        rows.append((pretoken, number % SALTS if len(pretoken) > SHORT else 0, doc_id, version, n, None))
                    else:
                        total += pieces * n
                rows.append((_HEAD, number % (1 << 30), doc_id, version, total, len(raw)))
                if len(rows) > 1 << 16:
                    yield out()
        yield out()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by pre-token, so its pieces are counted once, and remembered past the end of a batch
        count, last = counter(_processor(shared.value)), {}
        for batch in batches:
            pretokens = batch.column(0).to_pylist()
            own = [p for p in dict.fromkeys(pretokens) if p not in last and not p.startswith(_HEAD)]
            last.update(zip(own, count(own)))
            weights = [last.get(p, 1) for p in pretokens]
            last = {p: last[p] for p in pretokens[-1:] if p in last}
            pieces = pc.multiply(batch.column(4), pa.array(weights, pa.int64()))
            columns = [batch.column(2), batch.column(3), pieces, batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "pieces", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequencies = rows.mapInArrow(documents, "pretoken string, salt int, doc_id long, version binary, n long, n_bytes long")
    # long pre-tokens are not broadcast, and may be frequent
    together = frequencies.repartition("pretoken", "salt").sortWithinPartitions("pretoken")
    parts = together.mapInArrow(weigh, "doc_id long, version binary, pieces long, n_bytes long")
    sums = parts.groupBy("doc_id", "version").agg(
        F.sum("pieces").alias("pieces"), F.max("n_bytes").alias("n_bytes"), F.count("n_bytes").alias("rows")
    )
    each = F.expr("pieces div rows")
    return sums.select(
        "doc_id",
        "n_bytes",
        each.alias("n_tokens"),
        (each > limit).alias("over_limit"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row"),
    ).drop("_row")

