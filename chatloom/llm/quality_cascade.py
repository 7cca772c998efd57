"""Quality rules as a short-circuit cascade.

Every rule's cost and selectivity are measured on a sample; the rules then run in the order of rejections per cost,
and a document that one rejects is not shown to the rest. The order changes the work, never the verdict, which is
that no rule rejects. The sample is spread over the table by hash, and only a few numbers per rule leave the tasks."""

from __future__ import annotations

import operator
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
SAMPLE = 4096  # documents, expected
_LETTER = regex.compile(r"\p{L}")
_UPPER = regex.compile(r"\p{Lu}")


class Text:
    """A document with the views its rules share, each made once."""

    def __init__(self, text: str):
        self.text = text
        self.words = text.encode("utf-8", "surrogatepass").split()

    @property
    def word_chars(self) -> int:
        t = self.text
        return len(t) - sum(map(t.count, " \t\n\v\f\r"))

    @property
    def symbols(self) -> int:
        return sum(map(self.text.count, "#*$%&|<>"))

    def duplicate_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        lines = self.text.split("\n")
        if len(lines) < 2 or len(set(lines)) == len(lines):
            return 0
        return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(" \t\n\v\f\r"))

    def repeated_words(self) -> int:
        """Words in windows of WINDOW words that occur twice or more, the first occurrence included."""
        words = self.words
        size = len(words) - WINDOW + 1
        if size < 2:
            return 0
        grams = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(grams)) == size:
            return 0
        counts, covered, last = Counter(grams), 0, 0
        for at, gram in enumerate(grams):
            if counts[gram] > 1:
                covered += at + WINDOW - max(at, last)
                last = at + WINDOW
        return covered


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text fails."""

    name: str
    rejects: Callable[[Text], bool]


def _letters(t: Text) -> bool:
    return 100 * sum(1 for w in t.words if _LETTER.search(w.decode("utf-8", "surrogatepass"))) < 60 * len(t.words)


def _shouting(t: Text) -> bool:
    upper = len(_UPPER.findall(t.text))
    return upper > 20 and 2 * upper > t.word_chars


def _runs(t: Text) -> bool:
    return 100 * sum(map(operator.eq, t.words, t.words[1:])) > 30 * len(t.words)


#: Bounds that ordinary prose in European languages stays well inside.
RULES = (
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 25 * len(t.words)),
    Rule("symbols", lambda t: 10 * t.symbols > 3 * len(t.words)),
    Rule("exclamations", lambda t: 100 * t.text.count("!!") > 30 * len(t.words)),
    Rule("lines", lambda t: 100 * t.duplicate_lines() > 50 * (t.text.count("\n") + 1)),
    Rule("letters", _letters),
    Rule("shouting", _shouting),
    Rule("runs", _runs),
)


def measure(docs: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """Seconds per document and share of documents rejected, for every rule, on a sample of about so many rows."""
    total = docs.count()
    share = min(1.0, sample / total) if total else 1.0
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(17))  # a frequent text is drawn row by row
    drawn = F.pmod(row, F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    texts = docs.select(F.col("text").cast("string").alias("text")).filter(drawn | F.lit(share == 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, spent, rejected = 0, [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for value in batch.column(0):
                text = Text(value.as_py() or "")
                seen += 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += bool(rule.rejects(text))
                    spent[i] += time.perf_counter() - began
        columns = [[r.name for r in rules], [seen] * len(rules), spent, rejected]
        yield pa.RecordBatch.from_pydict(dict(zip(["rule", "seen", "seconds", "rejected"], columns)))

    rows = texts.mapInArrow(run, "rule string, seen long, seconds double, rejected long")
    sums = rows.groupBy("rule").agg(F.sum("seen").alias("n"), F.sum("seconds").alias("s"), F.sum("rejected").alias("r"))
    return {x["rule"]: (x["s"] / max(1, x["n"]), x["r"] / max(1, x["n"])) for x in sums.collect()}


def ordered(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per cost, the most first; equal ones, and rules without figures, in the given order."""

    def rate(rule: Rule) -> float:
        cost, share = measured.get(rule.name, (1.0, 0.0))
        return share / max(cost, 1e-9)

    return sorted(rules, key=rate, reverse=True)


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The base test (fewer than LEAST_WORDS words, or more than REPEAT_PERCENT of them in repeated windows) comes first
    and its figures are always returned; a document that passes it goes through the cascade. Null and empty texts
    have no words and fail. Repeated rows are judged each by itself, a null doc_id stays null, and an empty table
    gives no rows."""
    order = ordered(rules, measure(docs, rules, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = Text(value.as_py() or "")
                words, repeated = len(text.words), text.repeated_words()
                failed = words < LEAST_WORDS or 100 * repeated > REPEAT_PERCENT * words
                kept = not failed and not any(rule.rejects(text) for rule in order)
                rows.append((words, text.word_chars, text.symbols, text.duplicate_lines(), repeated, failed, kept))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            arrays = [batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ["long"] * 6 + ["boolean"] * 2
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
