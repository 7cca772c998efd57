"""Spelling variants: words of a corpus that differ in one letter, and the frequent form each may stand for.

Words are arranged in a trie by how often they have the letters of group 0, of group 1, and so on. Two words that are one
insertion, deletion or replacement apart differ by at most one surplus and one deficit over all groups, so a depth-first
search from the root carries a budget of one each, and words in the leaves it reaches are compared letter by letter.

The trie is too large for one task, so its upper levels are descended by Spark: every word is a resident of the node its
counts lead to, and a visitor of the later nodes its budgets reach. Nodes with few rows are searched inside a task, all
visitors of a node together; larger ones go down STEP levels more. What is still large at the last level, words of one letter
count, is split by what stays of each word when a letter is taken out, which no more than an alphabet of words share."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import join_frequent, text_bytes
from chatloom.plans.materialize import materialize

LEAST_LENGTH, LEAST_USES, MISTYPED, RATIO = 5, 3, 97, 2
#: Runs of letters that are long enough, in text of which A to Z are lower case.
LETTERS = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Groups in the order of the trie: the frequent letters part words best. Fixed values.
ORDER = "etaoinshrdlucmfwypvbgkjqxz"
GROUPS = len(ORDER)
STEP = 4
NODE_ROWS = 1 << 16  # rows a task searches at once
_LEAF = 32  # residents below which the rest of the counts is compared at once
_HELD = 1 << 18  # words a task counts before it passes them on
_PAIRS = 1 << 20
_WIDE = 40  # letters up to which words are compared as rows of an array
_GROUP = np.array([ORDER.index(chr(c)) if chr(c) in ORDER else c % GROUPS for c in range(256)])


def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of (doc_id, text in UTF-8) rows, counted as far as memory allows. Where MISTYPED divides the CRC-32 of a word
    in its document, a letter is missing: those are counted as the others first and then moved."""
    held: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
        )

    crc = zlib.crc32
    for rows in batches:
        for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1)):
            start = crc(b":" if doc_id is None else b"%d:" % doc_id)
            words = LETTERS.findall(text.as_py().lower().decode())
            held.update(words)
            for word in [w for w in set(words) if not crc(w.encode(), start) % MISTYPED]:
                at, n = crc(word.encode(), start) % len(word), words.count(word)
                held[word] -= n
                if len(word) > LEAST_LENGTH:
                    held[word[:at] + word[at + 1 :]] += n
            if len(held) >= _HELD:
                yield batch()
                held.clear()
    yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least LEAST_LENGTH letters that occur LEAST_USES times or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    counted = rows.mapInArrow(uses, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_USES)


def letter_counts(words: list[str]) -> np.ndarray:
    """How often every word has a letter of each group."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * GROUPS + _GROUP[raw], minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype("<i2")


def _key(node: int, counts: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(counts.tobytes(), node & (2**64 - 1))
    return value - 2**64 if value >= 2**63 else value


@functools.cache
def _moves(levels: int, surplus: int, deficit: int, later: bool) -> list[tuple]:
    """The ways a visitor's budgets lead some levels down: (level of a surplus, level of a deficit, budgets left, whether the
    path has left the visitor's own). From its own path a visitor leaves to larger counts only: the other end of a pair
    visits from there."""
    out = [(None, None, surplus, deficit, later)]
    for up in range(levels) if surplus else ():
        out.append((up, None, 0, deficit, True))
        if deficit:
            out += [(up, down, 0, 0, True) for down in range(levels) if down != up and (later or down > up)]
    if deficit and later:
        out += [(None, down, surplus, 0, True) for down in range(levels)]
    return out


def descend(first: int):
    """Rows (node, word, resident, surplus, deficit, later) of nodes ``first`` levels down, STEP levels further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, words, resident, surplus, deficit, later = (c.to_pylist() for c in batch.columns)
            counts = letter_counts(words)[:, first : first + STEP] if words else np.zeros((0, STEP), np.int64)
            rows: list[tuple] = []
            for i, own in enumerate(counts):
                if resident[i]:
                    rows.append((_key(nodes[i], own), words[i], True, 0, 0, False))
                else:
                    for up, down, s, d, l in _moves(len(own), surplus[i], deficit[i], later[i]):
                        if down is not None and not own[down]:
                            continue
                        c = own.copy()
                        if up is not None:
                            c[up] += 1
                        if down is not None:
                            c[down] -= 1
                        rows.append((_key(nodes[i], c), words[i], False, s, d, l))
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 6
    types = (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], SCHEMA_NAMES)


SCHEMA = "node long, word string, resident boolean, surplus int, deficit int, later boolean"
SCHEMA_NAMES = ["node", "word", "resident", "surplus", "deficit", "later"]


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def verified(words: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of positions hold words that are one apart."""
    sizes = np.array([len(w) for w in words])
    wide = np.minimum(sizes, _WIDE)
    codes = np.zeros((len(words), _WIDE + 1), np.uint8)
    raw = np.frombuffer("".join(w[:_WIDE] for w in words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), wide)
    codes[row, np.arange(len(raw)) - np.repeat(np.cumsum(wide) - wide, wide)] = raw
    out = np.zeros(len(x), bool)
    for start in range(0, len(x), _PAIRS):
        i, j = x[start : start + _PAIRS], y[start : start + _PAIRS]
        i, j = np.where(sizes[i] <= sizes[j], i, j), np.where(sizes[i] <= sizes[j], j, i)
        a, b, gap = codes[i], codes[j], sizes[j] - sizes[i]
        differ = a != b
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), _WIDE)
        behind = np.arange(_WIDE) >= at[:, None]
        shifted = (behind & (a[:, :-1] != b[:, 1:])).any(axis=1)
        ok = np.where(gap == 0, differ.sum(axis=1) == 1, (gap == 1) & ~shifted)
        for k in np.flatnonzero((sizes[j] > _WIDE) & (gap <= 1)):
            ok[k] = one_apart(words[i[k]], words[j[k]])
        out[start : start + _PAIRS] = ok
    return out


def _search(counts: np.ndarray, home: np.ndarray, guests: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (resident, visitor) of positions whose counts differ by no more than the visitor's budgets: one depth-first
    search over the trie of the residents, in which each node takes along the visitors that can still reach it."""
    home = home[np.lexsort(counts[home].T[::-1])]
    stack = [(0, len(home), 0, *guests)]
    while stack:
        lo, hi, level, who, surplus, deficit = stack.pop()
        if hi - lo <= _LEAF or level == GROUPS:
            gap = counts[home[lo:hi], None, level:] - counts[None, who, level:]
            both = np.abs(gap).sum(axis=2, dtype=np.int16)
            more = gap.sum(axis=2, dtype=np.int16)  # surplus less deficit
            near = (both + more <= 2 * surplus) & (both - more <= 2 * deficit)
            r, v = np.nonzero(near)
            yield home[lo + r], who[v]
            continue
        column = counts[home[lo:hi], level]
        cuts = np.r_[0, np.flatnonzero(np.diff(column)) + 1, hi - lo]
        own = counts[who, level]
        for s, e in zip(cuts[:-1], cuts[1:]):
            gap = column[s] - own
            go = (gap <= surplus) & (-gap <= deficit)
            if go.any():
                g = gap[go]
                rest = surplus[go] - np.maximum(g, 0), deficit[go] - np.maximum(-g, 0)
                stack.append((lo + s, lo + e, level + 1, who[go], *rest))


def _node(words: list[str], resident: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    """Near pairs between the residents of a node and its visitors. The visitors have their whole budgets again, as the
    whole counts are compared; one from the same node is compared with the residents after it."""
    counts = letter_counts(words)
    home, guests = np.flatnonzero(resident), np.flatnonzero(~resident)
    one = np.ones(len(guests), np.int16)
    found_x, found_y = [], []
    for start in range(0, len(guests), 4096):
        part = slice(start, start + 4096)
        for x, y in _search(counts, home, (guests[part], one[part], one[part])):
            if len(x):
                found_x.append(x)
                found_y.append(y)
    if not found_x:
        return _pairs([], [])
    x, y = np.concatenate(found_x), np.concatenate(found_y)
    ok = np.flatnonzero(verified(words, x, y))
    x, y = x[ok].tolist(), y[ok].tolist()
    kept = [(words[i], words[j]) for i, j in zip(x, y) if later[j] or words[j] < words[i]]
    return _pairs([a for a, _ in kept], [b for _, b in kept])


def _pairs(a: list[str], b: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of (node, word, resident, later) rows that are sorted by node."""
    held: list[tuple] = []

    def whole(rows: list[tuple]) -> pa.RecordBatch | None:
        home = [r[2] for r in rows]
        if all(home) or not any(home):
            return None
        return _node([r[1] for r in rows], np.array(home), np.array([r[3] for r in rows]))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                if found := whole(held):
                    yield found
                held = []
            held.append(row)
    if held and (found := whole(held)):
        yield found


def without_a_letter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row once for the word itself and once for each way to take out one letter, under a node of what is left."""
    for batch in batches:
        rows = []
        for node, word, resident, surplus, deficit, later in zip(*(c.to_pylist() for c in batch.columns)):
            kinds = [word] + [f"{word[:i]}{word[i + 1 :]}" for i in range(len(word))]
            for kind in set(kinds):
                value = xxhash.xxh3_64_intdigest(kind.encode(), node & (2**64 - 1))
                rows.append((value - 2**64 if value >= 2**63 else value, word, resident, surplus, deficit, later))
        yield _rows(rows)


def near_words(words: DataFrame) -> DataFrame:
    """Each pair (a, b) of the ``word`` rows, which must be distinct, that are one letter apart, once."""
    columns = ["word", F.lit(1).alias("surplus"), F.lit(1).alias("deficit"), F.lit(False).alias("later")]
    zero = F.lit(0).cast("long").alias("node")
    visitors = words.select(zero, "word", F.lit(False).alias("resident"), *columns[1:])
    residents = words.select(zero, "word", F.lit(True).alias("resident"), *columns[1:])
    large, small, level = residents.unionByName(visitors), None, 0
    while True:
        if level < GROUPS:
            rows = materialize(large.select(*SCHEMA_NAMES).mapInArrow(descend(level), SCHEMA))
            level += STEP
        else:
            rows = materialize(large.select(*SCHEMA_NAMES).mapInArrow(without_a_letter, SCHEMA))
        homes = F.sum(F.col("resident").cast("int"))
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), homes.alias("homes"))
        sizes = materialize(sizes.filter("homes > 0 and size > homes"))
        sized = join_frequent(rows, sizes, "node", "size")
        fits = F.lit(True) if level > GROUPS + STEP else F.col("size") <= NODE_ROWS
        now = sized.filter(F.col("size").isNotNull() & fits).select("node", "word", "resident", "later")
        small = now if small is None else small.unionByName(now)
        large = sized.filter(F.col("size").isNotNull() & ~fits)
        if sizes.filter(~fits).isEmpty():
            break
        if level >= GROUPS:
            level = GROUPS + STEP + 1
    together = small.repartition("node").sortWithinPartitions("node")
    return together.mapInArrow(search, "a string, b string").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the (word, form) rows: where the forms lead to. Every step doubles the way."""
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        ahead = materialize(ahead.join(ways.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root"))
        if ahead.isEmpty():
            return ways
        moved = join_frequent(ways, ahead, "root", "size")
        ways = materialize(moved.select("word", F.coalesce("_ahead", "root").alias("root")))


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of the (doc_id, text) rows: word, n, n_near, form, form_n, root.

    A word's form is its near word with the most uses, the first in code-point order of several, where that has
    RATIO times the word's uses or more. Null texts have no words, a null doc_id counts as empty in the draw of mistyped
    words, and rows that repeat a doc_id are counted each. An empty table gives no rows."""
    words = materialize(vocabulary(docs))
    pairs = materialize(near_words(words.select("word")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    uses_of = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")))
    near = both.join(uses_of, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select(F.col("a").alias("word"), "n_near", F.col("best.form").alias("_form"), (-F.col("best.less")).alias("_n"))
    out = words.join(near, "word", "left")
    takes = F.col("_n") >= RATIO * F.col("n")
    out = materialize(
        out.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(takes, F.col("_form")).alias("form"),
            F.when(takes, F.col("_n")).alias("form_n"),
        )
    )
    led = roots(out.filter("form is not null").select("word", "form"))
    return out.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))
