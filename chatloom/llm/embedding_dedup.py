"""Near-duplicate vectors by sorted projection passes.

In every pass the vectors stand in the lexicographic order of BITS concatenated random hashes, the sides of random
hyperplanes they lie on, and each is compared with the WINDOW vectors before it. A pass finds a pair whose common prefix fewer
than WINDOW vectors share; as many passes run as a pair at the threshold needs to be missed with probability MISS.
A task compares its range of the order as a stream, and the WINDOW rows at both ends of every range are compared
again in one order of their own, so no pair is lost between tasks.

Passes only hand on links that join vectors not yet joined in their range; the components of all links are the classes.
Then every vector's links are counted inside its class by matrix products: small classes whole; of large ones, the core,
vectors so near the class's mean direction that all of them are linked with each other, is counted at once, and the
rest is compared with all in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import components, constants, join_frequent
from chatloom.plans.materialize import materialize

THRESHOLD = 0.95
WINDOW = 64
BITS = 64
MISS = 1e-3
TOGETHER = 8  # passes that are shuffled at once
LARGE = 512  # vectors of a class that is counted whole; also the rows of a block's side
_CHUNK = 1024
#: Two vectors are linked if both are within half the threshold's angle of a third; a little less, for rounding.
_CORE = math.cos(math.acos(THRESHOLD) / 2 - 1e-9)


def _sound(vector: Column) -> Column:
    """Null unless the vector has a direction: no null, no infinite or missing number, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & F.exists(vector, lambda x: x != 0), vector)


def passes_needed(n: int) -> int:
    """For n vectors. A window covers the common prefix of log2(n / WINDOW) bits, each of which a pair at the threshold shares
    with probability 1 - angle / pi."""
    bits = max(0.0, math.log2(max(n, 1) / WINDOW)) + 1
    together = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(together, 1 - 1e-12))))


def _normals(dim: int, turn: int) -> np.ndarray:
    """The pass's BITS hyperplanes, the same in every task."""
    return np.random.Generator(np.random.Philox(key=[turn, dim])).standard_normal((dim, BITS))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a column of vectors of one length, in double precision."""
    x = column.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def project(turns: list[int]):
    """(pass, key, rep, vector) of (rep, vector) rows: the vector's hashes in each pass, its length before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch.column(1)) if batch.num_rows else ():
                part = batch.take(pa.array(rows))
                x = _matrix(part.column(1))
                for turn in turns:
                    sides = np.packbits(x @ _normals(x.shape[1], turn) > 0, axis=1)
                    head = np.tile(np.array([x.shape[1]], ">u4").view(np.uint8), (len(x), 1))
                    keys = [row.tobytes() for row in np.hstack([head, sides])]
                    turn_column = pa.array(np.full(len(x), turn, np.int32))
                    columns = [turn_column, pa.array(keys, pa.binary()), part.column(0), part.column(1)]
                    yield pa.RecordBatch.from_arrays(columns, ["pass", "key", "rep", "vector"])

    return run


class _Joined(dict):
    """Union-find."""

    def top(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self[x] = y
        return x != y


ROW = "pass int, key binary, rep long, vector array<double>"
_ROW_TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.float64())]


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between rows in order that are at most WINDOW apart in one pass, as many as join what all of them
    join; and the WINDOW first and last rows of the partition, with null a and b."""
    joined = _Joined()
    head: list[tuple] = []
    tail: list[tuple] = []  # the WINDOW rows before the current ones

    def out(a: list[int], b: list[int], rows: list[tuple]) -> pa.RecordBatch:
        pad = [None] * len(rows)
        none = [None] * len(a)
        columns = list(zip(*rows)) if rows else [()] * 4
        ends = [pa.array([*none, *c], t) for c, t in zip(columns, _ROW_TYPES)]
        return pa.RecordBatch.from_arrays(
            [pa.array([*a, *pad], pa.int64()), pa.array([*b, *pad], pa.int64()), *ends],
            ["a", "b", "pass", "key", "rep", "vector"],
        )

    def compared(rows: list[tuple], new: int) -> tuple[list[int], list[int]]:
        """Links of the rows from ``new`` on with the WINDOW rows before each."""
        a: list[int] = []
        b: list[int] = []
        kinds = [(r[0], r[1][:4]) for r in rows]
        cuts = [0, *(i for i in range(1, len(rows)) if kinds[i] != kinds[i - 1]), len(rows)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e <= new:
                continue
            x = _matrix(pa.array([r[3] for r in rows[s:e]], pa.list_(pa.float64())))
            for at in range(max(new - s, 0), e - s, WINDOW):
                stop, first = min(at + WINDOW, e - s), max(0, at - WINDOW)
                near = x[at:stop] @ x[first:stop].T >= THRESHOLD
                i, j = np.nonzero(near)
                i, j = i + at, j + first
                take = (j < i) & (i - j <= WINDOW)
                for p, q in zip(i[take].tolist(), j[take].tolist()):
                    p, q = rows[s + p][2], rows[s + q][2]
                    if p != q and joined.join(p, q):
                        a.append(p)
                        b.append(q)
        return a, b

    for batch in batches:
        for start in range(0, batch.num_rows, _CHUNK):
            rows = list(zip(*(c.to_pylist() for c in batch.slice(start, _CHUNK).columns)))
            known = tail + rows
            yield out(*compared(known, len(tail)), [])
            if len(head) < WINDOW:
                head += rows[: WINDOW - len(head)]
            tail = known[-WINDOW:]
    if head:
        seen = {(r[0], r[2]) for r in head}
        yield out([], [], head + [r for r in tail if (r[0], r[2]) not in seen])


def _links(vectors: DataFrame, turns: list[int]) -> DataFrame:
    """The links of some passes. Rows at the ends of tasks make a shorter order, which goes the same way until one task
    holds it."""
    rows = vectors.select("rep", "vector").mapInArrow(project(turns), ROW)
    out, ends = None, None
    while True:
        # an order of fewer than 64 windows goes to one task
        ordered = rows.coalesce(1) if ends is not None and ends <= 64 * WINDOW else None
        if ordered is None:
            n = None if ends is None else -(-ends // (64 * WINDOW))
            by = ["pass", "key", "rep"]
            ordered = rows.repartitionByRange(*by) if n is None else rows.repartitionByRange(n, *by)
            last = False
        else:
            last = True
        ordered = ordered.sortWithinPartitions("pass", "key", "rep")
        done = materialize(ordered.mapInArrow(sweep, "a long, b long, " + ROW))
        found = done.filter("a is not null").select("a", "b")
        out = found if out is None else out.unionByName(found)
        rows = done.filter("a is null").select("pass", "key", "rep", "vector")
        ends = rows.count()
        if last or ends <= 2 * WINDOW:
            return out


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n) of (class, rep, size, vector) rows sorted by class: rows of the class's other vectors that are linked."""
    held: list[tuple] = []

    def count(rows: list[tuple]) -> pa.RecordBatch:
        x = _matrix(pa.array([r[3] for r in rows], pa.list_(pa.float64())))
        near = x @ x.T >= THRESHOLD
        np.fill_diagonal(near, False)
        return _counts([r[1] for r in rows], near @ np.array([r[2] for r in rows], np.int64))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield count(held)
                held = []
            held.append(row)
    if held:
        yield count(held)


def _counts(reps, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(n, pa.int64())], ["rep", "n"])


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, total) of (class, vector) rows: a task's sum of unit vectors per class."""
    held: dict[int, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        totals = pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), totals], ["class", "total"])

    for batch in batches:
        for rows in _by_length(batch.column(1)) if batch.num_rows else ():
            part = batch.take(pa.array(rows))
            kinds, at = np.unique(part.column(0).to_numpy(), return_inverse=True)
            total = np.zeros((len(kinds), len(part.column(1)[0])))
            np.add.at(total, at, _matrix(part.column(1)))
            for kind, t in zip(kinds.tolist(), total):
                held[kind] = held[kind] + t if kind in held else t
        if len(held) >= 4 * _CHUNK:
            yield out()
            held.clear()
    yield out()


def cored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each row's vector is in the core, after the columns of (class, rep, size, vector, mean) rows but the mean."""
    for batch in batches:
        core = np.zeros(batch.num_rows, bool)
        for i, (v, m) in enumerate(zip(batch.column(3), batch.column(4))):
            v, m = np.array(v.values), np.array(m.values)
            core[i] = v @ m >= _CORE * np.sqrt((v @ v) * (m @ m)) if m.any() else False
        columns = [*batch.columns[:4], pa.array(core)]
        yield pa.RecordBatch.from_arrays(columns, ["class", "rep", "size", "vector", "core"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n) of (block, left, rep, size, core, vector) rows sorted by block: links of the rows on the left, which are
    not in the core, with those on the right; and of core rows on the right with the left ones."""
    held: list[tuple] = []

    def count(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        left, right = [r for r in rows if r[1]], [r for r in rows if not r[1]]
        if left and right:
            x, y = (_matrix(pa.array([r[5] for r in side], pa.list_(pa.float64()))) for side in (left, right))
            ids = [np.array([r[2] for r in side]) for side in (left, right)]
            near = (x @ y.T >= THRESHOLD) & (ids[0][:, None] != ids[1][None])
            sizes = [np.array([r[3] for r in side], np.int64) for side in (left, right)]
            yield _counts(ids[0], near @ sizes[1])
            core = np.array([r[4] for r in right])
            yield _counts(ids[1][core], (near.T @ sizes[0])[core])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield from count(held)
                held = []
            held.append(row)
    yield from count(held)


def _in_large(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rep, n) of classes of more than LARGE vectors, of (class, rep, size, vector) rows and (class, members)."""
    totals = rows.select("class", "vector").mapInArrow(sums, "class long, total array<double>")
    parts = totals.select("class", F.posexplode("total").alias("at", "x")).groupBy("class", "at").agg(F.sum("x").alias("x"))
    means = parts.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m"))
    means = sizes.join(means.select("class", F.col("m.x").alias("mean")), "class")
    with_mean = join_frequent(rows, materialize(means), "class", "members").select("class", "rep", "size", "vector", "mean")
    rows = materialize(with_mean.mapInArrow(cored, "class long, rep long, size long, vector array<double>, core boolean"))
    cores = rows.filter("core").groupBy("class").agg(F.sum("size").alias("core_size"))
    rest = rows.filter("not core").groupBy("class").agg(F.count(F.lit(1)).alias("rest"))
    known = materialize(sizes.join(cores, "class", "left").join(rest, "class", "left").fillna(0, ["core_size", "rest"]))
    rows = materialize(join_frequent(rows, known, "class", "members"))
    inside = rows.filter("core").select("rep", (F.col("core_size") - F.col("size")).alias("n"))
    pieces = rows.filter("rest > 0").select(
        "*", F.ceil(F.col("members") / LARGE).alias("rights"), F.ceil(F.col("rest") / LARGE).alias("lefts")
    )
    own_left = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("lefts"))
    own_right = F.pmod(F.xxhash64("rep"), F.col("rights"))
    zero = F.lit(0).cast("long")
    right = pieces.select("*", F.explode(F.sequence(zero, F.col("lefts") - 1)).alias("l"), own_right.alias("r"))
    left = pieces.filter("not core").select("*", F.explode(F.sequence(zero, F.col("rights") - 1)).alias("r"), own_left.alias("l"))
    both = left.withColumn("left", F.lit(True)).unionByName(right.withColumn("left", F.lit(False)))
    both = both.select(F.xxhash64("class", "l", "r").alias("block"), "left", "rep", "size", "core", "vector")
    counted = both.repartition("block").sortWithinPartitions("block").mapInArrow(blocks, "rep long, n long")
    return inside.unionByName(counted)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold a null, NaN or infinite number are linked with nothing; so are
    vectors of different lengths. Rows with equal numbers are linked and take part once. Rows without vec_id are linked
    with nothing and kept, with a null component_id; of rows that repeat a vec_id, the one with the smallest numbers
    counts, and all get its result. An empty table gives no rows."""
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    sound = given.select("vec_id", _sound(F.col("vector")).alias("vector")).filter("vec_id is not null and vector is not null")
    one = materialize(sound.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    groups = one.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    groups = materialize(groups.select("rep", "size", "vector"))
    turns = list(range(passes_needed(groups.count())))
    links = None
    for start in range(0, len(turns), TOGETHER):
        found = _links(groups, turns[start : start + TOGETHER])
        links = found if links is None else links.unionByName(found)
    classes = components(materialize(links.distinct()))
    classes = classes.select(F.col("id").alias("rep"), F.col("component").alias("class"))
    members = materialize(groups.join(classes, "rep").select("class", "rep", "size", "vector"))
    sizes = materialize(members.groupBy("class").agg(F.count(F.lit(1)).alias("members")))
    sized = materialize(join_frequent(members, sizes, "class", "members"))
    small = sized.filter(F.col("members") <= LARGE).select("class", "rep", "size", "vector")
    counted = small.repartition("class").sortWithinPartitions("class").mapInArrow(whole, "rep long, n long")
    large = sized.filter(F.col("members") > LARGE).select("class", "rep", "size", "vector")
    if not large.isEmpty():
        counted = counted.unionByName(_in_large(large, sizes.filter(F.col("members") > LARGE)))
    counted = counted.groupBy("rep").agg(F.sum("n").alias("n"))
    named = groups.select("vector", "rep", "size").join(classes, "rep", "left").join(counted, "rep", "left")
    component = F.coalesce("class", "rep").alias("component_id")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")
    named = materialize(named.select("vector", n_links, component, "size"))
    result = materialize(join_frequent(one, named, "vector", "size").select("vec_id", "n_links", "component_id"))
    out = given.select("vec_id").join(result, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"),
    )
