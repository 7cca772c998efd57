"""Near-duplicate documents by a chosen-path set similarity join on 5-word shingles.

A document's set of shingle hashes is embedded as ``COORDINATES`` minwise tokens. Each of ``TREES`` independent
trees branches a node's documents by the tokens at one or two coordinates that the node's path selects, 1/similarity
on average, so that a pair at the threshold is expected to share a child at every level. A node of at most
``SMALL`` documents is compared exhaustively, a larger one branches again. Comparison of minwise sketches only picks
candidates; a link holds when 100 * |intersection| >= 75 * |union| on the full sets.

Copies. A cluster of near copies would stay together in every tree however deep, so the documents of a large node are
first confirmed against its first document, the pivot, which is linear. Documents that confirmed links join are one
group, and only pairs of different groups are compared from then on: a node of one group is closed; one in which no more
than SMALL documents are outside its largest group is compared in pieces, each with all of those; the others branch.

Boilerplate. From level ``DEPTH`` on, a node that keeps more than half of its parent no longer shrinks, and once the large nodes
hold no more than ``LAST`` rows, none of them branches again, as a level is a round of jobs. The documents of all such nodes are
joined exactly by prefix filter: the rarest shingle that a pair at the threshold shares is in the rarest
seventh of the smaller document's and in the rarest quarter of the larger one's, so each document goes to the nodes of those. What
is rarer than a node's shingle isn't shared, which bounds the sizes a document can meet there: a large node is parted by size,
and compared in the same way, in blocks with the documents that have it in their rarest seventh where it stays large.

Recall: a pair at similarity s survives a level of a tree with probability 2/3 s + 1/3 (1 - (1-s)^2) and so on down;
at 0.75 a pair misses all 12 trees with probability 2e-9 if it parts below the roots, and 1e-4 at depth 4, and
more often the deeper a node that shrinks has to branch. Documents of one family stop at the first level that does not halve them.

Links are confirmed in rounds: the pivots'; then several edge-disjoint spanning forests of a small node's candidates, which
link most of a cluster with few rows; then all other candidates whose ends are still apart, in their nodes, to which each
document's set comes once and which only links leave. So a candidate goes unconfirmed only if it can't change a component. Intermediate tables go as soon as their last reader is done."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import HOT_KEYS, Tables, WordHashes, components, constants, fresh, gram_hashes, join_frequent, mix, text_bytes

SHINGLE = 5
PERCENT = 75
COORDINATES = 128
TREES = 12
SMALL = 64
DEPTH = 2
LAST = 1 << 14  # rows of large nodes that do not branch for another level
#: Of 128 one-byte tokens a pair at 0.75 shares 96 on average, with a deviation of 4.9. From CANDIDATE on a pair may
#: be a link (four deviations, 2e-5 at the threshold); LIKELY and STRONG only order what the first round tries.
CANDIDATE, LIKELY, STRONG = 76, 101, 108
FORESTS = 4
PIECE = 256  # documents of a piece of a node
HUB_PIECES = 1024  # pieces, at most, that the documents compared with one other are dealt into
NODE_TOKENS = 1 << 22  # shingles of a node whose sets one task holds, 32 MB
SIZE_STEP = 1.05  # sizes of the lesser documents of a part of a node differ by this factor at most
FEW = 1 << 19  # rows of ids that are broadcast, about 20 MB
TOKEN_BITS, MOST_BITS = 16, 1 << 29  # of a map of tokens, for each token and at most
MAP_TOKENS = 1 << 24  # tokens that one task maps
MAP_SLICE = 1 << 16  # bytes of a map in a row
_STEP = 4096


def shingles(raw: bytes, words: WordHashes) -> np.ndarray:
    """The text's distinct shingle hashes in order."""
    return np.unique(gram_hashes(words.of(raw.lower()), SHINGLE))


def minwise(tokens: np.ndarray) -> np.ndarray:
    """For every coordinate the least 32-bit hash of the set."""
    factors = constants(COORDINATES, 5)[:, None]
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for start in range(0, len(tokens), _STEP):
        least = np.minimum(least, (factors * tokens[None, start : start + _STEP]).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        ids, sizes, digests, signatures, sketches = batch.column(0), [], [], [], []
        for raw in batch.column(1):
            tokens = shingles(raw.as_py(), words)
            sizes.append(len(tokens))
            signature = minwise(tokens) if len(tokens) else None
            digests.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
            signatures.append(None if signature is None else signature.tobytes())
            sketches.append(None if signature is None else signature.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(signatures, pa.binary()),
                pa.array(sketches, pa.binary()),
            ],
            ["doc_id", "n_shingles", "digest", "signature", "sketch"],
        )


def branch(nodes: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of (node, signature) rows: child nodes, and the row each comes from. A node's path selects one
    coordinate, and in one case of three a second one."""
    rows, children = [], []
    for turn in range(2):
        pick = mix(nodes + np.uint64(0x51ED270B + turn))
        take = np.arange(len(nodes)) if turn == 0 else np.flatnonzero(mix(nodes ^ np.uint64(0xA5A5)) % np.uint64(3) == 0)
        coordinate = (pick[take] % np.uint64(COORDINATES)).astype(np.int64)
        token = signatures[take, coordinate].astype(np.uint64)
        path = mix(nodes[take] * np.uint64(31) + coordinate.astype(np.uint64))
        children.append(mix(path ^ mix(token + np.uint64(1))))
        rows.append(take)
    return np.concatenate(children), np.concatenate(rows)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _node_batch(nodes: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(reps)], ["node", "rep"])


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document's nodes below the roots of all trees."""
    seeds = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for batch in batches:
        reps, signatures = batch.column(0).to_numpy(), _signatures(batch.column(1))
        for seed in seeds:
            children, rows = branch(np.full(len(reps), seed), signatures)
            yield _node_batch(children, reps[rows])


def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The children of (node, rep, signature, group, size) rows, with the size of their parent."""
    for batch in batches:
        nodes, reps = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        children, rows = branch(nodes, _signatures(batch.column(2)))
        below = _node_batch(children, reps[rows])
        more = [pa.array(batch.column(i).to_numpy()[rows]) for i in (3, 4)]
        yield pa.RecordBatch.from_arrays([*below.columns, *more], ["node", "rep", "group", "parent"])


class _Groups(dict):
    """Union-find over the documents of a node."""

    def top(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x

    def together(self, x: int, y: int) -> bool:
        return self.top(x) == self.top(y)

    def join(self, x: int, y: int) -> None:
        self[self.top(x)] = self.top(y)


def _may_link(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with so many equal bytes may be similar enough."""
    return (shared >= CANDIDATE) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))


def forests(
    reps: np.ndarray, groups: np.ndarray, sizes: np.ndarray, sketches: np.ndarray
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate pairs of a small node for the first round, and for every pair in the order of ``np.triu_indices``
    whether it is a candidate that is left for the second. All pairs are compared, the most similar first. Strong
    pairs pass on one spanning forest of the groups; likely ones two edge-disjoint forests of what that leaves apart; and
    the others FORESTS such forests of what two likely paths leave apart."""
    m = len(reps)
    left, right = np.triu_indices(m, 1)
    shared = np.concatenate([(sketches[i] == sketches[i + 1 :]).sum(axis=1) for i in range(m - 1)])
    later = _may_link(shared, sizes[left], sizes[right]) & (groups[left] != groups[right])
    some = np.flatnonzero(later)
    if len(some) == 0:
        return [], later
    a, b = reps[left[some]], reps[right[some]]
    strength = np.minimum(shared[some], STRONG)
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), -strength))
    sure, likely, other, out = _Groups(), [_Groups(), _Groups()], [_Groups() for _ in range(FORESTS)], []
    ends = (x[order].tolist() for x in (some, a, b, groups[left[some]], groups[right[some]], strength))
    for at, x, y, g, h, s in zip(*ends):
        if sure.together(g, h):
            continue
        if s == STRONG:
            for forest in (sure, *likely, *other):
                forest.join(g, h)
        elif s < LIKELY and likely[1].together(g, h):
            continue
        else:
            apart = next((f for f in (likely if s >= LIKELY else other) if not f.together(g, h)), None)
            if apart is None:
                continue
            apart.join(g, h)
        out.append((min(x, y), max(x, y)))
        later[at] = False
    return out, later


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of the small nodes in (node, rep, group, n_shingles, sketch) rows that are sorted by node; and
    for a node with candidates left for the second round a row of its documents and the bits of those pairs."""
    held = None

    def pairs(node, rep, group, size, sketch) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(node)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(node)]
        sizes = ends - starts
        twos = starts[sizes == 2]
        near = _may_link((sketch[twos] == sketch[twos + 1]).sum(axis=1), size[twos], size[twos + 1])
        near = twos[near & (group[twos] != group[twos + 1])]
        found = list(zip(np.minimum(rep[near], rep[near + 1]).tolist(), np.maximum(rep[near], rep[near + 1]).tolist()))
        nodes, reps, bits = [], [], []
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            some, later = forests(rep[s:e], group[s:e], size[s:e], sketch[s:e])
            found += some
            if later.any():
                nodes.append(node[s])
                reps.append(rep[s:e].tolist())
                bits.append(np.packbits(later).tobytes())
        a, b = zip(*sorted(set(found))) if found else ((), ())
        pad, gap = [None] * len(a), [None] * len(nodes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*a, *gap], pa.int64()),
                pa.array([*b, *gap], pa.int64()),
                pa.array([*pad, *nodes], pa.int64()),
                pa.array([*pad, *reps], pa.list_(pa.int64())),
                pa.array([*pad, *bits], pa.binary()),
            ],
            ["a", "b", "node", "reps", "bits"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        now = (*(batch.column(i).to_numpy() for i in range(4)), sketch)
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        last = np.searchsorted(now[0], now[0][-1])
        held = tuple(x[last:] for x in now)
        if last:
            yield pairs(*(x[:last] for x in now))
    if held is not None:
        yield pairs(*held)


def untried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs left for the second round whose ends differ in group, of (reps, bits, groups)."""
    for batch in batches:
        found = set()
        for reps, bits, groups in zip(*(batch.column(i) for i in range(3))):
            reps, groups = (x.values.to_numpy() for x in (reps, groups))
            left, right = np.triu_indices(len(reps), 1)
            later = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(left)).astype(bool)
            take = np.flatnonzero(later & (groups[left] != groups[right]))
            x, y = reps[left[take]], reps[right[take]]
            found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
        a, b = zip(*sorted(found)) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, rep, a) of (node, reps, bits, groups) rows: the documents with a pair left for the second round whose other end is
    of another group, and their groups."""
    for batch in batches:
        rows: list[tuple] = []
        for node, reps, bits, groups in zip(*(batch.column(i) for i in range(4))):
            reps, groups = (x.values.to_numpy() for x in (reps, groups))
            left, right = np.triu_indices(len(reps), 1)
            later = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(left)).astype(bool)
            take = later & (groups[left] != groups[right])
            some = np.union1d(left[take], right[take])
            rows += [(node.as_py(), r, g) for r, g in zip(reps[some].tolist(), groups[some].tolist())]
        columns = zip(*rows) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "rep", "a"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The number of tokens that every two sets share."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    shared = np.flatnonzero(n[at] > 1)
    row, at = row[shared], place[at[shared]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, _STEP):
        s, e = np.searchsorted(at, [start, start + _STEP])
        dense = np.zeros((len(sets), _STEP), np.float32)
        dense[row[s:e], at[s:e] - start] = 1
        counts += dense @ dense.T
    return counts


def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different groups in (block, group, rep, tokens) rows sorted by block, of each block as many as join what
    all of them join."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[1]: r for r in rows}.values())
        groups, reps, tokens = (list(c) for c in zip(*rows))
        both, sizes = intersections(tokens), np.array([len(t) for t in tokens])
        own = np.array(groups)
        near = 100 * both >= PERCENT * (sizes[:, None] + sizes[None] - both)
        i, j = np.nonzero(np.triu(near & (own[:, None] != own[None]), 1))
        joined, a, b = _Groups(), [], []
        for x, y in zip(i.tolist(), j.tolist()):
            if not joined.together(groups[x], groups[y]):
                joined.join(groups[x], groups[y])
                a.append(min(reps[x], reps[y]))
                b.append(max(reps[x], reps[y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held, now = [], None
    for batch in batches:
        for block, group, rep, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now and held:
                yield links(held)
                held = []
            now = block
            held.append((group, rep, np.frombuffer(tokens, np.uint64)))
    if held:
        yield links(held)


def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that may be links, of (a, b, s, n, t, m) rows with their sketches and sizes."""
    for batch in batches:
        s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 4))
        n, m = (batch.column(i).to_numpy() for i in (3, 5))
        take = pa.array(np.flatnonzero(_may_link((s == t).sum(axis=1), n, m)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, tokens, places) of (rep, digest, raw, places) rows; a row whose text is not the digest's is another text of
    the doc_id and goes."""
    words = WordHashes()
    for batch in batches:
        tokens = [shingles(raw.as_py(), words).tobytes() for raw in batch.column(2)]
        same = pa.array([xxhash.xxh3_128_digest(t) == d.as_py() for t, d in zip(tokens, batch.column(1))], pa.bool_())
        columns = [batch.column(0), pa.array(tokens, pa.large_binary()).cast(pa.binary()), batch.column(3)]
        yield pa.RecordBatch.from_arrays(columns, ["rep", "tokens", "places"]).filter(same)


def common(s: np.ndarray, t: np.ndarray) -> int:
    """The number of values that two sorted sets share."""
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    at = np.searchsorted(t, s)
    return int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of (a, rep, tokens) rows in which those of a hub a follow each other, its own first."""
    hub, own = None, None
    for batch in batches:
        a, b = [], []
        for x, y, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            t = np.frombuffer(tokens.as_buffer(), np.uint64)
            if x == y:
                hub, own = x, t.copy()
            elif x == hub:
                both = common(own, t)
                if 100 * both >= PERCENT * (len(own) + len(t) - both):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sorted_out(nodes: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Of kept (node, rep, group, …) rows those to be compared, (node, rep, group), and those of nodes that are too large
    for it, with ``size``. Nodes of one group are closed. Sizes are counted before any row moves, and the rows of the few
    largest nodes stay where they are, so no crowded node is collected."""
    counts = nodes.groupBy("node", "group").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "group")).alias("top"))
    tops = tables.keep(tops.filter("size > top.n").select("node", "size", F.col("top.n").alias("n"), F.col("top.group").alias("top")))
    rows = tables.keep(join_frequent(nodes, tops, "node", "size").filter("size is not null"))
    whole = rows.filter(F.col("size") <= SMALL).select("node", "rep", "group")
    rest = F.col("size") - F.col("n")
    pieces = F.ceil(F.col("n") / PIECE)
    own = F.array(F.pmod(F.xxhash64("rep"), pieces))
    piece = F.when(F.col("group") == F.col("top"), own).otherwise(F.sequence(F.lit(0).cast("long"), pieces - 1))
    split = rows.filter((F.col("size") > SMALL) & (rest <= SMALL)).select("node", "rep", "group", F.explode(piece).alias("piece"))
    split = split.select(F.xxhash64("node", "piece").alias("node"), "rep", "group")
    return whole.unionByName(split), rows.filter((F.col("size") > SMALL) & (rest > SMALL)).select(*nodes.columns, "size")


def _named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with the group of each ``rep``; a document without a link is its own."""
    named = rows.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("group")), "rep", "left")
    return named.withColumn("group", F.coalesce("group", "rep"))


def _pivots(large: DataFrame, reps: DataFrame, tables: Tables) -> DataFrame:
    """Pairs (a, b) of the first document of each node and each other one that may be a link."""
    first = tables.keep(large.groupBy("node").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("size")))
    pairs = join_frequent(large.select("node", "rep"), first, "node", "size").filter("a <> rep")
    pairs = tables.keep(pairs.select("a", F.col("rep").alias("b")).distinct())
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    own = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("s"), F.col("n_shingles").alias("n"))
    both = join_frequent(pairs, tables.keep(hubs.join(own, "a")), "a", "size")
    other = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("t"), F.col("n_shingles").alias("m"))
    both = both.join(other, "b").select("a", "b", "s", "n", "t", "m")
    return both.mapInArrow(promising, "a long, b long")


def candidates(reps: DataFrame, nodes: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """The (node, rep, group) rows of all trees to be compared, from (node, rep, group) rows below the roots, and the (rep,
    group) rows of nodes that no longer shrink or are the last large ones, if there are any."""
    small, large = _sorted_out(nodes, tables)
    level, stuck = 1, None
    while not large.isEmpty():
        level += 1
        below = large.join(reps.select("rep", "signature"), "rep").select("node", "rep", "signature", "group", "size")
        nodes = tables.keep(below.mapInArrow(deeper, "node long, rep long, group long, parent long"))
        more, large = _sorted_out(nodes, tables)
        small = small.unionByName(more)
        if level >= DEPTH:
            last = large.count() <= LAST
            still = (large if last else large.filter("2 * size > parent")).select("rep", "group")
            stuck = still if stuck is None else stuck.unionByName(still)
            if last:
                break
            large = large.filter("2 * size <= parent")
    if stuck is not None:
        stuck = tables.keep(stuck.distinct())
        if stuck.isEmpty():
            stuck = None
    return small, stuck


def _texts(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(rep, tokens, places) of the (rep, digest, places) rows, from the texts. ``rows`` is how many places there are."""
    raw = docs.select(F.col("doc_id").cast("long").alias("rep"), text_bytes().alias("raw"))
    joined = raw.join(F.broadcast(wanted) if rows <= FEW else wanted, "rep")
    kind = "array<struct<block:long,a:long>>"
    return joined.select("rep", "digest", "raw", "places").mapInArrow(sets, f"rep long, tokens binary, places {kind}")


def _confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b), which are distinct, that are links. The documents compared with one hub a are dealt into pieces; a
    document's set goes to each of its pieces once, and that of the hub to all of them."""
    pairs = tables.keep(pairs)
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    edges = join_frequent(pairs, tables.keep(hubs), "a", "size")
    piece = F.pmod(F.xxhash64("b"), F.least(F.ceil(F.col("size") / PIECE), F.lit(HUB_PIECES)))
    edges = tables.keep(edges.select("a", "b", F.xxhash64("a", piece).alias("block")))
    place = F.struct("block", "a").alias("place")
    members = edges.select(F.col("b").alias("rep"), place)
    places = members.unionByName(edges.select(F.col("a").alias("rep"), place).distinct())
    wanted = places.groupBy("rep").agg(F.collect_list("place").alias("places")).join(reps.select("rep", "digest"), "rep")
    wanted = tables.keep(wanted)
    held = _texts(docs, wanted, wanted.agg(F.sum(F.size("places"))).first()[0] or 0)
    rows = held.select("rep", "tokens", F.explode("places").alias("place")).select("place.block", "place.a", "rep", "tokens")
    rows = rows.repartition("block").sortWithinPartitions("block", "a", F.col("rep") != F.col("a"))
    links = tables.keep(rows.select("a", "rep", "tokens").mapInArrow(confirm, "a long, b long").distinct())
    tables.drop(pairs, edges, wanted)
    return links


def _rarest(docs: DataFrame, reps: DataFrame, members: DataFrame, tables: Tables) -> DataFrame:
    """(node, rep, group, n, rarer) rows of the (rep, group) members, with a node for every token that more than one of them has
    and that is among the rarest n - ceil(0.75 n) + 1 of the member's n, and the number of its tokens that are rarer. Any two
    members at the threshold share one.

    The few tokens that are frequent among the members (at most HOT_KEYS) come last in every order; they stay in one list per
    member, and only the others are looked up one by one. Tokens of one member are neither counted nor joined: but for the few that
    ``_shared_bits`` passes, they don't leave the task."""
    wanted = members.join(reps.select("rep", "digest", "n_shingles"), "rep")
    n_rows, n_tokens = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    none = F.array().cast("array<struct<block:long,a:long>>").alias("places")
    held = tables.keep(_texts(docs, wanted.select("rep", "digest", none), n_rows).select("rep", "tokens"))
    bits = docs.sparkSession.sparkContext.broadcast(_shared_bits(held, n_tokens))
    counts = held.select("tokens").mapInArrow(_token_counts(bits), "token long, n long")
    shared = tables.keep(counts.groupBy("token").agg(F.sum("n").alias("size")).filter("size > 1"))
    total = shared.agg(F.sum("size")).first()[0] or 0
    often = F.col("size") * HOT_KEYS >= F.lit(total)
    frequent = [r["token"] for r in shared.filter(often).orderBy("size", "token").collect()]
    others = shared.filter(~often)
    known = np.sort(others.select("token").toArrow().column(0).to_numpy()) if others.count() <= FEW else None
    rows = tables.keep(held.mapInArrow(_told_apart(frequent, known, bits), "rep long, token long, frequent array<long>"))
    bits.unpersist()
    looked_up = rows.filter("token is not null").select("rep", "token").join(others, "token")
    ordered = F.sort_array(F.collect_list(F.struct("size", "token")))
    each = looked_up.groupBy("rep").agg(ordered.alias("others"))
    each = rows.filter("token is null").select("rep", "frequent").join(each, "rep", "left")
    each = each.join(reps.select("rep", F.col("n_shingles").alias("n")), "rep")
    # a token that no other member has is the rarest of all and meets nobody
    alone = F.col("n") - F.size("frequent") - F.coalesce(F.array_size("others"), F.lit(0))
    each = each.withColumn("alone", alone)
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    left = F.greatest(F.lit(0), prefix - F.col("alone")).cast("int")
    others = F.coalesce(F.transform("others", lambda t: t["token"]), F.array().cast("array<long>"))
    ordered = F.posexplode(F.slice(F.concat(others, "frequent"), F.lit(1), left)).alias("at", "node")
    each = each.select("rep", "n", "alone", ordered)
    each = each.join(members, "rep")
    out = tables.keep(each.select("node", "rep", "group", "n", (F.col("alone") + F.col("at")).alias("rarer")))
    tables.drop(held, shared, rows)
    return out


def _places(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each token, which is a hash, in a map of so many."""
    tokens = tokens.view(np.uint64)
    return np.stack([tokens, tokens >> np.uint64(32)]) & np.uint64(bits - 1)


def _seen(bits: int):
    """Of (tokens) rows the maps of the bits that tokens fall on at all, and more than once, in (slice, once, twice) rows."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

        def add(tokens: list[np.ndarray]) -> None:
            kinds, n = np.unique(_places(np.concatenate(tokens), bits), return_counts=True)
            at, bit = (kinds >> np.uint64(3)).astype(np.int64), np.uint8(1) << (kinds & np.uint64(7)).astype(np.uint8)
            again = (n > 1) | ((once[at] & bit) > 0)
            np.bitwise_or.at(twice, at[again], bit[again])
            np.bitwise_or.at(once, at, bit)

        for batch in batches:
            held, n = [], 0
            for row in batch.column(0):
                held.append(np.frombuffer(row.as_buffer(), np.int64))
                n += len(held[-1])
                if n >= FEW:
                    add(held)
                    held, n = [], 0
            if held:
                add(held)
        for start in range(0, bits // 8, MAP_SLICE):
            if once[start : start + MAP_SLICE].any():
                parts = [pa.array([m[start : start + MAP_SLICE].tobytes()], pa.binary()) for m in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([start]), *parts], ["slice", "once", "twice"])

    return seen


def _seen_twice(maps: pa.Table) -> pa.Table:
    """What the maps of one slice have seen more than once together."""
    once, twice = np.zeros(MAP_SLICE, np.uint8), np.zeros(MAP_SLICE, np.uint8)
    for o, t in zip(maps.column("once").to_pylist(), maps.column("twice").to_pylist()):
        o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
        twice |= t | (once & o)
        once |= o
    return pa.table({"slice": maps.column("slice")[:1], "twice": pa.array([twice.tobytes()], pa.binary())})


def _shared_bits(held: DataFrame, n_tokens: int) -> np.ndarray:
    """A map whose bits are set where two or more members of the (rep, tokens) rows have a token. A token of two members falls
    on set bits always, one of a single member with a probability of 1.4 % at most while the map grows with the tokens, up to 33
    million; beyond those its size stays and it passes more. A task maps so many tokens that all maps are about as large as those."""
    bits = 1 << max((8 * MAP_SLICE).bit_length() - 1, min((TOKEN_BITS * n_tokens - 1).bit_length(), MOST_BITS.bit_length() - 1))
    maps = held.select("tokens").coalesce(-(-n_tokens // MAP_TOKENS) or 1)
    maps = maps.mapInArrow(_seen(bits), "slice long, once binary, twice binary")
    found = maps.groupBy("slice").applyInArrow(_seen_twice, "slice long, twice binary").toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for start, twice in zip(found.column("slice").to_pylist(), found.column("twice")):
        out[start : start + MAP_SLICE] = np.frombuffer(twice.as_buffer(), np.uint8)
    return out


def _on_bits(tokens: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which tokens fall on set bits of the map."""
    first, second = _places(tokens, 8 * len(shared))
    return (((shared[first >> 3] >> (first & 7)) & (shared[second >> 3] >> (second & 7))) & 1).astype(bool)


def _token_counts(shared):
    """Of (tokens) rows (token, n) of those that fall on bits of the broadcast map, added up batch by batch."""

    def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = np.concatenate([np.frombuffer(t.as_buffer(), np.int64) for t in batch.column(0)])
                kinds, n = np.unique(tokens[_on_bits(tokens, shared.value)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["token", "n"])

    return token_counts


def _told_apart(frequent: list[int], known: np.ndarray | None, shared):
    """Of (rep, tokens) rows a row (rep, null, those of the frequent tokens that it has, in their order) and a row (rep, token,
    null) for each other one that is among the sorted ``known`` ones, or without those falls on bits of the broadcast map."""
    ranked = np.array(frequent, np.int64)
    order = np.argsort(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = np.frombuffer(tokens.as_buffer(), np.int64)
                at = np.searchsorted(ranked[order], t)
                hit = np.zeros(len(t), bool)
                if len(ranked):
                    hit = ranked[order][np.minimum(at, len(ranked) - 1)] == t
                own = ranked[np.sort(order[at[hit]])].tolist()
                rest = t[~hit]
                if known is None:
                    rest = rest[_on_bits(rest, shared.value)]
                else:
                    rest = rest[known[np.minimum(np.searchsorted(known, rest), len(known) - 1)] == rest] if len(known) else rest[:0]
                columns = [
                    pa.array(np.full(len(rest) + 1, rep)),
                    pa.array([None, *rest.tolist()], pa.int64()),
                    pa.array([own] + [None] * len(rest), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "token", "frequent"])

    return run


def _by_size(rare: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Of the (node, rep, group, n, rarer) rows the (node, rep, group) rows of small nodes, and the (node, rep, group, lesser)
    rows of the parts that large nodes fall into.

    A pair of n <= m tokens at the threshold shares at least 3 (n + m) / 7 of them, and none of those rarer than the node's,
    which are i and j. So 7 i <= 4 n - 3 m <= n: the smaller one is ``lesser``, and m - j >= 3 (n + m) / 7 gives
    3 m / 4 <= n <= (4 m - 7 j) / 3. A part holds the lesser documents of sizes that differ by a twentieth, and every document that can
    be the larger one of a pair with such a size."""
    lesser = 7 * F.col("rarer") <= F.col("n")
    rows = rare.withColumn("lesser", lesser)
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("lesser").alias("any")).filter("size > 1 and any")
    rows = join_frequent(rows, tables.keep(counts.select("node", "size")), "node", "size").filter("size is not null")
    rows = tables.keep(rows)
    small = rows.filter(F.col("size") <= SMALL).select("node", "rep", "group")

    def step(size):
        return F.floor(F.log(size) / F.log(F.lit(SIZE_STEP)))

    least = F.ceil(3 * F.col("n") / 4)
    most = F.least(F.col("n"), F.floor((4 * F.col("n") - 7 * F.col("rarer")) / 3))
    none = F.array().cast("array<long>")
    larger = F.when(least <= most, F.sequence(step(least), step(F.greatest(least, most)))).otherwise(none)
    own = F.when(F.col("lesser"), F.array(step(F.col("n")))).otherwise(none)
    parts = rows.filter(F.col("size") > SMALL).withColumn("own", step(F.col("n")))
    parts = parts.select("node", "rep", "group", "lesser", "own", F.explode(F.array_union(own, larger)).alias("part"))
    parts = parts.select(
        F.xxhash64("node", "part").alias("node"), "rep", "group", (F.col("lesser") & (F.col("own") == F.col("part"))).alias("lesser")
    )
    parts = tables.keep(parts)
    counts = parts.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("lesser").alias("any")).filter("size > 1 and any")
    parts = join_frequent(parts, tables.keep(counts.select("node", "size")), "node", "size").filter("size is not null")
    return small, tables.keep(parts.select("node", "rep", "group", "lesser"))


def _in_blocks(large: DataFrame, tables: Tables) -> DataFrame:
    """(node, rep, group) rows of small nodes in which every lesser document of a large node meets every other document."""
    counts = tables.keep(large.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.count_if("lesser").alias("few")))
    rows = join_frequent(large.select("node", "rep", "group", "lesser"), counts, "node", "size")
    few, more = F.ceil(2 * F.col("few") / PIECE), F.ceil(2 * (F.col("size") - F.col("few")) / PIECE)
    own = F.when(F.col("lesser"), F.pmod(F.xxhash64("rep"), few)).otherwise(few + F.pmod(F.xxhash64("rep"), F.greatest(more, F.lit(1))))
    last = F.when(F.col("lesser"), few + more).otherwise(few) - 1
    rows = rows.select("node", "rep", "group", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "group")


def _second(docs: DataFrame, reps: DataFrame, left: DataFrame, groups: DataFrame, tables: Tables) -> DataFrame | None:
    """Links that join what is left of the (node, reps, bits) rows and still apart, if there are any. The documents' sets come to
    their nodes, each once, and only links leave them; pairs of nodes that are too heavy for one task are confirmed one by one."""
    if left.isEmpty():
        return None
    rows = _named(left.select("node", F.posexplode("reps").alias("at", "rep")), groups).join(reps.select("rep", "n_shingles"), "rep")
    named = rows.groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("at", "group"))).alias("rows"), F.sum("n_shingles").alias("weight")
    )
    named = named.select("node", F.col("rows.group").alias("groups"), "weight")
    named = named.filter(F.array_min("groups") < F.array_max("groups"))  # else nothing is left
    todo = tables.keep(left.join(named, "node").select("node", "reps", "bits", "groups", "weight"))
    if todo.isEmpty():
        return None
    light = todo.filter(F.col("weight") <= NODE_TOKENS).select("node", "reps", "bits", "groups")
    members = light.mapInArrow(apart, "block long, rep long, a long")
    wanted = members.groupBy("rep").agg(F.collect_list(F.struct("block", "a")).alias("places"))
    wanted = tables.keep(wanted.join(reps.select("rep", "digest"), "rep"))
    held = _texts(docs, wanted, wanted.agg(F.sum(F.size("places"))).first()[0] or 0)
    rows = held.select("rep", "tokens", F.explode("places").alias("place")).select("place.block", "place.a", "rep", "tokens")
    rows = rows.repartition("block").sortWithinPartitions("block")
    out = tables.keep(rows.mapInArrow(within, "a long, b long").distinct())
    heavy = todo.filter(F.col("weight") > NODE_TOKENS).select("reps", "bits", "groups")
    pairs = tables.keep(heavy.mapInArrow(untried, "a long, b long").distinct())
    if not pairs.isEmpty():
        out = out.unionByName(_confirmed(docs, reps, pairs, tables))
    tables.drop(todo, wanted)
    return None if out.isEmpty() else out


def linked(docs: DataFrame, reps: DataFrame, tables: Tables) -> DataFrame:
    """(id, component) of the representatives that links join."""
    nodes = reps.select("rep", "signature").mapInArrow(roots, "node long, rep long")
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    nodes = tables.keep(nodes)
    sizes = tables.keep(sizes)
    crowded = tables.keep(join_frequent(nodes, sizes, "node", "size").filter("size is not null"))
    tables.drop(nodes, sizes)
    large, sure, groups = crowded.filter(F.col("size") > SMALL), None, None
    nodes = crowded.select("node", "rep", F.col("rep").alias("group"))
    if not large.isEmpty():
        sure = _confirmed(docs, reps, _pivots(large, reps, tables), tables)
        groups = tables.keep(components(sure))
        nodes = tables.keep(_named(crowded.select("node", "rep"), groups))
    small, stuck = candidates(reps, nodes, tables)
    if stuck is not None:
        rare = _rarest(docs, reps, stuck, tables)
        few, parts = _by_size(rare, tables)
        more, large = _sorted_out(parts, tables)
        small = small.unionByName(few).unionByName(more).unionByName(_in_blocks(large, tables))
    sketched = small.join(reps.select("rep", "n_shingles", "sketch"), "rep").select("node", "rep", "group", "n_shingles", "sketch")
    together = sketched.repartition("node").sortWithinPartitions("node")
    found = tables.keep(together.mapInArrow(compare, "a long, b long, node long, reps array<long>, bits binary"))
    tables.drop(crowded)
    pairs = tables.keep(found.filter("a is not null").select("a", "b").distinct())
    out = _confirmed(docs, reps, pairs, tables)
    out = out if sure is None else out.unionByName(sure)
    groups = tables.keep(components(out))
    tables.drop(pairs)
    left = found.filter("node is not null").select("node", "reps", "bits")
    more = _second(docs, reps, left, groups, tables)
    if more is None:
        return groups
    return components(more.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are linked and take part once, so copies cost nothing however many there are.
    A text without words (null, empty, white space) has no shingles and is linked with nothing. A row without
    doc_id is linked with nothing: its component_id is null and it is kept. Rows that repeat a doc_id are one
    document; of several texts, one counts for links with other documents. An empty table gives no rows."""
    tables = Tables(docs.sparkSession)
    described = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).mapInArrow(
        describe, "doc_id long, n_shingles long, digest binary, signature binary, sketch binary"
    )
    described = tables.keep(described)
    groups = (
        described.filter("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count(F.lit(1)).alias("size"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.first("sketch").alias("sketch"),
        )
    )
    groups = tables.keep(groups)
    rows = described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    rows = tables.keep(rows)
    tables.drop(described)
    twice = groups.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("least")).filter("n > 1")
    twice = tables.keep(twice)
    reps = groups
    if not twice.isEmpty():  # a doc_id with several texts goes by the one with the least digest
        reps = groups.join(twice.select("rep", "least"), "rep", "left").filter("least is null or least = digest")
        reps = tables.keep(reps.drop("least"))
    joined = linked(docs, reps, tables)
    classes = groups.select("digest", "rep", "size").join(joined, F.col("rep") == F.col("id"), "left")
    classes = tables.keep(classes.select("digest", F.coalesce("component", "rep").alias("component"), "size"))
    tables.drop(groups, reps)
    out = join_frequent(rows, classes, "digest", "size")
    component = F.coalesce("component", "doc_id")
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their component, with the columns of ``docs``; rows without doc_id stay."""
    (dropped,) = fresh(docs, "dropped")
    out = near_dedup(docs).filter("not kept").select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(out, docs["doc_id"].cast("long") == F.col(dropped), "left_anti")
