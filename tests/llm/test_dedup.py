import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from chatloom.llm import common, exact_dedup, mixing, near_dedup, suffix_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# exact


def test_exact_against_grouping(edge_docs, edge_rows):
    texts = {(r[0], SPACE.sub(" ", r[1] or "")) for r in edge_rows}
    sizes = {}
    for r in edge_rows:
        t = SPACE.sub(" ", r[1] or "")
        sizes[t] = sizes.get(t, 0) + 1
    got = rows_of(exact_dedup.exact_dedup(edge_docs))
    assert len(got) == len(texts)
    by_digest = {hashlib.sha256(t.encode()).digest(): t for _, t in texts}
    for r in got:
        t = by_digest[bytes(r["digest"])]
        assert (r["doc_id"], t) in texts
        known = [i for i, x in texts if x == t and i is not None]
        assert r["keep_id"] == (min(known) if known else None)
        assert r["group_size"] == sizes[t]
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["keep_id"])


def test_exact_keeps_one_row_with_its_columns(edge_docs, no_docs):
    kept = exact_dedup.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-13, 1, 3, 4, 5, 7, 8, 10, 11, 12]
    assert ids.count(None) == 2
    assert exact_dedup.keep_first(no_docs).count() == 0
    assert exact_dedup.exact_dedup(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_perfect_hash_is_minimal(n):
    keys = exact_dedup._as_keys([hashlib.sha256(str(i).encode()).digest() for i in range(n)])
    levels = exact_dedup.perfect_hash(keys)
    assert sorted(exact_dedup.slots(levels, keys)) == list(range(n))


def test_nonmembers_are_told_apart_by_their_bytes(spark):
    def table(ids):
        rows = [(i, hashlib.sha256(str(i).encode()).digest()) for i in ids]
        return spark.createDataFrame(rows, "doc_id long, digest binary")

    index = exact_dedup.build_index(table([*range(300), *range(20)]))
    found = exact_dedup.look_up(table(range(200, 700)), index).collect()
    assert len(found) == 700
    assert sorted(r["keep_id"] for r in found if r["in_history"]) == list(range(300))
    assert sorted(r["keep_id"] for r in found if not r["in_history"]) == list(range(300, 700))
    assert {r["keep_id"]: r["group_size"] for r in found} == {i: 1 + (i < 20) + (200 <= i < 300) for i in range(700)}


def test_the_index_gives_the_history_its_result(spark, edge_docs, monkeypatch):
    """With an index that holds nothing, the documents of the history have no group."""
    want = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(edge_docs).collect()}
    build = exact_dedup.build_index
    monkeypatch.setattr(exact_dedup, "build_index", lambda history: build(history.limit(0)))
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(edge_docs).collect()}
    assert got != want


CLASHING = ["_dropped", "_id", "_digest", "_own", "_w_id", "_w_digest", "_mixed", "_mix_key", "_key", "_row", "_copy", "_dedup_digest"]


def test_columns_with_the_operators_own_names(spark):
    rows = [(i, f"text {i // 2} of some words", "s", *range(len(CLASHING))) for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *CLASHING])
    for out, n in ((exact_dedup.keep_first(docs), 4), (near_dedup.keep_one(docs), 4), (mixing.mix_documents(docs), 8)):
        assert out.columns == docs.columns
        assert [tuple(r)[3:] for r in out.collect()] == [tuple(range(len(CLASHING)))] * n


def test_mix_copies_the_row_it_counts(spark):
    rows = [(1, "a b c d", "s1"), (1, "x", "s2"), (2, "e f", "s2"), (2, "e f", "s1")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string").coalesce(1)
        assert {tuple(r) for r in mixing.mix_documents(docs).collect()} <= {rows[0], rows[3]}


def test_hot_keys_meet_the_same_rows(spark):
    left = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 0 else id end as k")
    right = left.groupBy("k").count().selectExpr("k", "count as size", "k * 2 as v")
    got = common.join_frequent(left, right, "k", "size")
    assert got.count() == 5000
    assert got.filter("v <> k * 2 or v is null").count() == 0
    empty = common.join_frequent(left, right.limit(0), "k", "size")
    assert empty.count() == 5000 and empty.filter("v is not null").count() == 0


# near


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if both and 100 * both >= 75 * (len(x) + len(y) - both):
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    return {i: (len(sets[i]), top(i)) for i in texts}


def test_near_edges(edge_docs, edge_rows, no_docs):
    texts = {r[0]: r[1] for r in edge_rows if r[0] is not None}
    want = brute_components(texts)
    got = rows_of(near_dedup.near_dedup(edge_docs))
    assert len(got) == len(edge_rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert want[3][1] == want[4][1] == 1
    kept = near_dedup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.filter("doc_id in (2, 3, 4, 9)").count() == 0
    assert near_dedup.near_dedup(no_docs).count() == 0


def test_near_against_all_pairs(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for base in range(60):
        words = draw.choices(vocabulary, k=draw.randint(20, 150))
        for _ in range(draw.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts[len(texts)] = " ".join(copy)
    words = draw.choices(vocabulary, k=120)  # one large group of near copies
    for _ in range(400):
        copy = list(words)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        texts[len(texts)] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs).collect()}
    assert got == brute_components(texts)


def family(draw, size, shared, own, planted, common_own):
    """Texts with one boilerplate and words of their own; of the first 2 * planted, neighbours share some of those."""
    fresh = (f"w{i}" for i in itertools.count())
    boilerplate = [next(fresh) for _ in range(shared + 4)]
    texts = {}
    for i in range(size):
        words = [next(fresh) for _ in range(own)]
        if i < 2 * planted and i % 2:
            words[:common_own] = last[:common_own]
        last = words
        texts[i] = " ".join(boilerplate + words)
    order = list(texts)
    draw.shuffle(order)
    return {order[i]: t for i, t in texts.items()}


@pytest.mark.parametrize("size", [60, 150])
def test_near_links_in_a_family_below_the_threshold(spark, size):
    texts = family(random.Random(size), size, 171, 30, size // 4, 3)  # 171 of 231, planted 174 of 228
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs).collect()}
    want = brute_components(texts)
    assert len({c for _, c in want.values()}) == size - size // 4
    assert got == want


def test_near_links_in_a_family_that_does_not_shrink(spark):
    texts = family(random.Random(3), 2000, 171, 30, 100, 8)  # 171 of 231, planted 179 of 223
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()}
    pairs = {}
    for i, t in texts.items():  # a planted pair shares the first word after the boilerplate
        pairs.setdefault(t.split()[175], []).append(i)
    assert sum(len(p) == 2 for p in pairs.values()) == 100
    assert got == {i: min(p) for p in pairs.values() for i in p}


def test_a_family_that_does_not_shrink_branches_once(spark, monkeypatch):
    draw = np.random.default_rng(4)
    shared = draw.integers(0, 2**63, 171, dtype=np.uint64)
    sets = [np.r_[shared, draw.integers(0, 2**63, 30, dtype=np.uint64)] for _ in range(200)]
    rows = [(i, near_dedup.minwise(s).tobytes()) for i, s in enumerate(sets)]
    reps = spark.createDataFrame(rows, "rep long, signature binary").repartition(3)
    tables, levels, sorted_out = common.Tables(spark), [], near_dedup._sorted_out
    nodes = tables.keep(reps.mapInArrow(near_dedup.roots, "node long, rep long").selectExpr("node", "rep", "rep as group"))
    monkeypatch.setattr(near_dedup, "LAST", 0, raising=False)
    monkeypatch.setattr(near_dedup, "_sorted_out", lambda nodes, t: levels.append(nodes.count()) or sorted_out(nodes, t))
    _, stuck = near_dedup.candidates(reps, nodes, tables)
    assert sorted(r["rep"] for r in stuck.collect()) == list(range(200))
    assert sum(levels[1:]) < 2 * levels[0]


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_tokens_of_one_member_are_counted_and_not_looked_up(spark, monkeypatch, few):
    texts = {i: " ".join([f"s{j}" for j in range(30)] + [f"p{i // 2}x{j}" for j in range(8)] + [f"o{i}x{j}" for j in range(9)]) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    raw = docs.selectExpr("doc_id", "cast(text as binary) as raw")
    reps = raw.mapInArrow(near_dedup.describe, "doc_id long, n_shingles long, digest binary, signature binary, sketch binary").withColumnRenamed("doc_id", "rep")
    tables = common.Tables(spark)
    monkeypatch.setattr(near_dedup, "FEW", few)
    got = near_dedup._rarest(docs, tables.keep(reps), reps.selectExpr("rep", "rep as group"), tables).collect()
    sets = {i: shingle_set(t) for i, t in texts.items()}
    counts = collections.Counter(x for s in sets.values() for x in s)
    want = []
    for i, s in sets.items():
        order = sorted(counts[x] for x in s)
        want += [(i, len(s), at) for at, n in enumerate(order[: len(s) - math.ceil(0.75 * len(s)) + 1]) if n > 1]
    assert want and sorted((r["rep"], r["n"], r["rarer"]) for r in got) == sorted(want)


@pytest.mark.parametrize("task_tokens", [100, 1 << 24])
def test_tokens_of_one_member_do_not_leave_their_task(spark, monkeypatch, task_tokens):
    draw = np.random.default_rng(6)
    line, pair = draw.integers(-(2**63), 2**63 - 1, 50), draw.integers(-(2**63), 2**63 - 1, (100, 4))
    sets = [np.unique(np.r_[line, pair[i // 2], draw.integers(-(2**63), 2**63 - 1, 60)]) for i in range(200)]
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "rep long, tokens binary").repartition(4)
    monkeypatch.setattr(near_dedup, "MAP_TOKENS", task_tokens)
    bits = spark.sparkContext.broadcast(near_dedup._shared_bits(held, sum(map(len, sets))))
    counted = held.select("tokens").mapInArrow(near_dedup._token_counts(bits), "token long, n long").collect()
    assert len(counted) < 4 * 50 + 2 * 400 + 0.05 * 200 * 60
    got = collections.Counter()
    for r in counted:
        got[r["token"]] += r["n"]
    want = collections.Counter(t for s in sets for t in s.tolist())
    assert {t: n for t, n in got.items() if n > 1} == {t: n for t, n in want.items() if n > 1}
    apart = near_dedup._told_apart([], None, bits)
    looked_up = held.mapInArrow(apart, "rep long, token long, frequent array<long>").filter("token is not null")
    assert looked_up.count() < 200 * 54 + 0.05 * 200 * 60


def test_a_full_map_passes_more_tokens_and_loses_none(spark, monkeypatch):
    draw = np.random.default_rng(7)
    line = draw.integers(-(2**63), 2**63 - 1, 50)
    sets = [np.unique(np.r_[line, draw.integers(-(2**63), 2**63 - 1, 3000)]) for _ in range(200)]
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "rep long, tokens binary").repartition(4)
    monkeypatch.setattr(near_dedup, "MOST_BITS", 1 << 19)
    bits = near_dedup._shared_bits(held, sum(map(len, sets)))
    assert 8 * len(bits) == 1 << 19 and near_dedup._on_bits(line, bits).all()
    assert 0.3 < near_dedup._on_bits(draw.integers(-(2**63), 2**63 - 1, 10_000), bits).mean() < 1
    counted = held.select("tokens").mapInArrow(near_dedup._token_counts(spark.sparkContext.broadcast(bits)), "token long, n long")
    shared = counted.groupBy("token").sum("n").filter("`sum(n)` > 1").collect()
    assert {r[0]: r[1] for r in shared} == {t: 200 for t in line.tolist()}


def test_links_meet_in_the_parts_of_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "PIECE", 8)
    draw = random.Random(8)
    boilerplate = list(range(60))
    sets = {}
    for i in range(250):  # parts of one boilerplate, some words of a second one, and words of their own
        own = [1000 * (i + 1) + j for j in range(draw.choice([0, 1, 4, 9, 15]))]
        sets[i] = {*boilerplate[: draw.randint(30, 60)], *draw.sample(range(100, 140), draw.randint(0, 8)), *own}
    counts = collections.Counter(t for s in sets.values() for t in s)
    rare = []
    for i, s in sets.items():
        order = sorted(s, key=lambda t: (counts[t], t))
        prefix = order[: len(s) - math.ceil(0.75 * len(s)) + 1]
        rare += [(t, i, i, len(s), at) for at, t in enumerate(prefix) if counts[t] > 1]
    tables = common.Tables(spark)
    rare = tables.keep(spark.createDataFrame(rare, "node long, rep long, group long, n long, rarer long").repartition(3))
    small, parts = near_dedup._by_size(rare, tables)
    blocks = near_dedup._in_blocks(parts.join(parts.groupBy("node").count().withColumnRenamed("count", "size"), "node"), tables)
    met = set()
    for nodes in (small, blocks):
        together = collections.defaultdict(list)
        for r in nodes.collect():
            together[r["node"]].append(r["rep"])
        assert max(map(len, together.values()), default=0) <= 4 * near_dedup.PIECE
        assert all(len(t) == len(set(t)) for t in together.values())
        met |= {frozenset(p) for t in together.values() for p in itertools.combinations(t, 2)}
    links = {
        frozenset((i, j))
        for i, j in itertools.combinations(sets, 2)
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    }
    assert len(links) > 1000 and links <= met
    assert len(met) < 0.9 * len(sets) * (len(sets) - 1) / 2


def test_branching_keeps_pairs_at_the_threshold():
    draw = np.random.default_rng(1)
    survived = 0
    for _ in range(300):
        shared = draw.integers(0, 2**63, 300, dtype=np.uint64)
        sets = [np.r_[shared, draw.integers(0, 2**63, 50, dtype=np.uint64)] for _ in range(2)]  # 300 of 400
        signatures = np.stack([near_dedup.minwise(s) for s in sets])
        seeds = common.mix(np.arange(1, near_dedup.TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for depth in range(1):
            together = False
            for seed in seeds:
                children, rows = near_dedup.branch(np.full(2, seed), signatures)
                together |= bool(set(children[rows == 0]) & set(children[rows == 1]))
        survived += together
    assert survived == 300


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 130)]
    star = [(7, i) for i in range(8, 60)]
    edges = spark.createDataFrame(path + star + [(5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(edges).collect()}
    assert got == {i: 100 for i in range(100, 131)} | {i: 7 for i in range(7, 60)}
    assert common.components(edges.limit(0)).count() == 0


def test_components_that_are_stars_take_one_round(spark, monkeypatch):
    kept, materialize = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df: kept.append(1) or materialize(df))
    edges = spark.createDataFrame([(i % 3, i) for i in range(3, 90)] + [(5, 2), (2, 2)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(edges).collect()}
    assert got == {i: i % 3 for i in range(90)}
    assert len(kept) == 1


# repeated passages


def brute_spans(texts):
    seen = {}
    for i in sorted(texts):
        words = (texts[i] or "").encode().split()
        for at in range(len(words) - 49):
            seen.setdefault(tuple(words[at : at + 50]), []).append((i, at))
    cover = {}
    for places in seen.values():
        if len(places) > 1:
            for n, (i, at) in enumerate(sorted(places)):
                for p in range(at, at + 50):
                    cover[i, p] = cover.get((i, p), False) or n > 0
    spans = []
    for i, p in sorted(cover):
        if spans and spans[-1][0] == i and spans[-1][1] + spans[-1][2] == p:
            spans[-1][2] += 1
            spans[-1][3] += cover[i, p]
        else:
            spans.append([i, p, 1, int(cover[i, p])])
    return sorted(map(tuple, spans))


def spans_of(docs):
    return sorted(tuple(r) for r in suffix_dedup.repeated_spans(docs).collect())


def test_spans_on_edges(edge_docs, edge_rows, no_docs):
    texts = {r[0]: r[1] for r in edge_rows if r[0] is not None and r[0] != 11}
    assert spans_of(edge_docs.filter("doc_id <> 11")) == brute_spans(texts)
    assert spans_of(edge_docs.filter("doc_id = 11")) == [(11, 0, 60_000, 59_999)]
    assert spans_of(no_docs) == []


def test_spans_against_all_windows(spark):
    draw = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    passages = [draw.choices(vocabulary, k=n) for n in (49, 50, 51, 60, 140)]
    texts = {}
    for i in range(80):
        words = []
        for _ in range(draw.randint(0, 4)):
            words += draw.choices(vocabulary, k=draw.randint(0, 70))
            part = list(draw.choice(passages))
            if draw.random() < 0.4:
                part[draw.randrange(len(part))] = "edit"
            words += part
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert spans_of(docs) == brute_spans(texts)


def test_crowded_keys_give_the_same_spans(spark, monkeypatch):
    draw = random.Random(3)
    passage = draw.choices([f"v{i}" for i in range(500)], k=70)
    texts = {i: " ".join([f"a{i}"] * (i % 3) + passage + [f"b{i % 5}"] * 3) for i in range(120)}
    monkeypatch.setattr(suffix_dedup, "CROWD", 10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert spans_of(docs) == brute_spans(texts)


def test_removal_keeps_the_first_copy(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, "start " + " ".join(words) + " end"), (2, "other  " + "\n".join(words) + " tail"), (3, None), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == {1: rows[0][1], 2: "other  tail", 3: "", 4: "short"}
