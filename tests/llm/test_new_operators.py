import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import embedding_dedup, merkle, spelling

# vectors


def brute_links(rows, threshold=0.95):
    """{vec_id: linked ids} by every pair."""
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.linalg.norm(x)

    units = {i: unit(v) for i, v in rows if i is not None}
    links = {i: set() for i in units}
    ids = sorted(units)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = units[i], units[j]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def least_reachable(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += links[x]
    return out


def check_vectors(df, rows):
    links = brute_links(rows)
    classes = least_reachable(links)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[i]), classes[i], classes[i] == i), i


VECTORS = "vec_id long, embedding array<float>, label int, rep long, class long, size long"


def as_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS).repartition(3)


def test_vectors_edges(spark):
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.1, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [-1.0, 0.0, 0.0]),
        (6, None), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [float("nan"), 1.0, 0.0]), (10, [float("inf"), 1.0, 0.0]),
        (11, []), (12, [1.0, 0.0]), (13, [1.0, 0.0]), (14, [1e-30, 0.0, 0.0]), (-5, [0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0]),
        (15, [1e38, 0.0, 0.0]),
    ]
    check_vectors(embedding_dedup.near_vectors(as_vectors(spark, rows)), rows)
    empty = embedding_dedup.near_vectors(as_vectors(spark, rows).limit(0))
    assert empty.count() == 0
    twice = embedding_dedup.near_vectors(as_vectors(spark, rows[:3] + rows[:1])).collect()
    assert len(twice) == 4 and {r["n_links"] for r in twice} == {2}


def clusters(seed, sizes, noise, dim=16):
    draw = np.random.default_rng(seed)
    out = []
    for size, spread in zip(sizes, noise):
        centre = draw.standard_normal(dim)
        out += [centre + spread * draw.standard_normal(dim) for _ in range(size)]
    order = draw.permutation(len(out))
    return [(int(i), [float(np.float32(x)) for x in out[j]]) for i, j in enumerate(order)]


@pytest.mark.parametrize(
    "large,window", [(embedding_dedup.LARGE, embedding_dedup.WINDOW), (32, 16)]
)
def test_vectors_against_all_pairs(spark, monkeypatch, large, window):
    """Tight and loose clusters, singles and copies; with small bounds too, so that cores, blocks and several rounds of
    ends between tasks take part."""
    monkeypatch.setattr(embedding_dedup, "LARGE", large)
    monkeypatch.setattr(embedding_dedup, "WINDOW", window)
    rows = clusters(3, [200, 150, 40, 5] + [1] * 300, [0.05, 0.2, 0.2, 0.1] + [0.0] * 300)
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    check_vectors(embedding_dedup.near_vectors(as_vectors(spark, rows)), rows)


def test_more_vectors_need_more_passes():
    needed = [embedding_dedup.passes_needed(10**k) for k in range(10)]
    assert needed == sorted(needed) and needed[0] >= 1 and needed[9] < 200


# Merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    """Tree by tree, in Python: rows of (doc_id, text, lang, source, n_chars)."""
    def leaf(r, more=0):
        i, text, lang, source, n = r
        fields = (i, source, lang, None if n is None else n + more, text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            x = levels[-1]
            levels.append([sha("".join(x[k : k + 2])) for k in range(0, len(x), 2)])
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: grow([leaf(r) for r in of[x]]) for x in langs}
    top = grow([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for p, r in enumerate(of[x]):
            siblings = []
            for levels, at in ((trees[x], p), (top, k)):
                for level in levels[:-1]:
                    siblings.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else ""))
                    at //= 2
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, int(changed))
            for right, other in siblings:
                h = sha(other + h if right else h + other)
            root = top[-1][0]
            proof = sha("".join(o for _, o in siblings))
            out.append((str(r[0]), leaf(r), trees[x][-1][0], root, proof, h, h == root))
    return sorted(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def audited(docs):
    rows = merkle.audit(merkle.manifest(docs)).select(F.col("doc_id").cast("string"), *COLUMNS[1:]).collect()
    return sorted((str(r[0]), *r[1:]) for r in rows)


def test_manifest_of_odd_rows(spark, edge_docs, edge_rows, no_docs):
    assert audited(edge_docs) == brute_manifest([r[:5] for r in edge_rows])
    assert audited(no_docs) == []
    assert audited(edge_docs.filter("doc_id = 1")) == brute_manifest([r[:5] for r in edge_rows if r[0] == 1])


def test_manifest_over_several_rounds(spark, monkeypatch):
    """Runs that end in one child at several levels, blocks of four leaves."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "_IN_BLOCK", "(PARTITION BY grp, shiftright(pos, 2) ORDER BY pos")
    draw = random.Random(5)
    sizes = {"a": 37, "b": 1, None: 5, "ü": 64, "B": 2, "ab": 17}
    rows = [(i, f"text {i}", x, "s", i) for i, x in enumerate(x for x, n in sizes.items() for _ in range(n))]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert audited(docs) == brute_manifest(rows)


# spelling


def brute_words(rows):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if spelling.one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def got_variants(docs):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(docs).collect()}


def test_one_apart_by_definition():
    def edits(w):
        letters = "abé"
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return (out | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}) - {w}

    words = ["", "a", "b", "ab", "ba", "aab", "aba", "éab", "abab", "baba", "aabb"]
    for a in words:
        for b in words:
            assert spelling.one_apart(a, b) == (b in edits(a)), (a, b)


def test_variants_of_odd_texts(spark, edge_docs, edge_rows, no_docs):
    assert got_variants(edge_docs) == brute_variants([r[:2] for r in edge_rows])
    assert got_variants(no_docs) == {}


@pytest.mark.parametrize("node_rows", [1 << 16, 30])
def test_variants_against_all_pairs(spark, monkeypatch, node_rows):
    """Accents, capitals, signs that end a run, very long words; with small nodes every level is descended."""
    monkeypatch.setattr(spelling, "NODE_ROWS", node_rows)
    draw = random.Random(7)
    words = ["".join(draw.choice("abeÉéx×") for _ in range(draw.randint(4, 8))) for _ in range(300)]
    words += ["aebxe", "abexe", "axebe", "exabe", "q" * 60, "q" * 61, "q" * 300, "q" * 299 + "a", "Straße", "Strasse"]
    rows = [
        (i if i % 50 else None, draw.choice(" \n-1,").join(draw.choices(words, [1 / (k + 1) for k in range(len(words))], k=40)))
        for i in range(120)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_variants(docs) == brute_variants(rows)


def test_roots_lead_to_the_end_of_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(40)] + [("x", "w00")], "word string, form string")
    assert {r["root"] for r in spelling.roots(chain).collect()} == {"w40"}
