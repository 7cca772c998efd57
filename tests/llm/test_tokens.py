import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from chatloom.llm import packing, token_counts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "\n", "a", "b", "▁", "é", "é", "Σ", "İ", "of", "\t", "\x00", "👍", "!!", "<s>", "<0x0A>", " ", " ", "\x1c", "12",
    "<|endoftext|>", "<|startoftext|>", "'s", "don't",
]


def odd_texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD + [" ", " ", "\n"]) for _ in range(draw.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def check_packing(rows, texts, library, length):
    """Every id lies in one piece, sequences have no gap, and little is padded."""
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            assert bytes(r["ids"]) == ids[i][at : at + r["length"]].tobytes()
            at += r["length"]
        assert at == len(ids[i])
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += length - at
    return padding


def test_packing_odd_texts(spark, library):
    texts = dict(enumerate(odd_texts(600, 4)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, WORD_BPE, length=64).collect()
    assert check_packing(rows, texts, library, 64) < 3 * 64


def test_packing_blocks_hand_on_the_unfilled_sequence(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 4)
    draw = random.Random(1)
    texts = {i: " ".join(draw.choices(["one", "two", "three"], k=draw.randint(0, 90))) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, WORD_BPE, length=32).collect()
    assert check_packing(rows, texts, library, 32) < 32


def test_packing_edges(edge_docs, edge_rows, no_docs):
    rows = packing.pack(edge_docs, WORD_BPE, keep_ids=False).collect()
    assert all(r["ids"] is None for r in rows)
    starts = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["start"] == 0)
    assert starts == sorted((r[0] is None, r[0] or 0) for r in edge_rows)
    assert packing.pack(no_docs, WORD_BPE).count() == 0


def test_pieces_go_to_the_cheapest_sequence_with_room():
    lengths = np.array([10, 60, 30, 50, 40])
    placed = packing.assign(lengths, 2, 95)
    assert [p[0] for p in placed[:5]] == [1, 3, 4, 2, 0]
    assert [p[3] for p in placed[:3]] == [0, 1, 1]
    assert sum(p[2] for p in placed) == lengths.sum()
    cut = packing.assign(np.array([70, 70, 60]), 2, 100)
    assert len(cut) == 4 and sum(p[2] for p in cut) == 200
    assert packing.assign(np.array([70, 60]), 1, 100) == [(0, 0, 70, 0), (1, 0, 30, 0), (1, 30, 30, -1)]


def test_counts_odd_texts(spark):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(enumerate(odd_texts(1500, 9) + ["a " * 3000, "x" * 5000]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for r in token_counts.token_counts(docs, PIECES, limit=100).collect():
        n = len(processor.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), n), texts[r["doc_id"]]
        assert r["over_limit"] == (n > 100)


def test_counts_beyond_the_frequent_ones(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "SHARE", 3)
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {i: f"the the of unusual{i % 7} wörd{i}\n\nand  more" for i in range(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, PIECES).collect()}
    assert got == {i: len(processor.encode(t)) for i, t in texts.items()}


def test_counts_edges(edge_docs, edge_rows, no_docs):
    got = token_counts.token_counts(edge_docs, PIECES).collect()
    order = lambda pairs: sorted(pairs, key=str)
    assert order((r["doc_id"], r["n_bytes"]) for r in got) == order((r[0], len((r[1] or "").encode())) for r in edge_rows)
    assert all(r["n_tokens"] == 0 for r in got if r["n_bytes"] == 0)
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


def test_rows_that_share_an_id_are_counted_apart(spark):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(1, "a first text"), (1, "another, longer text"), (1, "a first text"), (None, "x"), (None, "y z"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, PIECES).collect()]
    assert sorted(got, key=str) == sorted(((i, len(processor.encode(t))) for i, t in rows), key=str)


def test_texts_whose_short_hashes_agree_and_long_frequent_words(spark):
    """Two texts without doc_id with one 32-bit hash; a separator longer than what is broadcast in every text."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(None, "word29873 x x x x "), (None, "word141855 ")]
    rows += [(i, f"text {i} {'-' * 100} {'-' * 100}") for i in range(40)] + [(None, "same text")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, PIECES).collect()]
    want = [(i, len(t), len(processor.encode(t))) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_models_that_join_words_are_refused():
    class Joined:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

        def is_byte(self, i):
            return False

        is_control = is_byte

    with pytest.raises(ValueError):
        token_counts.splitter(Joined())
