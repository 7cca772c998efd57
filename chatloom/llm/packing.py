"""Cost-balanced packing of tokenized documents into sequences of a fixed length.

A block of documents is packed at a time, inside the task that tokenizes them, so nothing is shuffled. Every piece
costs ``LINEAR * n + QUADRATIC * n * n`` (attention stays inside a document). The pieces go in descending order to
the sequence of least cost that still has room for them whole; a piece that fits nowhere whole is cut to fill
the sequence with the most room. A block has only sequences that its tokens fill, and what is left over goes on as
part of the next block; the last block of a task leaves less than one sequence's length unfilled, all in all."""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END = 1
LINEAR = 1.0
QUADRATIC = 1.0 / LENGTH
BLOCK = 512  # sequences packed together
_CACHE = 1 << 20  # words a task remembers
_GROUP = 512  # parts tokenized as one text

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


#: What a tokenizer file must say for texts to be tokenized by their words.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs whose lower case and class no library disputes: printable ASCII, and the letters from U+00C0 to U+017F but
#: for the dotted capital I.
_PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_LETTER = r"a-z\u00df-\u00f6\u00f8-\u017f"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^0-9{_LETTER}]+")


class WordIds(dict):
    """The ids of words as little-endian 32-bit bytes, remembered; words hold no space or line break.

    A tokenizer of words with an end mark always splits at white space, so a text's ids are those of its words in
    order. Words of plain signs fall into parts by the tokenizer's pattern; parts that are new are tokenized many at
    a time, and told apart by the end mark that the last id of each part carries, and no other. All other words go
    through the library one by one, and whole texts do where the tokenizer is of another kind."""

    def __init__(self, model: bytes, config: dict):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__({"": b""})
        self.tokenizer, self.parts = Tokenizer.from_buffer(model), {}
        self.bare = Tokenizer.from_buffer(model)  # for parts, which are normalized and split
        self.bare.normalizer = normalizers.Sequence([])
        spaces, to_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([spaces, to_bytes])
        normalizer, splitter = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
        split = (splitter.get("pretokenizers") or [{}])[0]
        self.by_word = (
            [n["type"] for n in normalizer.get("normalizers", [])] == _NORMALIZERS
            and (split.get("pattern", {}).get("Regex"), split.get("behavior"), split.get("invert")) == (_PATTERN, "Removed", True)
            and config["model"].get("end_of_word_suffix") == "</w>"
            and all(t["content"].startswith("<|") for t in config.get("added_tokens", []))
        )
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_parts(self, new: list[str]) -> None:
        groups = [new[s : s + _GROUP] for s in range(0, len(new), _GROUP)]
        texts = [" ".join(g) for g in groups]
        for group, found in zip(groups, self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                cuts, raw = [0, *(4 * ends).tolist()], ids.tobytes()
                self.parts.update((p, raw[cuts[i] : cuts[i + 1]]) for i, p in enumerate(group))
            else:
                self.parts.update((p, self.one(p)) for p in group)

    def learn(self, words: set[str]) -> None:
        new = words.difference(self)
        if len(self) + len(new) > _CACHE:
            self.clear()
            self[""] = b""
            self.parts.clear()
            new = words.difference(self)
        single, several, other = [], {}, []
        for word in new:
            low = word.lower()
            if word.isascii() and low.isalpha():
                single.append((word, low))
            elif word.isascii() and low[:-1].isalpha():
                several[word] = [low[:-1], low[-1]]
            elif _PLAIN.fullmatch(word) and "<|" not in word:
                several[word] = _PARTS.findall(low)
            else:
                other.append(word)
        parts = self.parts
        self._learn_parts(list({low for _, low in single}.union(*several.values()).difference(parts)))
        self.update((w, parts[low]) for w, low in single)
        self.update((w, b"".join([parts[p] for p in found])) for w, found in several.items())
        self.update((w, self.one(w)) for w in other)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        if not self.by_word:
            yield from map(self.one, texts)
            return
        words = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*words))
        for w in words:
            yield b"".join(map(self.__getitem__, w))


def assign(lengths: np.ndarray, sequences: int, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) for pieces of at most ``length``. What finds no room has sequence -1."""
    room = np.full(sequences, length)
    cost = np.zeros(sequences)
    out = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[piece])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            to = int(fits.argmin())
            if fits[to] == np.inf:
                to = int(room.argmax())
            if not room[to]:
                out.append((piece, start, left, -1))
                break
            n = min(left, int(room[to]))
            out.append((piece, start, n, to))
            room[to] -= n
            cost[to] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return out


class _Packer:
    """Collects pieces and packs a block when there are enough. A piece is (doc_id, its ids, start in the document,
    length, the document's tokens)."""

    def __init__(self, first_id: int, length: int, keep_ids: bool):
        self.next, self.length, self.keep_ids = first_id, length, keep_ids
        self.pieces, self.held, self.rows = [], 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.length
        for start in range(0, whole, self.length):
            part = ids[4 * start : 4 * (start + self.length)]
            self._emit((doc_id, part, start, self.length, tokens), 0, self.length, self.next, 0)
            self.next += 1
        if whole < tokens:
            self.pieces.append((doc_id, ids[4 * whole :], whole, tokens - whole, tokens))
            self.held += tokens - whole
        if self.held >= BLOCK * self.length:
            self.pack(last=False)

    def _emit(self, piece, start: int, n: int, sequence: int, offset: int) -> None:
        doc_id, ids, first, _, tokens = piece
        cut = ids[4 * start : 4 * (start + n)]
        self.rows.append((doc_id, first + start, n, zlib.crc32(cut), tokens, sequence, offset, cut if self.keep_ids else None))

    def pack(self, last: bool) -> None:
        if not self.pieces:
            return
        lengths = np.array([p[3] for p in self.pieces])
        count = -(-self.held // self.length) if last else self.held // self.length
        rest, offsets = [], [0] * count
        for piece, start, n, to in assign(lengths, count, self.length):
            doc_id, ids, first, _, tokens = self.pieces[piece]
            if to < 0:
                rest.append((doc_id, ids[4 * start : 4 * (start + n)], first + start, n, tokens))
            else:
                self._emit(self.pieces[piece], start, n, self.next + to, offsets[to])
                offsets[to] += n
        self.next += count
        self.pieces, self.held = rest, sum(p[3] for p in rest)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 8
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _chunks(batch: pa.RecordBatch, characters: int = 1 << 22) -> Iterator[tuple[list, list]]:
    """The batch's ids and texts, so many characters at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py() or ""
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= characters:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit,
    little-endian; null unless ``keep_ids``).

    ``vocabulary`` is the path of a tokenizer file, read by the driver. Every document's ids end with ``end``, so a
    null or empty text is one id. Each row of ``docs`` is a document of its own, repeated rows too, and a null doc_id
    stays null. An empty table gives no rows. The partitions' sequences are numbered apart: sequence_id is the partition
    times 2**40 plus a count, and the same input partitions give the same sequences again."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    config = {k: v for k, v in json.loads(raw).items() if k != "model"}
    config["model"] = {"end_of_word_suffix": json.loads(raw)["model"].get("end_of_word_suffix")}
    model = docs.sparkSession.sparkContext.broadcast(raw)
    close = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = WordIds(model.value, config)
        packer = _Packer(TaskContext.get().partitionId() << 40, length, keep_ids)
        for batch in batches:
            for ids, texts in _chunks(batch):
                gc.disable()  # many small objects, no cycles: looking for some takes a sixth of the time
                try:
                    for doc_id, found in zip(ids, words.of(texts)):
                        packer.add(doc_id, found + close)
                finally:
                    gc.enable()
                yield packer.take()
        packer.pack(last=True)
        yield packer.take()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
