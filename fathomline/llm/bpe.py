"""BPE encoding and decoding with a contiguous rank array per word."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import as_bytes, rows_of
from fathomline.session import ship_package

# The word pattern of the vocabulary file and the controls that
# Python, but not Unicode, counts as white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
CONTROLS = regex.compile("[\x1c-\x1f]")
RUNS = regex.compile(r"(?:[\x1c-\x1f]|\S)+")

SHORT = 256
CACHE = 1 << 26
PIECE = 1 << 20
NONE = 1 << 60
BITS = 20
LOW = (1 << BITS) - 1
# what a remembered entry takes beside its letters and ids
ENTRY = 200


def byte_names() -> list[str]:
    """Printable name of each byte: itself where printable, else the next letter from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (chr(256 + k) for k in range(256))
    return [chr(b) if b in printable else next(others) for b in range(256)]


def merge(parts: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the adjacent pair of least rank, leftmost first, until no pair has a rank.

    ``merges`` has, under the packed pair, the packed rank and new id. ``ranks[i]`` belongs to the
    boundary between parts i and i+1; a merge deletes one boundary and only its two neighbours change.
    """
    get = merges.get
    ranks = [get(a << BITS | b, NONE) for a, b in pairwise(parts)]
    while ranks:
        least = min(ranks)
        if least == NONE:
            break
        i = ranks.index(least)
        parts[i : i + 2] = [least & LOW]
        del ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] << BITS | parts[i], NONE)
        if i < len(ranks):
            ranks[i] = get(parts[i] << BITS | parts[i + 1], NONE)
    return parts


def merge_long(parts: list[int], merges: dict[int, int]) -> list[int]:
    """The same merges for a long word, where scanning all boundaries each time would be quadratic."""
    after = list(range(1, len(parts))) + [-1]
    before = list(range(-1, len(parts) - 1))
    pairs = (a << BITS | b for a, b in pairwise(parts))
    queue = [(merges[p], i, p) for i, p in enumerate(pairs) if p in merges]
    heapq.heapify(queue)
    alive: list[int | None] = list(parts)
    while queue:
        least, i, pair = heapq.heappop(queue)
        j = after[i] if alive[i] == pair >> BITS else -1
        if j < 0 or alive[j] != pair & LOW:
            continue
        alive[i], alive[j] = least & LOW, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (pair := alive[left] << BITS | alive[right]) in merges:
                heapq.heappush(queue, (merges[pair], left, pair))
    return [p for p in alive if p is not None]


def packed_merges(model: dict) -> dict[int, int]:
    """Merges of a vocabulary file: packed pair of ids to packed rank and new id."""
    ids = model["vocab"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return {ids[a] << BITS | ids[b]: rank << BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}


class Words(dict):
    """Packed ids of the words met before; emptied when they reach ``CACHE`` bytes."""

    def __init__(self, inner: list[int], last: list[int], merges: dict[int, int]) -> None:
        self.inner, self.last, self.merges = inner, last, merges
        self.size = 0

    def __missing__(self, word: str) -> bytes:
        data = word.encode("utf-8")
        inner = self.inner
        parts = [inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        parts = (merge if len(parts) <= SHORT else merge_long)(parts, self.merges)
        packed = array("I", parts).tobytes()
        self.size += len(data) + len(packed) + ENTRY
        if self.size > CACHE:
            self.clear()
            self.size = len(data) + len(packed) + ENTRY
        self[word] = packed
        return packed


class Coder(dict):
    """Token ids of white-space separated runs, kept as packed bytes for runs met before.

    A run is normalised (composed, lower case letter by letter), cut into words, and each
    word is merged on its own, so that equal words give equal ids wherever they stand. Runs and
    words are remembered apart: few words make up many runs. Either memory is emptied at ``CACHE`` bytes.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.merges = packed_merges(model)
        names = byte_names()
        self.inner = [self.ids[n] for n in names]
        self.last = [self.ids[n + self.end] for n in names]
        self.words = Words(self.inner, self.last, self.merges)
        self.size = 0
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def __missing__(self, run: str) -> bytes:
        if run.isascii():
            found = ASCII_WORDS.findall(run.lower())
        else:
            # letter by letter: a final sigma is not treated apart
            found = WORDS.findall(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())
        packed = self.words[found[0]] if len(found) == 1 else b"".join(map(self.words.__getitem__, found))
        self.size += len(run) + len(packed) + ENTRY
        if self.size > CACHE:
            self.clear()
            self.size = len(run) + len(packed) + ENTRY
        self[run] = packed
        return packed

    def plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without special tokens, piece by piece."""
        if len(text) <= PIECE and not CONTROLS.search(text):
            yield b"".join(map(self.__getitem__, text.split()))
            return
        held = []
        for run in RUNS.finditer(text):
            held.append(self[run.group()])
            if len(held) >= PIECE >> 3:
                yield b"".join(held)
                held.clear()
        yield b"".join(held)

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed little-endian 32-bit ids of a text; special tokens in it keep their own ids."""
        if not any(name in text for name in self.special):
            yield from self.plain(text)
            return
        for part in self.split.split(text):
            if part in self.special:
                yield np.array([self.special[part]], "<u4").tobytes()
            else:
                yield from self.plain(part)

    def decode(self, packed: bytes) -> str:
        """Names of the tokens joined by blanks: the vocabulary file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_coders: dict[str, Coder] = {}


def _coder(name: str) -> Coder:
    path = SparkFiles.get(name)
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _shipped(docs: DataFrame, vocabulary: str) -> str:
    """Give the vocabulary file to all executors; its name there."""
    ship_package(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) for every row of (doc_id, text): whole texts, special tokens in them recognised.

    Missing and empty texts give no ids; repeated rows and rows without doc_id are encoded
    like any other; further columns are ignored; no rows give no rows.
    """
    name = _shipped(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name)
        for ids, texts in rows_of(batches):
            found = [np.frombuffer(b"".join(coder.encode(t.decode("utf-8", "replace"))), "<u4") for t in texts]
            lists = pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["doc_id", "ids"])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) for every row of (doc_id, ids); missing ids give an empty text."""
    name = _shipped(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name)
        for ids, lists in rows_of(batches):
            texts = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of encoding and decoding every whole text in one pass.

    (doc_id, n_tokens, ids_sha256, decoded_sha256): number of ids, SHA-256 of the ids as
    little-endian unsigned 32-bit integers and of the decoded text in UTF-8. Cases as in ``encode``.
    """
    name = _shipped(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name)
        for ids, texts in rows_of(batches):
            counts, codes, words = [], [], []
            for text in texts:
                count, code, word = 0, hashlib.sha256(), hashlib.sha256()
                for packed in coder.encode(text.decode("utf-8", "replace")):
                    if packed:
                        code.update(packed)
                        word.update((" " * (count > 0) + coder.decode(packed)).encode("utf-8"))
                        count += len(packed) // 4
                counts.append(count)
                codes.append(code.hexdigest())
                words.append(word.hexdigest())
            arrays = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(codes), pa.array(words)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
