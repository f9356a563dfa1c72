"""Token counts of texts by a byte-level vocabulary, without shuffling pre-tokens."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.bpe import ENTRY, SHORT, byte_names, merge, merge_long, packed_merges
from fathomline.llm.common import as_bytes, rows_of
from fathomline.session import ship_package

# The pattern that cuts a text into pre-tokens, and the same for texts of ASCII letters only.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0  -     　"

# the broadcast table has at most this many names of at most so many bytes: 1.5 MB
FREQUENT = 32_768
NAME_BYTES = 48
TRACKED = 65_536
GROUPS = 64
CACHE = 1 << 26
PIECE = 1 << 20


def piece_pattern() -> regex.Pattern:
    """The pattern with the white space of Unicode: Python's own class has four controls more."""
    return regex.compile(PIECES.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Vocabulary:
    """Byte-level merges of a tokenizers file: how many tokens a pre-token has."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = packed_merges(model)
        self.first = [model["vocab"][name] for name in byte_names()]

    def length(self, piece: str) -> int:
        first = self.first
        parts = [first[b] for b in piece.encode("utf-8")]
        return len((merge if len(parts) <= SHORT else merge_long)(parts, self.merges))


class Misses(dict):
    """Second tier: lengths of the pre-tokens that a worker has encoded itself; emptied at ``CACHE`` bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.size = 0

    def __missing__(self, piece: str) -> int:
        found = self.vocabulary.length(piece)
        self.size += len(piece) + ENTRY
        if self.size > CACHE:
            self.clear()
            self.size = len(piece) + ENTRY
        self[piece] = found
        return found


class Lengths(dict):
    """First tier: lengths of the frequent pre-tokens; all others are left to the second tier."""

    def __init__(self, table: Table, misses: Misses) -> None:
        super().__init__(table.items())
        self.misses = misses

    def __missing__(self, piece: str) -> int:
        return self.misses[piece]


@dataclass
class Table:
    """Frequent pre-tokens as one block of bytes, with the ends of their names and their lengths in tokens."""

    names: bytes
    ends: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple[str, int]]) -> Table:
        rows = sorted(rows)
        names = [name.encode("utf-8") for name, _ in rows]
        ends = np.cumsum([len(n) for n in names], dtype=np.uint32) if rows else np.empty(0, np.uint32)
        return cls(b"".join(names), ends, np.array([n for _, n in rows], np.uint8))

    def items(self) -> Iterator[tuple[str, int]]:
        start = 0
        for end, length in zip(self.ends.tolist(), self.lengths.tolist()):
            yield self.names[start:end].decode("utf-8"), length
            start = end


class Counter:
    """Tokens of whole texts by both tiers."""

    def __init__(self, vocabulary: Vocabulary, table: Table) -> None:
        self.lengths = Lengths(table, Misses(vocabulary))
        self.special = vocabulary.special
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ascii = re.compile(ASCII_PIECES, re.ASCII)
        self.all = piece_pattern()

    def plain(self, text: str) -> int:
        pieces = self.ascii if text.isascii() else self.all
        if len(text) <= PIECE:
            return sum(map(self.lengths.__getitem__, pieces.findall(text)))
        return sum(self.lengths[found.group()] for found in pieces.finditer(text))

    def count(self, text: str) -> int:
        """A special token's name in a text is one token, and cuts the text."""
        if not any(name in text for name in self.special):
            return self.plain(text)
        parts = self.split.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(name: str) -> Vocabulary:
    path = SparkFiles.get(name)
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _shipped(spark: SparkSession, vocabulary: str) -> str:
    ship_package(spark)
    spark.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


def frequent_pieces(docs: DataFrame, size: int = FREQUENT) -> DataFrame:
    """(piece) of about the ``size`` most frequent pre-tokens of all texts, of ``NAME_BYTES`` bytes or fewer.

    Every task keeps a sketch of ``TRACKED`` counters at most, and what is exchanged are sketches: they
    are merged in ``GROUPS`` groups and then once more. No pre-token is shuffled. The sketch decides
    what is found in the first tier and never a count.
    """
    pieces = docs.select(F.explode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("piece"))
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("part")
    sketches = pieces.filter(F.octet_length("piece") <= NAME_BYTES).groupBy(group)
    merged = sketches.agg(F.expr(f"approx_top_k_accumulate(piece, {TRACKED})").alias("sketch"))
    # by a key: a partition without sketches has nothing to merge
    whole = merged.groupBy(F.col("part") >= 0).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    return whole.select(F.inline(F.expr(f"approx_top_k_estimate(sketch, {size})"))).select(F.col("item").alias("piece"))


def frequent_table(docs: DataFrame, vocabulary: str, size: int = FREQUENT) -> Table:
    """The first tier: the frequent pre-tokens with the lengths that tasks have found for them."""
    name = _shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [_vocabulary(name).length(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32())], ["piece", "n"])

    spread = frequent_pieces(docs, size).repartition(8)
    return Table.of((r["piece"], r["n"]) for r in spread.mapInArrow(run, "piece string, n int").collect())


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, size: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every whole text of (doc_id, text), nothing shuffled.

    A pre-token's length is looked up in the broadcast table of frequent ones, else in what the worker
    has encoded before, else it is encoded: the counts are those of the vocabulary's own library.
    Special tokens in a text count as one. Missing and empty texts have no tokens and no bytes;
    repeated rows and rows without doc_id are counted like any other; further columns are ignored;
    very long texts and words are counted whole, a long text piece by piece; no rows give no rows.
    """
    spark = docs.sparkSession
    name = _shipped(spark, vocabulary)
    sent = spark.sparkContext.broadcast(frequent_table(docs, vocabulary, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(_vocabulary(name), sent.value)
        for ids, texts in rows_of(batches):
            sizes = [len(t) for t in texts]
            found = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            columns = [pa.array(x, pa.int64()) for x in (ids, sizes, found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    counted = source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
