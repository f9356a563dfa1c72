"""Quality of texts by a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, as_bytes, rows_of
from fathomline.llm.labelled import held_out, training_rows, with_labels

FOLDS, FOLD = 3, 1
TRAINING_ROWS = 8_192
BUCKETS = 4096
RANK = 8
EPOCHS = 12
BATCH = 128
CACHE = 300_000


def _classes() -> np.ndarray:
    """Byte classes: upper case, lower case, digits, sentence marks, other signs, white space, beyond ASCII, newlines."""
    sets = [
        range(65, 91),
        range(97, 123),
        range(48, 58),
        b".,;:'\"-()",
        [b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:'\"-()"],
        b" \t\n\r\x0b\x0c",
        range(128, 256),
        b"\n",
    ]
    table = np.zeros((256, len(sets)))
    for k, members in enumerate(sets):
        table[list(members), k] = 1
    return table


CLASSES = _classes()
STATISTICS = 20
WIDTH = BUCKETS + STATISTICS


class Words(dict):
    """Bucket of each lower-case word; the memory is emptied at ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = zlib.crc32(word.lower()) % BUCKETS
        return found


def features(text: bytes, buckets: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text: its hashed words (logarithmic counts of unit length), then statistics.

    Every index comes once; all values lie within a few units whatever the length.
    """
    words = text.split()
    n, size = len(words), len(text)
    codes = np.fromiter(map(buckets.__getitem__, words), np.int64, n)
    index, count = np.unique(codes, return_counts=True)
    value = np.log1p(count)
    value /= max(np.sqrt((value**2).sum()), 1e-9)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES / max(size, 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    statistics = [
        *share,
        np.log1p(size) / 10,
        np.log1p(n) / 8,
        np.log1p(len(lines)) / 6,
        lengths.mean() / 10 if n else 0.0,
        lengths.std() / 10 if n else 0.0,
        distinct / max(n, 1),
        np.log1p(n / max(distinct, 1)),
        count.max() / n if n else 0.0,
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(size / max(len(lines), 1)) / 8,
        1.0 if not n else 0.0,
    ]
    return np.r_[index, BUCKETS + np.arange(STATISTICS)], np.r_[value, statistics]


@dataclass
class Machine:
    """Factorisation machine: intercept, weights and low-rank vectors of all features."""

    intercept: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Scores of rows stored one after the other, in time linear in their features.

        The sum over all pairs <v_i, v_j> x_i x_j is half of (sum v_i x_i)^2 less sum (v_i x_i)^2.
        """
        linear = np.add.reduceat(self.weight[index] * value, heads)
        scaled = self.factor[index] * value[:, None]
        total = np.add.reduceat(scaled, heads, axis=0)
        return self.intercept + linear + 0.5 * (total**2 - np.add.reduceat(scaled**2, heads, axis=0)).sum(1)

    def score(self, index: np.ndarray, value: np.ndarray, heads: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, heads), -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> Machine:
    """Fit by AdaGrad on the logistic loss over ``EPOCHS`` shuffled passes."""
    made = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(WIDTH), made.normal(0, 0.05, (WIDTH, RANK)))
    heat = [1e-6, np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6)]
    rate, decay = 0.1, 1e-5
    for _ in range(EPOCHS):
        order = made.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            index = np.concatenate([rows[k][0] for k in chosen])
            value = np.concatenate([rows[k][1] for k in chosen])
            heads = np.r_[0, np.cumsum([len(rows[k][0]) for k in chosen])[:-1]]
            owner = np.repeat(np.arange(len(chosen)), np.diff(np.r_[heads, len(index)]))
            error = machine.score(index, value, heads) - labels[chosen]
            scaled = machine.factor[index] * value[:, None]
            total = np.add.reduceat(scaled, heads, axis=0)
            pull = (error[owner] * value)[:, None] * (total[owner] - scaled)
            slope = np.bincount(index, error[owner] * value, WIDTH) + decay * machine.weight
            slopes = np.stack([np.bincount(index, pull[:, f], WIDTH) for f in range(RANK)], 1) + decay * machine.factor
            lead = float(error.sum())
            for k, g in enumerate((lead, slope, slopes)):
                heat[k] = heat[k] + g * g
            machine.intercept -= rate * lead / np.sqrt(heat[0])
            machine.weight -= rate * slope / np.sqrt(heat[1])
            machine.factor -= rate * slopes / np.sqrt(heat[2])
    return machine


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = TRAINING_ROWS) -> Machine | None:
    """Machine from at most ``rows`` labelled documents outside the held-out fold; None without any.

    Features are made by Spark. The driver gets those of the sample: at most ``rows`` times
    ``BUCKETS`` + ``STATISTICS`` numbers, far fewer for texts as they are.
    """
    sample = training_rows(labels, "quality", FOLDS, FOLD, rows, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Words()
        for ids, texts, marks in rows_of(batches):
            made = [features(t, buckets) for t in texts]
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(marks, pa.int32()),
                pa.array([i.astype(np.uint16).tobytes() for i, _ in made], pa.binary()),
                pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "index", "value"])

    chosen = with_labels(_source(docs), sample).select("doc_id", "text", "label")
    made = chosen.mapInArrow(run, "doc_id long, label int, index binary, value binary")
    found = scratch.keep(made).orderBy("doc_id", "index").toArrow()
    if not found.num_rows:
        return None
    index = [np.frombuffer(x, np.uint16).astype(np.int64) for x in found.column("index").to_pylist()]
    value = [np.frombuffer(x, np.float32).astype(float) for x in found.column("value").to_pylist()]
    return train(list(zip(index, value)), found.column("label").to_numpy().astype(float))


def scores(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text of (doc_id, text).

    The score lies between 0 and 1 and depends on the text alone. A missing text counts as
    empty, which has a score as any text; a repeated row comes back each time; rows without
    doc_id are scored and not held out; further columns are ignored; no rows give no rows. Without
    any labelled row nothing is known against a text and all scores are 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Words()
        for ids, texts in rows_of(batches):
            if sent.value is None:
                found = np.ones(len(ids))
            else:
                made = [features(t, buckets) for t in texts]
                heads = np.r_[0, np.cumsum([len(i) for i, _ in made])[:-1]]
                found = sent.value.score(np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]), heads)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], ["doc_id", "score"])

    scored = _source(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
