"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch


def held_out(folds: int, fold: int, key: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that no fit may read: crc32 of the id as text, by its remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def training_rows(labels: DataFrame, label: str, folds: int, fold: int, rows: int, scratch: Scratch) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled documents outside the held-out fold.

    Picked by a hash of the id, so the same documents at any partitioning. A repeated
    document counts once, with the greatest label; missing ids and labels are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return scratch.keep(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of ``docs`` in the sample, one row per id: the text of least hash where an id has several.

    The sample's rows are bounded, so it is broadcast, and so are the rows that come back, however often an id repeats.
    """
    rows = docs.join(F.broadcast(sample), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return rows.groupBy("doc_id").agg(least, F.max("label").alias("label")).select("doc_id", "least.text", "label")
