"""A corpus pipeline: toxicity, line dedup, near-duplicate removal, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the
last return the columns of documents. Rows that repeat a doc_id are one document in every stage; rows
without doc_id are never dropped as duplicates or as contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import bpe, decontaminate, lines, simhash, toxicity
from fathomline.llm.common import Scratch, table
from fathomline.llm.queries import vocabulary


def named(docs: DataFrame) -> list[str]:
    """The columns of ``docs``, whatever signs their names have."""
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; the model is fitted on what comes in."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark))
    return toxicity.reject(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand, but for one edit, at an earlier place."""
    return lines.remove_lines(docs).select(*named(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of every group whose fingerprints of 3-word shingles link at two or fewer bits."""
    found = simhash.near_duplicates(docs, words=3, distance=2)
    later = found.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*named(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*named(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text of every document left."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, the fitted score and token ids are beyond SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None
