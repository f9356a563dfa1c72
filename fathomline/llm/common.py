"""What the corpus operators share: scratch tables, components of links, batches of texts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.session import remove_folder, ship_package, work_folder


class Scratch:
    """Intermediate tables of one operator call, written to the shared work folder.

    A written table cuts the lineage: a lost executor does not bring back the work
    behind it, and several branches read the same rows.
    """

    def __init__(self, spark: SparkSession) -> None:
        ship_package(spark)
        self.spark = spark
        self.root = f"{work_folder(spark)}/{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch = path
        return table

    def release(self) -> None:
        """Let go of shuffle files of finished work: they stay until the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, table: DataFrame) -> None:
        """Free the disk of a kept table that no later plan reads."""
        remove_folder(self.spark, table._scratch)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


MISSING = -(1 << 63)


def with_document_key(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a long ``_key`` that names the document of each row, in the order of doc_id.

    Rows are one document if they have the same doc_id, or both none, and the same text. Where an id
    stands for one text only, it is its own key, and a missing one is the smallest. Where rows without id
    or rows of one id differ in text, all documents are numbered by id and a hash of the text.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING))
    named = docs.drop("_key", "_tag").withColumn("_key", own)
    tagged = named.withColumn("_tag", F.xxhash64(F.col("text").isNull(), "text"))
    span = tagged.groupBy("_key").agg(F.min("_tag").alias("low"), F.max("_tag").alias("high"))
    if span.filter("low != high").isEmpty():
        return named
    known = tagged.select("_key", "_tag").distinct().repartitionByRange("_key", "_tag").sortWithinPartitions("_key", "_tag")
    numbers = scratch.keep(known.withColumn("_number", F.monotonically_increasing_id()))
    keyed = tagged.join(numbers, ["_key", "_tag"]).withColumn("_key", F.col("_number"))
    return scratch.keep(keyed.select(*[f"`{c}`" for c in named.columns]))


def as_bytes(text: Column | str = "text") -> Column:
    """UTF-8 bytes of a text, empty for a missing one; Python tasks get them undecoded."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[tuple[list, ...]]:
    """Columns as lists, in pieces of about ``size`` bytes, so that memory does not follow the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            yield tuple(column.to_pylist() for column in batch.slice(start, step).columns)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b) with a > b."""
    around = edges if not large else edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        # every larger neighbour of a goes to the least of a and its neighbours
        moved = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a")
        return moved.select(F.col("v").alias("a"), F.least("a", "m").alias("b")).distinct()
    moved = edges.join(least, "a").select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            )
        )
    )
    return moved.filter("a != b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the least node reachable.

    Alternates large-star and small-star steps until nothing changes. All steps are
    joins and aggregations with map-side minimum; only a count and a checksum reach the driver.
    Links of a node with itself and missing ends are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("ok"))
    edges = scratch.keep(edges.filter("ok").drop("ok").distinct())
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s"))
    before = edges.agg(sign.alias("x")).first()["x"]
    while before["n"]:
        stepped = scratch.keep(_stars(_stars(edges, large=True), large=False))
        after = stepped.agg(sign.alias("x")).first()["x"]
        scratch.drop(edges)
        edges = stepped
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
