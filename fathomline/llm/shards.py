"""Sharding by a k-d tree over document metadata with weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch

MISSING = -(1 << 63)
SNAP = 0.005


def _placed(rows: DataFrame, keys: list, weight: str, scratch: Scratch) -> DataFrame:
    """``rows`` with ``upto``: the running sum of ``weight`` within each node, in order of ``keys``.

    The rows are dealt by ranges of (node, keys) and sorted; each range sums what it holds of
    each node, and these sums, one row per range and node, give the ranges their starts. No
    task holds more than a range.
    """
    ranged = rows.repartitionByRange("node", *keys).sortWithinPartitions("node", *keys)
    kept = scratch.keep(ranged.withColumn("range", F.spark_partition_id()))
    sums = kept.groupBy("node", "range").agg(F.sum(weight).alias("held"))
    before = W.partitionBy("node").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("node", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("range", "node").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    return kept.withColumn("upto", F.sum(weight).over(within)).join(starts, ["node", "range"]).withColumn(
        "upto", F.col("upto") + F.col("start")
    )


def _axis(name: str, values: list[str]) -> Column:
    """The metadata value of a row along the axis chosen for its node."""
    return F.expr(f"element_at(array({', '.join(values)}), {name} + 1)")


def kd_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shards of nearly equal bytes: (doc_id, size, text_crc32, shard, slot) for (doc_id, text, ...).

    The size of a row is the UTF-8 bytes of its text (a missing one has none) and 8 more. All
    rows form one node that is to give ``shards`` leaves; a node is cut along its widest metadata
    axis at the weighted median (or the fitting fraction, for an odd number of leaves) until
    each node is one leaf. The axes are the logarithm of the size, the checksum of the text,
    and the checksums of lang and source where these columns exist, each scaled to 0..1.

    Rows with equal texts are one group with the group's first lang and source: along every axis
    they stand together, so that they share a shard. Only a group that a cut falls into is split, in
    order of doc_id, and not even that where it holds under ``SNAP`` of a leaf's bytes. slot numbers the
    rows of a shard from 0 without gaps.

    Ties go by text checksums, then doc_id; repeated rows are each placed; rows without doc_id come first;
    with fewer groups than shards some shards may stay empty; further columns are ignored;
    no rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    extra = [F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("lang", "source") if c in docs.columns]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("hash"),
        *extra,
    )
    rows = scratch.keep(rows)
    if rows.isEmpty():
        return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    names = [c for c in ("lang", "source") if c in docs.columns]
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(MISSING)).alias("doc_id"), *names))
    scale = F.lit(float(1 << 32))
    group = rows.groupBy("crc", "hash", "size").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), first.alias("first")
    )
    group = group.select(
        "crc",
        "hash",
        "size",
        "n",
        "bytes",
        F.lit(0).alias("node"),
        F.lit(0).alias("lead"),
        F.lit(shards).alias("leaves"),
        F.lit(0).cast("long").alias("done"),
        (F.log("size") / 32).alias("x0"),
        (F.col("crc") / scale).alias("x1"),
        *[(F.col(f"first.{c}") / scale).alias(f"x{k + 2}") for k, c in enumerate(names)],
    )
    axes = [f"x{k}" for k in range(2 + len(names))]
    # a piece of a group: its rows from ``done`` bytes on, ``bytes`` of them
    pieces = scratch.keep(group)
    leaf = pieces.agg(F.sum("bytes").alias("b")).first()["b"] / shards
    while True:
        nodes = pieces.filter("leaves > 1").groupBy("node").agg(
            F.sum("bytes").alias("total"), *[(F.max(x) - F.min(x)).alias(f"w_{x}") for x in axes]
        )
        wide = F.array(*[f"w_{x}" for x in axes])
        # at most one row per node: fewer than the shards
        nodes = scratch.keep(nodes.select("node", "total", (F.array_position(wide, F.array_max(wide)) - 1).cast("int").alias("axis")))
        if nodes.isEmpty():
            break
        busy = pieces.join(F.broadcast(nodes), "node").withColumn("along", _axis("axis", axes))
        placed = _placed(busy, ["along", "crc", "hash", "size", "done"], "bytes", scratch)
        low = F.floor(F.col("leaves") / 2).cast("int")
        # whole bytes, in exact arithmetic: equal cuts for every row of a node
        cut = F.floor(F.col("total") * low / F.col("leaves")).cast("long")
        start = F.col("upto") - F.col("bytes")
        small = F.col("bytes") <= SNAP * leaf
        # bytes of the piece left of the cut, a whole number of rows
        part = F.least(F.greatest(cut - start, F.lit(0)), F.col("bytes"))
        left_rows = F.round(part / F.col("size")).cast("long")
        left = F.when(small, F.when(2 * part >= F.col("bytes"), F.col("bytes")).otherwise(0)).otherwise(left_rows * F.col("size"))
        cells = placed.withColumn("left", F.least(left, F.col("bytes")).cast("long"))
        halves = F.array(
            F.struct(
                (2 * F.col("node") + 1).alias("node"), F.col("lead"), low.alias("leaves"), F.col("done"), F.col("left").alias("bytes")
            ),
            F.struct(
                (2 * F.col("node") + 2).alias("node"),
                (F.col("lead") + low).alias("lead"),
                (F.col("leaves") - low).alias("leaves"),
                (F.col("done") + F.col("left")).alias("done"),
                (F.col("bytes") - F.col("left")).alias("bytes"),
            ),
        )
        split = cells.select("crc", "hash", "size", "n", *axes, F.inline(halves)).filter("bytes > 0")
        ready = pieces.filter("leaves = 1")
        pieces = scratch.keep(ready.unionByName(split.select(*ready.columns)))

    # a group in several pieces is dealt out in order of doc_id; a whole one needs no order
    pieces = pieces.withColumn("whole", F.col("bytes") == F.col("n") * F.col("size"))
    keys = ["crc", "hash", "size"]
    alone = rows.join(pieces.filter("whole").select(*keys, F.col("lead").alias("shard")), keys).select("doc_id", "size", "crc", "shard")
    # groups cut in two or more: at most one per cut, so fewer than the shards
    cut_up = scratch.keep(
        pieces.filter("NOT whole").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("done", "lead"))).alias("parts"))
    )
    mine = rows.join(F.broadcast(cut_up), keys).withColumn("node", F.xxhash64(*keys)).withColumn("one", F.lit(1).cast("long"))
    told = _placed(mine, [F.col("doc_id").asc_nulls_first()], "one", scratch)
    at = (F.col("upto") - 1) * F.col("size")
    shard = F.element_at(F.filter("parts", lambda p: p["done"] <= at), -1)["lead"]
    shared = told.select("doc_id", "size", "crc", shard.alias("shard"))
    dealt = alone.unionByName(shared).withColumn("node", F.col("shard")).withColumn("one", F.lit(1).cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("size")]
    numbered = _placed(dealt, order, "one", scratch)
    return numbered.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("upto") - 1).cast("long").alias("slot"))
