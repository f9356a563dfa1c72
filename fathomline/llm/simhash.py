"""SimHash near-duplicates through a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, as_bytes, components, rows_of

SEED = 42
FAN = 8
CELL = 4096
QUERIES = 4096
CHUNK = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(data: bytes, words: int = 3) -> np.ndarray:
    """64-bit hashes of the shingles of a UTF-8 text, in order.

    Words are runs without ASCII white space, A-Z in lower case; a text with fewer words
    than a shingle is one shingle, a text without words has none.
    """
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))


def vote(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes: a bit is set if over half of them set it; zero for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        piece = hashes[at : at + (1 << 16)]
        # sums of at most 255 ones fit a byte, which keeps the addition narrow
        padded = np.zeros((-(-len(piece) // 255), 255), np.uint64)
        padded.reshape(-1)[: len(piece)] = piece
        bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), 255, 8), axis=2, bitorder="little")
        total += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, words: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text over its ``words``-word shingles."""
    return vote(shingle_hashes(data, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            codes = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes)], ["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray sequence, as an unsigned number in a long."""
    return reduce(lambda x, k: x.bitwiseXOR(F.shiftrightunsigned(x, k)), (1, 2, 4, 8, 16, 32), code)


def _rotated(code: Column, by: int) -> Column:
    if not by:
        return code
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def _levels(codes: np.ndarray, cell: np.ndarray) -> list[tuple]:
    """The index over codes sorted by cell and Gray rank, from the leaves to one root per cell.

    A level is (pattern, mask, first child, end of children, cell): the bits that all codes
    below share, and which bits these are.
    """
    levels = [(codes, np.full(len(codes), FULL), None, None, cell)]
    low = high = codes
    while True:
        cells = levels[-1][4]
        starts_cell = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        inside = np.arange(len(cells)) - np.repeat(starts_cell, np.diff(np.r_[starts_cell, len(cells)]))
        heads = np.flatnonzero(inside % FAN == 0)
        low = np.bitwise_and.reduceat(low, heads)
        high = np.bitwise_or.reduceat(high, heads)
        mask = ~(low ^ high)
        levels.append((low & mask, mask, heads, np.r_[heads[1:], len(cells)], cells[heads]))
        if len(heads) == len(starts_cell):
            return levels


def within(codes: np.ndarray, cell: np.ndarray, probes: np.ndarray, probe_cell: np.ndarray, distance: int):
    """Pairs (probe index, code index) of the same cell that differ in at most ``distance`` bits.

    Probes go down from the root of their cell. A node compares only the bits that its parent
    did not compare, the differences add up, and a group is left as soon as they exceed the
    distance. ``codes`` are in order of cell and Gray rank, ``cell`` counts from 0 without gaps.
    """
    levels = _levels(codes, cell)
    found = []
    for at in range(0, len(probes), QUERIES):
        query = np.arange(at, min(at + QUERIES, len(probes)))
        pattern, mask, first, end, _ = levels[-1]
        node = probe_cell[query]
        spent = np.bitwise_count((probes[query] ^ pattern[node]) & mask[node])
        for depth in range(len(levels) - 2, -1, -1):
            keep = spent <= distance
            query, node, spent = query[keep], node[keep], spent[keep]
            parent_mask = mask
            width = end[node] - first[node]
            parent = np.repeat(node, width)
            child = np.repeat(first[node] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            query, spent = np.repeat(query, width), np.repeat(spent, width)
            pattern, mask, first, end, _ = levels[depth]
            spent = spent + np.bitwise_count((probes[query] ^ pattern[child]) & mask[child] & ~parent_mask[parent])
            node = child
        keep = spent <= distance
        found.append((query[keep], node[keep]))
    return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Least index that each of ``size`` indices reaches through the links left-right."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search(columns: list[np.ndarray], distance: int) -> pa.RecordBatch:
    keys, rotated, original, probe = columns
    cell = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
    member = ~probe
    # cells without a member (only probes came) have nothing to find
    held = np.unique(cell[member])
    place = np.searchsorted(held, cell)
    ok = np.isin(cell, held)
    codes = rotated[member]
    query, hit = within(codes, place[member], rotated[ok], place[ok], distance)
    rows, leaves = np.flatnonzero(ok)[query], np.flatnonzero(member)[hit]
    label = forest(rows, leaves, len(keys))
    moved = np.flatnonzero(original[label] != original)
    return pa.RecordBatch.from_arrays([pa.array(original[moved]), pa.array(original[label[moved]])], ["a", "b"])


def _child(width: int) -> str:
    """The ``deep`` bits of a code after its block."""
    return f"CASE WHEN deep = 0 THEN 0L ELSE shiftrightunsigned(shiftleft(code, {width}), 64 - deep) END"


def _depths(turned: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(turn, block, deep) of the blocks with more than one code: how many further bits part a block into children.

    None for a block of at most ``CELL`` codes; else as many as it takes until no child has more, tried out on
    the codes themselves: codes that share their next bits are parted by later ones.
    """
    most = 64 - width
    counts = turned.groupBy("turn", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    extra = F.least(F.ceil(F.log2(F.col("n") / F.lit(CELL))), F.lit(most)).cast("int")
    depths = scratch.keep(counts.select("turn", "block", F.when(F.col("n") > CELL, extra).otherwise(0).alias("deep")))
    while not depths.filter("deep > 0").isEmpty():
        children = turned.join(depths.filter(f"deep > 0 AND deep < {most}"), ["turn", "block"]).withColumn("child", F.expr(_child(width)))
        sizes = children.groupBy("turn", "block", "child").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
        full = scratch.keep(sizes.groupBy("turn", "block").agg(F.max("n").alias("n")))
        if full.isEmpty():
            break
        more = F.when(F.col("n").isNull(), 0).otherwise(F.greatest(F.ceil(F.log2(F.col("n") / F.lit(CELL))), F.lit(2)))
        depths = scratch.keep(
            depths.join(full, ["turn", "block"], "left").select("turn", "block", F.least(F.col("deep") + more, F.lit(most)).cast("int").alias("deep"))
        )
    return depths


def linked(codes: DataFrame, scratch: Scratch, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most ``distance`` bits apart.

    The fingerprints are put in ``distance + 1`` Gray orders, each beginning with another block
    of bits: two fingerprints within the distance agree in one block, which makes them meet
    below the same upper node of that order. A node with over ``CELL`` fingerprints is split by
    its next bits into children until none has more; a fingerprint belongs to one child and is also looked up in the
    greater ones that differ from its own by at most the distance, so none holds a hot block.
    Children are searched as whole cells, many per task. From each chunk comes a spanning
    forest, at most one link per fingerprint.
    """
    spark = codes.sparkSession
    blocks = distance + 1
    width = 64 // blocks
    orders = F.array(
        *[F.struct(F.lit(k).alias("turn"), _rotated(F.col("fp"), k * width).alias("code")) for k in range(blocks)]
    )
    turned = codes.select("fp", F.inline(orders)).select(
        "fp", "turn", "code", F.shiftrightunsigned("code", 64 - width).alias("block")
    )
    depths = _depths(turned, width, scratch)
    placed = turned.join(depths, ["turn", "block"])
    next_bits = F.expr(_child(width))
    masks = "array(0L)"
    for k in range(1, distance + 1):
        names = [f"i{j}" for j in range(k)]
        bit = " | ".join(f"shiftleft(1L, {name})" for name in names)
        inner = f"array({bit})"
        for j in range(k - 1, -1, -1):
            stop = f"i{j - 1}" if j else "deep"
            inner = f"flatten(transform(slice(sequence(0, 63), 1, {stop}), i{j} -> {inner}))"
        masks = f"concat({masks}, {inner})"
    spread = placed.withColumn("own", next_bits).withColumn("mask", F.explode(F.expr(f"CASE WHEN deep = 0 THEN array(0L) ELSE {masks} END")))
    spread = spread.withColumn("child", F.col("own").bitwiseXOR(F.col("mask"))).filter("child >= own")
    cells = spread.select(
        F.xxhash64("turn", "block", "child").alias("cell"),
        gray_rank(F.col("code")).alias("rank"),
        "code",
        "fp",
        (F.col("mask") != 0).alias("probe"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.repartition(parts, "cell").sortWithinPartitions("cell", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def columns(batch):
            key, _, code, fp, probe = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            return [key, code.view(np.uint64), fp, probe.astype(bool)]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(columns(batch))
            size += batch.num_rows
            if size < CHUNK:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1 if (whole[0] != whole[0][-1]).any() else 0
            if cut:
                yield _search([c[:cut] for c in whole], distance)
            held, size = [[c[cut:] for c in whole]], len(whole[0]) - cut
        if size:
            yield _search([np.concatenate(c) for c in zip(*held)], distance)

    return scratch.keep(ordered.mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """Near-duplicate groups of (doc_id, text): rows (doc_id, fp, fingerprint, component_id).

    Fingerprints of ``words``-word shingles link at ``distance`` or fewer differing bits;
    component_id is the least doc_id reachable. The pairs are found over distinct
    fingerprints, so a group of copies of any size is one code.

    Missing and empty texts have fingerprint zero and link like any other; a repeated row
    comes back once for each time; rows without doc_id take part and never name a group
    (a group of such rows only has no component_id); further columns are ignored; no rows
    give no rows. Every case has a test in tests/llm.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.keep(fingerprints(docs, words))
    codes = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(linked(codes.select("fp"), scratch, distance), scratch).withColumnRenamed("node", "fp")
    rooted = codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_code = scratch.keep(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(of_code, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
