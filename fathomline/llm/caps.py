"""Near-duplicate vectors by spherical-cap filters of a structured random product code."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, components
from fathomline.llm.simhash import forest

BLOCKS = 2
ROTATIONS = 16
COMMON = 16.0
LEAST = 24
LOWER = (0.96, 0.92, 0.88, 0.84, 0.8, 0.7, 0.5)
CROWD = 0.25
CELL = 2048
HELD = 1 << 14


def _cap(height: float, size: int) -> float:
    """Share of the unit sphere whose first coordinate is at least ``height``."""
    t = np.linspace(-1, 1, 200_001)
    density = np.power(np.maximum(1 - t * t, 0), (size - 3) / 2) if size > 2 else np.ones_like(t)
    return float(density[t >= height].sum() / density.sum())


def _both(height: float, size: int, cosine: float) -> float:
    """Chance that a vector at ``cosine`` to one within a cap is within it too."""
    t = np.linspace(height, 1, 2001)[:-1]
    density = np.power(1 - t * t, max(size - 3, 0) / 2)
    spread = math.sqrt(1 - cosine * cosine) * np.sqrt(1 - t * t) / math.sqrt(max(size - 1, 1))
    above = [0.5 * math.erfc((height - cosine * a) / (s * math.sqrt(2))) for a, s in zip(t, spread)]
    return float((density * above).sum() / density.sum())


def parameters(rows: int, size: int, cosine: float) -> tuple[float, int]:
    """(cap height, code words per block) for ``rows`` vectors of ``size`` components.

    The caps are so small that a cap holds about ``CROWD`` vectors of unrelated direction, and
    there are so many that two vectors at the threshold are expected to share ``COMMON`` of them.
    Replication therefore grows as a small power of the rows, and buckets do not grow. Directions
    of one code are not independent; ``ROTATIONS`` turned codes, each with its share, make up for it.
    """
    low, high = 0.0, 0.999
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if _cap(middle, size) * rows > CROWD else (low, middle)
    share = max(_cap(low, size), 1e-300)
    wanted = COMMON / ROTATIONS / max(_both(low, size, cosine), 1e-6) / share
    return low, max(2, math.ceil(wanted ** (1 / BLOCKS)))


@lru_cache(maxsize=4)
def code(size: int, words: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Random rotations, each with unit code words for every block of components; the same in every task."""
    made = np.random.default_rng([size, words])
    cuts = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
    out = []
    for _ in range(ROTATIONS):
        rotation, _ = np.linalg.qr(made.normal(size=(size, size)))
        tables = [made.normal(size=(words, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
        out.append((rotation, [t / np.linalg.norm(t, axis=1, keepdims=True) for t in tables]))
    return out


def exceeding(units: np.ndarray, height: float, words: int) -> list[np.ndarray]:
    """All filters whose direction has at least ``height`` as inner product with each unit vector.

    A direction joins one code word per block; a block's words that cannot reach the height
    with the best of all other blocks are left out before the sums are formed.
    """
    out: list[list[np.ndarray]] = [[] for _ in units]
    lead = 0
    for rotation, blocks in code(units.shape[1], words):
        turned = units @ rotation
        need = height * math.sqrt(len(blocks))
        ends = np.cumsum([t.shape[1] for t in blocks])
        parts = [turned[:, e - t.shape[1] : e] @ t.T for e, t in zip(ends, blocks)]
        best = np.stack([p.max(1) for p in parts], 1)
        total = best.sum(1)
        for row in np.flatnonzero(total >= need).tolist():
            sums, ids, rest = np.zeros(1), np.zeros(1, np.int64), total[row]
            for k, part in enumerate(parts):
                rest -= best[row, k]
                kept = np.flatnonzero(part[row] >= need - (total[row] - best[row, k]))
                grown = sums[:, None] + part[row, kept]
                a, b = np.nonzero(grown >= need - rest)
                sums, ids = grown[a, b], ids[a] * words + kept[b]
            out[row].append(ids + lead)
        lead += words ** len(blocks)
    return [np.sort(np.concatenate(own)) if own else np.zeros(0, np.int64) for own in out]


def decode(units: np.ndarray, height: float, words: int) -> list[np.ndarray]:
    """Filters of each unit vector: all it exceeds; where these are under ``LEAST``, all above a lower height.

    The directions of a product code lie less densely around some vectors than around others;
    a lower height there keeps the number that two neighbours share.
    """
    found = exceeding(units, height, words)
    for part in LOWER:
        few = [k for k, own in enumerate(found) if len(own) < LEAST]
        if not few:
            break
        for k, own in zip(few, exceeding(units[few], height * part, words)):
            found[k] = own
    return found


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return np.split(flat.astype(float), (offsets - offsets[0])[1:-1]) if len(column) else []


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _listed(vectors: DataFrame, height: dict[int, tuple[float, int]]) -> DataFrame:
    """(rep, filters): the filters of each vector; the number of components is part of a filter's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                rows = _vectors(piece.column("embedding"))
                ids = piece.column("rep").to_pylist()
                found: list[np.ndarray | None] = [None] * len(rows)
                for size in {len(r) for r in rows}:
                    own = [k for k, r in enumerate(rows) if len(r) == size]
                    for k, filters in zip(own, decode(_unit([rows[k] for k in own]), *height[size])):
                        found[k] = filters
                lists = pa.array(found, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["rep", "filters"])

    return vectors.mapInArrow(run, "rep long, filters array<long>")


def _links(rows: list[tuple], cosine: float) -> list[tuple[int, int, int]]:
    """(rep, vectors linked, least rep reached) within one cell of (filter, rep, weight, vector, filters, side).

    A pair counts in the first filter that its two lists share, so a pair that meets in many
    filters is counted once.
    """
    filter_, rep, weight, vector, lists, side = zip(*rows)
    x = _unit(list(vector))
    close = x @ x.T >= cosine
    np.fill_diagonal(close, False)
    side = np.array(side)
    if side.any():
        close &= side[:, None] != side[None, :]
    left, right = np.nonzero(close)
    if not len(left):
        return []
    # pairs that share an earlier filter are counted there
    earlier = [own[: np.searchsorted(own, filter_[0])] for own in lists]
    values, inverse = np.unique(np.concatenate(earlier), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(e) for e in earlier])
    met = np.zeros((len(rows), len(rows)), bool)
    for at in range(0, len(values), 512):
        own = (inverse >= at) & (inverse < at + 512)
        table = np.zeros((len(rows), min(512, len(values) - at)), np.float32)
        table[owner[own], inverse[own] - at] = 1
        met |= table @ table.T > 0
    label = forest(left, right, len(rows))
    counted = (close & ~met) @ np.array(weight)
    rep = np.array(rep)
    least = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least, label, rep)
    reached = least[label]
    return [(r, int(c), int(m)) for r, c, m in zip(rep.tolist(), counted, reached) if c or m != r]


def _meet(cells: DataFrame, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        now = None

        def told():
            columns = list(zip(*out)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["rep", "links", "least"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                names = ("filter", "low", "high", "rep", "weight", "side")
                filters, low, high, rep, weight, side = (piece.column(n).to_pylist() for n in names)
                vectors = _vectors(piece.column("embedding"))
                lists = [x.astype(np.int64) for x in _vectors_int(piece.column("filters"))]
                for k in range(piece.num_rows):
                    cell = (filters[k], low[k], high[k], len(vectors[k]))
                    if cell != now:
                        if len(held) > 1:
                            out += _links(held, cosine)
                        held, now = [], cell
                    held.append((filters[k], rep[k], weight[k], vectors[k], lists[k], side[k]))
                if len(out) > HELD:
                    yield told()
                    out = []
        if len(held) > 1:
            out += _links(held, cosine)
        yield told()

    return cells.mapInArrow(run, "rep long, links long, least long")


def _vectors_int(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return np.split(flat, (offsets - offsets[0])[1:-1]) if len(column) else []


def near_duplicates(table: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Links among (vec_id, embedding) at ``cosine`` or more: (vec_id, n_links, component_id, kept).

    Equal vectors are one vector with a weight. Every vector is listed under all filters of the
    product code that it exceeds; vectors under a common filter are compared exactly, in
    double precision. A filter with over ``CELL`` vectors is cut into blocks that meet pair by pair in
    tasks of their own. n_links counts the other vectors linked directly, component_id is the
    least vec_id reachable.

    Vectors that are missing, empty, zero, or have missing or non-finite components link with
    nothing; vectors of different length never link; rows that repeat a vec_id with equal vectors
    are one vector and each comes back; rows without vec_id take no part and come back with no links
    and no component; further columns are ignored; no rows give no rows.
    """
    spark = table.sparkSession
    scratch = Scratch(spark)
    e = F.col("embedding")
    fine = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(fine & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "embedding",
        fine.alias("fine"),
        F.xxhash64("embedding").alias("h1"),
        F.xxhash64(F.lit(7), "embedding").alias("h2"),
    )
    one = rows.filter("fine").groupBy("h1", "h2", "vec_id").agg(F.first("embedding").alias("embedding"))
    vectors = scratch.keep(
        one.groupBy("h1", "h2").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")
        )
    )
    sizes = vectors.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    height = {r["size"]: parameters(r["n"], r["size"], cosine) for r in sizes}
    listed = _listed(vectors.select("rep", "embedding"), height)
    spread = scratch.keep(listed.select("rep", F.explode("filters").alias("filter")))
    crowded = spread.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = spread.join(crowded, "filter").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("filter", "n"))).alias("own")
    )
    met = vectors.select("rep", "weight", "embedding").join(shared, "rep")
    met = met.select("rep", "weight", "embedding", F.col("own.filter").alias("filters"), F.inline("own"))
    cuts = F.ceil(F.col("n") / CELL).cast("int")
    block = F.pmod(F.xxhash64("rep"), cuts.cast("long")).cast("int")
    met = met.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), cuts - 1)))
    cells = met.select(
        "filter",
        F.least("block", "with").alias("low"),
        F.greatest("block", "with").alias("high"),
        "rep",
        "weight",
        "embedding",
        "filters",
        # within a cell of two blocks only pairs across count; those of one block meet in their own cell
        F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2).alias("side"),
    )
    keys = ["filter", "low", "high"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.repartition(parts, *keys).sortWithinPartitions(*keys, F.size("embedding"))
    found = scratch.keep(_meet(ordered, cosine))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")), scratch)
    known = vectors.select("h1", "h2", "rep", "weight").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = scratch.keep(
        known.select(
            "h1",
            "h2",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("root"),
            F.lit(True).alias("fine"),
        )
    )
    joined = rows.select("vec_id", "fine", "h1", "h2").join(known, ["h1", "h2", "fine"], "left")
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
