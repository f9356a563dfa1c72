"""Exact centroid clustering of vectors through dictionaries of subvectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch

SCALE = 256
# integers of components beyond this have squared distances that a long cannot hold
LARGEST = 1 << 27
SEGMENT = 1 << 14
WIDTH = 2


def integers(vectors: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors that are kept: q the integers floor(scale * x) of ``dims`` finite components."""

    def sound(x: Column) -> Column:
        value = F.abs(x.cast("double"))
        return F.coalesce(~F.isnan(value) & (value * scale < float(LARGEST)), F.lit(False))

    kept = vectors.filter((F.size("embedding") == dims) & F.forall("embedding", sound))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def _segment(ids: pa.Array, q: np.ndarray, width: int) -> dict:
    """One segment of vectors: per block of ``width`` dimensions the distinct subvectors, per vector their codes."""
    codes, sizes, values = [], [], []
    for at in range(0, q.shape[1], width):
        block = np.ascontiguousarray(q[:, at : at + width])
        whole = block.view(np.dtype((np.void, block.dtype.itemsize * block.shape[1]))).ravel()
        distinct, code = np.unique(whole, return_inverse=True)
        codes.append(code.astype("<u2"))
        sizes.append(len(distinct))
        values.append(distinct.tobytes())
    return {"ids": ids.to_pylist(), "codes": b"".join(c.tobytes() for c in codes), "sizes": sizes, "words": b"".join(values)}


SEGMENTS = "ids array<long>, codes binary, sizes array<int>, words binary"


def encode(kept: DataFrame, dims: int, width: int = WIDTH, rows: int = SEGMENT) -> DataFrame:
    """Segments of at most ``rows`` vectors, dictionary-encoded without loss; nothing is shuffled.

    A segment has the ids of its vectors, for each block the number of distinct subvectors, their
    integers, and the code of each vector's subvector. Blocks have ``width`` dimensions, the last maybe fewer.
    """
    if rows > 1 << 16:
        raise ValueError("a code has 16 bits")
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("codes", pa.binary()), ("sizes", pa.list_(pa.int32())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            at = 0
            while size - at >= (1 if last else rows):
                part = whole.slice(at, rows)
                flat = part.column("q").combine_chunks().flatten().to_numpy()
                q = flat.reshape(part.num_rows, dims).astype("<i4")
                yield pa.RecordBatch.from_pylist([_segment(part.column("vec_id"), q, width)], schema)
                at += part.num_rows
            held, size = whole.slice(at).to_batches(), size - at

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from cut(False)
        if size:
            yield from cut(True)

    return kept.mapInArrow(run, SEGMENTS)


def nearest(segment: dict, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, its squared distance, and the sums of each cluster's components.

    Each distinct subvector meets each centroid once; a vector's distances are sums of
    the partial ones by code. Equal distances go to the smaller number.
    """
    n, k, dims = len(segment["ids"]), *centroids.shape
    codes = np.frombuffer(segment["codes"], "<u2").reshape(-1, n)
    blocks, at = [], 0
    total = np.zeros((n, k), np.int64)
    for code, size, start in zip(codes, segment["sizes"], range(0, dims, width)):
        wide = min(width, dims - start)
        words = np.frombuffer(segment["words"], "<i4", size * wide, at).reshape(size, wide).astype(np.int64)
        at += 4 * size * wide
        partial = np.zeros((size, k), np.int64)
        for j in range(wide):
            partial += np.square(words[:, j, None] - centroids[:, start + j])
        total += partial[code]
        blocks.append((code, words))
    own = total.argmin(axis=1)
    sums = np.empty((k, dims), np.int64)
    for (code, words), start in zip(blocks, range(0, dims, width)):
        met = np.bincount(own * len(words) + code, minlength=k * len(words)).reshape(k, len(words))
        sums[:, start : start + words.shape[1]] = met @ words
    return own, total[np.arange(n), own], sums


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in ("ids", "codes", "sizes", "words")}


def moved(encoded: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after one round: exact floors of the means of their vectors, empty ones as they were."""
    sent = np.array(centroids, np.int64)
    k, dims = sent.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for segment in _segments(batches):
            own, _, part = nearest(segment, sent, width)
            counts += np.bincount(own, minlength=k)
            sums += part
        met = np.flatnonzero(counts)
        columns = [pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    wide = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
    parts = encoded.mapInArrow(run, "cluster int, n long, sums array<long>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect()
    changed = list(centroids)
    for row in found:
        changed[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return changed


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2", scale: int = SCALE, width: int = WIDTH
) -> DataFrame:
    """Clusters of (vec_id, embedding): rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors of exactly ``dims`` finite components are kept, each as integers floor(scale * x). The ``k``
    first centroids are the vectors of least SHA-256 of salt:vec_id; each of ``rounds`` rounds assigns
    all vectors and moves the centroids; a last assignment follows. All sums are exact integers.

    Vectors that are missing, of another length, or with components that are missing, not finite or of
    ``LARGEST`` and more after scaling are left out. Rows that repeat an id are vectors of their own;
    equal hashes go by the vector. Rows without vec_id are clustered and come last as first centroids.
    Fewer vectors than ``k`` give as many centroids. Other columns are ignored; no rows give no rows.
    Only centroids and the sums of ``k`` clusters reach the driver.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kept = integers(vectors, dims, scale)
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.select(name.alias("name"), "q").orderBy(F.col("name").asc_nulls_last(), "q").limit(k)
    centroids = [list(r["q"]) for r in seeds.collect()]
    result = "vec_id long, cluster int, distance long"
    if not centroids:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return spark.createDataFrame([], result).select("*", *none)
    encoded = scratch.keep(encode(kept, dims, width))
    for _ in range(rounds):
        centroids = moved(encoded, centroids, width)
    sent = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            own, distance, _ = nearest(segment, sent, width)
            columns = [pa.array(segment["ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    assigned = scratch.keep(encoded.mapInArrow(run, result))
    scratch.drop(encoded)
    parts = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    total = sum(int(r["s"]) for r in parts)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(r["cluster"], int(r["s"]), total, digests[r["cluster"]]) for r in parts]
    # at most k rows
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2", scale: int = SCALE) -> str:
    """The same rows as ``cluster`` by plain SQL over ``embeddings``."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) * {scale} < {LARGEST})) = {dims}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT n - 1 AS k, q
  FROM (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, q) AS n, q FROM kept)
  WHERE n <= {k}
)""",
    ]
    for turn in range(rounds + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (
  SELECT v.rid, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, min(
    list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT * {k} + c.k) AS best
  FROM kept v CROSS JOIN c{turn} c
  GROUP BY v.rid
)""")
        if turn < rounds:
            steps.append(f"""c{turn + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.q, c.q) AS q
  FROM c{turn} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q
    FROM (
      SELECT k, i, sum(x)::HUGEINT AS s, count(*) AS n
      FROM (SELECT best % {k} AS k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{turn})
      GROUP BY k, i
    )
    GROUP BY k
  ) m ON m.k = c.k
)""")
    last = f"""SELECT a.vec_id, CAST(a.best % {k} AS INTEGER) AS cluster, CAST(a.best // {k} AS BIGINT) AS distance,
  CAST(sum(a.best // {k}) OVER (PARTITION BY a.best % {k}) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best // {k}) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best % {k}"""
    return "WITH " + ",\n".join(steps) + "\n" + last


SQL = sql()
