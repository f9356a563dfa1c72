"""Centroid clustering against a plain version in whole numbers, and against SQL."""

import hashlib
import math
import os
import random

import duckdb
import pytest

from fathomline.llm import centroids

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(rows, k, rounds, dims):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of (vec_id, embedding)."""
    kept = []
    for name, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and abs(x) * 256 < centroids.LARGEST for x in e):
            kept.append((name, [math.floor(256 * x) for x in e]))
    named = [(hashlib.sha256(f"2:{name}".encode()).hexdigest() if name is not None else "z", q) for name, q in kept]
    centres = [q for _, q in sorted(named)[:k]]

    def assign(q):
        distances = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centres]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(assign(q)[0], []).append(q)
        centres = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centres)]
    out = [(name, *assign(q)) for name, q in kept]
    each = {}
    for _, c, d in out:
        each[c] = each.get(c, 0) + d
    return [
        (name, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for name, c, d in out
    ]


def made(n, dims, seed=1):
    """Vectors in exact binary fractions, so that a float says the same as a double."""
    rng = random.Random(seed)
    return [(i, [rng.randint(-300, 300) / 512 for _ in range(dims)]) for i in range(n)]


def run(spark, rows, **options):
    data = [(name, e, 0, "x") for name, e in rows]
    found = centroids.cluster(spark.createDataFrame(data, SCHEMA).repartition(3), **options)
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("dims, width", [(5, 2), (6, 3), (4, 1), (4, 4)])
def test_against_a_plain_version(spark, dims, width):
    rows = made(120, dims)
    got = run(spark, rows, k=7, rounds=3, dims=dims, width=width)
    assert got == sorted(plain(rows, 7, 3, dims), key=repr)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, e) for i, e in made(40, 3)]
    rows += [(100, None), (101, []), (102, [0.5, 0.5]), (103, [0.5, None, 0.5]), (104, [nan, 0.0, 0.0]), (105, [inf, 0.0, 0.0])]
    rows += [(106, [-inf, 0.0, 0.0]), (107, [2.0**30, 0.0, 0.0]), (108, [2.0**18, -(2.0**18), 2.0**18])]
    rows += [(None, [0.25, 0.25, 0.25])] * 2 + rows[:3] + [(0, [-0.5, 0.0, -0.001953125])]
    got = run(spark, rows, k=6, rounds=2, dims=3)
    assert got == sorted(plain(rows, 6, 2, 3), key=repr)
    assert not {r[0] for r in got} & set(range(100, 108))


def test_ties_copies_and_empty_clusters(spark):
    # all vectors equal: every centroid is the same, the first takes all and the others stay
    rows = [(i, [0.5, -0.5]) for i in range(300)]
    got = run(spark, rows, k=4, rounds=3, dims=2)
    assert got == sorted(plain(rows, 4, 3, 2), key=repr) and {r[1] for r in got} == {0}
    rows = [(i, [float(i % 2), 0.0]) for i in range(50)]
    assert run(spark, rows, k=3, rounds=2, dims=2) == sorted(plain(rows, 3, 2, 2), key=repr)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = made(3, 4)
    assert run(spark, rows, k=40, rounds=5, dims=4) == sorted(plain(rows, 40, 5, 4), key=repr)
    empty = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_segments_are_lossless_and_bounded(spark):
    rows = made(100, 4)
    kept = centroids.integers(spark.createDataFrame([(i, e, 0, "") for i, e in rows], SCHEMA).coalesce(1), 4)
    segments = centroids.encode(kept, 4, rows=16).collect()
    assert [len(s.ids) for s in segments] == [16] * 6 + [4]
    import numpy as np

    for s in segments:
        n, at, back = len(s.ids), 0, []
        for block, size in enumerate(s.sizes):
            words = np.frombuffer(s.words, "<i4", size * 2, at).reshape(size, 2)
            at += size * 8
            back.append(words[np.frombuffer(s.codes, "<u2").reshape(-1, n)[block]])
        q = np.concatenate(back, axis=1)
        assert [list(map(int, r)) for r in q] == [[math.floor(256 * x) for x in rows[i][1]] for i in s.ids]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_query_against_sql(spark):
    from fathomline.llm.queries import SQL, op13_centroids

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    relation = duck.sql(SQL["op13_centroids"])
    got = op13_centroids(spark, FOLDER)
    assert relation.columns == got.columns
    assert sorted(relation.fetchall()) == sorted(map(tuple, got.collect()))
