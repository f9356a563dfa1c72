"""Links and groups of vectors against all pairs, and the recall of the filters at the threshold."""

import os

import numpy as np
import pytest

from fathomline.llm import caps
from fathomline.llm.simhash import forest

MADE = np.random.default_rng(9)


def pair(cosine, size=64):
    a, b = MADE.normal(size=(2, size))
    a /= np.linalg.norm(a)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.9):
    ids = [i for i, v in rows if i is not None and good(v)]
    x = np.array([np.float32(v) for i, v in rows if i is not None and good(v)], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= cosine
    np.fill_diagonal(close, False)
    a, b = np.nonzero(close)
    label = forest(a, b, len(ids))
    least = {}
    for i, k in zip(ids, label):
        least[k] = min(least.get(k, i), i)
    out = {i: (int(c), least[k], i == least[k]) for i, c, k in zip(ids, close.sum(1), label)}
    return {i: out.get(i, (0, i, True)) for i, _ in rows if i is not None}


def corpus():
    rows = [v for c in (0.93, 0.95, 0.97, 0.99, 0.85, 0.7) for _ in range(25) for v in pair(c)]
    rows += list(MADE.normal(size=(500, 64)))
    centre = MADE.normal(size=64)
    rows += [centre] * 40 + [centre * 3] * 2 + [centre + MADE.normal(size=64) * s for s in np.linspace(0.01, 0.6, 120)]
    order = MADE.permutation(len(rows))
    out = [(int(k), np.float32(rows[k]).tolist()) for k in order]
    bad = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63]
    return out + [(10_000 + k, v) for k, v in enumerate(bad)] + [(None, centre.tolist())]


@pytest.mark.parametrize("cell", [2048, 7])
def test_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(caps, "CELL", cell)
    rows = corpus()
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, weight int, filters int")
    got = [tuple(r) for r in caps.near_duplicates(frame.repartition(5)).collect()]
    assert len(got) == len(rows) and (None, 0, None, False) in got
    told = brute(rows)
    links = {r[0]: r[1] for r in got if r[0] is not None}
    # no pair below the threshold, at most one in a hundred missed above it
    assert all(links[i] <= told[i][0] for i in told)
    assert sum(links.values()) >= 0.99 * sum(t[0] for t in told.values())
    groups = {r[0]: r[2] for r in got if r[0] is not None}
    assert np.mean([groups[i] == told[i][1] for i in told]) >= 0.99
    assert all(r[3] == (r[0] == r[2]) for r in got if r[0] is not None)


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold share a filter, at several sizes of the table."""
    for rows in (500, 50_000):
        height, words = caps.parameters(rows, 64, 0.9)
        pairs = [pair(0.9) for _ in range(400)]
        left = caps.decode(np.array([a for a, _ in pairs]), height, words)
        right = caps.decode(np.array([b for _, b in pairs]), height, words)
        met = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(left, right)])
        print(rows, height, words, np.mean([len(a) for a in left]), met)
        assert met >= 0.99


def test_decoding_lists_all_filters():
    units = MADE.normal(size=(20, 10))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    for x, got in zip(units, caps.exceeding(units, 0.5, 3)):
        told = []
        for rotation, (one, two) in caps.code(10, 3):
            y = x @ rotation
            told += ((one @ y[:5])[:, None] + (two @ y[5:])[None, :]).reshape(-1).tolist()
        assert got.tolist() == np.flatnonzero(np.array(told) / np.sqrt(2) >= 0.5).tolist()


def test_lengths_and_repeats(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.1]), (3, [2.0, 0.1]), (4, [5.0]), (5, [7.0])]
    got = sorted(tuple(r) for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_no_rows(spark):
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    from fathomline.llm.queries import op3_caps

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert {r.vec_id: tuple(r)[1:] for r in op3_caps(spark, folder).collect()} == brute(rows)
