"""Fingerprints, the index and the groups against plain versions of each."""

import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import simhash
from fathomline.llm.common import Scratch

MADE = random.Random(2)


def brute_fingerprint(text, size=3):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(rows, distance):
    codes = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(codes)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (codes[a] ^ codes[b]).bit_count() <= distance and root[a] < root[b]:
                    root = {i: root[a] if r == root[b] else r for i, r in root.items()}
        break
    return {i: (f"{codes[i]:016x}", root[i]) for i in ids}


def texts():
    base = " ".join(f"w{MADE.randrange(500)}" for _ in range(800))
    out = [None, "", " \t\n", "One", "one", "one TWO", "Ünï çode\x0bwords\x1cjoined", base, base.upper(), base + " end", "a b c " * 50]
    for _ in range(60):
        words = base.split()
        words[MADE.randrange(800)] = "changed"
        out.append(" ".join(words))
    out += [" ".join(f"w{MADE.randrange(500)}" for _ in range(30)) for _ in range(40)]
    return list(enumerate(out))


@pytest.mark.parametrize("distance", [2, 3])
def test_groups(spark, distance):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "a", 0) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, 3, distance).collect()}
    assert got == brute_groups(rows, distance)


@pytest.mark.parametrize("cell", [4096, 16])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    made = np.random.default_rng(4)
    centres = made.integers(0, 1 << 62, 12, dtype=np.int64)
    codes = set()
    for c in centres.tolist():
        for _ in range(150):
            code = c
            for bit in made.integers(0, 63, made.integers(0, 5)):
                code ^= 1 << int(bit)
            codes.add(code)
    codes = np.array(sorted(codes))
    scratch = Scratch(spark)
    links = simhash.linked(spark.createDataFrame([(int(c),) for c in codes], "fp long"), scratch).collect()
    place = {int(c): k for k, c in enumerate(codes)}
    got = simhash.forest(np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links]), len(codes))
    assert all((r.a ^ r.b) != 0 for r in links)
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    assert (got == simhash.forest(a, b, len(codes))).all()


def test_codes_that_share_leading_bits_are_parted_by_later_ones(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 64)
    made = np.random.default_rng(9)
    low = np.unique(made.integers(0, 1 << 24, 700))
    codes = [int(0x5A5A5A5A00000000 | int(c) << 6) for c in low]  # 32 leading bits and six trailing ones in common
    scratch = Scratch(spark)
    table = spark.createDataFrame([(c,) for c in codes], "fp long")
    turned = table.select(F.lit(0).alias("turn"), F.col("fp").alias("code"), F.shiftrightunsigned("fp", 43).alias("block"))
    depths = simhash._depths(turned, 21, scratch)
    assert depths.count() == 1 and depths.first()["deep"] > 11
    sizes = turned.join(depths, ["turn", "block"]).groupBy(F.expr(simhash._child(21)).alias("child")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 64
    links = simhash.linked(table, scratch).collect()
    place = {c: k for k, c in enumerate(codes)}
    got = simhash.forest(np.array([place[r.a] for r in links], int), np.array([place[r.b] for r in links], int), len(codes))
    all_codes = np.array(codes)
    a, b = np.nonzero(np.bitwise_count(all_codes[:, None] ^ all_codes[None, :]) <= 2)
    assert (got == simhash.forest(a, b, len(codes))).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    from fathomline.llm.queries import op1_simhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op1_simhash(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == brute_groups(rows, 2)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(4, "x y z"), (4, "x y z"), (None, "x y z"), (None, "lonely words here now"), (9, "x y z")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == ["(4, 4)", "(4, 4)", "(9, 4)", "(None, 4)", "(None, None)"]


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gray_rank(spark):
    codes = [k ^ (k >> 1) for k in (*range(64), (1 << 62) + 5)]
    got = spark.createDataFrame([(c,) for c in codes], "c long").select(simhash.gray_rank(F.col("c")).alias("r")).collect()
    assert [r.r for r in got] == [*range(64), (1 << 62) + 5]
