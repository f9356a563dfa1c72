"""The factorisation machine against sums over all pairs, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from fathomline.llm import quality
from fathomline.llm.common import Scratch

MADE = random.Random(5)


def test_scores_equal_the_sum_over_pairs():
    made = np.random.default_rng(1)
    machine = quality.Machine(0.3, made.normal(size=quality.WIDTH), made.normal(size=(quality.WIDTH, quality.RANK)))
    rows = [quality.features(t, quality.Words()) for t in (b"", b"one two two", "ünïcode wörds\n\nmore".encode(), b"x " * 5000)]
    heads = np.r_[0, np.cumsum([len(i) for i, _ in rows])[:-1]]
    got = machine.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), heads)
    for (index, value), score in zip(rows, got):
        assert len(set(index.tolist())) == len(index) and np.isfinite(value).all()
        told = machine.intercept + machine.weight[index] @ value
        for a in range(len(index)):
            for b in range(a):
                told += machine.factor[index[a]] @ machine.factor[index[b]] * value[a] * value[b]
        assert np.isclose(told, score)


@pytest.fixture(scope="module")
def tables(spark):
    def prose(n):
        return " ".join("".join(MADE.choice(("ka", "lo", "mi", "ne", "su")) for _ in range(3)) for _ in range(n))

    docs, labels = [], []
    for k in range(900):
        good = k % 3 > 0
        text = prose(40)
        docs.append((k, text if good else " ".join(w.upper() + "!!" for w in text.split()) if k % 2 else f"{text}{' buy now' * 30}", "x"))
        labels.append((k, int(good), 0))
    docs += [(None, prose(40), "x"), (2000, None, "x"), (2001, "", "x"), (2002, prose(90000), "x"), (3, docs[3][1], "x")]
    labels += [(None, 1, 0), (5, None, 0), (3, labels[3][1], 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, label string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_scores(spark, tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    machine = quality.fit(docs, labels, Scratch(spark))
    got = quality.scores(docs, machine).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.98
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[2000] == by_id[2001]


def test_held_out_labels_and_row_order_change_nothing(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit(docs, labels, Scratch(spark)), quality.fit(docs.repartition(7), turned, Scratch(spark))
    assert one.intercept == two.intercept and (one.factor == two.factor).all()


def test_nothing_to_learn_from(spark, tables):
    docs, labels = tables
    assert quality.fit(docs, labels.limit(0), Scratch(spark)) is None
    assert {r.score for r in quality.scores(docs, None).collect()} == {1.0}
    assert quality.scores(docs.limit(0), None).count() == 0
