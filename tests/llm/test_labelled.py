"""Bounded samples of labelled rows, and the registered classifiers on a held-out fold."""

import os
import zlib

import numpy as np
import pytest

from fathomline.llm import labelled, quality, toxicity
from fathomline.llm.common import Scratch

FOLDER = "/root/testdata/sf0.01"


def test_a_repeated_id_gives_one_row(spark):
    docs = spark.createDataFrame([(7, f"text {k}".encode()) for k in range(500)] + [(k, b"other") for k in range(100, 130)], "doc_id long, text binary")
    labels = spark.createDataFrame([(7, 1)] + [(k, 0) for k in range(100, 130)], "doc_id long, toxic int")
    for bound in (10, 1000):
        sample = labelled.training_rows(labels, "toxic", 5, 0, bound, Scratch(spark))
        rows = labelled.with_labels(docs.repartition(5), sample).collect()
        assert len(rows) == sample.count() <= bound and len({r.doc_id for r in rows}) == len(rows)
    least = {bytes(r.text) for r in labelled.with_labels(docs, sample).filter("doc_id = 7").collect()}
    again = {bytes(r.text) for r in labelled.with_labels(docs.repartition(9), sample).filter("doc_id = 7").collect()}
    assert least == again and len(least) == 1


def test_fits_see_one_row_per_id(spark):
    docs = spark.createDataFrame([(3, f"you idiot {k}") for k in range(300)] + [(k, "a calm text about boats") for k in range(20, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 0, 1)] + [(k, 1, 0) for k in range(20, 40)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, Scratch(spark), rows=10)
    assert model.intercept is not None and abs(model.intercept) < 10
    assert quality.fit(docs, labels, Scratch(spark), rows=10) is not None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name, label, folds, fold", [("op7_toxicity", "toxic", 5, 0), ("op9_quality", "quality", 3, 1)])
def test_query_on_its_held_out_fold(spark, name, label, folds, fold):
    from fathomline.llm.queries import QUERIES

    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES[name](spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
    known = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.95
    # equal texts have equal scores
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.score) == r.score


def test_held_out_of_missing_ids(spark):
    found = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r.h for r in found.select(labelled.held_out(2, zlib.crc32(b"1") % 2).alias("h")).collect()] == [False, True]
