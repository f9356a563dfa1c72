"""Restoration of disguised words and held-out accuracy of the toxicity score."""

import random
import zlib

import numpy as np
import pytest

from fathomline.llm import toxicity
from fathomline.llm.common import Scratch

MADE = random.Random(11)
SYLLABLES = "the an ing er tion and to of wor ly mo re cl es tra sh id lo ser".split()
BAD = ["idiot", "moron", "clown", "worthless"]


def prose(n):
    return " ".join("".join(MADE.choice(SYLLABLES) for _ in range(MADE.randrange(1, 4))) for _ in range(n))


def disguised(word):
    kind = MADE.randrange(4)
    if kind == 0:
        return word.replace("o", "0").replace("i", "1")
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return word[0] + word[1] * 4 + word[2:]
    return word.upper() + "!!!"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = [], []
    for k in range(1200):
        toxic = k % 4 == 0
        text = prose(40)
        if toxic:
            word = MADE.choice(BAD)
            text += f" {word if k % 8 else disguised(word)} {prose(5)}"
        docs.append((k, text, 1))
        labels.append((k, 1, int(toxic)))
    docs += [(None, "you idiot", 1), (5000, None, 1), (5001, "", 1), (5002, "x" * 50000 + " m0r0n " + "1" * 50000, 1)]
    docs += [(5003, "i d i o t", 1)] * 2
    labels += [(None, 1, 1), (7, 1, None), (4, 1, 1), (4, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.fixture(scope="module")
def model(spark, tables):
    return toxicity.fit(*tables, Scratch(spark))


def test_counts_of_the_language(spark):
    texts = ["Ab c", None, "ß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.gram: r.n for r in toxicity.language_counts(docs).collect()}

    def code(*symbols):
        at = 0
        for s in symbols:
            at = at * toxicity.SYMBOLS + s
        return at

    e = toxicity.EDGE
    assert got[code(e, e, e, 0)] == 1 and got[code(e, e, 0, 1)] == 1 and got[code(e, 0, 1, e)] == 1
    assert got[code(e, e, e, 2)] == 1 and got[code(e, e, e, 26)] == 1


def test_restoration(model):
    reader = toxicity.Reader(toxicity.Restorer(model.cost), lambda w: w)
    for seen, meant in {
        "1d10t": "idiot",
        "m0r0n": "moron",
        "idiooooot": "idiot",
        "CL0WN!!": "clown",
        "i.d.i.o.t": "idiot",
        "w0r7hl3ss": "worthless",
        "so i d i o t you": "idiot",
    }.items():
        assert meant in reader.of(seen), (seen, reader.of(seen))
    assert reader.of("the and*** 2023-01-05 better") == {"the", "and", "better"}


def test_best_path_is_the_least_costly(model):
    """Against all readings of short disguised words."""
    restorer = toxicity.Restorer(model.cost)

    def price(letters, extra):
        state = (toxicity.EDGE,) * 3
        for c in [*letters, " "]:
            code = toxicity.EDGE if c == " " else toxicity.symbol(c)
            extra += float(model.cost[(*state, code)])
            state = (*state[1:], code)
        return extra

    for text in ("1d10t", "m00n", "c1(0", "aaab"):
        ways = [("", 0.0)]
        for choices in restorer._choices(text, False):
            ways = [(w + letter, cost + extra) for w, cost in ways for letter, extra in choices]
        best = min(ways, key=lambda w: price(*w))
        assert np.isclose(price(*best), min(price(w, c) for w, c in ways if w == restorer.decode(text)))


def test_scores(tables, model):
    docs, labels = tables
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = toxicity.scores(docs, model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    odd = {r.doc_id: r.predicted for r in got if r.doc_id is None or r.doc_id >= 5000}
    assert odd == {None: 1, 5000: 0, 5001: 0, 5002: 1, 5003: 1}


def test_labels_of_the_held_out_fold_change_nothing(spark, tables, model):
    from pyspark.sql import functions as F

    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned, Scratch(spark))
    assert again.weights == model.weights and again.intercept == model.intercept


def test_reject_keeps_columns_and_clean_rows(tables, model):
    docs, _ = tables
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in toxicity.scores(docs, model).filter("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == ids


def test_nothing_to_learn_from(spark, tables):
    docs, labels = tables
    blank = toxicity.fit(docs, labels.limit(0), Scratch(spark))
    assert {r.score for r in toxicity.scores(docs, blank).collect()} == {0.0}
    none = docs.limit(0)
    assert toxicity.scores(none, toxicity.fit(none, labels, Scratch(spark))).count() == 0


def test_disguises_at_punctuation_and_doubled_letters(spark, tables, model):
    seen = ["so i d i o t.", '"i d i o t"', "(m 0 r 0 n)", "you i d i o t!", "c l o w n, the", "iddiot", "idioott you", '"mmoron."', "worthhless", "clloown"]
    fine = ["the tion. a b", "better wor", "idot", "cllan", "so a. b. c."]
    docs = spark.createDataFrame(list(enumerate(f"{prose(20)} {t}" for t in seen + fine)), "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.scores(docs, model).collect()}
    assert [got[k] for k in range(len(got))] == [1] * len(seen) + [0] * len(fine)
    left = toxicity.reject(docs, model).collect()
    assert sorted(r.doc_id for r in left) == list(range(len(seen), len(seen) + len(fine)))
    assert "worthless" in toxicity.Reader(toxicity.Restorer(model.cost), lambda w: w).of("worthless")
