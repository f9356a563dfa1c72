"""Token counts against the tokenizers library, which the operator does not use."""

import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomline.llm import counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello, it's 2023 and we'll see THE İstanbul ΣΑΣ Οδος  two  blanks\n\n\nend ",
    "a<|endoftext|>b <|endoftext|><|endoftext|>  c<|endoftext",
    "é café ﬁ 가 \U0001f600\U0001f468‍\U0001f469 क्षि ไทย 日本語 ½ ²³ Ⅷ",
    "x\x1cy\x1d z\x85w\xa0v u　t᠎s​r\x0bq\x0cp  \x1e",
    "no'sense 'S 'LL d'accord ''' $$$%%%***",
    "aaaaaaaaaab" * 400,
    "thinthethandther" * 3000,
    " " * 5000 + "x" + "\n" * 700,
    "x " * 30000,
    "\x00\x01\x7f",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def expected(library, text):
    n = len(library.encode(text or "", add_special_tokens=False).ids)
    return len((text or "").encode()), n, n > 512


def test_cases(spark, library):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "again", "x")] * 2, "doc_id long, text string, n_tokens string")
    got = counts.token_counts(docs, VOCABULARY).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        text = "again" if row.doc_id is None else TEXTS[row.doc_id]
        assert tuple(row)[1:] == expected(library, text), (row.doc_id, text and text[:40])


@pytest.mark.parametrize("size", [1, 5])
def test_the_first_tier_never_changes_a_count(spark, library, size):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)
    for row in counts.token_counts(docs, VOCABULARY, size=size).collect():
        assert tuple(row)[1:] == expected(library, TEXTS[row.doc_id])


def test_full_memories_are_emptied(monkeypatch, library):
    monkeypatch.setattr(counts, "CACHE", 600)
    monkeypatch.setattr(counts, "PIECE", 50)
    vocabulary = counts.Vocabulary(VOCABULARY)
    counter = counts.Counter(vocabulary, counts.Table.of([(" blanks", vocabulary.length(" blanks"))]))
    for text in TEXTS:
        assert counter.count(text or "") == expected(library, text)[1]


def test_the_most_frequent_come_first(spark):
    docs = spark.createDataFrame([("the the the of",)] * 50 + [("rare words",)], "text string")
    found = [r.piece for r in counts.frequent_pieces(docs, 2).collect()]
    assert found[0] == " the" and set(found) <= {" the", " of", "the"}
    table = counts.Table.of([("é", 2), (" a", 1)])
    assert dict(table.items()) == {"é": 2, " a": 1}


def test_partitions_without_a_sketch(spark):
    docs = spark.createDataFrame([(1, "the cat")], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(r.piece for r in counts.frequent_pieces(docs).collect()) == [" cat", "the"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_nothing_is_shuffled_but_sketches(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = counts.frequent_pieces(docs)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "Exchange" not in line or "partial_" in plan
    counted = counts.token_counts(docs, VOCABULARY)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    assert counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in counts.token_counts(nothing, VOCABULARY).orderBy("doc_id").collect()] == [(1, 0, 0, False), (2, 0, 0, False)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark, library):
    from fathomline.llm.queries import op11_token_counts

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op11_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == expected(library, texts[r.doc_id]) for r in got)
