"""Encoding against the tokenizers library, which the operator does not use."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomline.llm import bpe

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello, it's 2023 and we'll see THE İstanbul ΣΑΣ Οδος",
    "a<|endoftext|>b <|startoftext|><|endoftext|>  c<|endoftext",
    "é café ﬁ 가 \U0001f600\U0001f468‍\U0001f469 क्षि ไทย 日本語",
    "x\x1cy\x1dz\x85w\xa0v u　t᠎s​r\x0bq\x0cp",
    "no'sense 'S 'LL d'accord ''' $$$%%%***",
    "aaaaaaaaaab" * 400,
    "thinthethandther" * 3000,
    "́start",
    "x " * 30000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    packed = np.array(ids, "<u4").tobytes()
    words = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(words.encode()).hexdigest()


def test_cases(spark, library):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "again", "x")] * 2, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, VOCABULARY).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        text = "again" if row.doc_id is None else TEXTS[row.doc_id]
        assert tuple(row)[1:] == expected(library, text), (row.doc_id, text and text[:40])


def test_encode_then_decode(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    encoded = bpe.encode(docs, VOCABULARY)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    for row in bpe.decode(encoded, VOCABULARY).collect():
        assert ids[row.doc_id] == library.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids
        assert row.text == library.decode(ids[row.doc_id], skip_special_tokens=False)


def test_long_words_merge_alike():
    coder = bpe.Coder(VOCABULARY)
    word = ("abracadabra" * 40).encode()
    parts = [coder.inner[b] for b in word[:-1]] + [coder.last[word[-1]]]
    assert bpe.merge(list(parts), coder.merges) == bpe.merge_long(list(parts), coder.merges)


def test_no_rows(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark, library):
    from fathomline.llm.queries import op5_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op5_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == expected(library, texts[r.doc_id]) for r in got)
