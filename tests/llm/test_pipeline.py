"""The stages against plain versions of each on a small corpus."""

import os
import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fathomline.llm.common import Scratch

from .test_bpe import expected as bpe_expected
from .test_decontaminate import brute as leaks
from .test_lines import brute as cut_lines
from .test_simhash import brute_fingerprint

MADE = random.Random(21)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(n):
    return " ".join("".join(MADE.choice(("ka", "lo", "mi", "ne", "su", "ter", "ing")) for _ in range(MADE.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    items = [(k, prose(40)) for k in range(5)]
    for k in range(240):
        toxic = k % 5 == 0
        text = f"{prose(30)}\n{prose(25)}\n{prose(30) if not toxic else prose(8) + ' you idiot ' + prose(4)}"
        docs.append((k, text))
        labels.append((k, 1, int(toxic)))
    docs += [(300, docs[1][1]), (301, docs[2][1].replace("ka", "mi", 1)), (302, prose(20) + " " + items[2][1].upper() + " " + prose(9))]
    docs += [(303, docs[3][1].split("\n")[0] + "\n" + prose(30)), (304, None), (305, ""), (306, "you 1d10t " + prose(20)), (None, prose(9)), (7, docs[7][1])]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, 'en', 's', ?)", [(i, t, None if t is None else len(t)) for i, t in docs])
    duck.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    duck.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    duck.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    for name in ("documents", "labels", "benchmark"):
        duck.execute(f"COPY {name} TO '{out}/{name}.parquet' (FORMAT parquet)")
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    outs = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        outs.append(scratch.keep(stage(spark, outs[-1] if outs else docs, folder)))
        assert outs[-1].columns == COLUMNS
    before, toxic_gone, cut, single, clean = map(pairs, (docs, *outs))
    assert toxic_gone == [p for p in before if not ("idiot" in (p[1] or "") or "1d10t" in (p[1] or ""))]

    assert dict(cut) == {i: t for i, (_, _, t) in cut_lines([p for p in dict(toxic_gone).items() if p[0] is not None]).items()} | {None: dict(toxic_gone)[None]}
    codes = {i: brute_fingerprint(t, 3) for i, t in cut if i is not None}
    root = {i: i for i in codes}
    for a in sorted(codes):
        for b in sorted(codes):
            if a < b and (codes[a] ^ codes[b]).bit_count() <= 2 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert single == [p for p in cut if p[0] is None or root[p[0]] == p[0]]
    bad = {d for d, *_ in leaks(single, items)}
    assert bad and clean == [p for p in single if p[0] not in bad]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.STAGES[-1][1](spark, outs[-1], folder).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *bpe_expected(library, t))) for i, t in clean)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, got))


def test_columns_of_any_name_come_back(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS _key", "2 AS `a.b`", "3 AS component_id", "4 AS item_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark).keep(stage(spark, docs, folder))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out


def test_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).keep(stage(spark, docs, folder))
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_registered(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and sum(name.startswith("op") for name in found) == 13
    assert found["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
