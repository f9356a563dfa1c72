"""Decontamination against a comparison of every document with every item, and against the SQL."""

import os
import random

import duckdb
import pytest

from fathomline.llm import decontaminate as dec

MADE = random.Random(3)


def text(n, pool=3000):
    return " ".join(f"W{int(pool * MADE.random() ** 3)}" for _ in range(n))


def brute(docs, items, overlap=0.8):
    out = set()
    for doc, body, *_ in docs:
        words = dec.words_of((body or "").encode())
        joined = f" {' '.join(words)} "
        for item, wanted, *reply in items:
            ok, counts = True, None
            for part in (wanted, *reply):
                parts = dec.words_of((part or "").encode())
                if not parts:
                    ok = ok and counts is not None
                    continue
                runs = {" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}
                held = sum(f" {r} " in joined for r in runs)
                counts = counts or (len(runs), held)
                ok = ok and held >= overlap * len(runs) - 1e-9
            if ok and counts:
                out.add((doc, item, *counts))
    return out


def corpus():
    items = [(k, text(MADE.choice([3, 5, 12, 40, 64, 65, 150, 400]))) for k in range(60)] + [(60, None), (61, "..."), (None, text(30))]
    docs = [(k, text(MADE.choice([0, 4, 60, 130, 700]))) for k in range(60)]
    for k in range(80):
        body = items[MADE.randrange(60)][1].split(" ")
        for _ in range(MADE.randrange(4)):
            body[MADE.randrange(len(body))] = "changed"
        docs.append((100 + k, f"{text(MADE.randrange(200))} {', '.join(body).upper()}! {text(MADE.randrange(200))}"))
    docs += [(900, None), (901, ""), (None, items[-1][1]), (902, items[4][1]), (902, items[4][1])]
    return docs, items


@pytest.mark.parametrize("part, block", [(1 << 17, 32), (300, 1)])
def test_cases(spark, monkeypatch, part, block):
    monkeypatch.setattr(dec, "PART_TERMS", part)
    monkeypatch.setattr(dec, "BLOCK", block)
    docs, items = corpus()
    left = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, item_id int, terms string").repartition(4)
    right = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in dec.contaminated(left, right).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items)


def test_scattered_copies(spark):
    items = [(k, " ".join(f"w{MADE.randrange(400)}" for _ in range(60))) for k in range(20)]
    docs = [(k, t) for k, t in items]
    for k, t in items:
        words = t.split(" ")
        other = [" ".join(f"o{MADE.randrange(10**6)}" for _ in range(200)) for _ in range(2)]
        docs.append((100 + k, " ".join([*words[:20], other[0], *words[20:40], other[1], *words[40:]])))
        docs.append((200 + k, " ".join([*words[:15], other[0], *words[15:30], other[1], *words[30:]])))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in dec.contaminated(left, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)
    assert {(d, i) for d, i, *_ in got} >= {(k, k) for k in range(20)} | {(100 + k, k) for k in range(20)}


def test_passages_add_up(spark, monkeypatch):
    monkeypatch.setattr(dec, "PASSAGE", 16)
    docs, items = corpus()
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in dec.contaminated(left, right).collect()} == brute(docs, items)


def test_many_items_of_one_text_are_indexed_once(spark):
    items = [(k, text(12) if k % 10 == 0 else "one text that five thousand items of the table share") for k in range(5000)]
    texts = dec._texts(spark.createDataFrame(items, "item_id long, text string"))
    parts, count = dec.index_parts(texts, 0.8, dec.Scratch(spark))
    import pickle

    assert count == 1 and len(pickle.loads(parts.first()["index"]).items) == len({t for _, t in items})
    docs = [(1, "here is ONE text that five thousand items of the table share, indeed")]
    got = dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.count() == 4500


def test_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(dec, "PART_TERMS", 100)
    items = [(k, text(30)) for k in range(50)]
    parts, count = dec.index_parts(dec._texts(spark.createDataFrame(items, "item_id long, text string")), 0.8, dec.Scratch(spark))
    import pickle

    rows = parts.collect()
    held = [sum(len(dec.shingles(w.split(" "))) for _, w, _ in pickle.loads(r["index"]).items) for r in rows]
    assert len(rows) > 5 and count >= len(rows) and max(held) < 100 + 30 and sum(held) == sum(len(dec.shingles(dec.words_of(t.encode()))) for _, t in items)


def test_answers_count_too(spark):
    question = text(30)
    items = [(1, question, "the answer is forty two and no more"), (2, question, None), (3, question, "blue")]
    docs = [(1, question), (2, question + " the answer is forty two and no more"), (3, "blue " + question)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string, answer string")
    got = {tuple(r) for r in dec.contaminated(left, right).collect()}
    assert got == brute(docs, items) and {(d, i) for d, i, *_ in got} == {(1, 2), (2, 1), (2, 2), (3, 2), (3, 3)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert dec.contaminated(none, some).count() == 0
    assert dec.contaminated(some.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query_and_sql(spark):
    from fathomline.llm.queries import SQL, op10_decontaminate

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    expected = duck.sql(f"SELECT doc_id, item_id, n_shingles, n_found FROM ({SQL['op10_decontaminate']})").fetchall()
    assert sorted(tuple(r) for r in op10_decontaminate(spark, folder).collect()) == sorted(expected)
    assert expected
