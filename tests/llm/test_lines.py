"""Line removal against a comparison of all pairs of lines, and against the SQL."""

import os

import duckdb
import pytest

from fathomline.llm import lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def brute(rows, near_from=20):
    rows = sorted(rows)
    firsts = {}
    for doc, text in rows:
        for k, line in enumerate([] if text is None else text.split("\n")):
            if line.strip(" \t\r"):
                firsts.setdefault(line, (doc, k))
    gone = {
        line
        for line, pos in firsts.items()
        for other, before in firsts.items()
        if before < pos and max(len(line), len(other)) >= near_from and within_one(line, other)
    }
    out = {}
    for doc, text in rows:
        if text is None:
            out[doc] = (0, 0, None)
            continue
        parts = text.split("\n")
        kept = [x for k, x in enumerate(parts) if not x.strip(" \t\r") or (firsts[x] == (doc, k) and x not in gone)]
        out[doc] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


LONG = "".join(chr(97 + (k * k // 7) % 26) for k in range(5000))
BASE = "the quick brown fox jumps over the lazy dog"
TEXTS = [
    BASE + "\n\n  \nabc\nabd\n" + LONG,
    BASE.replace("quick", "quack") + "\nabc\n\n" + LONG[:2500] + "Z" + LONG[2501:],
    BASE[:-1] + "\n" + BASE + "s\n" + LONG[:10] + LONG[11:],
    None,
    "",
    "\n\n",
    BASE + "\r\n" + BASE + "\n" + BASE,
    "aaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaab",
    "é" * 19 + "è\n" + "é" * 20 + "\n" + "é" * 19,
    "X" + LONG + "\n" + LONG + "X\n" + LONG[:4999],
    "0123456789012345678\n01234567890123456789\n012345678901234567890",
    "\n".join(f"Page {k} of the great book of numbers" for k in range(40)),
    "abc\nxyz",
]


def test_cases(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 0, "g") for i, t in rows], "doc_id long, text string, n_lines int, _gone string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.remove_lines(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("near_from", [1, 2])
def test_short_lines_are_compared_too_if_asked(spark, near_from):
    rows = list(enumerate(TEXTS)) + [(90, "a\nb\nab\nabc\n\nx"), (91, "ab\nabcd\nb\nzz\nz\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.remove_lines(docs, near_from).collect()}
    assert got == brute(rows, near_from)


def test_columns_of_any_name_come_back(spark):
    names = ["doc_id", "text", "_key", "_tag", "_gone", "_lines", "a.b", "row", "h1"]
    rows = [(k, t, 1, "t", [2], "l", k, "r", 0.5) for k, t in enumerate(TEXTS[:4])] + [(0, BASE, 1, "t", [2], "l", 0, "r", 0.5)]
    kinds = ["long", "string", "int", "string", "array<int>", "string", "long", "string", "double"]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    found = lines.remove_lines(docs)
    assert found.columns == [*names, "n_lines", "n_removed"] and found.dtypes[:9] == docs.dtypes
    assert sorted(tuple(r)[2:9] for r in found.collect()) == sorted(r[2:] for r in rows)


def test_repeated_rows_missing_ids_and_counts(spark):
    rows = [(5, BASE, 1), (5, BASE, 1), (None, BASE, 2), (7, BASE + "\nnew", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(str, (tuple(r) for r in lines.remove_lines(docs).collect())))
    assert got == sorted(map(str, [(5, "", 0, 1, 1)] * 2 + [(None, BASE, 2, 1, 0), (7, "new", 3, 2, 1)]))


def test_rows_that_share_an_id_but_not_the_text(spark):
    own = [f"{k} {BASE[k:]} of a line that stands once {k * 7919}" for k in range(8)]
    rows = [(None, f"{own[0]}\n{BASE}\n{own[1]}"), (None, f"{own[2]}\n{own[3]}\n{own[4]}"), (None, f"{BASE}\n{own[5]}"), (None, None)]
    rows += [(9, f"{BASE}\n{own[6]}"), (9, f"{own[7]}\nabc"), (9, f"{own[7]}\nabc"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.remove_lines(docs).collect()), key=str)
    whole = lambda first, second: [
        (None, f"{own[0]}\n{BASE}\n{own[1]}" if first else f"{own[0]}\n{own[1]}", 3, 0 if first else 1),
        (None, f"{own[2]}\n{own[3]}\n{own[4]}", 3, 0),
        (None, f"{BASE}\n{own[5]}" if second else own[5], 2, 0 if second else 1),
        (None, None, 0, 0),
        (9, own[6], 2, 1),
        *[(9, f"{own[7]}\nabc", 2, 0)] * 2,
        (3, "short", 1, 0),
    ]
    # which of the two texts without id comes first is a matter of their hashes
    assert got in [sorted(whole(*x), key=str) for x in ((True, False), (False, True))]


def test_no_rows(spark):
    assert lines.remove_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = lines.remove_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query_and_sql(spark):
    from fathomline.llm.queries import SQL, op8_lines

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = duck.sql(f"SELECT doc_id, n_lines, n_removed, text FROM ({SQL['op8_lines']})").fetchall()
    got = [tuple(r) for r in op8_lines(spark, folder).collect()]
    assert sorted(got) == sorted(expected)
    texts = [(d, t) for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()]
    assert {r[0]: r[1:] for r in got} == brute(texts)
