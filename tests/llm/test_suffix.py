"""Repeat removal against a dictionary of all windows."""

import hashlib
import os
import random

import numpy as np
import pytest

from fathomline.llm import suffix

MADE = random.Random(7)


def brute(texts, length=100):
    """doc -> (bytes, removed, spans, digest); texts in order of their id."""
    seen, out = set(), {}
    for doc, text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def measured(rows):
    kept = {r.doc_id: r for r in rows}
    return {
        d: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for d, r in kept.items()
    }


def words(n, pool=400):
    return " ".join(f"w{MADE.randrange(pool)}é"[: MADE.randrange(2, 7)] for _ in range(n))


def corpus():
    shared = words(60)
    texts = [None, "", "short", "a" * 3000, "ab" * 900, shared, shared[:120] + "X" + shared[120:], shared * 3]
    texts += ["\x00" * 250, "\x00" * 100 + "z", "x" * 99, "y" * 100, "y" * 100]
    base = words(900)
    texts += [base, base[:1000] + "!" + base[1000:], base[500:2500], words(30) + base[300:420] + words(30)]
    texts += [words(20) + shared[MADE.randrange(50) : MADE.randrange(150, 220)] + words(20) for _ in range(40)]
    texts += [MADE.choice("pqr") * MADE.randrange(90, 130) + MADE.choice("pqr") * MADE.randrange(90, 130) for _ in range(30)]
    return list(enumerate(texts))


def test_cases(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in texts], "doc_id long, text string, first int, marks string").repartition(5)
    assert measured(suffix.remove_repeats(docs).collect()) == brute(texts)


@pytest.mark.parametrize("change", [{"HOT": 2}, {"PIECE": 300}, {"TEXTS": 500}])
def test_small_bounds_change_nothing(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(suffix, name, value)
    texts = corpus()
    batches = lambda: iter([batch_of(texts)])
    import pyarrow as pa

    def batch_of(rows):
        return pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [(t or "").encode() for _, t in rows]})

    pieces = list(suffix._pieces(batches(), 100))
    windows = sum(max(len((t or "").encode()) - 99, 0) for _, t in texts)
    found = [suffix.anchors(data, ends) for _, _, data, ends in pieces]
    assert sum(int((last - first + 1).sum()) for _, first, last, _, _ in found) == windows
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert measured(suffix.remove_repeats(docs).collect()) == brute(texts)


def test_repeated_rows_and_missing_ids(spark):
    text = words(80)
    rows = [(5, text), (5, text), (7, text), (None, text)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((r.doc_id if r.doc_id is not None else -1, len(r.kept)) for r in got)
    assert left == [(-1, len(text.encode())), (5, 0), (5, 0), (7, 0)]


def test_rows_that_share_an_id_but_not_the_text(spark):
    shared = words(60)
    texts = [(None, words(70) + shared), (None, shared + words(90)), (None, words(120)), (4, words(80)), (4, words(30) + shared), (4, words(90))]
    rows = texts + [texts[1], (2, "short"), (None, None)]
    got = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]

    def kept(order):
        known = brute([(k, texts[i][1]) for k, i in enumerate(order)])
        return {i: known[k][3] for k, i in enumerate(order)}

    ways = []
    for order in ([0, 1, 2, 3, 4, 5], [1, 0, 2, 3, 4, 5]):
        digests = kept(order)
        own = [(texts[i][0], len(texts[i][1].encode()), digests[i]) for i in [*range(6), 1]]
        own += [(2, 5, hashlib.sha256(b"short").hexdigest()), (None, 0, hashlib.sha256(b"").hexdigest())]
        ways.append(sorted(own, key=str))
    # which of the texts without id comes first is a matter of their hashes
    assert sorted(((i, n, hashlib.sha256(k).hexdigest()) for i, n, k in got), key=str) in ways


def test_no_rows(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_orders_suffixes():
    for size in (1, 2, 7, 300):
        for letters in (1, 2, 4, 256):
            text = np.random.default_rng(size + letters).integers(1, letters + 1, size).astype(np.uint8)
            order = suffix.suffix_array(text, depth=size + 8)
            assert sorted(range(size), key=lambda i: bytes(text[i:])) == order.tolist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    from fathomline.llm.queries import op4_suffix

    folder = "/root/testdata/sf0.001"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = {r.doc_id: tuple(r)[1:] for r in op4_suffix(spark, folder).collect()}
    assert got == brute(texts)


def test_windows_that_are_alone_are_not_sorted(monkeypatch):
    sizes = []
    sort = np.lexsort
    monkeypatch.setattr(suffix.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    parts = [b"abcdefghij", b"klmnopqrst", b"ABCabcdeXY"]
    part, offset = suffix.repeated_windows(parts, np.arange(3), np.zeros(3, np.int64), np.full(3, 6), 5)
    assert (part.tolist(), offset.tolist()) == ([2], [3])
    assert sizes[-1] == 2
