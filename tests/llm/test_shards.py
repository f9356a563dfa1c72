"""The law of the shards: every row once, nearly equal bytes, gapless slots, groups together."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from fathomline.llm import shards

MADE = random.Random(1)


def check(rows, got, count, slack):
    told = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert told == sorted((str(r.doc_id), r.size, r.text_crc32) for r in got)
    size, slots, kept = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert 0 <= r.shard < count
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        kept[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(size.values()) / count
    assert max(abs(size[k] - fair) for k in range(count)) <= slack, (fair, size)
    # a cut splits one group at most
    assert sum(len(s) - 1 for s in kept.values()) < count


def made(n, hot):
    rows = [(k, "".join(MADE.choice("abcé ") for _ in range(int(MADE.paretovariate(1.2) * 30) % 2000))) for k in range(n)]
    rows += [(n + k, "the same text again and again") for k in range(hot)]
    rows += [(2 * n + hot + k, rows[k][1]) for k in range(n // 4)]
    rows += [(None, "x"), (None, None), (10**9, None), (10**9 + 1, ""), (3, rows[3][1])]
    return rows


def plain(rows, count):
    """(doc_id, size, crc, shard, slot) of rows (doc_id, text, lang, source) by a tree built on one list."""
    def crc(x):
        return zlib.crc32((x or "").encode())

    groups = {}
    for doc, text, lang, source in rows:
        data = (text or "").encode()
        name = xxhash.xxh64_intdigest(data, 42)
        key = (crc(text), name - (1 << 64) if name >> 63 else name, len(data) + 8)
        groups.setdefault(key, []).append((shards.MISSING if doc is None else doc, crc(lang), crc(source)))
    axes = {k: (math.log(k[2]) / 32, k[0] / 2**32, min(g)[1] / 2**32, min(g)[2] / 2**32) for k, g in groups.items()}
    leaf = sum(len(g) * k[2] for k, g in groups.items()) / count
    parts = {}

    def cut(pieces, leaves, lead):
        if leaves == 1:
            for key, done, _ in pieces:
                parts.setdefault(key, []).append((done, lead))
            return
        widths = [max(axes[p[0]][a] for p in pieces) - min(axes[p[0]][a] for p in pieces) for a in range(4)] if pieces else [0]
        axis, low = widths.index(max(widths)), leaves // 2
        at, edge = 0, sum(p[2] for p in pieces) * low // leaves
        left, right = [], []
        for key, done, size in sorted(pieces, key=lambda p: (axes[p[0]][axis], *p[0], p[1])):
            part = min(max(edge - at, 0), size)
            if size <= shards.SNAP * leaf:
                part = size if 2 * part >= size else 0
            else:
                part = min(int(part / key[2] + 0.5) * key[2], size)
            left += [(key, done, part)] if part else []
            right += [(key, done + part, size - part)] if part < size else []
            at += size
        cut(left, low, lead)
        cut(right, leaves - low, lead + low)

    cut([(k, 0, len(g) * k[2]) for k, g in groups.items()], count, 0)
    dealt = {}
    for key, group in groups.items():
        for i, (doc, *_) in enumerate(sorted(group)):
            shard = [lead for done, lead in sorted(parts[key]) if done <= i * key[2]][-1]
            dealt.setdefault(shard, []).append((doc, key[0], key[2]))
    return sorted((d, size, c, shard, slot) for shard, own in dealt.items() for slot, (d, c, size) in enumerate(sorted(own)))


@pytest.mark.parametrize("count, hot", [(24, 0), (7, 900)])
def test_against_a_plain_tree(spark, count, hot):
    rows = [(d, t, "en" if (d or 0) % 3 else None, f"s{(d or 0) % 5}") for d, t in made(400, hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = shards.kd_shards(docs.repartition(5), count).collect()
    assert sorted((shards.MISSING if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == plain(rows, count)


@pytest.mark.parametrize("hot", [0, 4000])
def test_laws(spark, hot):
    rows = made(1500, hot)
    docs = spark.createDataFrame([(d, t, "en" if (d or 0) % 3 else None, f"s{(d or 0) % 5}", 0) for d, t in rows], "doc_id long, text string, lang string, source string, shard int")
    got = shards.kd_shards(docs.repartition(6), 24).collect()
    check(rows, got, 24, 2100)


def test_one_text_fills_all_shards(spark):
    docs = spark.createDataFrame([(k, "abc") for k in range(500)], "doc_id long, text string")
    got = shards.kd_shards(docs, 24).collect()
    counts = Counter(r.shard for r in got)
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 2


def test_few_rows_and_one_shard(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id long, text string")
    assert sorted(r.slot for r in shards.kd_shards(docs, 24).collect()) == [0, 0]
    assert sorted((r.shard, r.slot) for r in shards.kd_shards(docs, 1).collect()) == [(0, 0), (0, 1)]
    assert shards.kd_shards(docs.limit(0), 24).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark):
    from fathomline.llm.queries import op6_shards

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = op6_shards(spark, folder).collect()
    largest = max(len((t or "").encode()) for _, t in rows)
    check(rows, got, 24, largest + 100)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
