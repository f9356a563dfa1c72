"""The prefix trie against a plain version, and against SQL."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fathomline.llm import trie

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, n string, depth string"


def plain(rows):
    """Node rows of (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append(c)
        ends.setdefault(tuple(built), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below)
    return sorted(
        (
            min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), len(kids.get(node, [])),
            leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, own_members in members.items()
    )


def run(spark, rows, parts=3, **options):
    data = [(*r, "x", "y") for r in rows]
    found = trie.prefix_trie(spark.createDataFrame(data, SCHEMA).repartition(parts), **options)
    return sorted((tuple(r) for r in found.collect()))


def made(seed, convs=90, vocabulary=3, most=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), convs):
        for turn in range(rng.randint(1, most)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randrange(vocabulary))))
    return rows


@pytest.mark.parametrize("seed, light", [(1, 4096), (2, 3), (3, 1)])
def test_against_a_plain_version(spark, seed, light):
    rows = made(seed)
    assert run(spark, rows, light=light) == plain(rows)


def test_odd_rows(spark):
    rows = made(5, 20)
    rows += [(None, 0, "user", "lost"), (300, None, None, None), (300, None, "user", None), (300, 1, None, "a b"), (301, 5, "user", "same")]
    # repeated rows and turns, ties of a turn with other texts, a conversation that its stem leaves without turns
    rows += [(302, 0, "user", "x y")] * 4 + [(302, 0, "user", "other"), (302, 0, "userx", " y")]
    rows += [(c, 0, "user", "only") for c in range(400, 440)] + [(500, 0, "u", "\x1cé b c\td")]
    assert run(spark, rows) == plain(rows)


def test_copies_and_a_hot_first_turn(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 2000, 20) for t in range(5)]
    rows += [(c, t, "user", "hello there" if t == 0 else f"{c} {t}") for c in range(5000, 5600, 20) for t in range(4)]
    for light in (4096, 10):
        assert run(spark, rows, light=light) == plain(rows)


def test_a_conversation_across_many_ranges(spark):
    rows = [(7, t, "user", f"w {t % 5}") for t in range(900)] + [(8, t, "user", f"w {t % 5}") for t in range(700)]
    rows += [(c, t, "user", "z") for c in (3, 9) for t in range(4)]
    assert run(spark, rows, parts=8, light=1) == plain(rows)


def test_a_chain_of_ever_longer_conversations(spark):
    rows = [(20 * c, t, "user", f"t{t}") for c in range(40) for t in range(c + 1)]
    for light in (4096, 2):
        assert run(spark, rows, light=light) == plain(rows)


def test_shared_digests_are_found_and_made_anew(spark, monkeypatch):
    good = trie.bases
    monkeypatch.setattr(trie, "bases", lambda seed: [1, 1, 1, 1] if seed == 0 else good(seed))
    # with base 1 the order of turns does not count
    rows = [(20, 0, "u", "a"), (20, 1, "u", "b"), (40, 0, "u", "b"), (40, 1, "u", "a")] + made(4, 30)
    assert run(spark, rows) == plain(rows)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 62, (5000, 3)), axis=0)
    slots = trie.Slots(keys)
    assert sorted(slots.of(keys)) == list(range(len(keys)))
    other = rng.integers(0, 1 << 62, (5000, 3))
    assert (slots.of(other) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.ones((2, 3), np.int64))


def test_long_digest_texts_come_in_pieces(spark):
    rows = [(g, 0, 0, c) for g, n in ((1, 3000), (2, 1), (3, 17)) for c in range(n)]
    pairs = spark.createDataFrame(rows, "depth long, a long, b long, conv_id long").repartition(5)
    found = trie.joined_digests(pairs, trie.NODE, "conv_id", trie.Scratch(spark), size=50).collect()
    want = {g: hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest() for g, n in ((1, 3000), (2, 1), (3, 17))}
    assert {r.depth: r.ends_sha256 for r in found} == want


def test_no_rows(spark):
    assert run(spark, [], parts=1) == []
    assert run(spark, [(None, 0, "user", "a")], parts=1) == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_query_against_sql_and_plain(spark):
    from fathomline.llm.queries import SQL, op12_trie

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    relation = duck.sql(SQL["op12_trie"])
    got = op12_trie(spark, FOLDER)
    assert relation.columns == got.columns
    got = sorted(map(tuple, got.collect()))
    assert sorted(relation.fetchall()) == got
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    assert got == plain(rows)
