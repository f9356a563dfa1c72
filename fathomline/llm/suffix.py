"""Removal of repeated 100-byte strings by two-stage suffix sorting.

A suffix array over all bytes would have to move every suffix with a hundred bytes of
context, far more than the corpus. So the positions are first put into groups that hold all
equal strings: every 100-byte window picks its least hashed ``SEED_BYTES``-gram (its anchor),
equal windows pick the same one, and neighbouring windows mostly share theirs. Windows
of anchors that occur once are done. What is left is sorted, many groups per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, as_bytes, rows_of, with_document_key

LENGTH = 100
SEED_BYTES = 20
PIECE = 1 << 20
TEXTS = 1 << 20
HOT = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < size:
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.r_[np.uint64(1), np.full(size - 1, BASE)].cumprod(dtype=np.uint64)
            _inverse = np.r_[np.uint64(1), np.full(size - 1, back)].cumprod(dtype=np.uint64)
    return _powers, _inverse


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= BASE
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Polynomial hashes of any stretch of a byte array, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        powers, self.inverse = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        # bytes are spread over 64 bits first, so that no short pattern cancels out
        spread = _mixed(np.arange(1, 257, dtype=np.uint64))
        np.cumsum(spread[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[: len(self.sums)][start])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of all windows that lie within one of the texts joined in ``data``.

    Returns (position, first window, last window, hash of the anchor, hash of all that its
    windows cover); ``bounds`` holds the text ends. Each window belongs to exactly one anchor.
    """
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return empty
    hashes = Hashes(data)
    seed = min(SEED_BYTES, length)
    n = len(data) - length + 1
    grams = hashes.of(slice(0, len(data) - seed + 1), slice(seed, len(data) + 1))
    span = length - seed + 1
    # the least of each run of ``span`` grams by doubling
    least, width = grams, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    valid = np.zeros(n + 1, np.int64)
    starts = np.r_[0, bounds[:-1]]
    whole = bounds - starts >= length
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, bounds[whole] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    place = _leftmost(grams, least, n, span)
    change = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]), True])
    first, last = change[:-1], change[1:] - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    position = place[first]
    covers = hashes.of(first, last + length)
    shape = (position - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    return position, first, last, grams[position], _mixed(covers ^ shape * MIX)


def _leftmost(grams: np.ndarray, least: np.ndarray, n: int, span: int) -> np.ndarray:
    """For each window the first place among its grams that holds the least value."""
    found = _is_least(grams, least, n, span)
    at = np.flatnonzero(found)
    # the next such place at or after the window start whose value is the window's least
    number = _before(found)[:n]
    values = grams[at]
    wrong = np.flatnonzero(values[number] != least)
    while len(wrong):
        number[wrong] += 1
        wrong = wrong[values[number[wrong]] != least[wrong]]
    return at[number]


def _before(marked: np.ndarray) -> np.ndarray:
    """How many places before each one are marked."""
    return np.cumsum(marked) - marked


def _is_least(grams: np.ndarray, least: np.ndarray, n: int, span: int) -> np.ndarray:
    """Places whose gram is the least one of some window that covers them."""
    most = np.full(len(grams) + span - 1, 0, np.uint64)
    most[span - 1 : span - 1 + n] = least
    width = 1
    while width * 2 <= span:
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    tail = len(grams)
    greatest = np.maximum(most[:tail], most[span - width : span - width + tail])
    return greatest >= grams


def type_b(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    n = len(text)
    unlike = np.r_[text[:-1] != text[1:], False]
    differs = np.flatnonzero(unlike)
    following = _before(unlike)
    found = following < len(differs)
    at = differs[np.minimum(following, len(differs) - 1)] if len(differs) else np.zeros(n, np.int64)
    return found & (text[np.minimum(at, n - 1)] < text[np.minimum(at + 1, n - 1)])


def _words(text: np.ndarray) -> np.ndarray:
    """The eight symbols from each position as one big-endian number, zeros beyond the end."""
    out = np.r_[text.astype(np.uint64), np.zeros(8, np.uint64)]
    for k in (1, 2, 4):
        out = out[:-k] << np.uint64(8 * k) | out[k:]
    return out


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of a byte array in the order of their first ``depth`` bytes (two-stage sorting).

    Stage one sorts only the suffixes that are smaller than their successors. Stage two takes
    the buckets in order of their first byte: each finished bucket, scanned in order, gives the
    order of the preceding suffixes that are greater than their successors, which come before
    the directly sorted ones in their own buckets. Ties beyond ``depth`` are left in any order.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    direct = type_b(text)
    words = _words(text)
    chosen = np.flatnonzero(direct)
    chosen = chosen[np.argsort(words[chosen], kind="stable")]
    # refine runs of equal words eight bytes at a time
    equal = np.r_[False, words[chosen[1:]] == words[chosen[:-1]]] if len(chosen) else np.zeros(0, bool)
    done = 8
    rank = np.cumsum(~equal)
    while done < depth and equal.any():
        busy = np.flatnonzero(equal | np.r_[equal[1:], False])
        key = words[np.minimum(chosen[busy] + done, n)]
        sort = np.lexsort((key, rank[busy]))
        chosen[busy] = chosen[busy][sort]
        key, group = key[sort], rank[busy]
        same = np.r_[False, (key[1:] == key[:-1]) & (group[1:] == group[:-1])]
        equal = np.zeros(len(chosen), bool)
        equal[busy] = same
        rank = np.cumsum(~equal)
        done += 8

    byte_of = text[chosen]
    cuts = np.searchsorted(byte_of, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(bucket: np.ndarray, byte: int) -> np.ndarray:
        """Give the preceding greater suffixes to their buckets; those of this bucket come back."""
        before = bucket - 1
        before = before[before >= 0]
        before = before[~direct[before]]
        kinds = text[before]
        sort = np.argsort(kinds, kind="stable")
        before, kinds = before[sort], kinds[sort]
        values, heads = np.unique(kinds, return_index=True)
        own = before[:0]
        for value, part in zip(values.tolist(), np.split(before, heads[1:])):
            if value == byte:
                own = part
            else:
                pending[value].append(part)
        return own

    parts = []
    for byte in range(256):
        # the suffix of one byte is the least of its bucket
        grown = [np.array([n - 1])] if text[n - 1] == byte else []
        wave = np.concatenate([*grown, *pending[byte]]) if grown or pending[byte] else np.zeros(0, np.int64)
        while len(wave):
            parts.append(wave)
            wave = hand_on(wave, byte)
        bucket = chosen[cuts[byte] : cuts[byte + 1]]
        if len(bucket):
            parts.append(bucket)
            hand_on(bucket, byte)
    return np.concatenate(parts)


def shared_prefix(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each suffix in the order shares its first ``length`` bytes with the one before.

    The end of the text counts as zero bytes, as in sorting.
    """
    n = len(text)
    words = _words(text)
    same = np.zeros(len(order), bool)
    left, right = order[:-1], order[1:]
    alive = np.arange(max(len(order) - 1, 0))
    for at in range(0, length, 8):
        beyond = np.uint64(8 * max(at + 8 - length, 0))
        alive = alive[words[np.minimum(left[alive] + at, n)] >> beyond == words[np.minimum(right[alive] + at, n)] >> beyond]
    same[alive + 1] = True
    return same


def repeated_windows(parts: list[bytes], owner: np.ndarray, start: np.ndarray, count: np.ndarray, length: int = LENGTH):
    """Windows of the parts that also occur earlier: index of the part and offset in it.

    Part k comes from document ``owner[k]`` at ``start[k]`` and holds ``count[k]`` windows, from its
    first byte on. "Earlier" goes by owner, then place; the same place given twice is no repeat.
    """
    text = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    heads = np.r_[0, ends[:-1]]
    order = suffix_array(text, length)
    part = np.repeat(np.arange(len(parts)), np.diff(np.r_[0, ends]))
    offset = np.arange(len(text)) - heads[part]
    same = shared_prefix(text, order, length)
    # a place counts if it starts a window of its part; the others carry the chain of equal prefixes
    group = np.cumsum(~same)
    whole = offset[order] < count[part[order]]
    order, group = order[whole], group[whole]
    # a window that is alone in its group is no repeat and need not be sorted
    several = np.bincount(group)[group] > 1
    order, group = order[several], group[several]
    who, where = owner[part[order]], start[part[order]] + offset[order]
    sort = np.lexsort((where, who, group))
    order, group, who, where = order[sort], group[sort], who[sort], where[sort]
    head = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    lead = np.repeat(first, np.diff(np.r_[first, len(group)]))
    later = (who != who[lead]) | (where != where[lead])
    return part[order[later]], offset[order[later]]


def _intervals(owner: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one owner: (owner, first, last)."""
    sort = np.lexsort((window, owner))
    owner, window = owner[sort], window[sort]
    if not len(owner):
        return owner, window, window
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (window[1:] > window[:-1] + 1)]
    head = np.flatnonzero(fresh)
    return owner[head], window[head], window[np.r_[head[1:], len(owner)] - 1]


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to about ``PIECE`` bytes: (ids, offset of each in its text, data, ends).

    A longer text is cut into pieces that overlap by a window less one byte.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        ends = np.cumsum([len(p) for _, _, p in held])
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        return np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held]), data, ends

    for ids, texts in rows_of(batches):
        for doc, text in zip(ids, texts):
            for at in range(0, max(len(text) - length + 1, 0), PIECE):
                piece = text[at : at + PIECE + length - 1]
                if size and size + len(piece) > PIECE + length:
                    yield out()
                    held, size = [], 0
                held.append((doc, at, piece))
                size += len(piece)
    if size:
        yield out()


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


MARKS = "doc_id long, first long, last long"


def find_anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Anchors of (doc_id, text): (seed, cover, doc_id, first, last, told).

    Within a piece of the input, windows that repeat an equal stretch are told at once; they
    come united, without cover and under a hash of their place. So of a passage that very many
    texts share, each piece hands on one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seed", "cover", "doc_id", "first", "last", "told"]
        for ids, offsets, data, ends in _pieces(batches, length):
            _, first, last, seed, cover = anchors(data, ends, length)
            which = np.searchsorted(ends, first, side="right")
            shift = offsets[which] - np.r_[0, ends[:-1]][which]
            doc, first, last = ids[which], first + shift, last + shift
            sort = np.lexsort((first, doc, cover, seed))
            again = np.r_[False, (seed[sort][1:] == seed[sort][:-1]) & (cover[sort][1:] == cover[sort][:-1])]
            lead = sort[np.maximum.accumulate(np.where(again, 0, np.arange(len(sort))))]
            # the same place of the same document is no repeat
            other = (doc[sort] != doc[lead]) | (first[sort] != first[lead])
            kept, told = sort[~again], sort[again & other]
            flag = pa.array(np.zeros(len(kept), bool))
            yield _batch(names, seed[kept].view(np.int64), cover[kept].view(np.int64), doc[kept], first[kept], last[kept], flag)
            who, low, high = _runs(doc[told], first[told], last[told])
            spread = _mixed(who.view(np.uint64) * MIX + low.view(np.uint64)).view(np.int64)
            none, flag = pa.nulls(len(who), pa.int64()), pa.array(np.ones(len(who), bool))
            yield _batch(names, spread, none, who, low, high, flag)

    return docs.mapInArrow(run, "seed long, cover long, doc_id long, first long, last long, told boolean")


def _runs(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unite adjoining or overlapping stretches of windows of one owner."""
    if not len(owner):
        return owner, first, last
    sort = np.lexsort((first, owner))
    owner, first, last = owner[sort], first[sort], last[sort]
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (first[1:] > last[:-1] + 1)])
    return owner[head], first[head], np.maximum.reduceat(last, head)


def _stretches(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of wanted anchors cover: (seed, doc_id, first, count, bytes).

    Of a seed with over ``HOT`` different stretches each window comes alone, keyed by its own hash,
    so that only equal windows meet and no task has to hold them all.
    """
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "first", "last", "hot")).alias("anchors"))
    joined = docs.join(lists.hint("shuffle_hash"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seed", "doc_id", "first", "count", "bytes"]
        for ids, texts, found in rows_of(batches, 1 << 21):
            seeds, docs_, firsts, counts, parts = [], [], [], [], []
            seen: dict[bytes, tuple[int, int]] = {}
            told: list[tuple[int, int]] = []
            for doc, text, own in sorted(zip(ids, texts, found), key=lambda r: r[0]):
                for a in sorted(own, key=lambda a: a["first"]):
                    if not a["hot"]:
                        seeds.append(a["seed"])
                        firsts.append(a["first"])
                        counts.append(a["last"] - a["first"] + 1)
                        parts.append(text[a["first"] : a["last"] + length])
                        docs_.append(doc)
                        continue
                    for at in range(a["first"], a["last"] + 1):
                        window = text[at : at + length]
                        # a window met before in this piece is told at once
                        if seen.setdefault(window, (doc, at)) != (doc, at):
                            told.append((doc, at))
                            continue
                        seeds.append(int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True))
                        firsts.append(at)
                        counts.append(1)
                        parts.append(window)
                        docs_.append(doc)
            for doc, at in told:
                seeds.append(None)
                docs_.append(doc)
                firsts.append(at)
                counts.append(1)
                parts.append(None)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            columns = (seeds, docs_, firsts, counts, parts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    picked = joined.select("doc_id", "text", "anchors")
    return picked.mapInArrow(run, "seed long, doc_id long, first long, count long, bytes binary")


def _sorted_out(stretches: DataFrame, length: int) -> DataFrame:
    """Windows that the suffix order shows to occur earlier in their group, as (doc_id, first, last)."""
    parts = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stretches.repartition(parts, "seed").sortWithinPartitions("seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def search(rows):
            texts = [r[4] for r in rows]
            owner, start, count = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            part, offset = repeated_windows(texts, owner, start, count, length)
            return _batch(["doc_id", "first", "last"], *_intervals(owner[part], start[part] + offset))

        for columns in rows_of(batches):
            for row in zip(*columns):
                # groups go together; a task holds about TEXTS bytes or one group
                if size >= TEXTS and row[0] != held[-1][0]:
                    yield search(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield search(held)

    return dealt.mapInArrow(run, MARKS)


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """Windows of (doc_id, text as bytes) that start earlier elsewhere: (doc_id, first, last) window starts."""
    by_seed = W.partitionBy("seed")
    placed = (
        find_anchors(docs, length)
        .repartition("seed")
        .withColumn("place", F.rank().over(W.partitionBy("seed", "cover").orderBy("doc_id", "first")))
        .withColumn("least", F.min("cover").over(by_seed))
        .withColumn("most", F.max("cover").over(by_seed))
        .withColumn("kinds", F.sum(F.when(F.col("place") == 1, 1)).over(by_seed))
        .filter("told OR place > 1 OR least != most")
        .withColumn("told", F.expr("told OR place > 1"))
    )
    placed = scratch.keep(placed.select("seed", "doc_id", "first", "last", "told", (F.col("kinds") > HOT).alias("hot")))
    scratch.release()
    stretches = scratch.keep(_stretches(docs, placed.filter("NOT told"), length))
    again = stretches.filter("seed IS NULL").select("doc_id", "first", F.col("first").alias("last"))
    sorted_out = scratch.keep(_sorted_out(stretches.filter("seed IS NOT NULL"), length))
    scratch.release()
    return placed.filter("told").select("doc_id", "first", "last").unionAll(again).unionAll(sorted_out)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Cut every byte that a ``length``-byte string covers which also starts earlier.

    ``docs`` has (doc_id, text); texts are taken as UTF-8 bytes, "earlier" means in a smaller doc_id
    or before in the same document, and all strings are judged on the input. Returns (doc_id,
    n_bytes, spans, kept): the removed runs as structs (first, end) and what is left, as bytes.

    A missing text counts as empty; texts shorter than ``length`` stay whole; a missing doc_id is
    the smallest; rows of equal doc_id and text are one document and each comes back with the same
    result; rows without doc_id or of one doc_id that differ in text are documents of their own, in
    the order of a hash of the text; further columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = with_document_key(docs, scratch)
    source = keyed.select(F.col("_key").alias("doc_id"), F.col("doc_id").cast("long").alias("id"), as_bytes().alias("text"))
    marks = repeats(source.select("doc_id", "text"), scratch, length)
    lists = marks.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    joined = source.join(lists.hint("shuffle_hash"), "doc_id", "left").select("id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in rows_of(batches):
            spans, kept = [], []
            for text, own in zip(texts, found):
                runs = _cover(own, length)
                spans.append([{"first": a, "end": b} for a, b in runs])
                at, left = 0, []
                for a, b in runs:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                kept.append(b"".join(left))
            pair = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64())]
            columns += [pa.array(spans, pair), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<first: long, end: long>>, kept binary")


def _cover(marks: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the marked windows."""
    runs: list[list[int]] = []
    for first, last in sorted((m["first"], m["last"]) for m in marks or ()):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + length)
        else:
            runs.append([first, last + length])
    return [(a, b) for a, b in runs]
