"""Prefix trie of conversations: node counts through minimal-perfect-hash tables of flat arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
# Four primes just below 2^31; a prefix digest is four remainders, 62 bits a pair.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
HEAD = 3
LIGHT = 4096
CHUNK = 1 << 16
NODE = ["depth", "a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo a prime below 2^31, elementwise."""
    out = np.ones(len(exponents), np.uint64)
    left, square = exponents.astype(np.uint64), base % prime
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * np.uint64(square) % np.uint64(prime)
        square = square * square % prime
        left >>= np.uint64(1)
    return out


def bases(seed: int) -> list[int]:
    """One base per prime, another choice for each seed."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "big") % (p - 3) + 2 for i, p in enumerate(PRIMES)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, w) per row: 120 bits of the hash of role and text, and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)

    def bits(at: int) -> Column:
        return F.conv(F.substring(whole, at, 15), 16, 10).cast("long")

    known = conversations.filter(F.col("conv_id").isNotNull())
    return known.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        bits(1).alias("t1"),
        bits(17).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"),
    )


def _running(values: np.ndarray, run: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin again with each run."""
    total = np.cumsum(values)
    return total - (total[first] - values[first])[run]


DIGESTS = [f"d{i}" for i in range(len(PRIMES))]
BEFORE = [f"e{i}" for i in range(len(PRIMES))]
COUNTED = "conv_id long, t1 long, t2 long, w long, part int, pos long, cum long, " + ", ".join(f"{d} long" for d in DIGESTS + BEFORE)


def numbered(turns: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """Turns with ``pos`` in their conversation, words ``cum`` and digests ``d0`` to ``d3`` so far, ``e0`` to ``e3`` before.

    Ordered by turn, missing ones first, then by hash. A digest is a sum of hashes times powers of a base, so
    ranges of the sorted rows are summed on their own, and one row per range gives the next ones their
    starts: no task holds more than a range, however long a conversation is.
    """
    base = bases(seed)
    ties = turns.withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "t1", "t2", "tie"]
    ranged = ties.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "turn").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, [0] * (2 + len(PRIMES))
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, t1, t2, w = (batch.column(c).to_numpy() for c in ("conv_id", "t1", "t2", "w"))
            new = np.r_[True, conv[1:] != conv[:-1]]
            runs, first = np.cumsum(new) - 1, np.flatnonzero(new)
            goes_on = (runs == 0) & (conv[0] == last)
            pos = _running(np.ones(len(conv), np.int64), runs, first) + goes_on * held[0]
            columns, before = [pos, _running(w, runs, first) + goes_on * held[1]], []
            for i, prime in enumerate(PRIMES):
                turn = (t1 if i % 2 else t2).astype(np.uint64) % np.uint64(prime)
                term = (turn * powers(base[i], pos, prime) % np.uint64(prime)).astype(np.int64)
                columns.append((_running(term, runs, first) + goes_on * held[2 + i]) % prime)
                before.append((columns[-1] - term) % prime)
            last, held = conv[-1], [int(c[-1]) for c in columns]
            for name, column in zip(["pos", "cum", *DIGESTS, *BEFORE], columns + before):
                batch = batch.append_column(name, pa.array(column, pa.int64()))
            yield batch

    counted = scratch.keep(ranged.mapInArrow(run, COUNTED))
    end = F.max(F.struct("conv_id", "pos", "cum", *DIGESTS)).alias("end")
    ends = counted.groupBy("part").agg(F.min("conv_id").alias("first"), end)
    starts, before = [], None
    # one row per range
    for row in ends.orderBy("part").collect():
        now = list(row["end"])
        if before and row["first"] == before[0]:
            grown = [pow(b, before[1], p) for b, p in zip(base, PRIMES)]
            starts.append((row["part"], *before, *grown))
            if now[0] == before[0]:
                sums = [(x + g * d) % p for x, g, d, p in zip(before[3:], grown, now[3:], PRIMES)]
                now = [now[0], now[1] + before[1], now[2] + before[2], *sums]
        before = now
    if not starts:
        return counted.drop("part")
    names = ["conv_id", "p", "c", *[f"s{i}" for i in range(len(PRIMES))], *[f"g{i}" for i in range(len(PRIMES))]]
    known = turns.sparkSession.createDataFrame(starts, "part int, " + ", ".join(f"{n} long" for n in names))
    joined = counted.join(F.broadcast(known), ["part", "conv_id"], "left")
    added = [
        F.when(F.col("p").isNull(), F.col(d)).otherwise((F.col(f"s{i}") + F.col(f"g{i}") * F.col(d)) % prime).alias(d)
        for names in (DIGESTS, BEFORE)
        for i, (d, prime) in enumerate(zip(names, PRIMES))
    ]
    none = F.lit(0)
    return joined.select("conv_id", "t1", "t2", "w", (F.col("pos") + F.coalesce("p", none)).alias("pos"), (F.col("cum") + F.coalesce("c", none)).alias("cum"), *added)


def _packed(digests: list[Column], names: tuple[str, str]) -> list[Column]:
    return [
        (F.shiftleft(digests[2 * i], 31).bitwiseOR(digests[2 * i + 1])).alias(name) for i, name in enumerate(names)
    ]


def paths(turns: DataFrame, seed: int, scratch: Scratch, stem: int = 20, most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and (conv_id, size) of all of them.

    A row has its conversation, depth, digest (a, b) of the turns up to it and (pa, pb) of those before,
    its own hash, its words and those so far. The first turns are put in front in closed form:
    digests of a shifted sequence follow from those of the original one.
    """
    base = bases(seed)
    turns = scratch.keep(numbered(turns, seed, scratch))
    fields = ["t1", "t2", "w", "cum", *DIGESTS]
    at = [F.max(F.when(F.col("pos") == i, F.col(f))).alias(f"{f}_{i}") for i in range(1, most + 1) for f in fields]
    each = scratch.keep(turns.groupBy("conv_id").agg(F.max("pos").alias("own"), *at))
    stems = each.select(F.col("conv_id").alias("stem"), F.col("own").alias("stem_size"), *[F.col(f"{f}_{i}").alias(f"{f}_b{i}") for i in range(1, most + 1) for f in fields])
    named = each.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % (most + 1)).withColumn("stem", F.col("conv_id") - F.col("conv_id") % stem)
    whole = named.join(stems, "stem", "left").withColumn("front", F.least("h", F.coalesce("stem_size", F.lit(0))))
    whole = whole.withColumn("size", F.col("front") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))

    def pick(number: str, names: str) -> Column:
        """The field at a position from 1 to ``most``; nothing before the first turn."""
        found = F.lit(0).cast("long")
        for i in range(1, most + 1):
            found = F.when(F.col(number) == i, F.coalesce(F.col(names.format(i)), F.lit(0))).otherwise(found)
        return found

    shift, add = [], []
    for i, (d, prime) in enumerate(zip(DIGESTS, PRIMES)):
        back = pow(base[i], -1, prime)
        steps = F.array(*[F.lit(pow(back, n, prime)) for n in range(most + 1)])
        step = F.element_at(steps, (F.col("h") - F.col("front") + 1).cast("int"))
        shift.append(step.alias(f"m{i}"))
        add.append(F.pmod(pick("front", d + "_b{}") - pick("h", d + "_{}") * step % prime, F.lit(prime)).alias(f"o{i}"))
    words = (pick("front", "cum_b{}") - pick("h", "cum_{}")).alias("more")
    info = whole.select("conv_id", "h", "front", "size", words, *shift, *add)
    later = turns.join(info, "conv_id").filter("pos > h")
    now, past = ([(F.col(f"o{i}") + F.col(d) * F.col(f"m{i}")) % p for i, (d, p) in enumerate(zip(names, PRIMES))] for names in (DIGESTS, BEFORE))
    depth, cum = (F.col("pos") - F.col("h") + F.col("front")).alias("depth"), (F.col("cum") + F.col("more")).alias("cum")
    after = later.select("conv_id", depth, "t1", "t2", "w", cum, "size", *_packed(now, ("a", "b")), *_packed(past, ("pa", "pb")))
    zero = F.lit(0).cast("long")
    fronts = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("depth"),
                *[F.col(f"{f}_b{i}").alias(f) for f in ("t1", "t2", "w", "cum")],
                *_packed([F.col(f"{d}_b{i}") for d in DIGESTS], ("a", "b")),
                *_packed([F.col(f"{d}_b{i - 1}") if i > 1 else zero for d in DIGESTS], ("pa", "pb")),
            )
            for i in range(1, most + 1)
        ]
    )
    first = whole.select("conv_id", "front", "size", F.inline(fronts)).filter("depth <= front")
    return scratch.keep(first.select(after.columns).unionAll(after)), scratch.keep(info.select("conv_id", "size"))


def _slots_hash(keys: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of (a, b, depth) rows."""
    out = np.full(len(keys), (salt * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1), np.uint64)
    for column in keys.T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


class Slots:
    """A minimal perfect hash of the distinct keys of one shard: n keys have the slots 0 to n-1.

    Each level is a bit array; keys that are alone at their bit get it, the others go to the
    next level. A slot is the number of set bits before its own. The key is kept at its slot,
    which verifies every look-up.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, start = keys, 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("a shard holds one key twice")
            size = 2 * len(left) + 1
            place = (_slots_hash(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + start
            self.levels.append((alone, rank))
            start += int(alone.sum())
            left = left[~alone[place]]
        self.keys = np.empty_like(keys)
        self.keys[self._find(keys)] = keys

    def _find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            place = (_slots_hash(keys[left], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[place]
            found[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return found

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that are not there."""
        found = self._find(keys)
        met = found >= 0
        met[met] = (self.keys[found[met]] == keys[met]).all(axis=1)
        return np.where(met, found, -1)


def accumulate(keys: np.ndarray, parents: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and saved tokens of whole subtrees, per node of a shard that holds each of its subtrees whole.

    ``keys`` and ``parents`` are (a, b, depth) rows; a parent that is not in the shard is above it.
    The counts lie in flat arrays by slot, and each depth, deepest first, is added to the parents' slots.
    """
    slots = Slots(keys)
    own, above = slots.of(keys), slots.of(parents)
    n = len(keys)
    total, parent, depth = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    total[own], parent[own], depth[own] = saved, above, keys[:, 2]
    leaves = np.ones(n, np.int64)
    leaves[parent[parent >= 0]] = 0
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        np.add.at(total, parent[level], total[level])
        np.add.at(leaves, parent[level], leaves[level])
    return leaves[own], total[own]


RUN = ["owner", "n"]


def _light_sums(runs: DataFrame, light: int, scratch: Scratch) -> DataFrame:
    """(owner, n, leaves, total, up_owner, up_n, top) for the runs of at most ``light`` conversations.

    Such a run has fewer than twice as many runs below it. Pointers are doubled until each names
    the highest light run above; all runs below one lie in one shard, many per task.
    """
    small = runs.filter(F.col("n") <= light)
    anchored = scratch.keep(
        small.withColumn("free", F.coalesce(F.col("up_n") <= light, F.lit(False)))
        .withColumn("ao", F.when(F.col("free"), F.col("up_owner")).otherwise(F.col("owner")))
        .withColumn("an", F.when(F.col("free"), F.col("up_n")).otherwise(F.col("n")))
    )
    while True:
        up = anchored.select(F.col("owner").alias("ao"), F.col("n").alias("an"), F.col("ao").alias("bo"), F.col("an").alias("bn"))
        stepped = anchored.join(up, ["ao", "an"]).withColumn("still", (F.col("ao") == F.col("bo")) & (F.col("an") == F.col("bn")))
        stepped = scratch.keep(stepped.drop("ao", "an").withColumnsRenamed({"bo": "ao", "bn": "an"}).select(*anchored.columns[:-2], "ao", "an", "still"))
        scratch.drop(anchored)
        anchored = stepped.drop("still")
        anchored._scratch = stepped._scratch
        if stepped.filter(~F.col("still")).isEmpty():
            break
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = anchored.select(*RUN, "ao", "an", "a", "b", "bottom", "pa", "pb", "top", "saved").repartition(parts, "ao", "an").sortWithinPartitions("ao", "an")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: pa.Table) -> pa.RecordBatch:
            column = {name: rows.column(name).to_numpy() for name in rows.column_names}
            keys = np.stack([column["a"], column["b"], column["bottom"]], axis=1)
            parents = np.stack([column["pa"], column["pb"], column["top"] - 1], axis=1)
            leaves, total = accumulate(keys, parents, column["saved"])
            arrays = [pa.array(x, pa.int64()) for x in (column["owner"], column["n"], leaves, total)]
            return pa.RecordBatch.from_arrays(arrays, [*RUN, "leaves", "total"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            ao, an = whole.column("ao").to_numpy(), whole.column("an").to_numpy()
            other = np.flatnonzero((ao != ao[-1]) | (an != an[-1]))
            if len(other):
                yield shard(whole.slice(0, int(other[-1]) + 1))
                whole = whole.slice(int(other[-1]) + 1)
            held, size = whole.to_batches(), whole.num_rows
        if size:
            yield shard(pa.Table.from_batches(held))

    summed = scratch.keep(dealt.mapInArrow(run, "owner long, n long, leaves long, total long"))
    scratch.drop(anchored)
    return summed


def subtree_sums(runs: DataFrame, light: int, scratch: Scratch) -> DataFrame:
    """(owner, n, leaves, total) of every run: childless nodes and saved tokens of its whole subtree.

    Runs of many conversations, which have no bound on what lies below them, take the sums of the
    light runs under them and then double their reach upwards, one aggregation and one join a step.
    """
    small = _light_sums(runs, light, scratch)
    heavy = runs.filter(F.col("n") > light)
    if heavy.isEmpty():
        return small
    given = small.join(runs.filter(F.col("n") <= light).select(*RUN, "up_owner", "up_n"), RUN).filter(F.col("up_n") > light)
    given = given.groupBy(F.col("up_owner").alias("owner"), F.col("up_n").alias("n")).agg(F.sum("leaves").alias("gl"), F.sum("total").alias("gt"))
    own = heavy.join(given, RUN, "left")
    alone = F.when(F.col("kids") == 0, 1).otherwise(0)
    table = scratch.keep(
        own.select(
            *RUN,
            F.col("up_owner").alias("ao"),
            F.col("up_n").alias("an"),
            (F.coalesce("gl", F.lit(0)) + alone).cast("long").alias("leaves"),
            (F.coalesce("gt", F.lit(0)) + F.col("saved")).cast("long").alias("total"),
        )
    )
    while not table.filter(F.col("an").isNotNull()).isEmpty():
        more = table.filter(F.col("an").isNotNull()).groupBy(F.col("ao").alias("owner"), F.col("an").alias("n"))
        more = more.agg(F.sum("leaves").alias("ml"), F.sum("total").alias("mt"))
        up = table.select(F.col("owner").alias("ao"), F.col("n").alias("an"), F.col("ao").alias("bo"), F.col("an").alias("bn"))
        reached = table.join(up, ["ao", "an"], "left").join(more, RUN, "left")
        stepped = scratch.keep(
            reached.select(
                *RUN,
                F.col("bo").alias("ao"),
                F.col("bn").alias("an"),
                (F.col("leaves") + F.coalesce("ml", F.lit(0))).alias("leaves"),
                (F.col("total") + F.coalesce("mt", F.lit(0))).alias("total"),
            )
        )
        scratch.drop(table)
        table = stepped
    return small.unionByName(table.select(*small.columns))


def joined_digests(pairs: DataFrame, group: list[str], value: str, scratch: Scratch, size: int = CHUNK) -> DataFrame:
    """Per group the SHA-256 of its values in ascending order, joined by commas, as ``ends_sha256``.

    The text is made in ranges of the sorted pairs, and only pieces of about ``size`` bytes of it are
    brought together, so that a group of any size is a few rows; the hash itself reads them in order.
    """
    order = [*group, value]
    schema = ", ".join(f"{g} long" for g in group)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, length = None, None, [], 0
        made: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [pa.array(x, pa.string() if i == len(order) else pa.int64()) for i, x in enumerate(zip(*made))]
            yield pa.RecordBatch.from_arrays(columns, [*order, "text"])
            made.clear()

        weight = 0
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in order]
            for *now, number in zip(*columns):
                if held and (now != key or length >= size):
                    made.append((*key, first, ",".join(held)))
                    weight += length
                    held, length = [], 0
                if not held:
                    key, first = now, number
                held.append(str(number))
                length += len(held[-1]) + 1
                if weight + 100 * len(made) > 64 * size:
                    yield from flush()
                    weight = 0
        if held:
            made.append((*key, first, ",".join(held)))
        if made:
            yield from flush()

    ranged = pairs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = scratch.keep(ranged.mapInArrow(texts, f"{schema}, {value} long, text string"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *now, text in zip(*(batch.column(name).to_pylist() for name in [*group, "text"])):
                if now == key:
                    digest.update(b"," + text.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text.encode())
            if done:
                yield packed(done)
        if key is not None:
            yield packed([(*key, digest.hexdigest())])

    def packed(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, pa.string() if i == len(group) else pa.int64()) for i, x in enumerate(zip(*done))]
        return pa.RecordBatch.from_arrays(columns, [*group, "ends_sha256"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, *group).sortWithinPartitions(*order).select(*group, "text")
    return scratch.keep(dealt.mapInArrow(digests, f"{schema}, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, stem: int = 20, most: int = HEAD, light: int = LIGHT) -> DataFrame:
    """The prefix trie of rebuilt conversations, a row per node.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). A conversation
    c begins with the first h turns of conversation c - c % stem, h = crc32(c) % (most + 1), and goes on
    with its own turns after its first h. Nodes are the distinct sequences of first turns.

    Turns go by their number, missing ones first, then by the hash of role and text, so repeated turns and
    rows are turns of their own; missing role and text are empty. Rows without conv_id belong to no
    conversation. A conversation left without turns is a member of the root. Other columns are ignored; very long
    texts are hashed whole; no conversations give no rows. Digests are verified against the turns' own
    hashes, node by node, and made anew with another base if two sequences should share one.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.keep(turns_of(conversations))
    seed = 0
    while True:
        path, sizes = paths(turns, seed, scratch, stem, most)
        checks = [f(c).alias(f"{name}_{c}") for c in ("pa", "pb", "t1", "t2") for name, f in (("low", F.min), ("high", F.max))]
        counted = path.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"), F.max("w").alias("w"), F.max("cum").alias("cum"), *checks
        )
        nodes = scratch.keep(counted)
        if nodes.filter(" OR ".join(f"low_{c} != high_{c}" for c in ("pa", "pb", "t1", "t2"))).isEmpty():
            break
        seed += 1
    nodes = nodes.select(*NODE, "n", "owner", "w", "cum", F.col("low_pa").alias("pa"), F.col("low_pb").alias("pb"))
    root = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner")).first()
    zero = F.lit(0).cast("long")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("up_owner"), F.col("n").alias("up_n"))
    below = nodes.filter("depth > 1").join(parents, ["depth", "pa", "pb"])
    first = nodes.filter("depth = 1").withColumn("up_owner", F.lit(root["owner"]).cast("long")).withColumn("up_n", F.lit(root["n"]).cast("long"))
    none = F.lit(None).cast("long")
    top = conversations.sparkSession.range(1 if root["n"] else 0).select(
        *[zero.alias(c) for c in [*NODE, "w", "cum", "pa", "pb"]],
        F.lit(root["n"]).cast("long").alias("n"),
        F.lit(root["owner"]).cast("long").alias("owner"),
        none.alias("up_owner"),
        none.alias("up_n"),
    )
    tree = scratch.keep(top.unionByName(first).unionByName(below))
    # nodes of one owner with the same members are a run: a path without branches or ends but at its bottom
    enters = F.col("up_n").isNull() | (F.col("up_owner") != F.col("owner")) | (F.col("up_n") != F.col("n"))
    runs = tree.groupBy(*RUN).agg(
        F.min("depth").alias("top"),
        F.max("depth").alias("bottom"),
        F.max_by("a", "depth").alias("a"),
        F.max_by("b", "depth").alias("b"),
        F.min_by("pa", "depth").alias("pa"),
        F.min_by("pb", "depth").alias("pb"),
        F.max("cum").alias("last"),
        F.min(F.col("cum") - F.col("w")).alias("before"),
        F.max(F.when(enters, F.col("up_owner"))).alias("up_owner"),
        F.max(F.when(enters, F.col("up_n"))).alias("up_n"),
    )
    runs = scratch.keep(runs.withColumn("saved", (F.col("n") - 1) * (F.col("last") - F.col("before"))))
    kids = runs.filter("up_n IS NOT NULL").groupBy(F.col("up_owner").alias("owner"), F.col("up_n").alias("n")).agg(F.count(F.lit(1)).alias("kids"))
    runs = scratch.keep(runs.join(kids, RUN, "left").withColumn("kids", F.coalesce("kids", zero)))
    sums = subtree_sums(runs, light, scratch)
    ended = path.filter("depth = size").select(*NODE, "conv_id").unionAll(sizes.filter("size = 0").select(zero, zero, zero, "conv_id"))
    ends = joined_digests(ended, NODE, "conv_id", scratch)
    known = runs.join(sums, RUN).select(*RUN, "bottom", "kids", "last", "leaves", (F.col("total") - F.col("saved")).alias("under"))
    found = tree.join(known, RUN).join(ends, NODE, "left")
    return found.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("up_owner").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("bottom"), F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("under") + (F.col("n") - 1) * (F.col("last") - F.col("cum") + F.col("w"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


#: The same rows by plain SQL over ``conversations``, node names being hashes of whole prefixes.
SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos, t, w
  FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
    FROM conversations
    WHERE conv_id IS NOT NULL
  )
), each AS (
  SELECT conv_id, conv_id - conv_id % 20 AS stem, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda sum, x: list_reduce(
      list_prepend(xor(sum, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END
    )
  ), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), front AS (
  SELECT e.conv_id, o.pos AS depth, o.t, o.w FROM each e JOIN own o ON o.conv_id = e.stem AND o.pos <= e.h
), size AS (
  SELECT e.conv_id, e.h, count(f.depth) AS n FROM each e LEFT JOIN front f ON f.conv_id = e.conv_id GROUP BY e.conv_id, e.h
), built AS (
  SELECT * FROM front
  UNION ALL
  SELECT s.conv_id, o.pos - s.h + s.n, o.t, o.w FROM size s JOIN own o ON o.conv_id = s.conv_id AND o.pos > s.h
), path AS MATERIALIZED (
  SELECT conv_id, depth, w, sha256(string_agg(t, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM built
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM each
), nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS owner, count(*) AS n, any_value(w) AS w FROM path GROUP BY node, depth
), parents AS (
  SELECT n.node, q.node AS up FROM nodes n JOIN path q ON q.conv_id = n.owner AND q.depth = n.depth - 1
), kids AS (
  SELECT up AS node, count(*) AS k FROM parents GROUP BY up
), under AS (
  SELECT q.node, sum((n.n - 1) * n.w) AS saved, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes n LEFT JOIN kids k ON k.node = n.node JOIN path q ON q.conv_id = n.owner AND q.depth <= n.depth
  GROUP BY q.node
), ends AS (
  SELECT p.node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
  FROM path p JOIN (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id) d ON d.conv_id = p.conv_id AND d.depth = p.depth
  GROUP BY p.node
)
SELECT CAST(n.owner AS BIGINT) AS conv_id, CAST(n.depth AS BIGINT) AS depth, CAST(u.owner AS BIGINT) AS parent_conv_id,
  CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(k.k, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n
JOIN under s ON s.node = n.node
LEFT JOIN parents p ON p.node = n.node
LEFT JOIN nodes u ON u.node = p.up
LEFT JOIN kids k ON k.node = n.node
LEFT JOIN ends e ON e.node = n.node
"""
