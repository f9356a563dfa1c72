"""Benchmark decontamination: BM25 over the shingles of test items by block-max WAND, then exact overlap."""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, as_bytes, rows_of
from fathomline.operators.ranking import running_sum

WORDS = re.compile(r"[^\W_]+")
SHINGLE = 5
SEGMENT = 64
BLOCK = 32
PASSAGE = 4096
PART_TERMS = 1 << 17
K1, B = 1.2, 0.75
ODD = 0x9E3779B97F4A7C15
CLOSE = 1e-9


def words_of(data: bytes) -> list[str]:
    return WORDS.findall(data.decode("utf-8", "replace").lower())


def shingles(words: list[str], size: int = SHINGLE) -> set[str]:
    """Distinct runs of ``size`` words; fewer words are one run, none give none."""
    if len(words) <= size:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def word_code(word: str) -> int:
    """64 bits of a word, never zero."""
    return xxhash.xxh64_intdigest(word) | 1


def terms_of(codes: np.ndarray, size: int) -> np.ndarray:
    """A term per run of ``size`` words, from the codes of the words; 0 where a word has none."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, known = np.full(n, size, np.uint64), np.ones(n, bool)
    for j in range(size):
        own = codes[j : j + n]
        total = total * np.uint64(ODD) + own
        known &= own != 0
    return np.where(known, total | np.uint64(1), np.uint64(0))


def item_terms(words: list[str]) -> np.ndarray:
    """The terms of a test item in order, repeats included: its shingles, or its whole if it is shorter."""
    codes = np.fromiter(map(word_code, words), np.uint64, len(words))
    return terms_of(codes, min(SHINGLE, len(words)))


@dataclass
class Part:
    """Inverted index of test items with about ``PART_TERMS`` shingles in all.

    Items are cut into segments of at most ``SEGMENT`` distinct shingles. An impact is a BM25 term score
    divided by the least score that a text with the wanted share of the segment's shingles can have, so that
    a score of 1 is what retrieval asks for, and nothing is lost by asking for it: a text with that share of
    an item has that share of one of its segments. Postings go by segment; each block of ``BLOCK`` of them, and
    each list, has its greatest impact.
    """

    words: dict[str, int]
    sizes: list[int]
    terms: np.ndarray
    postings: list[tuple[list[int], list[float], list[int], list[float], float]]
    item_of: list[int]
    items: list[tuple[str, str, str]]  # key, words, answer
    known: dict[int, tuple[set[str], set[str]]] = field(default_factory=dict)

    def shingles_of(self, index: int) -> tuple[set[str], set[str]]:
        if index not in self.known:
            _, text, answer = self.items[index]
            self.known[index] = (shingles(text.split(" ") if text else []), shingles(answer.split(" ") if answer else []))
        return self.known[index]

    def query(self, words: list[str]) -> np.ndarray:
        """Places of the index terms that a text has, gathered passage by passage."""
        found = []
        for at in range(0, len(words), PASSAGE):
            own = words[at : at + PASSAGE + SHINGLE - 1]
            codes = np.fromiter(map(self.words.get, own, repeat(0)), np.uint64, len(own))
            if np.count_nonzero(codes) < self.sizes[0]:
                continue
            for size in self.sizes:
                terms = terms_of(codes, size)
                terms = terms[terms != 0]
                place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
                found.append(np.unique(place[self.terms[place] == terms]))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def candidates(self, words: list[str]) -> set[int]:
        """Items with a segment that scores at least 1 for the terms of a text: WAND with block maxima.

        The lists are kept by current segment. The pivot is the first segment where the greatest impacts
        of the lists up to it reach 1; no earlier one can. If the maxima of the blocks around the pivot do not,
        all segments up to the end of the shortest block are skipped; else the pivot is scored.
        """
        lists = [self.postings[t] for t in self.query(words).tolist()]
        if sum(x[4] for x in lists) < 1 - CLOSE:
            return set()
        found: set[int] = set()
        # (current segment, place in the list, list)
        open_lists = [(x[0][0], 0, x) for x in lists]
        while open_lists:
            open_lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, None
            for n, (segment, _, x) in enumerate(open_lists):
                total += x[4]
                if total >= 1 - CLOSE:
                    pivot = segment
                    break
            if pivot is None:
                break
            while n + 1 < len(open_lists) and open_lists[n + 1][0] == pivot:
                n += 1
            bound, end = 0.0, open_lists[n + 1][0] if n + 1 < len(open_lists) else 1 << 62
            for _, at, x in open_lists[: n + 1]:
                block = bisect_left(x[2], pivot, at // BLOCK)
                if block < len(x[2]):
                    bound += x[3][block]
                    end = min(end, x[2][block] + 1)
            if bound < 1 - CLOSE:
                open_lists = _moved(open_lists, n, max(end, pivot + 1))
            elif open_lists[0][0] == pivot:
                if sum(x[1][at] for _, at, x in open_lists[: n + 1]) >= 1 - CLOSE:
                    found.add(self.item_of[pivot])
                open_lists = _moved(open_lists, n, pivot + 1)
            else:
                open_lists = _moved(open_lists, n, pivot)
        return found


def _moved(open_lists: list[tuple], upto: int, segment: int) -> list[tuple]:
    """The lists with the first ``upto`` + 1 of them moved to ``segment`` or beyond; finished ones go."""
    out = []
    for now, at, x in open_lists[: upto + 1]:
        if now < segment:
            at = bisect_left(x[0], segment, at)
            if at == len(x[0]):
                continue
            now = x[0][at]
        out.append((now, at, x))
    return out + open_lists[upto + 1 :]


def build(items: list[tuple[str, str, str, dict[int, int]]], total: int, mean: float, share: float) -> Part:
    """The index over (key, words, answer, document frequencies above 1) of ``total`` items of ``mean`` words."""
    vocabulary: dict[str, int] = {}
    lists: dict[int, list[tuple[int, float]]] = {}
    sizes, item_of = set(), []
    for number, (_, text, _, shared) in enumerate(items):
        words = text.split(" ")
        for word in words:
            if word not in vocabulary:
                vocabulary[word] = word_code(word)
        sizes.add(min(SHINGLE, len(words)))
        terms, counts = np.unique(item_terms(words), return_counts=True)
        frequency = np.fromiter((shared.get(t, 1) for t in terms.view(np.int64).tolist()), np.float64, len(terms))
        idf = np.log(1 + (total - frequency + 0.5) / (frequency + 0.5))
        impact = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(words) / mean))
        for at in range(0, len(terms), SEGMENT):
            own, score = terms[at : at + SEGMENT], impact[at : at + SEGMENT]
            wanted = int(np.ceil(share * len(own) - 1e-9))
            score = score / np.sort(score)[:wanted].sum()
            for term, value in zip(own.tolist(), score.tolist()):
                lists.setdefault(term, []).append((len(item_of), value))
            item_of.append(number)
    terms = np.array(sorted(lists), np.uint64)
    postings = []
    for term in terms.tolist():
        segments, impacts = (list(x) for x in zip(*lists[term]))
        starts = range(0, len(segments), BLOCK)
        ends = [segments[min(i + BLOCK, len(segments)) - 1] for i in starts]
        tops = [max(impacts[i : i + BLOCK]) for i in starts]
        postings.append((segments, impacts, ends, tops, max(tops)))
    return Part(vocabulary, sorted(sizes), terms, postings, item_of, [i[:3] for i in items])


def _texts(items: DataFrame) -> DataFrame:
    """(item_id, key, words, answer, size, terms): the words of item and answer, their digest, and distinct terms."""
    answer = as_bytes(F.col("answer").cast("string")) if "answer" in items.columns else F.lit(b"")
    source = items.select(F.col("item_id").cast("long").alias("item_id"), as_bytes().alias("text"), answer.alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, answers in rows_of(batches):
            out = []
            for item, text, reply in zip(ids, texts, answers):
                words = words_of(text)
                if words:
                    terms = np.unique(item_terms(words)).view(np.int64).tolist()
                    out.append((item, " ".join(words), " ".join(words_of(reply)), len(words), terms))
            names = ["item_id", "words", "answer", "size", "terms"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    found = source.mapInArrow(run, "item_id long, words string, answer string, size long, terms array<long>")
    return found.withColumn("key", F.sha2(F.concat_ws("\n", "words", "answer"), 256))


def index_parts(texts: DataFrame, share: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """(part, index): the pickled indexes over the texts of items, each text once, built in tasks; and their number.

    Parts are cut where the running number of shingles passes a multiple of ``PART_TERMS``: a part has at
    most so many and one item more. Document frequencies and lengths are taken over all texts.
    """
    once = scratch.keep(texts.drop("item_id").dropDuplicates(["key"]))
    totals = once.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("size"), F.sum(F.size("terms")).alias("terms")).first()
    if not totals["n"]:
        return once, 0
    terms = once.select("key", F.explode("terms").alias("term"))
    shared = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    frequent = terms.join(shared, "term").groupBy("key").agg(F.collect_list(F.struct("term", "df")).alias("shared"))
    weighed = once.withColumn("all", F.lit(0)).withColumn("weight", F.size("terms").cast("long"))
    summed = running_sum(weighed.select("all", "key", "weight"), "all", "key", "weight", "upto")
    part = F.floor((F.col("upto") - F.col("weight")) / PART_TERMS).cast("int").alias("part")
    whole = once.join(summed.select("key", part), "key").join(frequent, "key", "left").select("part", "key", "words", "answer", "shared")
    parts = totals["terms"] // PART_TERMS + 1
    dealt = whole.repartition(min(parts, 256), "part").sortWithinPartitions("part", "key")
    n, mean = totals["n"], totals["size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(part: int, rows: list[tuple]) -> pa.RecordBatch:
            index = pickle.dumps(build(rows, n, mean, share))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([index], pa.binary())], ["part", "index"])

        now, rows = None, []
        for parts, *columns in rows_of(batches):
            for part, key, words, answer, own in zip(parts, *columns):
                if part != now and rows:
                    yield packed(now, rows)
                    rows = []
                now = part
                rows.append((key, words, answer, {x["term"]: x["df"] for x in own or ()}))
        if rows:
            yield packed(now, rows)

    return scratch.keep(dealt.mapInArrow(run, "part int, index binary")), parts


def contaminated(docs: DataFrame, items: DataFrame, overlap: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_found) of documents that hold a test item.

    Every passage of every whole text of (doc_id, text) queries the index of (item_id, text[, answer]) with
    its 5-word shingles, which are the index's terms; what the passages of a text find adds up. An item is
    retrieved if a segment of it reaches the least BM25 score that ``overlap`` of its shingles can have, so
    no item with that share is lost, however scattered. It counts if the document has at least
    ``overlap`` of its distinct shingles and, where the items have an answer, of the answer's too. Words
    are runs of letters and digits in lower case; an item of fewer words than a shingle is one shingle.

    Missing texts and texts without words hold nothing, items without words are never found;
    repeated documents and items give one row per pair; rows without doc_id or item_id are
    compared like others; further columns are ignored; without documents or items there are no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    texts = scratch.keep(_texts(items))
    parts, count = index_parts(texts, overlap, scratch)

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part: Part = pickle.loads(sent.value)
            for ids, texts in rows_of(batches, 1 << 21):
                out = []
                for doc, text in zip(ids, texts):
                    words = words_of(text)
                    found = part.candidates(words)
                    if found:
                        seen, joined = shingles(words), f" {' '.join(words)} "
                    for item in sorted(found):
                        wanted, reply = part.shingles_of(item)
                        # a short item is one run of fewer words, found as such
                        held = len(wanted & seen) if len(next(iter(wanted)).split(" ")) == SHINGLE else int(f" {next(iter(wanted))} " in joined)
                        enough = held >= overlap * len(wanted) - 1e-9
                        if enough and reply:
                            short = len(next(iter(reply)).split(" ")) < SHINGLE
                            told = int(f" {next(iter(reply))} " in joined) if short else len(reply & seen)
                            enough = told >= overlap * len(reply) - 1e-9
                        if enough:
                            out.append((doc, part.items[item][0], len(wanted), held))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*out)) or [[]] * 4
                names = ["doc_id", "key", "n_shingles", "n_found"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

        return run

    schema = "doc_id long, key string, n_shingles long, n_found long"
    pairs = spark.createDataFrame([], schema)
    for number in range(count):
        # one bounded part at a time passes the driver, as the bytes that a task has made
        row = parts.filter(F.col("part") == number).select("index").first()
        if row is not None:
            pairs = pairs.unionAll(source.mapInArrow(search(spark.sparkContext.broadcast(bytes(row["index"]))), schema))
    named = texts.select("item_id", "key").distinct()
    return pairs.distinct().join(named, "key").select("doc_id", "item_id", "n_shingles", "n_found")


#: The same pairs over the views documents and benchmark, whose items all have at least five words.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) x),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) x),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles
"""
