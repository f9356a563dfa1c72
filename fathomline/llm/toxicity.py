"""Toxicity of texts after noisy-channel restoration of disguised words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, as_bytes, rows_of
from fathomline.llm.labelled import held_out, training_rows, with_labels

FOLDS, FOLD = 5, 0
TRAINING_ROWS = 20_000
WORDS = 512
CACHE = 200_000
OTHER, EDGE, SYMBOLS = 26, 27, 28
ORDER = 4

# Letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
JOINTS = "._-*~"
# costs of the channel, in nats
SUBSTITUTED, DROPPED, REPEATED, DOUBLED, JOINED, PARTED = 1.0, 4.0, 0.5, 4.0, 0.2, 2.5

SIGNS = re.escape("".join(LEET))
PIECES = re.compile(rf"[^\W_][\w{SIGNS}{re.escape(JOINTS)}]*|[{SIGNS}][\w{SIGNS}{re.escape(JOINTS)}]+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
REPEATS = re.compile(r"(.)\1*")
DOUBLED_LETTER = re.compile(r"(.)\1")
# three runs of white-space separated characters in a row with at most one letter or digit each
SIGN = r"(?:[^\w\s]|_)*"
SPACED = re.compile(rf"(?<!\S)(?:(?=\S){SIGN}(?:[^\W_]{SIGN})?\s+){{2}}(?=\S){SIGN}(?:[^\W_]{SIGN})?(?!\S)")
DOTTED = re.compile(rf"(?:[\w{SIGNS}][{re.escape(JOINTS)}]){{2,}}[\w{SIGNS}]")
TAIL = re.compile(r"[\W_]+$")
LETTERS = re.compile(r"[^\W\d_]+")
AROUND = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = re.compile(rf"[^\w{SIGNS}]|_")


@lru_cache(maxsize=4096)
def single(run: str) -> str:
    """The one character of a run within punctuation, a sign only where there is nothing else; or empty."""
    if len(run) == 1:
        return run
    core = AROUND.sub("", run) or MARKS.sub("", run)
    return core if len(core) == 1 else ""


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Symbol of each code point below 2^16: a-z without accents, another letter, or the word's edge."""
    table = np.full(1 << 16, EDGE, np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            first = unicodedata.normalize("NFD", char.lower())[:1]
            table[code] = ord(first) - 97 if "a" <= first <= "z" else OTHER
    return table


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return folding()[np.minimum(codes, (1 << 16) - 1)]


def grams(texts: list[bytes]) -> np.ndarray:
    """Counts of all runs of ``ORDER`` symbols; the symbols before a word count as its edge."""
    gap = " " * ORDER
    data = symbols(gap.join(["", *(t.decode("utf-8", "replace").lower() for t in texts), ""])).astype(np.int32)
    if len(data) < ORDER:
        return np.zeros(SYMBOLS**ORDER, np.int64)
    back = [data[ORDER - 1 - k : len(data) - k] for k in range(ORDER)]
    for k in range(2, ORDER):
        back[k] = np.where(back[k - 1] == EDGE, EDGE, back[k])
    use = (back[0] != EDGE) | (back[1] != EDGE)
    code = back[ORDER - 1]
    for k in range(ORDER - 2, -1, -1):
        code = code * SYMBOLS + back[k]
    return np.bincount(code[use], minlength=SYMBOLS**ORDER)


def language_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over every text of (doc_id, text): at most 28^4 rows, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for _, texts in rows_of(batches, 1 << 21):
            total += grams(texts)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["gram", "n"])

    source = docs.select(F.lit(0).alias("doc_id"), as_bytes().alias("text"))
    return source.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def costs(counts: np.ndarray) -> np.ndarray:
    """-log probability of a symbol after three others, interpolated down to single symbols."""
    shape = (SYMBOLS,) * ORDER
    full = counts.reshape(shape).astype(float)
    mixed = (full.sum((0, 1, 2)) + 1) / (full.sum() + SYMBOLS)
    for drop in range(ORDER - 2, -1, -1):
        lower = full.sum(tuple(range(drop))) if drop else full
        total = lower.sum(-1, keepdims=True)
        mixed = (lower + 4 * mixed) / (total + 4)
    return -np.log(mixed).astype(np.float32)


class Restorer:
    """Viterbi decoding of character lattices under the character language model."""

    def __init__(self, cost: np.ndarray) -> None:
        self.cost = cost.reshape(-1)

    def _choices(self, text: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
        """What each character may stand for: (letters, cost); no letter is the empty string."""
        run = 0
        before = ""
        for char in text:
            run = run + 1 if char == before else 1
            before = char
            if char.isalpha():
                kept = [(char, 0.0 if run < 3 else DROPPED)]
                yield kept + [("", REPEATED if run > 2 else DOUBLED)] if run > 1 else kept
            elif char in LEET:
                yield [(x, SUBSTITUTED) for x in LEET[char]] + [("", DROPPED if run == 1 else SUBSTITUTED)]
            elif spaced or char in JOINTS:
                yield [("", JOINED if spaced else SUBSTITUTED), (" ", PARTED if spaced else JOINED)]
            else:
                yield [(" ", 0.0)]

    def decode(self, text: str, spaced: bool = False) -> str:
        """The least costly reading of a text in lower case, with blanks between words."""
        edge = (EDGE,) * (ORDER - 1)
        best: dict[tuple, tuple[float, tuple]] = {edge: (0.0, ())}
        for choices in self._choices(text, spaced):
            after: dict[tuple, tuple[float, tuple]] = {}
            for state, (spent, path) in best.items():
                for letter, extra in choices:
                    cost, now = spent + extra, state
                    if letter:
                        code = EDGE if letter == " " else symbol(letter)
                        if code == EDGE and state[-1] == EDGE:
                            continue
                        at = 0
                        for s in state:
                            at = at * SYMBOLS + s
                        cost += float(self.cost[at * SYMBOLS + code])
                        now = edge if code == EDGE else (*state[1:], code)
                    if now not in after or cost < after[now][0]:
                        after[now] = (cost, (path, letter) if letter else path)
            best = after or best
        ends = []
        for state, (spent, path) in best.items():
            at = 0
            for s in state:
                at = at * SYMBOLS + s
            ends.append((spent + (float(self.cost[at * SYMBOLS + EDGE]) if state[-1] != EDGE else 0.0), path))
        path = min(ends, key=lambda e: e[0])[1]
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))


@lru_cache(maxsize=4096)
def symbol(char: str) -> int:
    return int(symbols(char)[0])


def letters_of(word: str) -> tuple[str, list[int]]:
    """A word with each run of a letter written once, and the lengths of these runs."""
    runs = [m.group() for m in REPEATS.finditer(word)]
    return "".join(r[0] for r in runs), list(map(len, runs))


class Reader(dict):
    """Restored words of white-space separated runs; plain words stand for themselves.

    A run is restored where it mixes letters with signs that stand for letters, parts single
    letters by joints, or repeats a letter three times. ``keep`` maps a restored word to what is
    remembered of it; of a word that it maps to none, the ``known`` words that become it when letters
    are repeated are remembered instead. The memory is emptied at ``CACHE`` runs.
    """

    def __init__(self, restorer: Restorer, keep, known: Iterable[str] = ()) -> None:
        self.restorer, self.keep = restorer, keep
        self.known: dict[str, list[tuple[str, list[int]]]] = {}
        for word in known:
            shape, lengths = letters_of(word)
            self.known.setdefault(shape, []).append((word, lengths))

    def words(self, run: str) -> list[str]:
        run = run.lower()
        if run.isalpha():
            return [run] if not TRIPLE.search(run) else self.restorer.decode(run).split()
        out = []
        for piece in PIECES.findall(run):
            piece = TAIL.sub("", piece)
            if piece.isalpha() and not TRIPLE.search(piece):
                out.append(piece)
            elif LETTERS.search(piece):
                out += self.restorer.decode(piece, spaced=bool(DOTTED.fullmatch(piece))).split()
        return out

    def kept(self, word: str) -> list:
        """What is remembered of a word, or of the known words that it is with letters repeated."""
        own = self.keep(word)
        if own is not None or not self.known or not DOUBLED_LETTER.search(word):
            return [] if own is None else [own]
        shape, lengths = letters_of(word)
        meant = [w for w, least in self.known.get(shape, ()) if all(a <= b for a, b in zip(least, lengths))]
        return [x for x in map(self.keep, meant) if x is not None]

    def __missing__(self, run: str):
        found = tuple(x for word in self.words(run) for x in self.kept(word))
        if len(self) >= CACHE:
            self.clear()
        self[run] = found
        return found

    def of(self, text: str) -> set:
        """What is kept of all words of a text, spaced-out ones among them."""
        runs = text.split()
        found = set()
        for kept in map(self.__getitem__, set(runs)):
            if kept:
                found.update(kept)
        if not SPACED.search(text):
            return found
        alone = list(map(single, runs))
        marks = bytes(map(bool, alone))
        at = marks.find(b"\1\1\1")
        while at >= 0:
            end = marks.find(b"\0", at)
            end = len(runs) if end < 0 else end
            spread = " ".join(alone[at:end]).lower()
            if LETTERS.search(spread):
                words = self.restorer.decode(spread, spaced=True).split()
                found.update(x for word in words for x in self.kept(word))
            at = marks.find(b"\1\1\1", end)
        return found


def key_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 0) - (1 << 63)


@dataclass
class Model:
    """Character model, weights of words, intercept and the weighted words themselves."""

    cost: np.ndarray
    weights: dict[int, float]
    intercept: float | None
    words: tuple[str, ...] = ()

    def score(self, kept: set) -> float:
        if self.intercept is None:
            return 0.0
        z = self.intercept + sum(self.weights[k] for k in sorted(kept))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def reader(self) -> Reader:
        return Reader(Restorer(self.cost), lambda w: k if (k := key_of(w)) in self.weights else None, self.words)


def _logistic(hits: list[np.ndarray], labels: np.ndarray, width: int, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.zeros((len(labels), width + 1), np.float32)
    for row, own in enumerate(hits):
        x[row, own] = 1
    x[:, -1] = 1
    w = np.zeros(width + 1)
    penalty = np.r_[np.full(width, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - labels) + penalty * w
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        # a long step is shortened, which keeps separable samples from swinging
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = TRAINING_ROWS, words: int = WORDS) -> Model:
    """Character model from all texts; words from at most ``rows`` labelled ones outside the held-out fold.

    The ``words`` restored words whose presence tells most about the label (by likelihood
    ratio) get weights by logistic regression. Counts are made by Spark; the driver sees the
    28^4 character counts, the chosen words and which sample rows have them.
    """
    spark = docs.sparkSession
    counted = language_counts(docs).toPandas()
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    counts[counted["gram"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    cost = costs(counts)
    sample = training_rows(labels, "toxic", FOLDS, FOLD, rows, scratch)
    sent = spark.sparkContext.broadcast(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Restorer(sent.value), lambda w: (key_of(w), w))
        for texts, marks in rows_of(batches):
            kept = [sorted(reader.of(t.decode("utf-8", "replace"))) for t in texts]
            keys, names = ([[x[i] for x in row] for row in kept] for i in (0, 1))
            columns = [pa.array(keys, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), pa.array(marks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["words", "names", "label"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    seen = with_labels(source, sample).select("text", "label").mapInArrow(run, "words array<long>, names array<string>, label int")
    seen = scratch.keep(seen)
    total = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    if not n:
        return Model(cost, {}, None)
    with_word = seen.select(F.explode("words").alias("word"), "label").groupBy("word")
    table = with_word.agg(F.count(F.lit(1)).alias("k"), F.sum("label").alias("h"))
    h, k = F.col("h"), F.col("k")

    def term(observed, row, column):
        return F.when(observed > 0, observed * F.log(observed * n / (row * column))).otherwise(0.0)

    gain = term(h, k, F.lit(t)) + term(k - h, k, F.lit(n - t)) + term(t - h, n - k, F.lit(t)) + term(n - t - k + h, n - k, F.lit(n - t))
    best = table.filter("h > 1").withColumn("gain", 2 * gain).filter(F.col("gain") > 10).filter(h * n > k * t)
    chosen = [r["word"] for r in best.orderBy(F.desc("gain"), "word").limit(words).collect()]
    if not chosen:
        return Model(cost, {}, float(np.log((t + 0.5) / (n - t + 0.5))))
    hits = seen.select("label", F.array_intersect("words", F.array(*[F.lit(c) for c in chosen])).alias("hits")).collect()
    place = {c: i for i, c in enumerate(chosen)}
    w = _logistic([np.array([place[x] for x in r["hits"]], np.int64) for r in hits], np.array([r["label"] for r in hits]), len(chosen))
    named = seen.select(F.inline(F.arrays_zip("words", "names"))).filter(F.col("words").isin(chosen)).groupBy("words")
    names = named.agg(F.min("names").alias("name")).collect()
    return Model(cost, dict(zip(chosen, w[:-1].tolist())), float(w[-1]), tuple(sorted(r["name"] for r in names)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text of (doc_id, text).

    The score lies between 0 and 1 and depends on the text alone. A missing text counts as
    empty and gets the score of a text without known words; a repeated row comes back each
    time; rows without doc_id are scored and not held out; further columns are ignored; no rows
    give no rows. Without any labelled row all scores are 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = sent.value.reader()
        for ids, texts in rows_of(batches):
            found = [sent.value.score(reader.of(t.decode("utf-8", "replace"))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` whose text scores below 0.5, all columns as they were; nothing is shuffled.

    Only the text goes to the Python worker and only the score comes back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = sent.value.reader()
        for texts in batches:
            parts = rows_of([pa.RecordBatch.from_arrays([texts], ["text"])])
            found = [sent.value.score(reader.of(t.decode("utf-8", "replace"))) for (part,) in parts for t in part]
            yield pa.array(found, pa.float64())

    return docs.filter(F.arrow_udf(run, "double")(as_bytes()) < 0.5)
