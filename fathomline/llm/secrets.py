"""Secret scans over versioned contents with a ledger of what was scanned by which rules."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, as_bytes, rows_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    hint: str = ""

    def version(self) -> str:
        """Changes with anything that changes findings."""
        told = repr((self.kind, self.pattern, self.least, self.group, self.any_case))
        return hashlib.sha256(told.encode()).hexdigest()[:16]


# The base kinds.
BASE = (
    Rule(
        "assign",
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        6,
        2,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]+", 24),
)
# blobs that a task remembers, so that rows that repeat one are not scanned again
SEEN = 100_000
FINDINGS = "blob string, rule string, kind string, first long, last long"


class _Scanner:
    def __init__(self, rule: Rule) -> None:
        self.rule, self.version = rule, rule.version()
        self.pattern = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))
        # a run of a plain class shorter than the least length is never found at all
        plain = re.fullmatch(r"(.*\])\+", rule.pattern)
        if plain and not rule.group and not rule.hint:
            self.pattern = re.compile(f"{plain[1]}{{{rule.least},}}", re.ASCII)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches, in code points; too short ones are dropped."""
        rule = self.rule
        if rule.hint and rule.hint not in text:
            return []
        return [m.span() for m in self.pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob, content, todo): ``todo`` lists the rule versions that have not seen the blob.

    Rows that repeat a blob lie in one task, which scans it once while it is among the last ``SEEN`` ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = {rule.version(): _Scanner(rule) for rule in rules}
        seen: dict[str, None] = {}
        for keys, contents, todo in rows_of(batches):
            out: list[tuple] = []
            for key, content, versions in zip(keys, contents, todo):
                if key in seen:
                    continue
                seen[key] = None
                if len(seen) > SEEN:
                    del seen[next(iter(seen))]
                text = content.decode("utf-8", "replace")
                for version in versions:
                    kind = scanners[version].rule.kind
                    out += [(key, version, kind, *span) for span in scanners[version].spans(text)]
            columns = list(zip(*out)) or [[]] * 5
            types = [pa.string()] * 3 + [pa.int64()] * 2
            names = ["blob", "rule", "kind", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return blobs.mapInArrow(run, FINDINGS)


class Ledger:
    """Which (blob, rule version) pairs were scanned, and what was found, as two tables in a folder.

    Both are only appended to. Findings are written before the pairs are entered: a scan that
    breaks off between the two is repeated, and readers take findings without repeats.
    """

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rule string")

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).distinct()

    def update(self, versions: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = BASE) -> DataFrame:
        """Scan what the ledger has not seen of (path, content); the address (path, blob) of every row.

        A blob is named by the SHA-256 of its content. Only hashes are grouped; of each blob
        with an unseen pair one row is picked, by its path, and only its content is scanned.
        """
        addressed = scratch.keep(versions.select("path", F.sha2("content", 256).alias("blob")))
        known = [rule.version() for rule in rules]
        pairs = addressed.groupBy("blob").agg(F.min(F.struct("path")).alias("pick"))
        pairs = pairs.select("blob", F.col("pick.path").alias("path"), F.explode(F.array(*map(F.lit, known))).alias("rule"))
        unseen = pairs.join(self.scanned(), ["blob", "rule"], "left_anti")
        todo = scratch.keep(unseen.groupBy("blob", "path").agg(F.sort_array(F.collect_set("rule")).alias("todo")))
        # one row of a path that has several contents is the right one: the blob is compared too
        chosen = versions.join(todo.hint("shuffle_hash"), versions["path"].eqNullSafe(todo["path"]))
        chosen = chosen.filter(F.sha2("content", 256) == F.col("blob")).select("blob", "content", "todo")
        scan_blobs(chosen, rules).write.mode("append").parquet(f"{self.folder}/findings")
        todo.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{self.folder}/scanned")
        return addressed


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE, ledger: str | None = None) -> DataFrame:
    """Secrets of every whole text of (doc_id, text), scanned once per distinct content.

    Returns (doc_id, spans): structs (kind, first, last) in code points, the end exclusive,
    by start and then by the order of ``rules``. With ``ledger``, a shared folder, contents that
    were scanned by the same rule versions in an earlier call are not scanned again.

    A missing text counts as empty and has no spans; a repeated row comes back each time;
    rows without doc_id are scanned too; further columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    book = Ledger(spark, ledger or f"{scratch.root}/ledger")
    versions = docs.select(F.col("doc_id").cast("long").alias("path"), as_bytes().alias("content"))
    addressed = book.update(versions, scratch, rules)
    order = F.create_map(*[F.lit(x) for k, rule in enumerate(rules) for x in (rule.kind, k)])
    wanted = F.col("rule").isin([rule.version() for rule in rules])
    found = book.findings().filter(wanted).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("first", order[F.col("kind")].alias("at"), "last", "kind"))).alias("spans")
    )
    joined = addressed.join(scratch.keep(found), "blob", "left")
    spans = F.transform(
        F.coalesce("spans", F.array()), lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last"))
    )
    return joined.select(F.col("path").alias("doc_id"), spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind and the spans as text, for rows of ``scan``."""

    def text(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ","
        )

    kinds = [rule.kind for rule in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
