"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import Scratch, with_document_key

NEAR_FROM = 20
BLOCK = 256
BLANKS = " \t\r"


def _halves(c: Column, lo: Column, right: Column) -> list[tuple[Column, Column]]:
    """The two ways to fix half of the block between ``lo`` and ``right``: (lo, right) after it.

    ``c`` is the greater length of a pair. One edit lies in one half, so the two lines agree in
    all that is fixed on the other side, whichever of them has the character more.
    """
    half = F.floor((c - lo - right) / 2).cast("int")
    return [((lo + half).cast("int"), right.cast("int")), (lo.cast("int"), (right + half).cast("int"))]


def _fixed(c: Column, lo: Column, right: Column, line: Column) -> Column:
    """Hash of all that is fixed of a line and of where it is fixed."""
    return F.xxhash64(c, lo, right, F.substring(line, F.lit(1), lo), F.right(line, right))


def _states(c: Column, more: Column, lo: Column, right: Column, key: Column) -> Column:
    return F.struct(c.alias("c"), more.alias("more"), lo.alias("lo"), right.alias("right"), key.alias("key"))


def _shared(states: DataFrame, scratch: Scratch) -> DataFrame:
    """States whose key belongs to more than one line."""
    counts = states.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return states.join(scratch.keep(counts), "key")


def _near(firsts: DataFrame, source: DataFrame, near_from: int, scratch: Scratch) -> DataFrame:
    """Lines (h1, h2) with an earlier line exactly one edit away.

    ``firsts`` has (h1, h2, pos, size, keys): the distinct lines, their earliest place, their length and
    the hashes of their halves, for a partner as long at most and for one a character longer.
    """
    zero, size = F.lit(0), F.col("size")
    spread = firsts.filter("size(keys) > 0").select("h1", "h2", "pos", "size", F.posexplode("keys").alias("way", "key"))
    shared = _shared(spread.filter(size + F.floor(F.col("way") / 2) >= near_from), scratch)
    ways = F.array(
        *[_states(size + more, F.lit(more), lo, right, F.col("key")) for more in (0, 1) for lo, right in _halves(size + more, zero, zero)]
    )
    flagged = shared.select("h1", "h2", "pos", F.get(ways, F.col("way")).alias("state"))
    flagged = flagged.groupBy("h1", "h2", "pos").agg(F.collect_list("state").alias("states"))
    by_doc = flagged.groupBy("pos.doc_id").agg(F.collect_list(F.struct("h1", "h2", "pos", "states")).alias("wanted"))
    fetched = source.join(by_doc.hint("shuffle_hash"), "doc_id").select(F.split("text", "\n", -1).alias("lines"), "wanted")
    # a text is split once; only its wanted lines leave it, each once however often its document comes
    lines = fetched.select(F.expr("inline(transform(wanted, w -> struct(w AS w, get(lines, w.pos.line_no) AS line)))"))
    once = lines.select("w.*", "line").dropDuplicates(["h1", "h2"])
    states = scratch.keep(once.select("h1", "h2", "pos", "line", F.inline("states")).drop("key"))
    scratch.release()
    block = F.col("c") - F.col("lo") - F.col("right")
    c, lo, right, line = (F.col(x) for x in ("c", "lo", "right", "line"))
    # long lines: halve what may differ until its deletions are few
    while (states.agg(F.max(block).alias("m")).first()["m"] or 0) > BLOCK:
        ways = F.array(*[_states(c, F.col("more"), x, y, _fixed(c, x, y, line)) for x, y in _halves(c, lo, right)])
        halves = states.filter(block > BLOCK).select("h1", "h2", "pos", "line", F.inline(ways))
        states = scratch.keep(states.filter(block <= BLOCK).unionByName(_shared(halves, scratch).select(*states.columns)))

    # the deletion neighbourhood: the longer line of a pair loses each character of the block in
    # turn, with the place kept; the shorter one stands for itself at place 0
    inner = F.expr("substring(line, lo + 1, length(line) - lo - right)")
    around = states.withColumn("block", inner).withColumn("around", _fixed(c, lo, right, line))
    variants = F.when(F.col("more") == 1, F.expr("array(struct(0 AS p, xxhash64(around, block) AS variant))")).otherwise(
        F.expr(
            "transform(sequence(1, length(block)), i -> struct(i AS p,"
            " xxhash64(around, concat(substring(block, 1, i - 1), substring(block, i + 1))) AS variant))"
        )
    )
    rows = scratch.keep(around.select("h1", "h2", "pos", F.inline(variants)))
    me = F.struct("pos", "h1", "h2")
    # equal variants deleted at one place: lines of equal length; with place 0: one has a character more
    same = rows.groupBy("variant", "p").agg(F.min(me).alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND p > 0")
    whole = rows.groupBy("variant").agg(
        F.min(F.when(F.col("p") == 0, me)).alias("short"), F.min(F.when(F.col("p") > 0, me)).alias("long")
    )
    whole = whole.filter("short IS NOT NULL AND long IS NOT NULL")
    pairs = (
        rows.join(same, ["variant", "p"])
        .select("h1", "h2", "pos", "other")
        .unionByName(rows.join(whole, "variant").select("h1", "h2", "pos", F.expr("if(p = 0, long, short)").alias("other")))
        .filter("other.pos < pos")
        .select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
        .distinct()
    )
    texts = scratch.keep(states.select("h1", "h2", "line").distinct())
    other = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    checked = pairs.join(texts, ["h1", "h2"]).join(other, ["o1", "o2"]).filter(F.levenshtein("line", "other", 1) == 1)
    return checked.select("h1", "h2").distinct()


def remove_lines(docs: DataFrame, near_from: int = NEAR_FROM) -> DataFrame:
    """Drop the lines of (doc_id, text) that stand, but for at most one edit, at an earlier place.

    Lines are what newlines part; places are ordered by doc_id, then by line. A line goes if an
    equal line stands earlier, or, from ``near_from`` characters on, if a line at an edit distance
    of one (a character changed, added or lost) has its first place earlier. Blank lines stay.
    Returns the columns of ``docs`` with the new text (and n_chars, if there is one) and with
    n_lines and n_removed, which replace columns of these names.

    Lines meet under hashes: every line states which half it shares with another; only lines that
    share one give their deletion variants, and each group of equal variants compares with its
    earliest line only, so that a group of any size gives one row per line. Texts move twice, to the
    lines that have a partner and to the final cut.

    A missing text stays missing and has no lines; a text of removed lines only becomes empty; a
    missing doc_id is the smallest; rows of equal doc_id and text are one document and each comes back
    with the same result; rows without doc_id or of one doc_id that differ in text are documents of
    their own, in the order of a hash of the text; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    # further columns travel as one, so that their names cannot clash
    others = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    whole = docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("row"))
    keyed = with_document_key(whole, scratch)
    source = keyed.select(F.col("_key").alias("doc_id"), "text")
    split = source.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    split = split.filter(F.btrim("line", F.lit(BLANKS)) != "")
    size = F.length("line")
    zero = F.lit(0)
    halves = [(size + more, lo, right) for more in (0, 1) for lo, right in _halves(size + more, zero, zero)]
    keys = F.array(*[_fixed(c, lo, right, F.col("line")) for c, lo, right in halves])
    lines = scratch.keep(
        split.select(
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(7), "line").alias("h2"),
            F.struct("doc_id", "line_no").alias("pos"),
            size.alias("size"),
            F.when(size >= near_from - 1, keys).otherwise(F.array().cast("array<long>")).alias("keys"),
        )
    )
    firsts = lines.groupBy("h1", "h2").agg(
        F.min("pos").alias("pos"), F.max("pos").alias("last"), F.first("size").alias("size"), F.first("keys").alias("keys")
    )
    firsts = scratch.keep(firsts)
    scratch.release()
    near = scratch.keep(_near(firsts.drop("last"), source, near_from, scratch))
    scratch.release()
    # a line with one place and no earlier neighbour has nothing to lose
    repeated = firsts.filter("pos != last").select("h1", "h2", F.col("pos").alias("first"))
    again = lines.select("h1", "h2", "pos").join(repeated, ["h1", "h2"]).filter("pos != first").select("pos")
    nearly = lines.select("h1", "h2", "pos").join(near, ["h1", "h2"]).select("pos")
    gone = again.unionAll(nearly).groupBy("pos.doc_id").agg(F.collect_set("pos.line_no").alias("_gone"))

    joined = keyed.join(gone.withColumnRenamed("doc_id", "_key").hint("shuffle_hash"), "_key", "left")
    cut = joined.withColumn("_lines", F.split("text", "\n", -1))
    left = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get(F.col("_lines"), i)
    )
    whole_text = F.col("_gone").isNull()
    cut = cut.withColumn("text", F.when(whole_text, F.col("text")).otherwise(F.array_join(left, "\n")))
    kinds = dict(docs.dtypes)

    def given(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col(name)
        own = F.col("row").getField(name)
        if name == "n_chars":
            own = F.when(whole_text, own).otherwise(F.length("text").cast(kinds[name]))
        return own.alias(name)

    def number(values: str) -> Column:
        return F.greatest(F.coalesce(F.size(values), F.lit(0)), F.lit(0)).cast("long")

    kept = [given(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*kept, number("_lines").alias("n_lines"), number("_gone").alias("n_removed"))


#: The same rows for (doc_id, n_lines, n_removed, text) over the view documents.
SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents
), firsts AS (
  SELECT line, length(line) AS n, min(doc_id * 100000000 + line_no) AS pos
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2
), states AS (
  SELECT line, n, pos, n + d AS c, side,
    CASE side WHEN 0 THEN left(line, (n + d) // 2) ELSE right(line, (n + d) // 2) END AS half
  FROM firsts, (VALUES (0), (1)) more(d), (VALUES (0), (1)) sides(side)
  WHERE n + d >= 20
), pairs AS (
  SELECT DISTINCT a.line AS line, b.line AS other, a.n AS n, b.n AS m
  FROM states a JOIN states b ON a.c = b.c AND a.side = b.side AND a.half = b.half AND b.pos < a.pos
), near AS (
  SELECT DISTINCT line FROM pairs, LATERAL (SELECT unnest(range(1, greatest(n, m) + 1)) AS p) places
  WHERE left(line, p - 1) = left(other, p - 1) AND (
    n = m AND substring(line, p + 1) = substring(other, p + 1)
    OR n = m + 1 AND substring(line, p + 1) = substring(other, p)
    OR m = n + 1 AND substring(line, p) = substring(other, p + 1))
), marked AS (
  SELECT l.doc_id, l.line_no, l.line,
    coalesce(f.pos < l.doc_id * 100000000 + l.line_no OR near.line IS NOT NULL, false) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near ON l.line = near.line
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
