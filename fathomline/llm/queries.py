"""The named queries of the corpus operators over the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import bpe, caps, centroids, counts, decontaminate, lines, quality, secrets, shards, simhash, suffix, toxicity, trie
from fathomline.llm.common import Scratch, table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of 3-word shingles and the groups that link at two or fewer bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=3, distance=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every text; each distinct text is scanned once and its findings go to all its documents."""
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


def op3_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors linked at a cosine of 0.9 or more, and the least of each group."""
    return caps.near_duplicates(table(spark, folder, "embeddings"), 0.9)


def op4_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text when bytes under a 100-byte string that starts earlier are cut."""
    cut = suffix.remove_repeats(table(spark, folder, "documents"), 100)
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def vocabulary(file: str = "word_bpe_49k.json", setting: str = "WORD_BPE_FILE") -> str:
    """Path of a public vocabulary file; the environment setting overrides the installed one."""
    if setting in os.environ:
        return os.environ[setting]
    import public_tokenizers

    return public_tokenizers.path(file)


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of encoding every text and decoding it again."""
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary())


def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards 0 to 23 of nearly equal bytes."""
    placed = shards.kd_shards(table(spark, folder, "documents"), 24)
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", none)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every restored text by a model that never reads the labels of the held-out fold."""
    docs = table(spark, folder, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, folder, "labels"), Scratch(spark)))


def op8_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every text without the lines that stand, but for one edit, at an earlier place."""
    return lines.remove_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with how many of its shingles they have."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text by a machine that never reads the labels of the held-out fold."""
    docs = table(spark, folder, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, folder, "labels"), Scratch(spark)))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text by the byte-level vocabulary, and whether they are over 512."""
    return counts.token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json", "BYTE_BPE_FILE"))


def op12_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations, with counts per node."""
    return trie.prefix_trie(table(spark, folder, "conversations"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors in 40 clusters after five rounds in whole numbers."""
    return centroids.cluster(table(spark, folder, "embeddings"), k=40, rounds=5, dims=64)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_caps": op3_caps,
    "op4_suffix": op4_suffix,
    "op5_bpe": op5_bpe,
    "op6_shards": op6_shards,
    "op7_toxicity": op7_toxicity,
    "op8_lines": op8_lines,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_counts": op11_token_counts,
    "op12_trie": op12_trie,
    "op13_centroids": op13_centroids,
}

#: SQL for the queries that SQL can express on whole tables; the others are tested by brute force.
SQL: dict[str, str] = {
    "op8_lines": lines.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op12_trie": trie.SQL,
    "op13_centroids": centroids.SQL,
}
