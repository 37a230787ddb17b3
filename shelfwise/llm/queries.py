"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import anchors, decontaminate, licenses, lm, merkle, neardup, packing, pii, quality, secrets, suffixes, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back: its payload's size and digest, and what it revisits."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the ordered rules."""
    return quality.judged(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in one slot of a token-budget batch of its length bucket."""
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts, the base digest, and all spans."""
    found = pii.spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, z -> z.base and z.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(only_base=True), 256).alias("base_sha256"), pii.joined().alias("spans"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts, the base digest, and all spans."""
    found = secrets.spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, z -> z.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(only_base=True), 256).alias("base_sha256"), secrets.joined().alias("spans"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) whose question and answer stand in the document."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return neardup.classes(table(spark, sf_dir, "documents"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that a smaller document has."""
    return suffixes.repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (a, x) -> a + x.end - x.start)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license wording in every document."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under the base counts and under the trained model."""
    return lm.scores(table(spark, sf_dir, "documents"))


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its subroot, the root and its proof; a third of the texts are tampered with and checked."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower)
    return merkle.verified(merkle.manifest(docs, tampered)).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


@query
def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 20-word sequences that start earlier."""
    return anchors.repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.expr("aggregate(removed, 0L, (a, x) -> a + x.end - x.start)").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 16 leading components, whitened, with its exact deviation from the mean."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
