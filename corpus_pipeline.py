"""Corpus pipeline: quality, exact dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet and read
again. All but the last return the columns of `documents`.

Defined cases: decisions belong to a row, by its doc_id and text, so rows that share a doc_id are judged each by its own text. A
row without doc_id goes through all stages like the others; in dedup it gives way to equal or similar rows with one. Of rows with
equal doc_id and equal text one stays. Rows that share a doc_id and differ in text are one document to near dedup, and stay or
go together. A null or empty text is rejected by the quality stage. An empty table gives an empty result; without labels all
documents with words pass the quality stage; an empty benchmark takes nothing away. Very long texts are taken whole. Columns
beside those of `documents` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe import bpe_encode
from loomgraph.llm.common import materialize, table
from loomgraph.llm.decontaminate import search_benchmark
from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.near_dedup import near_duplicates
from loomgraph.llm.quality import classify_quality

ORACLE_SQL = None
KEY = "__pipeline_key"


def row_key(digest: Column) -> Column:
    """Key of a row: its doc_id, null too, and a digest of its text."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), digest), 256))


def keep(docs: DataFrame, key: Column, decisions: DataFrame, once: bool = False) -> DataFrame:
    """Rows of docs whose key is in decisions (key); with `once`, one row for each key, over the same shuffle."""
    kept = docs.withColumn(KEY, key).join(decisions.select(F.col("key").alias(KEY)).distinct(), KEY, "left_semi")
    return (kept.dropDuplicates([KEY]) if once else kept).select(*docs.columns)


def text_digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity isn't above their language's limit."""
    key = row_key(text_digest())
    return keep(docs, key, classify_quality(docs, table(spark, sf_dir, "labels"), key=key).filter("accepted"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id."""
    kept = exact_dedup(docs).filter("kept").select(row_key(F.col("text_sha256")).alias("key"))
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return keep(docs, row_key(F.sha2(normal, 256)), kept, once=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles, the one with the smallest doc_id."""
    # Rows without doc_id get one above all others, by their text.
    above = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62)) + F.lit(1 << 62)
    own = F.coalesce(F.col("doc_id").cast("long"), above)
    found = near_duplicates(docs.select(own.alias("doc_id"), "text")).filter("kept")
    return keep(docs, own, found.select(F.col("doc_id").alias("key")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    # As a table: whoever writes it otherwise has 10,000 whole texts at once in each worker.
    return materialize(search_benchmark(docs, table(spark, sf_dir, "benchmark"), keep_all=True), "clean")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    import public_tokenizers

    return materialize(bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json")), "tokens")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
