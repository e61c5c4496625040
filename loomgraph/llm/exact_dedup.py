"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of each partition's digests is merged into at most `counters` candidates. Their exact sizes and
winners are counted (partial aggregation, so a digest that holds a third of all rows costs one row per task), and these
at most `counters` verified rows are broadcast: rows of heavy digests are decided on the map side and never shuffled.
The other digests, none of which has more than 1/(counters+1) of all rows, take an ordinary shuffle.

Defined cases: null text counts as empty; an empty table gives an empty result; of equal texts the smallest doc_id
stays; a null doc_id sorts after all others, and rows that repeat a doc_id share its decision; very long texts are
digested whole; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import byte_column, id_text, map_batches, materialize

SPACE = b"\t\n\v\f\r "


def normalise(text: bytes) -> bytes:
    """Each run of white space (\\x09-\\x0D, \\x20) becomes one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in SPACE else b"") + b" ".join(words) + (b" " if text[-1] in SPACE else b"")


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = [hashlib.sha256(normalise(t or b"")).digest() for t in byte_column(batch, "text")]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "digest"])


def misra_gries(items, counters: int) -> dict:
    """At most `counters` items; each item that is more than 1/(counters+1) of the input is among them."""
    kept: dict = {}
    for x in items:
        if x in kept:
            kept[x] += 1
        elif len(kept) < counters:
            kept[x] = 1
        else:
            kept = {k: n - 1 for k, n in kept.items() if n > 1}
    return kept


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text)."""
    return map_batches(id_text(df, id_col, text_col), _digests, "doc_id long, digest binary")


def heavy_digests(prints: DataFrame, counters: int) -> DataFrame:
    """digest, keep_id, group_size of at most `counters` digests, exact, among them each that more than 1/(counters+1) of all rows have.

    Summaries merge by adding up their counts: the largest `counters` sums have what the merged summary would keep.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = misra_gries((d for b in batches for d in b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "n"])

    merged = prints.select("digest").mapInArrow(summarise, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    chosen = merged.orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    return prints.join(F.broadcast(chosen), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of df."""
    prints = materialize(fingerprints(df, id_col, text_col), "digests")
    heavy = materialize(heavy_digests(prints, counters).coalesce(1), "heavy")
    split = F.broadcast(heavy)
    light = prints.join(split, "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rows = prints.join(split, "digest").unionByName(light.join(groups, "digest"))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
