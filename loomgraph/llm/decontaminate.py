"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of consecutive words. A block is the last BLOCK words of a search window. The
shift table tells how far the search may jump from a block; a shift of zero leads to the bucket of the block (the
patterns that end with it), and their words are compared directly. Patterns of equal length share one set of tables, so a
short item doesn't shorten the jumps of the long ones.

Defined cases: null text (of a document or an item) has no words; an item without words has no window; an empty
benchmark or an empty table of documents gives zero hits or no rows; an item with fewer words than a window is one
window; items with equal windows are all reported; all items without an item_id count as one, which has no name in the
list of items; repeated rows are each searched; whole texts are searched.
The benchmark is taken in blocks of at most `block_words` words on average, one after another, so what is broadcast at
a time is bounded; each document carries a bit per word from block to block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import byte_column, id_text, kept, materialize, plain_words, ship

WINDOW = 10
BLOCK = 2


class WuManber:
    """Patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str | None]]):
        self.m, self.b = length, min(BLOCK, length)
        self.jump = self.m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]] = {}
        for words, items in patterns.items():
            for end in range(self.b, self.m + 1):
                block = words[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.jump), self.m - end)
            self.bucket.setdefault(words[-self.b :], []).append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of each occurrence."""
        m, b, jump, shift, bucket, n = self.m, self.b, self.jump, self.shift.get, self.bucket, len(words)
        at = m
        while at <= n:
            block = (words[at - 2], words[at - 1]) if b == 2 else (words[at - 1],)
            far = shift(block, jump)
            if far:
                at += far
                continue
            window = tuple(words[at - m : at])
            for pattern, items in bucket[block]:
                if pattern == window:
                    yield at - m, items
            at += 1


class Benchmark:
    """Search tables of a block of items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for item, text in items:
            words = plain_words(text or b"")
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                owners = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
                if item not in owners:
                    owners.append(item)
        self.tables = [WuManber(m, p) for m, p in sorted(by_length.items())]

    def hits(self, words: list[bytes], bits: np.ndarray) -> set[str]:
        """Marks the words that are inside an occurrence; the items that occur."""
        found: set[str] = set()
        for t in self.tables:
            for start, items in t.search(words):
                bits[start : start + t.m] = 1
                found.update(items)
        return found


def _benchmark(key: str, items, window: int) -> Benchmark:
    """The tables of a block, built once per worker process."""
    return kept(key, lambda: Benchmark(items.value, window))


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    """The benchmark in parts of about block_words words; a hash of the item tells its part."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (6 * block_words)))
    return [items] if n == 1 else [items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i) for i in range(n)]


def search_benchmark(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = 400_000, keep_all: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    keep_all: return instead the input's own columns for the documents without any hit.
    """
    spark = docs.sparkSession
    blocks = _blocks(bench, item_col, item_text_col, block_words)
    spans = "__hit binary, __items array<string>"
    own = docs if keep_all else id_text(docs, id_col, text_col)
    own_text = text_col if keep_all else "text"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    final = fields if keep_all else "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    df = own
    for k, part in enumerate(blocks):
        first, last = k == 0, k == len(blocks) - 1
        rows = spark.sparkContext.broadcast([(r.item, r.text.encode() if r.text is not None else None) for r in part.toLocalIterator()])
        ship(spark)
        step = _scan(rows, uuid.uuid4().hex, window, first, last, own_text, keep_all)
        df = df.mapInArrow(step, final if last else f"{fields}, {spans}")
        if not last:
            df = materialize(df, "decontaminate")
    return df


def _scan(rows, key: str, window: int, first: bool, last: bool, text_col: str, keep_all: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _benchmark(key, rows, window)
        for batch in batches:
            texts = byte_column(batch, text_col)
            own = batch.schema.names if first else batch.schema.names[:-2]
            before = [None] * len(texts) if first else batch.column(len(own)).to_pylist()
            items_before = [None] * len(texts) if first else batch.column(len(own) + 1).to_pylist()
            out, hit_bytes, hit_items = [], [], []
            for text, bits_before, found_before in zip(texts, before, items_before, strict=True):
                words = plain_words(text or b"")
                bits = np.zeros(len(words), np.uint8) if bits_before is None else np.unpackbits(np.frombuffer(bits_before, np.uint8), count=len(words))
                found = bench.hits(words, bits) | set(found_before or ())
                if last:
                    out.append((len(words), int(bits.sum()), len(found), hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest()))
                else:
                    hit_bytes.append(np.packbits(bits).tobytes())
                    hit_items.append(list(found))
            if not last:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(hit_bytes, pa.binary()), pa.array(hit_items, pa.list_(pa.string()))], [*own, "__hit", "__items"])
            elif keep_all:
                clean = batch.filter(pa.array([x[1] == 0 for x in out], pa.bool_()))
                yield pa.RecordBatch.from_arrays(clean.columns[: len(own)], own)
            else:
                n_words, n_hit, n_items, digest = ([x[i] for x in out] for i in range(4))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return run
