"""How filters of a corpus interact, in every order they can be applied.

Documents are routed by a fingerprint of their text (RDD, partitioned by xxhash). A partition keeps, for each fingerprint, a chain
of the different texts that share it, in full, with the smallest id of each: equal fingerprints of different texts do no harm. Each
id that isn't the smallest of its text is emitted as a copy. Before the shuffle each task does the same with what it reads, so a text
that a third of all rows have leaves a task once, and its copies are emitted where they are read, spread by their ids. Then every
document is one number, the mask of the filters it fails; combineByKey adds up vectors of counts by mask for each part, and all
orders follow from these 32 counts.

Defined cases: a null text is empty, a null part is the empty string. A row without doc_id is no copy and makes none. Rows that share
a doc_id are judged each by its own text; rows with equal doc_id and equal text are no copies of each other. Of several labels of a
document one that says so is enough. Very long texts are compared in whole. An empty table gives an empty result; other columns of
the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ship

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
UPPER = bytes(range(65, 91))
MARKS = re.compile(rb"[#$%&*|]")
#: Bytes of text that a task holds before it hands on what it has.
HELD = 32 << 20
#: Bytes of text by which the partitions of the shuffle are numbered; a partition holds its different texts.
ROUTED = 64 << 20
#: Bytes that a held text takes beside its own, roughly.
ENTRY = 500
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failures(text: bytes) -> int:
    """Mask of the filters that a text fails by itself: A few words, B repeated words, C capitals, D marks."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, UPPER))
    points = len(text.decode("utf-8", "replace"))
    fails = (n < 50, 100 * len(set(words)) < 65 * n, 100 * capitals > 5 * points, MARKS.search(text) is not None)
    return sum(1 << i for i, x in enumerate(fails) if x)


class Chains:
    """By fingerprint, the texts seen with their mask, smallest id and how many rows of each part have that id."""

    def __init__(self):
        self.by_print: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, mask: int | None, doc: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Take in rows of one text and id; yields (id, part, mask, rows) of the ids that turn out not to be the smallest."""
        chain = self.by_print.setdefault(key, [])
        held = next((x for x in chain if x[0] == text), None)
        if held is None:
            chain.append([text, failures(text) if mask is None else mask, doc, dict(parts)])
            self.bytes += len(text) + ENTRY
        elif doc == held[2]:
            for p, n in parts.items():
                held[3][p] = held[3].get(p, 0) + n
        else:
            loser, lost = (doc, parts) if doc > held[2] else (held[2], held[3])
            if doc < held[2]:
                held[2:] = [doc, dict(parts)]
            for p, n in lost.items():
                yield loser, p, held[1] | COPY, n

    def heads(self) -> Iterator[tuple]:
        """(fingerprint, text, mask, smallest id, rows by part) of all that is held, which is then empty."""
        for key, chain in self.by_print.items():
            for text, mask, doc, parts in chain:
                yield key, text, mask, doc, parts
        self.__init__()


def fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _read(rows: Iterable, held: int, hashed=fingerprint) -> Iterator[tuple]:
    """A task's rows as (key, text or None, mask, id, rows by part): texts by their fingerprint, what is decided already spread by its id."""
    chains = Chains()
    settled = lambda found: ((xxhash.xxh3_64_intdigest(str(doc)), None, mask, doc, {p: n}) for doc, p, mask, n in found)
    for doc, text, part in rows:
        text = bytes(text)
        if doc is None:
            yield from settled([(None, part, failures(text), 1)])
        else:
            yield from settled(chains.add(hashed(text), text, None, doc, {part: 1}))
        if chains.bytes > held:
            yield from chains.heads()
    yield from chains.heads()


def _settle(rows: Iterable) -> Iterator[tuple]:
    """(id, part, mask, rows) of all that came to a partition."""
    chains = Chains()
    for key, (text, mask, doc, parts) in rows:
        if text is None:
            yield from ((doc, p, mask, n) for p, n in parts.items())
        else:
            yield from chains.add(key, text, mask, doc, parts)
    for _, _, mask, doc, parts in chains.heads():
        yield from ((doc, p, mask, n) for p, n in parts.items())


def routed(docs: DataFrame, held: int = HELD, hashed=fingerprint) -> RDD:
    """(id, part, mask, rows) of every document of docs (doc_id, text, part), once its text has met all equal ones."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), F.coalesce(F.col("part").cast("string"), F.lit("")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROUTED))
    return plain.rdd.mapPartitions(lambda part: ((x[0], x[1:]) for x in _read(part, held, hashed))).partitionBy(n, lambda key: key).mapPartitions(_settle)


def filter_masks(docs: DataFrame, held: int = HELD, hashed=fingerprint) -> DataFrame:
    """doc_id, part, mask (bit i: fails the filter FILTERS[i]), rows."""
    return docs.sparkSession.createDataFrame(routed(docs, held, hashed), "doc_id long, part string, mask int, rows long", verifySchema=False)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of the documents whose text a smaller id has."""
    return filter_masks(docs).filter(F.col("mask").bitwiseAND(COPY) > 0).select("doc_id")


def interactions(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of the result for one part. counts[k, mask]: all documents, good and toxic ones, by mask."""
    masks = np.arange(MASKS)
    made, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out = (masks & before == 0) & (masks & bit > 0)
            total = lambda k, chosen: int(counts[k][chosen].sum())
            removed = total(0, out)
            made.append((part, order, step, total(0, masks & (before | bit) == 0), removed, total(0, (masks & before > 0) & (masks & bit > 0)), int(counts[0][bit]), total(1, out), total(2, out), letter))
            shapley[letter] += removed
            before |= bit
    for *row, letter in made:
        yield (*row, shapley[letter])


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _counted(row) -> np.ndarray:
    return _added(np.zeros((3, MASKS), np.int64), row)


def _added(counts: np.ndarray, row) -> np.ndarray:
    mask, n, good, toxic = row
    counts[0, mask] += n
    counts[1, mask] += n * good
    counts[2, mask] += n * toxic
    return counts


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source", held: int = HELD) -> DataFrame:
    """One row for each part, each of the 120 orders of the filters and each of its steps: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", F.col(part).alias("part"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    rows = filter_masks(own, held).join(said, "doc_id", "left").select("part", "mask", "rows", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.rdd.map(lambda r: (r[0], r[1:])).combineByKey(_counted, _added, np.add, numPartitions=n, partitionFunc=lambda p: fingerprint(p.encode()))
    return spark.createDataFrame(counts.flatMap(lambda x: interactions(*x)), RESULT, verifySchema=False)
