"""What the text operators share: shipping the package, shared tables, word hashing, Arrow plumbing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or a folder of our own where it is unset (local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="loomgraph-")
    return _own_dirs[app]


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="loomgraph-src-"), "loomgraph_src.zip")
    with zipfile.ZipFile(to, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("loomgraph", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


#: Spark's setting that drops an execution's shuffle files at its end.
CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings while a table is written: the above, and so many rows and bytes at once in a Python worker. Rows alone bound nothing where texts are long.
WRITING = dict.fromkeys(CLEANUP, "true") | {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors.

    Shuffle files of the write go with its end; the table holds all that later steps need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in WRITING}
    try:
        for key, value in WRITING.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by materialize() that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/loomgraph/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a Python worker keeps from task to task.
_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """make() once per worker process and key; what another operator kept goes, as workers are used again by whatever comes next."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Give up what other operators kept in this worker."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(doc_id long, text string, …) under fixed names: columns of the input that have our result's names do no harm."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


#: ASCII A-Z to a-z, other bytes unchanged except that ASCII non-alphanumerics become spaces.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it holds `most` words, so memory is bounded. A task that has one needs nothing that is kept."""

    def __init__(self, most: int = 50_000):
        super().__init__()
        forget()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def chain(*parts: np.ndarray) -> np.ndarray:
    """Hash of a sequence of equally long hash columns, position-dependent."""
    out = mix(parts[0] + np.uint64(0x9E3779B97F4A7C15))
    for p in parts[1:]:
        out = mix(out * np.uint64(0xD1342543DE82EF95) + p)
    return out
