"""Reading a repository's files and writing the index's tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.parse import MOST_BYTES, is_indexable
from loomgraph.sources.listing import SKIPPED, entries, ignore_rules, is_ignored, walk_names
from loomgraph.sources.tables import ship, written

#: Folders that the driver looks for before it hands the trees below them to tasks.
FAN = 64
#: Names that a task holds at once.
LISTED = 10_000


def _open(root: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))
    return files, base.rstrip("/")


def names(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified_ms, ignores) of all files below a folder without skipped folders; ignores: the text of an ignore file.

    The driver looks for folders from the top until it has enough of them, whose trees tasks then walk; files are listed by tasks
    only, those of the folders above too. Spark's own file source isn't used: it passes over names that start with an underscore or a dot.
    """
    ship(spark)
    files, top = _open(root)
    above, folders = [], [top]
    while folders and len(folders) < FAN:
        above.append(folders.pop(0))
        folders += [path for path, is_folder, _, _ in entries(files, above[-1]) if is_folder and path.rpartition("/")[2] not in SKIPPED]
    schema = "path string, size long, modified_ms long, ignores string"

    def walk_trees(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for folder, deep in zip(part["folder"], part["deep"], strict=True):
                found = walk_names(files, folder, top, deep=bool(deep))
                while rows := list(islice(found, LISTED)):
                    yield pd.DataFrame(rows, columns=["path", "size", "modified_ms", "ignores"])

    todo = [(f, False) for f in above] + [(f, True) for f in folders]
    return spark.createDataFrame(todo, "folder string, deep boolean").repartition(len(todo), "folder").mapInPandas(walk_trees, schema)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, text) of the indexable files below a folder, without skipped folders, ignored files and files above 2 MiB.

    Tasks list and read, so the folder must be one that they see; what comes to the driver is the ignore files.
    """
    files, top = _open(root)
    found = written(names(spark, root), "names")
    rules = ignore_rules([(r.path.rpartition("/")[0], r.ignores) for r in found.filter("ignores is not null").toLocalIterator()])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, size in zip(part["path"], part["size"], strict=True):
                if not is_ignored(path, rules):
                    with files.open_input_stream(f"{top}/{path}") as f:
                        rows.append((path, size, f.read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["path", "size", "text"])

    wanted = found.filter((F.col("size") <= MOST_BYTES) & F.col("ignores").isNull()).filter(is_indexable(F.col("path"))).select("path", "size")
    n = max(1, min(1000, wanted.count() // 50))
    return wanted.repartition(n).mapInPandas(read, "path string, size long, text string")


def export(files: DataFrame, root: str) -> int:
    """Write the texts of files (path, text) below a folder that all executors see; their number. A task that runs again writes the same."""
    ship(files.sparkSession)
    store, top = _open(root)

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, text in zip(part["path"], part["text"], strict=True):
                store.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{top}/{path}") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(part)]})

    return files.select("path", "text").mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def remove(paths: DataFrame, root: str) -> int:
    """Delete files (path) below a folder; their number."""
    ship(paths.sparkSession)
    store, top = _open(root)

    def drop(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            gone = 0
            for path in part["path"]:
                if store.get_file_info(f"{top}/{path}").type != fs.FileType.NotFound:
                    store.delete_file(f"{top}/{path}")
                    gone += 1
            yield pd.DataFrame({"n": [gone]})

    return paths.select("path").mapInPandas(drop, "n long").agg(F.sum("n")).first()[0] or 0


#: Buckets of a table by the hash of its key; one is rewritten if a change falls into it.
BUCKETS = 64


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number and content (folder by bucket) of a table's newest manifest; 0 without one."""
    store, at = _files(spark, f"{path}/manifests")
    names = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
    n = max((int(x.removesuffix(".json")) for x in names if x.endswith(".json")), default=0)
    if not n:
        return 0, {}
    return n, json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifests/{n}.json").collect()))


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table as its newest manifest has it; who reads an older one goes on with that one's files, which stay. Without a schema its files tell it."""
    _, folders = _manifest(spark, path)
    found = [f"{path}/{x}" for x in folders.values()]
    if schema is None:
        return spark.read.parquet(*found)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def upsert(changes: DataFrame, keys: list[str], path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table at a path with the rows of changes in place of those of the same key; one row a key in changes.

    Only buckets into which changes fall are read and written, into a new folder; the manifest that names it is written last and in
    one step, so readers see all of an upsert or nothing of it. One writer at a time.
    """
    spark, schema = changes.sparkSession, changes.schema
    n, folders = _manifest(spark, path)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    new = changes.select("*", bucket)
    touched = [str(r.bucket) for r in new.select("bucket").distinct().collect()]  # of a fixed number of buckets
    old = [f"{path}/{folders[b]}" for b in touched if b in folders]
    if old:
        kept = spark.read.schema(schema).parquet(*old).join(changes.select(*keys), keys, "left_anti").select(*schema.names)
        new = new.unionByName(kept.select("*", bucket))
    folder = f"data-{uuid.uuid4().hex}"
    new.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    named = folders | {b: f"{folder}/bucket={b}" for b in touched}
    store, at = _files(spark, f"{path}/manifests/{n + 1}.tmp")
    out = store.create(at)
    out.write(json.dumps(named, sort_keys=True).encode())
    out.close()
    store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{n + 1}.json"))
    return read_table(spark, path, schema)


def emit(events: DataFrame, path: str, last_id: int) -> None:
    """Append a batch of events (ts, kind, agent, symbol_handle, task, detail) to the log with the ids behind last_id, in order of ts.

    One writer appends at a time; ids of a batch are dealt by one window, so a batch is as large as one task can sort.
    """
    rows = events.withColumn("id", F.row_number().over(W.orderBy("ts", "kind")).cast("long") + F.lit(last_id))
    rows.select("id", "ts", "kind", "agent", "symbol_handle", "task", "detail").write.mode("append").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, as commands answer with."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
