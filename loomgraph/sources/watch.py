"""A folder as a stream: what appeared, changed and went since the last look.

The offset is the number of a listing (paths with size and time), which is kept beside the checkpoint until the batch behind it is
done; a batch is the difference between two listings, so it tells of deletions and goes on after a restart where the last one
stopped. Listing is the work of one process, as with Spark's own file streams; files are read by the executors.

A listing is a folder of buckets by the hash of a path, and listings are written and compared bucket by bucket, so the process that
lists holds one bucket at a time, whatever the number of files. Tasks are told which changes of which bucket are theirs, not the
paths, and find them in the listings.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import tempfile
import zlib

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomgraph.sources.listing import walk_kept

#: Buckets of a listing, and how many files are held while they are dealt out.
BUCKETS, HELD = 1024, 50_000

SCHEMA = "path string, change string, modified_ms long, size long, text string"


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Part(InputPartition):
    """Changes that one task reads: pieces (bucket, first, end) of the changes between two listings, each in the order of its bucket."""

    def __init__(self, before: int, now: int, pieces: list[tuple[int, int, int]]):
        self.before, self.now, self.pieces = before, now, pieces


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files, self.root = at(options["path"])
        self.root = self.root.rstrip("/")
        self.store, self.listings = at(options["listings"])
        self.per_task = int(options.get("filespertask", "200"))
        self.store.create_dir(self.listings, recursive=True)

    def _numbers(self) -> list[int]:
        """Of the listings that are whole: the digests are written last."""
        found = [x.base_name for x in self.store.get_file_info(fs.FileSelector(self.listings)) if x.base_name.isdigit()]
        whole = self.store.get_file_info([f"{self.listings}/{x}/digests.json" for x in found]) if found else []
        return sorted(int(x) for x, at in zip(found, whole, strict=True) if at.type == fs.FileType.File)

    def _digests(self, n: int) -> dict[str, str]:
        """Of each bucket of a listing that has files, by its number."""
        if not n:
            return {}
        with self.store.open_input_stream(f"{self.listings}/{n}/digests.json") as f:
            return json.loads(f.read())

    def _load(self, n: int, bucket: int, there: bool) -> dict[str, list[int]]:
        """(size, time) by path of a bucket; there: whether it has files."""
        if not there:
            return {}
        with self.store.open_input_stream(f"{self.listings}/{n}/{bucket}.json") as f:
            return json.loads(f.read())

    def _deal(self, near: str) -> dict[str, str]:
        """List what is there now into files by bucket in a folder of this process; their digests."""
        rows: dict[int, list[str]] = {}

        def put() -> None:
            for bucket, lines in rows.items():
                with open(f"{near}/{bucket}.json", "a") as f:
                    f.writelines(lines)
            rows.clear()

        for i, (path, size, when) in enumerate(walk_kept(self.files, self.root), 1):
            rows.setdefault(zlib.crc32(os.fsencode(path)) % BUCKETS, []).append(json.dumps([path, size, when]) + "\n")
            if i % HELD == 0:
                put()
        put()
        digests = {}
        for name in os.listdir(near):
            with open(f"{near}/{name}") as f:
                text = json.dumps({path: [size, when] for path, size, when in map(json.loads, f)}, sort_keys=True)
            with open(f"{near}/{name}", "w") as f:
                f.write(text)
            digests[name.removesuffix(".json")] = hashlib.sha256(text.encode()).hexdigest()
        return digests

    def _changes(self, part: Part, bucket: int, old: dict, new: dict) -> list[tuple]:
        """(path, change, time, size) in a bucket, in a fixed order; old, new: the listings' digests."""
        was, now = self._load(part.before, bucket, str(bucket) in old), self._load(part.now, bucket, str(bucket) in new)
        changes = [(p, "added" if p not in was else "modified", when, size) for p, (size, when) in sorted(now.items()) if was.get(p) != [size, when]]
        return changes + [(p, "deleted", when, size) for p, (size, when) in sorted(was.items()) if p not in now]

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._numbers(), default=0)
        with tempfile.TemporaryDirectory(prefix="listing-") as near:
            now = self._deal(near)
            if now != self._digests(last):
                last += 1
                to = f"{self.listings}/{last}"
                self.store.create_dir(to, recursive=True)
                for bucket in now:
                    with open(f"{near}/{bucket}.json", "rb") as f, self.store.open_output_stream(f"{to}/{bucket}.json") as out:
                        out.write(f.read())
                with self.store.open_output_stream(f"{to}/digests.tmp") as f:
                    f.write(json.dumps(now, sort_keys=True).encode())
                self.store.move(f"{to}/digests.tmp", f"{to}/digests.json")
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """Of buckets with few changes, several go to one task; of those with many, one goes to several."""
        old, new = self._digests(start["listing"]), self._digests(end["listing"])
        out, room = [], 0
        for bucket in sorted(int(x) for x in old.keys() | new.keys() if old.get(x) != new.get(x)):
            first, n = 0, len(self._changes(Part(start["listing"], end["listing"], []), bucket, old, new))
            while first < n:
                if not room:
                    out.append(Part(start["listing"], end["listing"], []))
                    room = self.per_task
                taken = min(room, n - first)
                out[-1].pieces.append((bucket, first, first + taken))
                first, room = first + taken, room - taken
        return out

    def read(self, part: Part):
        old, new = self._digests(part.before), self._digests(part.now)
        for bucket, first, end in part.pieces:
            for path, change, when, size in self._changes(part, bucket, old, new)[first:end]:
                text = None
                if change != "deleted":
                    try:
                        with self.files.open_input_stream(f"{self.root}/{path}") as f:
                            text = f.read().decode("utf-8", "replace")
                    except FileNotFoundError:
                        continue  # gone meanwhile: the next listing says so
                yield path, change, when, size, text

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["listing"]:
                self.store.delete_dir(f"{self.listings}/{n}")


class FolderSource(DataSource):
    """spark.readStream.format("folder"): options path, listings (a folder to keep listings in) and filespertask."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})


def watch(spark: SparkSession, root: str, listings: str, files_per_task: int = 200) -> DataFrame:
    """A stream of (path, change, modified_ms, size, text) below a folder: added, modified and deleted files, those with names that start with a dot or an underscore too, without skipped folders and ignored files."""
    # By value: the processes that plan a Python source don't get the files that were sent to the workers.
    modules = [sys.modules[__name__], sys.modules["loomgraph.sources.listing"]]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        spark.dataSource.register(FolderSource)
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)
    return spark.readStream.format("folder").option("path", root).option("listings", listings).option("filesPerTask", str(files_per_task)).load()


def to_look_at(batch: DataFrame) -> tuple[DataFrame, bool]:
    """(path, text) of what a batch wants read again, and whether the scan behind it must be a full one, as something is gone."""
    gone = not batch.filter("change = 'deleted'").isEmpty()
    return batch.filter("change <> 'deleted'").select("path", "text"), gone
