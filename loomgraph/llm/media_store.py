"""Media columns: content-addressed payloads in tar shards, with metadata read off their headers.

A payload is stored as a lossless greyscale PNG of 64 samples a row, named by the SHA-256 of the payload, in a tar file in the
shared folder; a row carries the digest, the shard, the offset and the length. Payloads aren't shuffled: a task writes what it reads,
a digest once however often it meets it, so a payload that a third of all rows have is written once by each task. Of the places that
several tasks wrote a digest to, the index names the first; the other copies stay in their shards, where nothing leads to them. Only
digests and places are aggregated and joined.

Metadata columns come from range reads of a member's first bytes (PNG signature and header chunk), so a table of terabytes is
described by reading a few bytes a member. Only what asks for samples reads whole members, in the order they lie in, many ranges of a
shard by one task and one shard by many tasks.

A shard's rows are handed on once its file is closed, and the index is written as a table: a task that is run again writes another
file, and files of which the index names nothing are removed at the end.

Defined cases: a null text is empty; an empty payload is 64 zero bytes, as a payload has a positive multiple of 64; texts that differ
only in zero bytes at their end can share a payload. Rows that repeat a doc_id, or have none, each have a row in the result. Very long
texts are stored whole, each in memory by itself. An empty table gives an empty result and no shard; other columns of the input are
not looked at.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import drop_table, materialize, shared_dir, ship

WIDTH = 64
#: PNG's signature and the bytes up to the end of its header chunk; tar's block.
SIGNATURE, HEADER_BYTES, TAR_BLOCK = b"\x89PNG\r\n\x1a\n", 33, 512
#: Digests that a task remembers to have written; forgetting one costs a second copy, which the index doesn't name.
REMEMBERED = 200_000
INDEX = "digest binary, shard string, at long, length long"
METADATA = INDEX + ", format string, width long, height long, bit_depth int, channels int"
FEATURES = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """The payload as samples of a PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()  # filter 0: samples as they are
    packed, most = zlib.compress(lines, level), 1 << 30
    parts = [_chunk(b"IDAT", packed[i : i + most]) for i in range(0, len(packed), most)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def header(data: bytes) -> tuple[str, int, int, int, int]:
    """Format, width, height, bit depth and channels by a member's first bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return "png", width, height, depth, {0: 1, 2: 3, 4: 2, 6: 4}[colour]


def decode(media: bytes) -> bytes:
    """The payload of a PNG that encode() made; every chunk's checksum is tested."""
    _, width, height, _, _ = header(media[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while True:
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        at += 12 + n
        if kind == b"IEND":
            break
        packed.append(data)
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("samples with a filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, deviation (thousandths, as integers) and a 64-bit average hash over eight by eight blocks of samples."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    n, total = a.size, int(a.sum(dtype=np.int64))
    mean = 1000 * total // n
    spread = int(round(float(a.std(dtype=np.float64)) * 1000))
    by_column = a.reshape(len(a), 8, 8).sum(axis=2, dtype=np.int64)
    edges = [len(a) * i // 8 for i in range(9)]
    # Blocks are compared with the mean without division: 64 * sum against samples * mean.
    bits = [int(by_column[x:y, j].sum()) * n > total * max(1, (y - x) * 8) for x, y in zip(edges, edges[1:], strict=False) for j in range(8)]
    return f"{WIDTH}x{len(a)} mean={mean} std={spread} ahash={int(''.join('01'[b] for b in bits), 2):016x}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shard:
    """One tar file that is being written."""

    def __init__(self, store: str):
        self.uri = f"{store}/shard-{uuid.uuid4().hex}.tar"
        files, path = _open(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = files.open_output_stream(path)
        self.tar = tarfile.open(fileobj=self.sink, mode="w", format=tarfile.USTAR_FORMAT)
        self.rows: list[tuple] = []

    def add(self, digest: bytes, media: bytes) -> None:
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        self.rows.append((digest, self.uri, self.tar.offset + TAR_BLOCK, len(media)))
        self.tar.addfile(info, io.BytesIO(media))

    def close(self) -> pa.RecordBatch:
        self.tar.close()
        self.sink.close()
        return _batch(self.rows, INDEX)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def payload_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, digest (of the payload) and payload of each row; without Python."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("bytes"))
    n = F.octet_length("bytes")
    more = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH))).cast("int")
    payload = F.concat("bytes", F.substring(F.lit(bytes(WIDTH)), F.lit(1), more))
    return rows.select("doc_id", n.cast("long").alias("n_bytes"), F.unhex(F.sha2(payload, 256)).alias("digest"), payload.alias("payload"))


def _writer(store: str, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        shard = None
        for batch in batches:
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
                shard = shard or Shard(store)
                shard.add(digest, encode(payload.as_py()))
                if shard.tar.offset >= shard_bytes:
                    yield shard.close()
                    shard = None
        if shard:
            yield shard.close()

    return run


def write_store(payloads: DataFrame, store: str, shard_bytes: int = 256 << 20) -> DataFrame:
    """Index (digest, shard, at, length) of the payloads (digest, payload), stored in tar files of up to about shard_bytes below `store`; a digest has one place in it."""
    ship(payloads.sparkSession)
    stored = payloads.select("digest", "payload").mapInArrow(_writer(store, shard_bytes), INDEX)
    index = materialize(stored.groupBy("digest").agg(F.min(F.struct("shard", "at", "length")).alias("place")).select("digest", "place.*"), "media-index")
    _remove_unnamed(index, store)
    return index


def _remove_unnamed(index: DataFrame, store: str) -> None:
    """Files of tasks that were run again; their number, like the index's shards, follows the tasks, not the rows."""
    spark = index.sparkSession
    named = {r.shard.rpartition("/")[2] for r in index.select("shard").distinct().toLocalIterator()}
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for x in files.listStatus(path) if files.exists(path) else []:
        if x.getPath().getName() not in named:
            files.delete(x.getPath(), False)


def _ranges(index: DataFrame, span: int = 8 << 20) -> DataFrame:
    """The index dealt out by stretches of shards, in the order in which they lie there; the index is small, so the tasks are numbered by the bytes it points to."""
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // span)
    return index.repartition(n, "shard", F.expr(f"at div {span}")).sortWithinPartitions("shard", "at")


def _reading(fn: Callable, ddl: str, names: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn(row, read) over rows of an index, with read(n) for a member's first n bytes; the last shard stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_shard, file = None, None
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:names]), strict=True):
                if row[1] != at_shard:
                    if file:
                        file.close()
                    files, path = _open(row[1])
                    at_shard, file = row[1], files.open_input_file(path)
                rows.append(fn(row, lambda n: file.read_at(n, row[2])))  # noqa: B023
            yield _batch(rows, ddl)
        if file:
            file.close()

    return run


def read_metadata(index: DataFrame) -> DataFrame:
    """The index with format, width, height, bit_depth and channels, from the first 33 bytes of each member."""
    ship(index.sparkSession)
    return _ranges(index).select("digest", "shard", "at", "length").mapInArrow(_reading(lambda row, read: (*row, *header(read(HEADER_BYTES))), METADATA, 4), METADATA)


def _features(row: tuple, read: Callable[[int], bytes]) -> tuple:
    digest, _, _, length = row
    media = read(length)
    payload = decode(media)
    own = hashlib.sha256(payload)
    if own.digest() != digest:
        raise ValueError(f"member {digest.hex()} holds another payload")
    return digest, len(payload), own.hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)


def read_features(index: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: all from the stored bytes, read back whole and tested against their address."""
    ship(index.sparkSession)
    return _ranges(index).select("digest", "shard", "at", "length").mapInArrow(_reading(_features, FEATURES, 4), FEATURES)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", store: str | None = None, shard_bytes: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
    """Store df's texts; rows (doc_id, n_bytes, digest, shard, at, length, format, width, height, bit_depth, channels) and the store's index."""
    store = store or f"{shared_dir(df.sparkSession)}/loomgraph/media-{uuid.uuid4().hex}"
    rows = payload_rows(df, id_col, text_col)
    narrow = materialize(rows.select("doc_id", "n_bytes", "digest"), "media-rows")
    index = write_store(rows, store, shard_bytes)
    described = materialize(read_metadata(index), "media-metadata")
    drop_table(index)
    return narrow.join(described, "digest"), described


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and where the payload lies, for every row."""
    rows, index = media_columns(df, id_col, text_col, store)
    found = read_features(index)
    named = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return rows.join(found, "digest").select("doc_id", "n_bytes", *named, "shard", F.col("at").alias("offset"), "length", "format", "width", "height", "bit_depth", "channels")
