import hashlib
import io
import os
import random
import tarfile
import zlib

import pytest

from loomgraph.llm import media_store as ms
from loomgraph.llm.common import shared_dir


def payload_of(text):
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 if data else 64)


def made_up():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc é中\n") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    return [*enumerate(texts), (100, None), (101, ""), (102, "same" * 16), (103, "same" * 16), (None, "same" * 16), (103, "other"), (104, "x" * 3_000_000), (105, "a"), (106, "a\0")]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 5000])
def test_round_trip(n):
    payload = ms.padded(bytes(random.Random(n).randbytes(n)))
    media = ms.encode(payload)
    assert ms.decode(media) == payload
    assert ms.header(media[:33]) == ("png", 64, len(payload) // 64, 8, 1)
    with pytest.raises(ValueError, match="damaged|header"):
        ms.decode(media[:40] + bytes([media[40] ^ 1]) + media[41:])


def test_every_row_against_its_text(spark):
    rows = made_up()
    found = ms.media_features(table_of(spark, rows).selectExpr("*", "'p' as shard", "1 as digest", "'q' as payload"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, len((t or "").encode()), len(p := payload_of(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), ms.feature(p)) for i, t in rows), key=key)
    out = found.collect()
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in out), key=key) == want
    by_text = {}
    for r in out:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.shard, r.offset))
        assert (r.format, r.width, r.height, r.bit_depth, r.channels, r.length) == ("png", 64, r.payload_bytes // 64, 8, 1, r.media_bytes)
    assert all(len(x) == 1 for x in by_text.values())


def test_shards_are_tar_files_and_a_payload_has_one_place(spark):
    store = f"{shared_dir(spark)}/media-test-{random.randrange(1 << 40):x}"
    df = table_of(spark, made_up()).repartition(7)
    _, index = ms.media_columns(df, store=store, shard_bytes=4096)
    places = {(os.path.basename(r.shard), r["at"]): (bytes(r.digest), r["length"]) for r in index.collect()}
    folder, seen = store.removeprefix("file:"), []
    assert {s for s, _ in places} == {x for x in os.listdir(folder) if x.endswith(".tar")} and len({s for s, _ in places}) > 3
    for name in {s for s, _ in places}:
        with tarfile.open(f"{folder}/{name}") as tar:
            for member in tar.getmembers():
                if (name, member.offset_data) not in places:
                    continue  # a copy that another task wrote too
                digest, length = places[name, member.offset_data]
                data = tar.extractfile(member).read()
                assert member.name == f"{digest.hex()}.png" and len(data) == length and hashlib.sha256(ms.decode(data)).digest() == digest
                seen.append(digest)
    assert len(seen) == len(set(seen)) == len({payload_of(t) for _, t in made_up()})


def test_a_task_writes_a_payload_once(spark):
    store = f"{shared_dir(spark)}/media-test-{random.randrange(1 << 40):x}"
    _, index = ms.media_columns(spark.range(4000, numPartitions=4).selectExpr("id as doc_id", "concat('text ', id % 3) as text"), store=store)
    members = 0
    for name in os.listdir(store.removeprefix("file:")):
        if name.endswith(".tar"):
            with tarfile.open(f"{store.removeprefix('file:')}/{name}") as tar:
                members += len(tar.getmembers())
    assert index.count() == 3 and members <= 12


def test_metadata_reads_headers_only(spark):
    asked = []
    row = (b"d", "", 0, 0)
    media = ms.encode(ms.padded(b"q" * 700))
    stream = io.BytesIO(media)
    read = lambda n: asked.append(n) or stream.getvalue()[:n]
    assert (*row, *ms.header(read(ms.HEADER_BYTES)))[4:] == ("png", 64, 11, 8, 1)
    assert asked == [33]


def test_a_damaged_store_is_an_error(spark):
    store = f"{shared_dir(spark)}/media-test-{random.randrange(1 << 40):x}"
    _, index = ms.media_columns(table_of(spark, [(1, "some text")]), store=store)
    at = index.first()
    path = at.shard.removeprefix("file://").removeprefix("file:")
    with open(path, "r+b") as f:
        f.seek(at["at"] + at["length"] - 30)
        f.write(b"\xff\xff")
    with pytest.raises(Exception, match="damaged|zlib|invalid"):
        ms.read_features(index).collect()


def test_files_that_nothing_names_go(spark):
    store = f"{shared_dir(spark)}/media-test-{random.randrange(1 << 40):x}"
    folder = store.removeprefix("file:")
    os.makedirs(folder)
    open(f"{folder}/shard-lost.tar", "w").close()
    ms.media_columns(table_of(spark, [(1, "a")]), store=store)
    assert not os.path.exists(f"{folder}/shard-lost.tar")


def test_empty_table(spark):
    assert ms.media_features(table_of(spark, [])).count() == 0
