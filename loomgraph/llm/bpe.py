"""Byte-level BPE encoding and decoding, merging by a segment tree over adjacent pair ranks.

A text is cut at the strings of the added tokens, the rest into pieces by the vocabulary's pattern. A piece is a linked
list of symbols; leaf i of the segment tree holds the rank of the pair that starts at symbol i (and i itself, so the
smallest value is the leftmost pair of lowest rank). The root names the next merge; a merge changes three leaves, each
in logarithmic time. A single space between two characters that aren't white space always starts a piece, so a text falls into chunks
there. Chunks and pieces already seen are remembered up to a bound, so pattern and tree run for few of them.

Defined cases: null text counts as empty and has no tokens; an empty table gives an empty result; very long pieces take
n log n steps; repeated rows are encoded each; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomgraph.llm.common import id_text, kept, ship

#: Fixed value: how the byte-level pre-tokenizer cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Above every key rank << 32 | position.
NONE = 1 << 62
#: Each cache has two generations of so many entries.
CHUNKS_KEPT, PIECES_KEPT = 600_000, 500_000
#: A space at which any text can be cut without changing its pieces.
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SegmentTree:
    """Minimum of a list of ints under point updates; t[1] is the least of all (t[0] of none)."""

    def __init__(self, values: list[int]):
        self.n = n = len(values)
        self.t = t = [NONE] * n + values
        for i in range(n - 1, 0, -1):
            x, y = t[2 * i], t[2 * i + 1]
            t[i] = x if x < y else y

    def put(self, i: int, value: int) -> None:
        t = self.t
        i += self.n
        t[i] = value
        while i > 1:
            other = t[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if t[i] == value:
                return
            t[i] = value


class UnsafeCut(Exception):
    """A chunk that has white space at an end, or nothing at all."""


class Remembered(dict):
    """Results of a function of strings. When `most` are held they become the elder generation, and the former one goes."""

    def __init__(self, fn, most: int):
        super().__init__()
        self.fn, self.most, self.elder = fn, most, {}

    def __missing__(self, key: str) -> bytes:
        made = self.elder.get(key)
        if made is None:
            made = self.fn(key)
            if len(key) > 64:
                return made
        if len(self) >= self.most:
            self.elder = dict(self)
            self.clear()
        self[key] = made
        return made


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        letter = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letter[c] for c in word) for word, i in vocab.items()}
        self.byte_id = [0] * 256
        for c, b in letter.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: word.encode() for word, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.pieces = regex.compile(PATTERN)
        self.piece_ids = Remembered(lambda p: np.array(self.merge(p.encode("utf-8", "surrogatepass")), "<u4").tobytes(), PIECES_KEPT)
        self.chunk_ids = Remembered(self.after_space, CHUNKS_KEPT)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        sym = [*map(self.byte_id.__getitem__, data)]
        n = len(sym)
        if n < 2:
            return sym
        merges = self.merges
        found = [*map(merges.get, zip(sym, sym[1:], strict=False))]
        tree = SegmentTree([NONE if m is None else m[0] << 32 | i for i, m in enumerate(found)])
        t, put = tree.t, tree.put
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while (low := t[1]) != NONE:
            i = low & 0xFFFFFFFF
            j = after[i]
            sym[i] = new = found[i][1]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                put(j, NONE)
                before[k] = i
                m = found[i] = merges.get((new, sym[k]))
                put(i, NONE if m is None else m[0] << 32 | i)
            else:
                put(i, NONE)
                if j < n - 1:
                    put(j, NONE)
            if (p := before[i]) >= 0:
                m = found[p] = merges.get((sym[p], new))
                put(p, NONE if m is None else m[0] << 32 | p)
        return [s for s in sym if s >= 0]

    def by_pieces(self, text: str) -> bytes:
        """Ids of a text without added tokens, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.piece_ids.__getitem__, self.pieces.findall(text)))

    def after_space(self, chunk: str) -> bytes:
        """Ids of a space followed by a chunk."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise UnsafeCut
        return self.by_pieces(" " + chunk)

    def by_chunks(self, text: str) -> bytes:
        """The same as by_pieces, chunk by chunk."""
        for chunks in (text.split(" "), SAFE_SPACE.split(text)):
            if len(chunks) > 1 and chunks[0] and not chunks[0][-1].isspace():
                try:
                    return self.by_pieces(chunks[0]) + b"".join(map(self.chunk_ids.__getitem__, chunks[1:]))
                except UnsafeCut:
                    continue
        return self.by_pieces(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text."""
        if not self.cut or not any(word in text for word in self.added):
            return self.by_chunks(text)
        return b"".join(np.array([self.added[part]], "<u4").tobytes() if part in self.added else self.by_chunks(part) for part in self.cut.split(text) if part)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def run(self, text: str) -> tuple[bytes, bytes]:
        """Of a text: its ids as bytes, and the bytes that these ids decode to."""
        ids = self.encode(text)
        return ids, self.decode(ids)


def _loaded_bpe(source: bytes) -> ByteBPE:
    return kept(hashlib.sha256(source).hexdigest(), lambda: ByteBPE(source))


def bpe_encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens and ids_sha256, decoded_sha256 (digests) or else ids array<int>, decoded string.

    The driver reads the vocabulary file (of fixed size) and broadcasts its content.
    """
    with open(vocab_path, "rb") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded_bpe(source.value)
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                ids, back = bpe.run(text or "")
                n.append(len(ids) // 4)
                if digests:
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
                else:
                    first.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    second.append(back.decode("utf-8", "replace"))
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())], names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return id_text(df, id_col, text_col).mapInArrow(run, schema)
