"""Language-model scoring by online logistic context mixing.

A token (a word of the lower-cased text, or the end of a document) is spelled as its bytes and one closing space, eight bits
each. Every bit is predicted in several contexts: the position, the last 1 to 4 bytes and the whole spelling so far, each
hashed with the bits already seen into a table of counts. The stretched predictions are combined by weights that a gate
selects (bit, position, how often the spelling so far was seen); the weights are learned online, and the result is refined
by an adaptive probability map, learned online too. What a token's own count leaves over by absolute discounting goes to its
spelling. In a document this is combined with the document's own past: a mixture over shares of a cache, whose weights adapt
to the document as Bayes' rule has it. So a score is the log10 probability of the whole text under one proper model.

The corpus gives exact counts of all tokens of the training documents (a shuffle of partial counts), and from these the context
tables. The tables have a fixed size and so has the list of the most frequent tokens; both are broadcast. Tokens of a document
that aren't in the list are met with their exact counts by a join, so nothing that grows with the corpus reaches one machine.
The mixer learns from all distinct tokens, each left out of the tables: every task makes one pass over its share, and the mean
of the tasks' mixers, weighted by what each learned from, is the model's.

Defined cases: null text counts as empty and is one end token; an empty training set gives every token count 0; an empty table
gives an empty result; tokens of any length are spelled in whole; repeated rows are each scored; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import byte_column, id_text, materialize, mix, ship

#: log2 of the slots of each context's table: position, 1, 2, 3, 4 bytes, spelling so far.
SLOTS = (12, 18, 20, 20, 20, 21)
STARTS = np.concatenate([[0], np.cumsum([1 << s for s in SLOTS])]).astype(np.int64)
TOTAL = int(STARTS[-1])
CHUNK = 1 << 16
#: Tables are counted by at least so many tasks, each of about so many distinct tokens; each task sends at most one set of tables.
TRAIN_TASKS, TASK_TOKENS = 12, 500_000
#: Tokens that the mixer learns from in one go, and after how many its steps have become smaller by the root of two.
STEP, RATE_TOKENS = 1024, 7_680
MIXER = ["w", "map", "w_bits", "map_bits"]
TOP = 1 << 17
DISCOUNT = 0.75
#: Shares of a document's own past in a prediction; each has the same weight at first.
CACHE = np.array([0.0, 0.05, 0.2, 0.5])
GATES = 8 * 4 * 4
LN10 = float(np.log(10.0))
CLOSE = 0x20


def counted(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Partial counts of tokens; b'' is the end of a document."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "c"])
        counts.clear()
        return batch

    for batch in batches:
        for text in byte_column(batch, "text"):
            counts.update((text or b"").lower().split())
            counts[b""] += 1
            if len(counts) > most:
                yield out()
    if counts:
        yield out()


class Spelling:
    """Bits of tokens and the table slots of their contexts."""

    def __init__(self, tokens: list[bytes]):
        data = np.frombuffer(b" ".join(tokens) + b" ", np.uint8)
        self.bytes = data
        sizes = np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens))
        self.owner = np.repeat(np.arange(len(tokens)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.pos = np.arange(len(data)) - first[self.owner]
        wide = data.astype(np.uint64)
        before = [np.where(self.pos > k, np.concatenate([np.zeros(k + 1, np.uint64), wide[: -k - 1]])[: len(wide)] + np.uint64(1), np.uint64(0)) for k in range(4)]
        # A running polynomial of the spelling so far; uint64 wraps.
        powers = np.cumprod(np.full(int(self.pos.max(initial=0)) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
        terms = (wide + np.uint64(1)) * powers[self.pos]
        sums = np.cumsum(terms, dtype=np.uint64)
        start = np.where(first > 0, sums[first - 1], np.uint64(0))
        prefix = sums - terms - start[self.owner]
        tail = np.zeros(len(data), np.uint64)
        bases = [np.minimum(self.pos, 15).astype(np.uint64)]
        for k in range(4):
            tail = mix(tail + before[k] + np.uint64(k + 1))
            bases.append(tail)
        bases.append(mix(prefix + self.pos.astype(np.uint64)))
        self.bases = [mix(b + np.uint64(i << 40)) for i, b in enumerate(bases)]

    def bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each of the eight bits: its number, its values, the slots (contexts x bytes)."""
        partial = np.ones(len(self.bytes), np.uint64)
        for k in range(8):
            bit = (self.bytes >> np.uint8(7 - k)) & np.uint8(1)
            slots = np.empty((len(SLOTS), len(partial)), np.int64)
            for i, base in enumerate(self.bases):
                h = (base ^ (partial * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9FB21C651E98DF25)
                slots[i] = (h >> np.uint64(64 - SLOTS[i])).astype(np.int64) + STARTS[i]
            yield k, bit, slots
            partial = partial * np.uint64(2) + bit


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of zeros and ones by slot, of the distinct tokens of a partition: new tokens are spelled like tokens, not like text."""
    zeros, ones, any_ = np.zeros(TOTAL, np.float32), np.zeros(TOTAL, np.float32), False
    for batch in batches:
        tokens = batch.column(0).to_pylist()
        for i in range(0, len(tokens), 8192):
            any_ = True
            s = Spelling(tokens[i : i + 8192])
            for _, bit, slots in s.bits():
                for table, which in ((ones, bit == 1), (zeros, bit == 0)):
                    np.add.at(table, slots[:, which].ravel(), np.float32(1))
    if any_:
        for i in range(0, TOTAL, CHUNK):
            a, b = zeros[i : i + CHUNK], ones[i : i + CHUNK]
            if a.any() or b.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["chunk", "zeros", "ones"])


def _sum_tables(group):
    import pandas as pd  # here only: scoring does without it, and it takes 45 MB of a worker

    add = lambda name: np.sum([np.frombuffer(x, np.float32) for x in group[name]], axis=0, dtype=np.float32).tobytes()
    return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "zeros": [add("zeros")], "ones": [add("ones")]})


def log(x):
    with np.errstate(divide="ignore"):
        return np.log(x)


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Mixer:
    """Gated weights and the map that refines their result."""

    BUCKETS, SPAN = 33, 12.0

    def __init__(self):
        self.w = np.full((GATES, len(SLOTS) + 1), 0.3)
        self.w[:, -1] = 0.0
        self.map = np.tile(squash(np.linspace(-self.SPAN, self.SPAN, self.BUCKETS)), (8, 1))
        # How many bits each row of weights and each place of the map has learned from.
        self.w_bits, self.map_bits = np.zeros((GATES, 1)), np.zeros((8, self.BUCKETS))

    @staticmethod
    def gate(k: int, pos: np.ndarray, seen: np.ndarray) -> np.ndarray:
        level = (seen > 0).astype(np.int64) + (seen >= 4) + (seen >= 32)
        return (k * 4 + np.minimum(pos, 3)) * 4 + level

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(x, -self.SPAN, self.SPAN - 1e-6) + self.SPAN) * (self.BUCKETS - 1) / (2 * self.SPAN)
        low = at.astype(np.int64)
        return low, at - low

    def predict(self, k: int, s: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """P(bit = 1) from stretched inputs (contexts x n)."""
        w = self.w[gate]
        x = np.einsum("in,ni->n", s, w[:, :-1]) + w[:, -1]
        low, part = self.place(x)
        refined = self.map[k, low] * (1 - part) + self.map[k, low + 1] * part
        return np.clip((squash(x) + refined) / 2, 1e-6, 1 - 1e-6)

    def learn(self, k: int, s: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float) -> None:
        w = self.w[gate]
        x = np.einsum("in,ni->n", s, w[:, :-1]) + w[:, -1]
        err = (bit - squash(x)) * weight
        step, bits = np.zeros_like(self.w), np.bincount(gate, weight, GATES)[:, None]
        for i in range(s.shape[0]):
            step[:, i] = np.bincount(gate, err * s[i], GATES)
        step[:, -1] = np.bincount(gate, err, GATES)
        self.w += rate * step / (bits + 8.0)
        self.w_bits += bits
        low, part = self.place(x)
        for at, share in ((low, 1 - part), (low + 1, part)):
            up, near = (np.bincount(at, x, self.BUCKETS) for x in (share * weight * (bit - self.map[k, at]), share * weight))
            self.map[k] += 0.5 * rate * up / (near + 8.0)
            self.map_bits[k] += near
        np.clip(self.map, 1e-6, 1 - 1e-6, out=self.map)


class Model:
    """What scoring needs of the tables: stretched predictions, how often each spelling was seen, the mixer; N and V."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, mixer: Mixer, n: int, v: int):
        self.s = stretch((ones + 0.4) / (zeros + ones + 0.8)).astype(np.float16)
        seen = zeros[STARTS[-2] :] + ones[STARTS[-2] :]
        self.seen = np.minimum(seen, 255).astype(np.uint8)
        self.mixer, self.n, self.v = mixer, n, v

    def log_spelling(self, tokens: list[bytes]) -> np.ndarray:
        """Natural logarithm of the probability of each token's spelling."""
        out = np.zeros(len(tokens))
        for i in range(0, len(tokens), 8192):
            part = Spelling(tokens[i : i + 8192])
            total = np.zeros(len(part.bytes))
            for k, bit, slots in part.bits():
                p = self.mixer.predict(k, self.s[slots].astype(np.float64), Mixer.gate(k, part.pos, self.seen[slots[-1] - STARTS[-2]]))
                total += np.log(np.where(bit == 1, p, 1 - p))
            out[i : i + 8192] = np.bincount(part.owner, total, len(tokens[i : i + 8192]))
        return out

    def spelling(self, tokens: list[bytes]) -> np.ndarray:
        """Probability of each token's spelling; 0 where it is below the smallest float."""
        return np.exp(self.log_spelling(tokens))

    def log_probability(self, tokens: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's probability, by its discounted count and its spelling."""
        if not tokens:
            return np.empty(0)
        left = DISCOUNT * self.v / self.n if self.n else 1.0
        return np.logaddexp(log(np.maximum(counts - DISCOUNT, 0) / max(self.n, 1)), np.log(left) + self.log_spelling(tokens))


def fit_mixer(zeros: np.ndarray, ones: np.ndarray, tokens: list[bytes], mixer: Mixer | None = None, done: int = 0) -> Mixer:
    """One online pass over tokens; each is taken out of the tables, as if it were new. With a mixer it goes on from `done` tokens."""
    mixer = mixer or Mixer()
    for i in range(0, len(tokens), STEP):
        part = Spelling(tokens[i : i + STEP])
        w = np.ones(len(part.bytes))
        rate = 1.5 / (1 + (done + i) / RATE_TOKENS) ** 0.5
        for k, bit, slots in part.bits():
            z = np.maximum(zeros[slots] - (bit == 0), 0)
            o = np.maximum(ones[slots] - (bit == 1), 0)
            s = np.clip(np.log((o + 0.4) / (z + 0.4)), -15, 15)  # stretch of (o + 0.4) / (z + o + 0.8)
            mixer.learn(k, s, Mixer.gate(k, part.pos, z[-1] + o[-1]), bit.astype(np.float64), w, rate)
    return mixer


def _mixers(tables):
    """The mixer that a pass over all tokens of a partition gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, ones = tables.value
        mixer, done = Mixer(), 0
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            fit_mixer(zeros, ones, tokens, mixer, done)
            done += len(tokens)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (mixer.w, mixer.map, mixer.w_bits, mixer.map_bits)], MIXER)

    return run


def mean_mixer(parts: Iterable) -> Mixer:
    """The mean of mixers as _mixers() gives them, each place weighted by the bits it learned from; where none did, it stays as at first."""
    out = Mixer()
    w, refined = np.zeros_like(out.w), np.zeros_like(out.map)
    for r in parts:
        bits, near = np.frombuffer(r.w_bits).reshape(out.w_bits.shape), np.frombuffer(r.map_bits).reshape(out.map_bits.shape)
        w += bits * np.frombuffer(r.w).reshape(w.shape)
        refined += near * np.frombuffer(r.map).reshape(refined.shape)
        out.w_bits += bits
        out.map_bits += near
    out.w = np.where(out.w_bits > 0, w / np.maximum(out.w_bits, 1e-300), out.w)
    out.map = np.where(out.map_bits > 0, refined / np.maximum(out.map_bits, 1e-300), out.map)
    return out


def train(counts: DataFrame, n: int, v: int) -> Model:
    """Model from the table of token counts: tables and mixer learn from all of its tokens."""
    spark = counts.sparkSession
    tasks = max(TRAIN_TASKS, -(-v // TASK_TOKENS))
    parts = counts.repartition(tasks).mapInArrow(_tables, "chunk long, zeros binary, ones binary")
    summed = parts.groupBy("chunk").applyInPandas(_sum_tables, "chunk long, zeros binary, ones binary")
    zeros, ones = np.zeros(TOTAL, np.float32), np.zeros(TOTAL, np.float32)
    for r in summed.toLocalIterator():  # at most TOTAL / CHUNK rows
        zeros[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.zeros, np.float32)
        ones[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.ones, np.float32)
    tables = spark.sparkContext.broadcast((zeros, ones))
    # By a hash, so that the order in which tokens are met, and with it the result, doesn't depend on the run.
    dealt = counts.select("token").repartition(tasks, "token").sortWithinPartitions(F.xxhash64("token", F.lit(10)), "token")
    mixer = mean_mixer(dealt.mapInArrow(_mixers(tables), ", ".join(f"{name} binary" for name in MIXER)).collect())  # one row a task, of some 15 kB
    tables.destroy()
    return Model(zeros, ones, mixer, n, v)


def _scan(shared):
    """Per document: sums over its frequent tokens, and its other tokens for the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, top_c, top_p, n, v = shared.value  # place 0: not a frequent token
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            names, times, pasts, per_doc = [], [], [], []
            for text in byte_column(batch, "text"):
                words = (text or b"").lower().split()
                words.append(b"")
                number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                at = np.fromiter(map(top.get, number, repeat(0)), np.int64, len(number))
                order = np.argsort(ids, kind="stable")
                sizes = np.bincount(ids, minlength=len(number))
                ranks = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rank = np.empty(len(ids), np.int64)
                rank[order] = ranks
                past = rank / np.maximum(np.arange(len(ids)), 1)
                where = at[ids]
                hit = where > 0
                pt, before = top_p[where[hit]], past[hit]
                cols[0].append(len(words))
                cols[1].append(int(hit.sum()))
                cols[2].append(float(np.log10((top_c[where[hit]] + 1) / (n + v + 1)).sum()))
                cols[3].append([float((np.logaddexp(np.log1p(-x) + pt, log(x * before)) if x else pt).sum() / LN10) for x in CACHE])
                cols[4].append(len(text or b""))
                rest = at == 0
                names += compress(number, rest)
                times.append(sizes[rest])
                # The past of each later occurrence, token by token.
                pasts.append(past[order][np.repeat(rest, sizes) & (ranks > 0)].astype(np.float32))
                per_doc.append(int(rest.sum()))
            whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
            starts = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            n_of = whole(times, np.int32)
            rest = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(n_of), pa.ListArray.from_arrays(starts(n_of - 1), pa.array(whole(pasts, np.float32)))], ["token", "n", "past"])
            types = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int64())
            made = [pa.array(x, t) for x, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made[:4], pa.ListArray.from_arrays(starts(per_doc), rest), made[4]], ["doc_id", "held_out", "n_tokens", "top_known", "top_base", "top_sums", "rest", "n_bytes"])

    return run


def _probabilities(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            p = model.value.log_probability(tokens, batch.column(1).to_numpy().astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["token", "c", "p"])

    return run


def least_count(counts: DataFrame) -> int:
    """The smallest count, in steps of an eighth of a doubling, that at most TOP tokens reach; no task sends more than its tokens of them."""
    step = F.floor(F.log2("c") * 8).cast("int")
    spread = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for r in spread:
        total += r["n"]
        if total > TOP:
            break
        least = r["least"]
    return least


def score_documents(df: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, total_bits, bits_per_byte (null of an empty text) of every row of df.

    The model learns from the rows for which held_out is false.
    """
    spark = df.sparkSession
    ship(spark)
    rows = id_text(df, id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialize(rows.filter("not held_out").select("text").mapInArrow(counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = train(counts, n, v)
    shared_model = spark.sparkContext.broadcast(model)

    frequent = counts.filter(F.col("c") >= least_count(counts)).toPandas()
    tokens = [bytes(t) for t in frequent["token"]]
    p = model.log_probability(tokens, frequent["c"].to_numpy(np.float64))
    top = {t: i for i, t in enumerate(tokens, 1)}
    shared_top = spark.sparkContext.broadcast((top, np.concatenate([[0.0], frequent["c"].to_numpy(np.float64)]), np.concatenate([[0.0], p]), n, v))

    schema = "doc_id long, held_out boolean, n_tokens long, top_known long, top_base double, top_sums array<double>, rest array<struct<token: binary, n: int, past: array<float>>>, n_bytes long"
    scanned = materialize(rows.mapInArrow(_scan(shared_top), schema).withColumn("row", F.monotonically_increasing_id()), "scanned")
    rest = scanned.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.n", "r.past")
    needed = rest.groupBy("token").agg(F.lit(0).alias("z")).join(counts, "token", "left").select("token", F.coalesce("c", F.lit(0)).alias("c"))
    known = needed.mapInArrow(_probabilities(shared_model), "token binary, c long, p double")
    met = rest.join(known, "token")

    def again(x: float, q: Column) -> Column:
        """Natural logarithm of (1 - x) exp(p) + x q."""
        a = F.col("p") + float(np.log1p(-x))
        b = F.log(F.lit(x) * q)
        return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))) if x else a

    one = lambda x: (F.col("p") + float(np.log1p(-x)) + F.aggregate("past", F.lit(0.0), lambda s, q: s + again(x, q))) / LN10
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base"), *[F.sum(one(float(x))).alias(f"s{i}") for i, x in enumerate(CACHE)])
    joined = scanned.drop("rest").join(sums, "row", "left")
    total = [F.col("top_sums")[i] + F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(CACHE))]
    most = F.greatest(*total)
    score = most + F.log10(sum((F.pow(F.lit(10.0), t - most) for t in total[1:]), F.pow(F.lit(10.0), total[0] - most)) / len(CACHE))
    joined = joined.withColumn("score", score)
    bits = -F.col("score") / float(np.log10(2.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("top_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("top_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        "score",
        bits.alias("total_bits"),
        (bits / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))).alias("bits_per_byte"),
    )
