"""Repair of conversation structure by a Viterbi search over edits.

A well-formed conversation reads `(s?(ua)+)?` in the initials of its roles. A forward pass over the rows of one conversation
carries, for each of four grammar states, the least (cost, audit string) of any edits that lead there; each row's layer is closed
with at most two insertions, as a third one leads back to a state that is cheaper already. Of two audits of equal cost in one state
neither is the beginning of the other (the longer one would have more insertions), so the smaller one stays smaller whatever
follows, and one audit a state is enough.

Conversations of up to `block_rows` rows and `block_bytes` bytes are solved in one task each, many to a task, over rows sorted by
the shuffle. Longer ones are never gathered: a range sort spreads their rows, repeated messages are found by an aggregate, each block
of rows becomes the table of least audits from each state to each other (such tables combine like matrices), and only the audit comes
together. Their repaired text then streams by in order.

Defined cases: rows are taken by turn (nulls first), then role, then text. A null role or text is one space, so a null text is
blank and a null role fits no state. An empty role fits none either. A null conv_id is a conversation of its own. Very long texts are
taken whole; other columns of the input are not looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgraph.llm.common import drop_table, materialize, ship

#: Grammar states: nothing yet, behind a system, a user and an assistant message.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state that a message of a chosen role leads to.
CHOSEN = NEXT["u"] | NEXT["a"]
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60
ROLE = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\x0b\x0c\r"

Layer = list[tuple[int, str]]


def closed(layer: Layer) -> Layer:
    """The layer with what one inserted user message, then one inserted assistant message, reach more cheaply."""
    for to, froms in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        cost, audit = min(layer[x] for x in froms)
        layer[to] = min(layer[to], (cost + INSERT, audit + "I"))
    return layer


def advanced(layer: Layer, initial: str, fault: str | None) -> Layer:
    """The layer behind one more row."""
    new = [(cost + DELETE, audit + "D") for cost, audit in layer]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault else 0
        for moves, price, letter in ((CHOSEN, REROLE + more, "R"), (NEXT.get(initial, {}), more, "K")):
            for at, to in moves.items():
                cost, audit = layer[at]
                if cost + price <= new[to][0]:
                    new[to] = min(new[to], (cost + price, audit + letter))
    return closed(new)


def entered(state: int) -> Layer:
    layer = [(FAR, "")] * 4
    layer[state] = (0, "")
    return closed(layer)


def joined(layer: Layer, table: list[Layer]) -> Layer:
    """The layer behind a block whose table has, for each state before it, the layer behind it."""
    return [min((layer[x][0] + table[x][y][0], layer[x][1] + table[x][y][1]) for x in range(4)) for y in range(4)]


def cheapest(layer: Layer) -> tuple[int, str]:
    return min(layer[START], layer[ASSISTANT])


def fault_of(text: str, seen: bool) -> str | None:
    """The first fault of a row."""
    kept = text.rstrip(WHITE)
    return "blank" if not kept else "duplicate" if seen else "truncated" if kept[-1] not in ".!?" else None


def repaired(audit: str, rows: Iterable[tuple[str, str, int | None]]) -> Iterator[tuple[str, str, int | None, str]]:
    """(role, text, turn, edit) of the repaired conversation, from its rows (role, text, turn) in order; nothing is held."""
    rows, state = iter(rows), START
    for edit in audit:
        role, text, turn = ("", "", None) if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[role[:1]][state]
        else:
            state = CHOSEN[state]
            role = ROLE[state]
        yield role, text, turn, edit


class Summary:
    """Counts over consecutive rows of a conversation; those of two neighbours add up."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        one = Summary()
        one.rows, one.first_initial, one.last_initial, one.first_turn, one.last_turn, one.turns = 1, initial, initial, turn, turn, int(turn is not None)
        if fault:
            setattr(one, fault, 1)
        self.join(one)

    def join(self, x: Summary) -> None:
        """Take in what follows."""
        if self.rows and x.rows:
            self.illegal += self.last_initial + x.first_initial not in LEGAL
        if not self.rows:
            self.first_initial = x.first_initial
        if x.rows:
            self.last_initial = x.last_initial
        if x.first_turn is not None:
            self.turns -= x.first_turn == self.last_turn
            self.first_turn = x.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = x.last_turn
        for name in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(x, name))

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns

    def values(self) -> dict:
        return {x: getattr(self, x) for x in self.FIELDS}

    @classmethod
    def of(cls, values: dict) -> Summary:
        made = cls()
        for x in cls.FIELDS:
            setattr(made, x, values[x])
        return made


def digest(messages: Iterable[tuple]) -> str:
    """SHA-256 of `role:text` joined by newlines, fed message by message."""
    h = hashlib.sha256()
    for i, (role, text, *_) in enumerate(messages):
        h.update(("\n" * (i > 0) + role + ":" + text).encode("utf-8", "surrogatepass"))
    return h.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
OUTCOME = ", ".join(f"{x} long" for x in COUNTS) + ", audit string, repaired_sha256 string"
MESSAGES = "position long, turn long, role string, text string, edit string"
BLOCK = "block long, rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, table array<array<struct<cost: long, audit: string>>>"


def outcome(found: Summary, layer: Layer, rows: Callable[[], Iterable[tuple]]) -> dict:
    cost, audit = cheapest(layer)
    counts = {x: getattr(found, x) for x in COUNTS[:-1]}
    return counts | {"cost": cost, "audit": audit, "repaired_sha256": digest(repaired(audit, rows()))}


def solved(rows: list[tuple[str, str, int | None]]) -> tuple[Summary, Layer]:
    """Faults and least edits of one conversation's rows (role, text, turn), in order."""
    found, layer, seen = Summary(), entered(START), set()
    for role, text, turn in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        found.add(turn, role[:1], fault)
        layer = advanced(layer, role[:1], fault)
    return found, layer


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that agree in the first columns, which the partition is sorted by."""
    rows = (row for b in batches for row in zip(*(x.to_pylist() for x in b.columns), strict=True))
    return groupby(rows, key=itemgetter(*range(keys)) if keys > 1 else lambda r: (r[0],))


def _per_group(df: DataFrame, keys: list[str], order: list, fn: Callable[[tuple, Iterator[tuple]], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that fn makes of each group's sorted rows. Groups are streamed: fn sees an iterator. The keys' columns come first."""
    ship(df.sparkSession)
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    ddl = ", ".join([fields[0], schema])
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, rows in _grouped(batches, len(keys)):
            for made in fn(key, rows):
                out.append({keys[0]: key[0], **made})
                size += 1 + len(made.get("text") or made.get("audit") or "") // 100
                if size >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def _plain(df: DataFrame) -> DataFrame:
    """(conv_id, gone, turn, role, text) without nulls in role and text."""
    gone = F.col("gone") if "gone" in df.columns else F.lit(False)
    return df.select("conv_id", gone.alias("gone"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys in which nulls are equal."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(b, on, how).drop(*(f"__{k}" for k in keys))


def _long(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of long conversations in order (place), and each conversation's counts and least edits."""
    keys = ["conv_id", "turn", "role", "text"]
    placed = materialize(rows.filter("not gone").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "placed")
    marks = placed.select("conv_id", "place", "turn", F.substring("role", 1, 1).alias("initial"), F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "").alias("kept"), F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256).alias("message"))
    firsts = marks.groupBy("conv_id", "message").agg(F.min("place").alias("first"))
    met = _met(marks, firsts, ["conv_id", "message"]).select("conv_id", F.expr(f"place div {block_rows}").alias("block"), "place", "turn", "initial", F.when(F.col("kept") == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.substring("kept", -1, 1).isin(".", "!", "?"), "truncated").alias("fault"))

    def blocks(key: tuple, part: Iterator[tuple]) -> Iterator[dict]:
        found, table = Summary(), [entered(x) for x in range(4)]
        for _, _, _, turn, initial, fault in part:
            found.add(turn, initial, fault)
            table = [advanced(x, initial, fault) for x in table]
        yield {"block": key[1], **found.values(), "table": [[{"cost": c, "audit": a} for c, a in x] for x in table]}

    def combined(key: tuple, part: Iterator[tuple]) -> Iterator[dict]:
        found, layer = Summary(), entered(START)
        for row in part:
            found.join(Summary.of(dict(zip(Summary.FIELDS, row[2:-1], strict=True))))
            layer = joined(layer, [[(x["cost"], x["audit"]) for x in line] for line in row[-1]])
        cost, audit = cheapest(layer)
        yield {x: getattr(found, x) for x in COUNTS[:-1]} | {"cost": cost, "audit": audit}

    tables = _per_group(met, ["conv_id", "block"], ["place"], blocks, BLOCK)
    made = _per_group(tables, ["conv_id"], ["block"], combined, OUTCOME.rpartition(",")[0])
    return placed, materialize(made, "audits")


def _solve(df: DataFrame, short: Callable, long: Callable, schema: str, block_rows: int, block_bytes: int) -> DataFrame:
    """What short(rows) makes of each conversation within the limits, long(values, rows) of the others, as one table."""
    rows = _plain(df)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    big = materialize(sizes.filter((F.col("n") > block_rows) | (F.col("bytes") > block_bytes)).select("conv_id"), "long")
    some = not big.isEmpty()
    rest = _met(rows, big, ["conv_id"], "left_anti") if some else rows
    kept = lambda part: ((role, text, turn) for _, gone, turn, role, text in part if not gone)
    out = _per_group(rest, ["conv_id"], ["turn", "role", "text"], lambda key, part: short(list(kept(part))), schema)
    if not some:
        drop_table(big)
        return out
    placed, audits = _long(_met(rows, big, ["conv_id"], "left_semi"), block_rows)
    # The audit comes ahead of its conversation's rows, in the same stream.
    null = F.lit(None).cast("string")
    head = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("turn"), null.alias("role"), null.alias("text"), F.struct(*COUNTS, "audit").alias("found"))
    lines = head.unionByName(placed.select("conv_id", "place", "turn", "role", "text"), allowMissingColumns=True)
    lost = _met(big, audits, ["conv_id"], "left_anti")  # long ones of which no row is left
    none = lost.select("conv_id", F.lit(True).alias("gone"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    empty = _per_group(none, ["conv_id"], ["turn"], lambda key, part: short([]), schema)

    def stream(key: tuple, part: Iterator[tuple]) -> Iterable[dict]:
        found = next(part)[5]
        return long(found, ((role, text, turn) for _, _, turn, role, text, _ in part))

    return out.unionByName(empty).unionByName(_per_group(lines, ["conv_id"], ["place"], stream, schema))


def repair_summary(df: DataFrame, block_rows: int = 4096, block_bytes: int = 1 << 24) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of df (conv_id, turn, role, text).

    Rows for which a column `gone` is true count as absent, but their conversation has a row in the result.
    """

    def short(rows: list[tuple]) -> Iterator[dict]:
        found, layer = solved(rows)
        yield outcome(found, layer, lambda: rows)

    def long(found: dict, rows: Iterator[tuple]) -> Iterator[dict]:
        yield found | {"repaired_sha256": digest(repaired(found["audit"], rows))}

    return _solve(df, short, long, OUTCOME, block_rows, block_bytes)


def repair_messages(df: DataFrame, block_rows: int = 4096, block_bytes: int = 1 << 24) -> DataFrame:
    """conv_id, position, turn, role, text, edit (K kept, R other role, I inserted): the repaired conversations of df, message by message."""

    def lines(audit: str, rows: Iterable[tuple]) -> Iterator[dict]:
        for i, (role, text, turn, edit) in enumerate(repaired(audit, rows)):
            yield {"position": i, "turn": turn, "role": role, "text": text, "edit": edit}

    return _solve(df, lambda rows: lines(cheapest(solved(rows)[1])[1], rows), lambda found, rows: lines(found["audit"], rows), MESSAGES, block_rows, block_bytes)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults by crc32(`conv_id:turn`) % 20: 0 drops a row (`gone`), 1 empties its text, 2 takes its [.!?] away, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    plain = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text")]
    rows = df.select("conv_id", "turn", (F.crc32(F.concat(plain[0], F.lit(":"), plain[1])) % 20).alias("fault"), plain[2].alias("role"), plain[3].alias("text"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.select("conv_id", "turn", (fault == 0).alias("gone"), F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"))
    return made.drop("copy")
