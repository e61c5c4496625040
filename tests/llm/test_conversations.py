import hashlib
import random
import re
import zlib

import pytest

from loomgraph.llm import conversations as cv

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Every sequence of edits on rows (role, text, turn), in order, that leads to the grammar: the least (cost, audit) and its messages."""
    faults, seen = [], set()
    for role, text, _ in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = (1 << 30, "", [])
    stack = [(0, 0, "", [])]
    while stack:
        at, cost, audit, made = stack.pop()
        initials = "".join(r[:1] for r, _ in made)
        if not re.fullmatch(r"s?(ua)*u?", initials) or any(not r for r, _ in made[-1:]):
            continue
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            best = min(best, (cost, audit, made))
        if not audit.endswith("II"):
            stack += [(at, cost + 5, audit + "I", [*made, (r, "")]) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, _ = rows[at]
            more = 5 if faults[at] == "truncated" else 0
            stack.append((at + 1, cost + 2, audit + "D", made))
            if faults[at] not in ("blank", "duplicate"):
                stack.append((at + 1, cost + more, audit + "K", [*made, (role, text)]))
                stack += [(at + 1, cost + 1 + more, audit + "R", [*made, (r, text)]) for r in ("user", "assistant")]
    initials = [r[:1] for r, _, _ in rows]
    turns = [t for _, _, t in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": best[0], "audit": best[1],
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest(),
    }


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0].encode(), r[1].encode()))


def table_of(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def made_up(seed, n, longest=4):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for _ in range(rng.randint(0, longest)):
            out.append((c, rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["system", "user", "assistant", "tool", "", "Ä", "sage", "user"]), rng.choice(["a.", "b", "", " \t", "a.", "c! \n", "d?"])))
    return out


def expected(data):
    convs = {}
    for c, turn, role, text in data:
        convs.setdefault(c, []).append((role if role is not None else " ", text if text is not None else " ", turn))
    return {c: brute(in_order(rows)) for c, rows in convs.items()}


def got(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_against_every_sequence_of_edits(spark):
    data = made_up(1, 150)
    assert got(cv.repair_summary(table_of(spark, data))) == expected(data)


@pytest.mark.parametrize("limits", [{"block_rows": 1}, {"block_rows": 2}, {"block_rows": 3, "block_bytes": 2}])
def test_long_conversations_go_block_by_block(spark, limits):
    data = made_up(2, 60)
    assert got(cv.repair_summary(table_of(spark, data), **limits)) == expected(data)


def test_one_long_conversation_both_ways(spark):
    rng = random.Random(5)
    data = [(7, i // 2 if i % 50 else None, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"{i}.", f"{i}", "same.", ""])) for i in range(900)]
    whole, parts = (got(cv.repair_summary(table_of(spark, data), block_rows=n)) for n in (4096, 64))
    assert whole == parts
    audit = whole[7]["audit"]
    assert len(audit.replace("I", "")) == 900
    rows = [(r.position, r.turn, r.role, r.text, r.edit) for r in cv.repair_messages(table_of(spark, data), block_rows=64).orderBy("position").collect()]
    assert rows == [(r.position, r.turn, r.role, r.text, r.edit) for r in cv.repair_messages(table_of(spark, data)).orderBy("position").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in rows))
    assert whole[7]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows).encode()).hexdigest()


def test_nulls_empty_and_extra_columns(spark):
    data = [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, None, None), (1, None, "user", None), (2, 5, "user", "x" * 300_000 + "."), (2, 9, "assistant", "y.")]
    df = table_of(spark, data).selectExpr("*", "'z' as audit", "1 as gaps", "true as kept")
    assert got(cv.repair_summary(df)) == expected(data)
    assert cv.repair_summary(table_of(spark, [])).count() == 0
    assert cv.repair_messages(table_of(spark, [])).count() == 0


def damage(data):
    """The contract's faults, row by row; conversations without rows stay."""
    out = {}
    for c, turn, role, text in data:
        rows = out.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [("user" if fault == 4 else role, text, turn)] * (2 if fault == 3 else 1)
    return out


@pytest.mark.parametrize("block_rows", [4096, 1])
def test_damage(spark, block_rows):
    rng = random.Random(3)
    data = [(c if c else None, t if t != 3 else None, rng.choice(["system", "user", "assistant", None]), rng.choice(["a.", f"b{t}!", None, "c"])) for c in range(90) for t in range(rng.randint(1, 4))]
    want = {c: brute(in_order(rows)) for c, rows in damage(data).items()}
    assert got(cv.repair_summary(cv.damaged(table_of(spark, data)), block_rows=block_rows)) == want
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    none = got(cv.repair_summary(cv.damaged(table_of(spark, [(gone, 0, "user", "a.")]))))[gone]
    assert none == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    big = got(cv.repair_summary(cv.damaged(table_of(spark, [(gone, 0, "user", "a" * 100)])), block_bytes=50))[gone]
    assert big == none
