import random
import re
from itertools import permutations

import pytest

from loomgraph.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))


def brute(docs, labels):
    """Each order applied to each document, one step after the other."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = [(s or "", (*fails(t or ""), i is not None and i > first[t or ""]), *(i is not None and any(x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))) for i, t, s in docs]
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            every = list(left)
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone, left = [r for r in left if r[1][k]], [r for r in left if not r[1][k]]
                failing = [r for r in every if r[1][k]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[1]) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def made_up(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "cc", "Dé", "e#", "中文", "x y", f"w{rng.randrange(500)}"])
    texts = [rng.choice([" ", "\t", "\n\x0b"]).join([f"w{rng.randrange(9000)}" if rng.random() < 0.7 else word() for _ in range(rng.choice([0, 3, 49, 50, 51, 120]))]) for _ in range(40)]
    docs = [(i, rng.choice([*texts, None]), rng.choice(["s1", "s2", None, ""])) for i in range(120)]
    docs += [(3, docs[3][1], "s1"), (3, docs[3][1], "s2"), (3, "other " * 60, "s1"), (None, docs[3][1], "s1"), (None, None, None), (500, "Q" * 200_000, "s9"), (501, "Q" * 200_000, "s9")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("held", [fa.HELD, 1])
def test_against_every_order(spark, held):
    docs, labels = made_up()
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' as part", "7 as mask", "true as good").repartition(5)
    assert got(fa.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held=held)) == brute(docs, labels)


def test_colliding_fingerprints_keep_their_texts_apart(spark):
    docs, _ = made_up(2)
    df = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("source", "part").repartition(4)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    one, all_ = (sorted(map(tuple, fa.filter_masks(df, hashed=h).groupBy("doc_id", "part", "mask").sum("rows").collect()), key=key) for h in (fa.fingerprint, lambda text: len(text) % 2))
    assert one == all_


def test_copies(spark):
    docs = [(5, "a", "s"), (2, "a", "s"), (9, "a", "s"), (2, "a", "s"), (1, "b", "s"), (7, None, "s"), (8, "", "s"), (None, "a", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, part string").repartition(3)
    assert sorted(r.doc_id for r in fa.copies(df).collect()) == [5, 8, 9]


def test_a_hot_text_leaves_a_task_once(spark):
    df = spark.range(4000, numPartitions=4).selectExpr("id as doc_id", "'the same text' as text", "'s' as part")
    n = fa.routed(df).count()
    heads = df.rdd.mapPartitions(lambda part: (x for x in fa._read(((r[0], r[1].encode(), r[2]) for r in part), fa.HELD) if x[1] is not None)).count()
    assert n == 4000 and heads == 4


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit_filters(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert fa.audit_filters(spark.createDataFrame([(1, "a", None)], SCHEMA), labels).count() == 600
