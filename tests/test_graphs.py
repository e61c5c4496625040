"""Chains, cycles and levels against plain Python, on graphs with long ways, pure cycles and forks."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def reaches(links):
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in {x for link in links for x in link}:
        seen, stack = set(), list(after.get(start, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += after.get(x, ())
        out[start] = seen
    return out


def components(links):
    reach = reaches(links)
    return sorted((a, min(b for b in reach if b in reach[a] and a in reach[b])) for a in reach if a in reach[a])


def ring(prefix, n):
    return [(f"{prefix}{i:03d}", f"{prefix}{(i + 1) % n:03d}") for i in range(n)]


def test_long_chains_and_rings(spark):
    chain = [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(70)]
    links = [*chain, ("t070", "a017"), *ring("a", 37), *ring("b", 1), *ring("c", 2), ("z1", "t003"), ("z2", "gone"), *[(f"q{i}", f"q{i + 1}") for i in range(9)]]
    df = spark.createDataFrame(links, "a string, b string")
    assert rows(graph.components_of_cycles(df)) == components(links)


def test_forks_with_chains_between_them(spark):
    rng = random.Random(11)
    # Between the forks f… lie chains; a chain's nodes have the smallest names, so a component is named by one of them.
    links = [("f1", "a1"), ("a1", "a2"), ("a2", "f2"), ("f2", "f1"), ("f2", "d1"), ("d1", "d2"), ("f1", "e1"), ("e1", "f3"), ("f3", "f3"), ("f3", "g1"), ("g1", "g2"), ("g2", "g1")]
    for _ in range(14):
        a, b = rng.sample(range(9), 2)
        n = rng.randint(0, 3)
        way = [f"h{a}", *(f"c{a}{b}{i}{_:02d}" for i in range(n)), f"h{b}"]
        links += list(zip(way, way[1:], strict=False))
    df = spark.createDataFrame(sorted(set(links)), "a string, b string")
    assert rows(graph.components_of_cycles(df)) == components(set(links))


def test_no_links(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert rows(graph.components_of_cycles(df)) == []


def levels_of(tasks, deps, most):
    """Level by level, as waves are defined."""
    state, level, out = dict(tasks), 0, {}
    cyclic = {a for a, _ in components(deps)} if deps else set()
    left = {t for t, s in tasks if s in ("pending", "blocked") and t not in cyclic}
    while left and level < most:
        now = {t for t in left if all(d in out or state.get(d, "done") == "done" for a, d in deps if a == t)}
        if not now:
            break
        out |= dict.fromkeys(now, level)
        left, level = left - now, level + 1
    return sorted(out.items())


def test_waves_against_level_by_level(spark):
    rng = random.Random(6)
    n = 130
    tasks = [(f"T{i:03d}", rng.choice(["pending"] * 12 + ["blocked", "done", "failed", "running"])) for i in range(n)]
    deps = {(f"T{i:03d}", f"T{rng.randrange(max(0, i - 4), i):03d}") for i in range(1, n) for _ in range(rng.choice([0, 1, 1, 1, 1, 2]))}
    deps |= {("T005", "unknown"), ("T020", "T025")}
    t, d = spark.createDataFrame(tasks, "id string, state string"), spark.createDataFrame(sorted(deps), "task_id string, depends_on string")
    cyclic = graph.components_of_cycles(d.select(F.col("task_id").alias("a"), F.col("depends_on").alias("b")))
    got = graph.waves(t, d, cyclic)
    assert rows(got) == levels_of(tasks, deps, 64)
    assert rows(graph.waves(t, d, cyclic, most=3)) == levels_of(tasks, deps, 3)
    level = dict(rows(got))
    at = min(x for x, v in level.items() if v == max(level.values()))
    want = [(level[at], at)]
    while level[at]:
        at = min(b for a, b in deps if a == at and level.get(b) == level[at] - 1)
        want.append((level[at], at))
    assert rows(graph.critical_path(got, d)) == sorted(want)


def test_a_chain_of_a_hundred(spark):
    tasks = spark.createDataFrame([(f"T{i:03d}", "pending") for i in range(100)], "id string, state string")
    deps = spark.createDataFrame([(f"T{i + 1:03d}", f"T{i:03d}") for i in range(99)], "task_id string, depends_on string")
    none = spark.createDataFrame([], "node string, component string")
    assert rows(graph.waves(tasks, deps, none)) == [(f"T{i:03d}", i) for i in range(64)]
    assert rows(graph.waves(tasks, deps, none, most=1000))[-1] == ("T099", 99)
    assert graph.waves(tasks.limit(0), deps, none).count() == 0 and graph.critical_path(graph.waves(tasks.limit(0), deps, none), deps).count() == 0


def test_nesting_deeper_than_any_limit(spark):
    n = 75
    symbols = spark.createDataFrame([(f"s{i:03d}", f"s{i - 1:03d}" if i else None) for i in range(n)] + [("t1", "t0"), ("t0", None)], "id string, parent_id string")
    below = graph.descendants(symbols, spark.createDataFrame([("s000",), ("s070",), ("t1",)], "root string"), hops=5)
    assert rows(below) == sorted([("s000", f"s{i:03d}", i) for i in range(1, n)] + [("s070", f"s{i:03d}", i - 70) for i in range(71, n)])
    above = graph.ancestors(symbols, spark.createDataFrame([("s074",), ("t0",)], "start string"), hops=5)
    assert rows(above) == sorted([("s074", f"s{74 - d:03d}", d) for d in range(n)] + [("t0", "t0", 0)])
