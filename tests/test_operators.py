import random

import pandas as pd
import pytest

from loomgraph.functions import scalars as fn
from loomgraph.operators import diff, graph, relational, schedule, state
from loomgraph.operators import source_text as tx
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_impact_on_a_chain_and_a_cycle(spark):
    edges = spark.createDataFrame([("signup", "save", "calls"), ("save", "write", "calls"), ("write", "signup", "calls"), ("f", "write", "contains")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("write",)], "seed string")
    assert rows(graph.impact(edges, seeds, 3)) == [("write", "save", 1), ("write", "signup", 2)]
    assert rows(graph.impact(edges, seeds, 1)) == [("write", "save", 1)]


def test_components_of_cycles_on_random_graphs(spark):
    rng = random.Random(2)
    for _ in range(3):
        nodes = [f"n{i:02d}" for i in range(14)]
        links = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(18)}
        reach = {n: {b for a, b in links if a == n} for n in nodes}
        for _ in nodes:
            reach = {n: r | {y for x in r for y in reach[x]} for n, r in reach.items()}
        want = sorted((a, min(b for b in nodes if b in reach[a] and a in reach[b])) for a in nodes if a in reach[a])
        df = spark.createDataFrame(sorted(links), "a string, b string")
        assert rows(graph.components_of_cycles(df)) == want
        asked = [(a, b) for a in nodes[:5] for b in nodes[5:9]] + [(nodes[0], nodes[0])]
        deps = df.withColumnsRenamed({"a": "task_id", "b": "depends_on"})
        closes = graph.would_cycle(spark.createDataFrame(asked, "task_id string, depends_on string"), deps)
        assert rows(closes) == sorted((t, u, t == u or t in reach[u]) for t, u in asked)


def test_waves_and_critical_path(spark):
    tasks = spark.createDataFrame([("T1", "done"), ("T2", "pending"), ("T3", "blocked"), ("T4", "pending"), ("T5", "failed"), ("T6", "pending"), ("T7", "pending"), ("T8", "pending")], "id string, state string")
    deps = spark.createDataFrame([("T2", "T1"), ("T3", "T2"), ("T4", "T3"), ("T6", "T5"), ("T7", "T99"), ("T8", "T8")], "task_id string, depends_on string")
    cyclic = graph.components_of_cycles(deps.select(F.col("task_id").alias("a"), F.col("depends_on").alias("b")))
    levels = graph.waves(tasks, deps, cyclic)
    assert rows(levels) == [("T2", 0), ("T3", 1), ("T4", 2), ("T7", 0)]
    assert rows(graph.critical_path(levels, deps)) == [(0, "T2"), (1, "T3"), (2, "T4")]


def test_task_view_blocks_on_unknown(spark):
    tasks = spark.createDataFrame([("T1", "done"), ("T2", "pending"), ("T3", "pending")], "id string, state string")
    deps = spark.createDataFrame([("T2", "T1"), ("T3", "T9")], "task_id string, depends_on string")
    got = {r.id: (r.ready, r.blocked_by) for r in relational.task_view(tasks, deps).collect()}
    assert got == {"T1": (False, []), "T2": (True, []), "T3": (False, ["T9"])}


def test_lease_replay():
    def command(i, ts, op, symbol, above, agent, priority=1, ttl=10):
        return {"id": i, "ts": ts, "op": op, "symbol": symbol, "ancestors": above, "agent": agent, "priority": priority, "ttl_secs": ttl}

    log = [
        command(1, 0, "acquire", "m", ["c", "f"], "a"), command(2, 1000, "acquire", "c", ["f"], "b"), command(3, 2000, "acquire", "m", ["c", "f"], "a"),
        command(4, 3000, "acquire", "f", [], "b", 5), command(5, 4000, "release", "f", [], "b"), command(6, 5000, "acquire", "c", ["f"], "c"),
        command(7, 15000, "acquire", "m", ["c", "f"], "a"), command(8, 16000, "heartbeat", "c", ["f"], "c"),
    ]
    got = state.replay(pd.DataFrame(log)).outcome.tolist()
    assert got == ["acquired", "denied", "extended", "preempted", "released", "acquired", "acquired", "ignored"]


def test_lease_commands():
    base = {"symbol": "m", "ancestors": ["c", "f"], "priority": 0, "ttl_secs": 10, "preempt": False, "queue": True, "to": None, "scope": None}
    log = [
        {"id": 1, "ts": 0, "op": "acquire", "agent": "a"}, {"id": 2, "ts": 1000, "op": "acquire", "agent": "b"}, {"id": 3, "ts": 2000, "op": "acquire", "agent": "c", "priority": 5},
        {"id": 4, "ts": 3000, "op": "acquire", "agent": "d", "priority": 9, "preempt": True, "queue": False},  # takes it from a, but two wait
        {"id": 5, "ts": 4000, "op": "release", "agent": "d"}, {"id": 6, "ts": 5000, "op": "acquire", "agent": "b"}, {"id": 7, "ts": 6000, "op": "acquire", "agent": "c", "priority": 5},
        {"id": 8, "ts": 7000, "op": "transfer", "agent": "c", "to": "b"}, {"id": 9, "ts": 8000, "op": "release", "agent": "c"}, {"id": 10, "ts": 9000, "op": "heartbeat", "agent": "b", "symbol": None},
        {"id": 11, "ts": 18_999, "op": "settle", "agent": "e", "scope": [("m", ["c", "f"]), ("x", [])]}, {"id": 12, "ts": 19_500, "op": "settle", "agent": "e", "scope": [("m", ["c", "f"]), ("x", [])]},
        {"id": 13, "ts": 19_600, "op": "sweep", "agent": "e"}, {"id": 14, "ts": 19_700, "op": "settle", "agent": "e", "scope": [("m", ["c", "f"]), ("x", [])]},
        {"id": 15, "ts": 19_800, "op": "acquire", "agent": "f", "symbol": "f", "ancestors": []}, {"id": 16, "ts": 19_900, "op": "dequeue", "agent": "f", "symbol": "f"}, {"id": 17, "ts": 20_000, "op": "release_all", "agent": "e"},
    ]
    got = state.replay(pd.DataFrame([base | x for x in log]))
    # 12: expired at 19,000, but nothing has swept it yet.
    assert got.outcome.tolist() == ["acquired", "denied", "denied", "preempted", "released", "denied", "acquired", "transferred", "ignored", "refreshed", "denied", "denied", "swept", "settled", "denied", "cancelled", "released"]
    assert got.holder.tolist()[5] == "c"


def test_task_request_and_session_folds(spark):
    def fold(fn, rows_, schema):
        return [tuple(r) for r in fn(spark.createDataFrame(rows_, schema)).orderBy("id").collect()]

    tasks = [(1, "add", None, None, False), (2, "claim", "a", None, False), (3, "claim", "b", None, False), (4, "state", "b", "done", False), (5, "submit", "b", None, False), (6, "submit", "a", None, False), (7, "approve", "a", None, False), (8, "reject", "b", None, False), (9, "assign", "b", "c", False), (10, "assign", "b", "c", False), (11, "reclaim", None, None, False), (12, "claim", "d", None, False), (13, "state", "e", "failed", True)]
    got = fold(state.task_fold, [(i, i * 10, "T1", op, a, v, f) for i, op, a, v, f in tasks], "id long, ts long, task string, op string, agent string, value string, force boolean")
    assert [(x[2], x[3], x[4]) for x in got] == [("done", "pending", None), ("done", "running", "a"), ("refused", "running", "a"), ("refused", "running", "a"), ("refused", "running", "a"), ("done", "review", "a"), ("refused", "review", "a"), ("done", "running", "a"), ("done", "running", "c"), ("unchanged", "running", "c"), ("done", "pending", None), ("done", "running", "d"), ("done", "failed", "d")]

    schema = "id long, ts long, request string, op string, agent string, from_agent string, to_agent string, kind string, deadline_at long"
    one = lambda i, ts, r, op, agent=None, frm=None, to=None, kind=None, due=None: (i, ts, r, op, agent, frm, to, kind, due)
    log = [
        one(1, 0, "r1", "open", "a", "a", "b", "question", 100), one(2, 1, "r1", "accept", "c"), one(3, 2, "r1", "accept", "b"), one(4, 3, "r1", "accept", "b"), one(5, 4, "r1", "fulfill", "b"), one(6, 5, "r1", "cancel", "a"),
        one(7, 0, "r2", "open", "a", "a", None, "lease-transfer", None), one(8, 1, "r2", "accept", "a"), one(9, 2, "r2", "symbol_free"), one(10, 0, "r3", "open", "a", "a", "b", "review", 50), one(11, 49, "r3", "sweep"), one(12, 50, "r3", "sweep"),
        one(13, 0, "r4", "open", "a", "a", "a", "review"), one(14, 0, "r5", "open", "a", "a", "b", "lease-transfer"), one(15, 1, "r5", "accept", "b"), one(16, 0, "r6", "open", "a", "a", "b", "question", 10), one(17, 10, "r6", "accept", "b"), one(18, 11, "r6", "decline", "b"),
    ]
    got = {x[0]: (x[2], x[3]) for x in fold(state.request_fold, log, schema)}
    assert [got[i] for i in range(1, 7)] == [("done", "open"), ("refused", "open"), ("done", "accepted"), ("refused", "accepted"), ("done", "fulfilled"), ("refused", "fulfilled")]
    assert [got[i] for i in range(7, 13)] == [("done", "open"), ("refused", "open"), ("done", "fulfilled"), ("done", "open"), ("ignored", "open"), ("done", "expired")]
    assert [got[i] for i in range(13, 19)] == [("refused", None), ("done", "open"), ("transferred", "fulfilled"), ("done", "open"), ("refused", "expired"), ("refused", "expired")]

    sessions = [(1, 0, "s1", "open", "mcp"), (2, 0, "s2", "open", "hook"), (3, 10_000, "s1", "end", None), (4, 20_000, "s3", "open", "mcp"), (5, 50_000, "s3", "heartbeat", None), (6, 70_000, None, "sweep", None), (7, 110_001, None, "sweep", None)]
    got = fold(state.session_fold, [(i, ts, "a", s, op, t, False) for i, ts, s, op, t in sessions], "id long, ts long, agent string, session string, op string, transport string, keep boolean")
    assert [(x[2], x[3]) for x in got] == [("opened", False), ("opened", False), ("ended", False), ("opened", False), ("alive", False), ("expired 1", False), ("expired 1", True)]


def test_diff_and_check(spark):
    schema = "id string, path string, parent_id string, own_hash string"
    stored = spark.createDataFrame([("f", "p", None, "0"), ("c", "p", "f", "1"), ("m", "p", "c", "2"), ("x", "p", "c", "3")], schema)
    parsed = spark.createDataFrame([("f", "p", None, "0"), ("c", "p", "f", "1"), ("m", "p", "c", "9"), ("n", "p", "c", "4"), ("o", "p", "n", "5"), ("q", "new", None, "6")], schema)
    changes = diff.changed_symbols(stored, parsed)
    assert rows(changes.select("id", "change", F.coalesce("covering", F.lit("-")))) == [("m", "modified", "c"), ("n", "added", "c"), ("o", "added", "c"), ("q", "added", "-"), ("x", "removed", "c")]
    leases = spark.createDataFrame([("L1", "m", "me", "active", 1), ("L2", "f", "you", "active", 2), ("L3", "c", "me", "expired", 3)], "id string, symbol_id string, agent string, state string, acquired_at long")
    got = diff.check(changes, stored, leases, "me")
    assert rows(got.select("id", "covered", F.coalesce("holder", F.lit("-")))) == [("m", True, "-"), ("n", False, "you"), ("o", False, "you"), ("q", True, "-"), ("x", False, "you")]


def test_guard_advises(spark):
    schema = "id string, path string, kind string, name string, fqn string, parent_id string, start_byte long, role string"
    symbols = spark.createDataFrame([("f", "a.py", "file", "a.py", "a.py", None, 0, None), ("c", "a.py", "class", "C", "C", "f", 1, None), ("m", "a.py", "method", "m", "C.m", "c", 2, None), ("g", "b.py", "file", "b.py", "b.py", None, 0, None)], schema)
    leases = spark.createDataFrame([("L1", "m", "you", "active", 0, 100_000, 0), ("L2", "g", "me", "active", 0, 100_000, 0), ("L3", "c", "old", "active", 0, 500, 0)], "id string, symbol_id string, agent string, state string, acquired_at long, expires_at long, priority long")
    asked = spark.createDataFrame([("a.py", None), ("a.py", "c"), ("b.py", None), ("new.py", None)], "path string, symbol string")
    got = {(r.path, r.symbol): r for r in diff.guard(asked, symbols, leases, "me", 1000).collect()}
    assert {k: v.verdict for k, v in got.items()} == {("a.py", "f"): "denied", ("a.py", "c"): "denied", ("b.py", "g"): "allowed", ("new.py", None): "allowed"}
    assert [(x.action, x.symbol, x.secs) for x in got["a.py", "f"].suggestions] == [("request-transfer", "a.py:C.m", 99), ("narrow", "a.py:C.m", 99)]
    assert len(got["a.py", "c"].suggestions) == 1 and got["b.py", "g"].via == "b.py" and got["new.py", None].unindexed
    soon = diff.guard(asked.limit(1), symbols, leases, "me", 71_000).first()
    assert soon.suggestions[0].action == "wait"
    free = diff.guard(asked.limit(1), symbols, leases.limit(0), "me", 0).first()
    assert free.verdict == "warn" and free.suggestions[0].action == "acquire"


def test_contention_and_claims(spark):
    symbols = spark.createDataFrame([("f", "a.py", "file", "a.py", "a.py", None, 0), ("m", "a.py", "method", "m", "m", "f", 2), ("n", "b.py", "file", "b.py", "b.py", None, 0)], "id string, path string, kind string, name string, fqn string, parent_id string, start_byte long")
    tasks = spark.createDataFrame([("T1", "pending", None, 1, 1, None), ("T2", "pending", None, 5, 2, "testing"), ("T3", "pending", None, 0, 3, None), ("T4", "running", "a", 0, 4, None)], "id string, state string, assignee string, priority long, created_at long, required_capability string")
    scope = spark.createDataFrame([("T1", "m"), ("T2", "n"), ("T4", "m")], "task_id string, symbol_id string")
    leases = spark.createDataFrame([("L1", "f", "a", "active", 0, 100, 0)], "id string, symbol_id string, agent string, state string, acquired_at long, expires_at long, priority long")
    deps = spark.createDataFrame([], "task_id string, depends_on string")
    held = schedule.contention(tasks, scope, symbols, leases, 50)
    assert rows(held.select("task_id", "holder")) == [("T1", "a")]  # a's own task isn't in a's way
    planned = schedule.plan(tasks, deps, held)
    agents = spark.createDataFrame([("t", False, "testing"), ("p", True, None)], "name string, paused boolean, capability string")
    first = lambda who: [r.id for r in schedule.claimable(planned, tasks, agents, who).collect()]
    assert first("t") == ["T2", "T3"] and first("p") == [] and first("nobody") == ["T3"]
    assert tuple(schedule.summary(planned, spark.createDataFrame([], "node string, component string")).first()) == (2, 3, 1, 0, 1)


def test_scanners(spark):
    files = spark.createDataFrame([("a.ts", "app.get('/pay', f)\n// app.post('/no')\nrouter.route(\"/all\")\n" + " " * 160 + "@PostMapping(\"/x\")\nr.Route(`/é`,\n  methods=['put', 'GET'])"), ("s.sql", "ALTER TABLE pay ADD b int;\nCREATE TABLE\n IF NOT EXISTS \"public\".\"Pay\" (a int);\nDROP TABLE old;"), ("q.py", "x = 'SELECT * FROM public.pay JOIN gone'\nfrom os import x")], "path string, text string")
    assert rows(tx.routes(files).select("path", "method", "route", F.coalesce("handler", F.lit("-")))) == [("a.ts", "ANY", "/all", "-"), ("a.ts", "GET", "/pay", "f"), ("a.ts", "POST", "/x", "-"), ("a.ts", "PUT|GET", "/é", "methods")]
    tables = tx.tables_defined(files)
    assert rows(tables) == [("s.sql", "old", "DROP TABLE", 3), ("s.sql", "pay", "CREATE TABLE IF NOT EXISTS", 1)]
    assert rows(tx.table_references(files.filter("path = 'q.py'"), tables)) == [("q.py", "pay")]
    assert tx.service_name("x/go.mod", "module a.b/c/pay\n") == "pay" and tx.service_name("x/Cargo.toml", "[workspace]\n") is None
    assert tx.service_name("svc/build.gradle", "") == "svc" and tx.service_name("build.gradle", "") == "root" and tx.service_name("package.json", '{"name": "n"}') == "n"
    assert tx.service_name("pyproject.toml", '[project]\nversion = "1"\n[tool.poetry]\nname = "p"') == "p" and tx.service_name("package.json", "{") is None
    services = spark.createDataFrame([("",), ("a",), ("a/b",)], "dir string")
    assert rows(tx.owning_service(spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("r.ts",)], "path string"), services)) == [("a/b/c.ts", "a/b"), ("a/x.ts", "a"), ("r.ts", "")]
    assert rows(tx.parent_service(services)) == [("a", ""), ("a/b", "a")]


def test_route_goes_to_its_symbol(spark):
    found = spark.createDataFrame([("p", 50, "GET", "/a", None), ("p", 120, "GET", "/b", None), ("p", 900, "GET", "/c", None), ("p", 50, "GET", "/d", "next")], "path string, at long, method string, route string, handler string")
    symbols = spark.createDataFrame([("outer", "p", "outer", 0, 100), ("inner", "p", "inner", 40, 80), ("next", "p", "next", 200, 300)], "id string, path string, name string, start_byte long, end_byte long")
    got = tx.attribute_routes(found, symbols)
    assert rows(got.select("route", "symbol")) == [("/a", "inner"), ("/b", "next"), ("/d", "next")]
    meta = dict(map(tuple, tx.endpoint_meta(got).collect()))
    assert meta["inner"] == '{"method":"GET","path":"/a"}' and '"routes":[{"method":"GET","path":"/d"},{"method":"GET","path":"/b"}]' in meta["next"]


def test_scalars(spark):
    df = spark.createDataFrame([("a/./b/../c", -1500, "Hello,  World! ")], "p string, n long, t string")
    got = df.select(fn.normalize_path(F.col("p")), fn.secs_left(F.col("n"), 0), fn.age_secs(F.lit(0), -1500), fn.slug(F.col("t")), fn.human_secs(F.lit(59)), fn.human_secs(F.lit(61))).first()
    assert tuple(got) == ("a/c", -2, -1, "hello-world", "59s", "1m 1s")
    tests = ["tests/a.py", "a/test_b.py", "a/b_test.go", "a.spec.ts", "src/a.py", "conftest.py", "x/PayTest.java", "latest.py"]
    flags = [r[0] for r in spark.createDataFrame([(t,) for t in tests], "p string").select(fn.is_test_path(F.col("p"))).collect()]
    assert flags == [True, True, True, True, False, False, True, False]
    words = spark.createDataFrame([("Implement the boxes, payments and x",)], "t string").select(fn.keywords(F.col("t"))).first()[0]
    assert words == ["boxes", "box", "payments", "payment"]
    kinds = spark.createDataFrame([("cursor", "dev", None), ("vim", "person", "ide"), (None, "build-bot", None), ("agent-x", "x", None), ("Copilot", "x", "cli"), (None, "x", None)], "tool string, kind string, transport string")
    assert [r[0] for r in kinds.select(fn.worker_type(F.col("tool"), F.col("kind"), F.col("transport"))).collect()] == ["human", "human", "service", "service", "ai", "human"]


def test_resolve_and_owner(spark):
    schema = "id string, path string, kind string, name string, fqn string, start_byte long, role string"
    repos = spark.createDataFrame([("R1", "root", ".")], "id string, name string, root_path string")
    symbols = spark.createDataFrame([("s1", "api", "service", "pay", "pay", 0, None), ("f1", "api/a.py", "file", "a.py", "api/a.py", 0, None), ("m1", "api/a.py", "method", "run", "A.run", 5, "api"), ("m2", "api/b.py", "method", "run", "B.run", 5, None)] + [(f"x{i:02d}", "z", "method", "same", f"Z{i}.same", i, None) for i in range(30)], schema).withColumn("repo_id", F.lit("R1"))
    ids = lambda t: [r.id for r in relational.resolve(symbols, t, repos).collect()]
    assert ids("m1") == ["m1"] and ids("service:pay") == ["s1"] and ids("api/a.py:A.run") == ["m1"] and ids("api/a.py") == ["f1"]
    assert ids("run") == ["m1", "m2"] and ids("RUN") == ["m1", "m2"] and ids("none") == []
    assert ids("root:api/b.py:B.run") == ["m2"] and len(ids("same")) == 30 and len(ids("SAME")) == 25
    assert relational.resolve_one(symbols, "A.run").first().id == "m1"
    for text, error in (("nothing like it", relational.NotFound), ("run", relational.Ambiguous)):
        with pytest.raises(error):
            relational.resolve_one(symbols, text)
    paths = spark.createDataFrame([("api/a.py",), ("db/x.sql",), ("README",)], "path string")
    assert rows(relational.owner_rule(paths, [("*", "core"), ("*.sql", "data"), ("/api/", "api")]).select("path", "owner")) == [("README", "core"), ("api/a.py", "api"), ("db/x.sql", "data")]
    import re

    match = lambda glob, path: bool(re.search(relational.glob_pattern(glob), path))
    assert match("docs", "docs/a") and match("docs", "docs") and not match("docs", "x/docs/a") and not match("api/", "x/api/a") and not match("api/", "api")
    assert match("*.rs", "a/b.rs") and match("a/*.rs", "a/b.rs") and not match("a/*.rs", "x/a/b.rs") and match("a/**/b", "a/b") and match("a?c.{py,rs}", "abc.rs") and match("x[0-9]", "x7/q") and match("x*[!0-9]", "q/xa")
    assert relational.owner_rules("# c\n* core # x\nlone\n/a/ b c\n") == [("*", "core"), ("/a/", "b c")]


def inferred(scope, edges, tasks, deps, parent):
    """The rules of dependency inference in plain Python."""
    open_ = {t for t, state in tasks if state not in ("done", "failed")}
    above = lambda x: {x} | (above(parent[x]) if parent.get(x) else set())
    by = {}
    for t, x in scope:
        for src, dst, kind in edges:
            for u, y in scope:
                if t in open_ and u in open_ and t != u and src == x and y in above(dst) and kind in ("calls", "uses", "imports", "queries") and (t, u) not in deps:
                    by[t, u] = min(by.get((t, u), (src, kind)), (src, kind))
    known, out = set(deps), []
    for t, u in sorted(by):
        reach = {u}
        for _ in tasks:
            reach |= {b for a, b in known if a in reach}
        if t not in reach:
            known.add((t, u))
            out.append((t, u, *by[t, u]))
    return out


def test_dependencies_are_inferred_by_all_rules(spark):
    rng = random.Random(11)
    parent = {"f": None, "K": "f", "L": "f", "K.a": "K", "K.b": "K", "L.a": "L", "L.b": "L"}
    symbols = spark.createDataFrame(list(parent.items()), "id string, parent_id string")
    states = ["pending", "running", "failed", "done", "review", "pending", "blocked"]
    tasks = [(f"T{i}", s) for i, s in enumerate(states)]
    seen = 0
    for deps in (set(), {("T0", "T1"), ("T4", "T5"), ("T5", "T2")}):
        scope = sorted({(t, rng.choice(sorted(parent))) for t, _ in tasks for _ in range(2)})
        edges = sorted({(rng.choice(sorted(parent)), rng.choice(sorted(parent)), rng.choice(["calls", "uses", "tests"])) for _ in range(16)})
        want = inferred(scope, edges, tasks, deps, parent)
        got = state.infer_dependencies(
            spark.createDataFrame(scope, "task_id string, symbol_id string"), spark.createDataFrame(edges, "src string, dst string, kind string"),
            spark.createDataFrame(tasks, "id string, state string"), spark.createDataFrame(sorted(deps), "task_id string, depends_on string"), symbols,
        )
        assert rows(got) == want
        seen += len(want)
    assert seen


def test_ten_thousand_ownership_rules(spark):
    import re

    rng = random.Random(8)
    seg = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    makers = [lambda: "/".join(seg() for _ in range(rng.randint(1, 4))), lambda: "/".join(seg() for _ in range(rng.randint(1, 3))) + "/", lambda: f"/{seg()}/{seg()}*", lambda: f"{seg()}/**/*.{rng.choice(['py', 'ts', 'go'])}", lambda: f"*{rng.choice('abc')}.{rng.choice(['py', 'ts', 'go'])}", lambda: f"{seg()}/{{{seg()},{seg()}}}/?y"]
    rules = [("*", "all"), ("*x", "loose"), *[(rng.choice(makers)(), f"o{i}") for i in range(10_000)]]
    paths = sorted({"/".join([seg() for _ in range(rng.randint(1, 5))]) + rng.choice(["", ".py", ".ts", ".md"]) for _ in range(150)})
    compiled = [re.compile(relational.glob_pattern(g)) for g, _ in rules]
    want = [(p, max(i for i, x in enumerate(compiled) if x.search(p))) for p in paths]
    got = relational.owner_rule(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    assert rows(got) == [(p, i, rules[i][1]) for p, i in want]
    assert rows(relational.owner_rule(spark.createDataFrame([("a",)], "path string"), [("b", "x")])) == [("a", -1, None)]


def test_keywords_of_many_goals_as_of_each(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB_") for _ in range(rng.randint(1, 7)))
    made = [(f"s{i:03d}", f"p{i % 7}/{word()}", "class", word(), f"{word()}.{word()}", i, None) for i in range(150)]
    symbols = spark.createDataFrame(made, "id string, path string, kind string, name string, fqn string, start_byte long, role string")
    texts = [("g1", "Add abab and baba"), ("g2", "the BAB aaa's bbb, zzz"), ("g3", "for the new"), ("g4", "abab")]
    got = relational.goal_matches(spark.createDataFrame(texts, "goal string, text string"), symbols, most=5)
    want = []
    for goal, text in texts:
        want += [(goal, r.id, r.place) for r in relational.keyword_matches(symbols, text, 5).collect()]
    assert rows(got) == sorted(want) and want


def test_who_owns_names_others_beside_an_own_lease(spark):
    from types import SimpleNamespace

    from loomgraph.operators import reports

    symbols = spark.createDataFrame([("f", "a.py", "file", "a.py", "a.py", None, 0, "R1"), ("c", "a.py", "class", "C", "C", "f", 5, "R1")], "id string, path string, kind string, name string, fqn string, parent_id string, start_byte long, repo_id string")
    leases = spark.createDataFrame([("L1", "f", "me", 0, 1, 99_000, None, "active"), ("L2", "c", "you", 0, 1, 99_000, None, "active")], "id string, symbol_id string, agent string, priority long, acquired_at long, expires_at long, task string, state string")
    m = SimpleNamespace(symbols=symbols, leases=leases, repos=spark.createDataFrame([("R1", "root", ".")], "id string, name string, root_path string"))
    assert [tuple(r) for r in reports.who_owns(m, "f", "me", 0).collect()] == [("yours", "you", 99)]
    assert [tuple(r) for r in reports.who_owns(m, "f", "you", 0).collect()] == [("held", "me", 99)]
    assert [tuple(r) for r in reports.who_owns(m, "c", "him", 200_000).collect()] == [("nobody", None, None)]


def test_short_and_long_keywords_are_looked_up_in_blocks(spark, monkeypatch):
    made = [("s1", "p/x", "class", "As", "As", 1, None), ("s2", "p/y", "class", "LongKeyword", "a.LongKeyword", 2, None), ("s3", "p/z", "class", "Keyword", "b.Keyword", 3, None)]
    symbols = spark.createDataFrame(made, "id string, path string, kind string, name string, fqn string, start_byte long, role string")
    texts = [("g1", "an ass"), ("g2", "the longkeyword"), ("g3", "keywords, nowhere")]
    monkeypatch.setattr(relational, "KEYWORDS", 2)
    got = relational.goal_matches(spark.createDataFrame(texts, "goal string, text string"), symbols, most=5)
    want = [(goal, r.id, r.place) for goal, text in texts for r in relational.keyword_matches(symbols, text, 5).collect()]
    assert rows(got) == sorted(want) and len(want) == 4


def test_contention_meets_two_leases_a_symbol(spark, monkeypatch):
    rng = random.Random(6)
    symbols = spark.createDataFrame([("f", "a.py", "file", "a.py", "a.py", None)] + [(f"m{i}", "a.py", "method", f"m{i}", f"m{i}", "f") for i in range(12)], "id string, path string, kind string, name string, fqn string, parent_id string")
    made = [(f"L{i:03d}", rng.choice(["f", "f", "m1", "m2"]), f"A{rng.randint(0, 3)}", rng.choice([50, 150]), 1, rng.choice(["active", "expired"])) for i in range(120)]
    leases = spark.createDataFrame(made, "id string, symbol_id string, agent string, expires_at long, priority long, state string")
    tasks = [(f"T{i}", rng.choice([None, "A0", "A1", "A2", "A3"])) for i in range(12)]
    met, plain = [], relational.conflicts
    monkeypatch.setattr(relational, "conflicts", lambda held, *rest: (met.append(held), plain(held, *rest))[1])
    got = schedule.contention(spark.createDataFrame(tasks, "id string, assignee string"), spark.createDataFrame([(f"T{i}", f"m{i}") for i in range(12)], "task_id string, symbol_id string"), symbols, leases, 100)
    want = []
    for i, (task, agent) in enumerate(tasks):
        against = [(s, lease, f"m{i}", holder, "same" if s != "f" else "ancestor") for lease, s, holder, until, _, state in made if state == "active" and until > 100 and holder != (agent or "") and s in ("f", f"m{i}")]
        if against:
            s, lease, symbol, holder, relation = min(against)
            want.append((task, symbol, lease, holder, relation))
    assert rows(got) == sorted(want) and want
    assert max(r["count"] for r in met[0].groupBy("symbol_id").count().collect()) == 2


def test_claim_is_the_first_claimable_of_the_whole_plan(spark, monkeypatch):
    """The best tasks lie on a cycle of done ones that is longer than HOPS, or only wait; some are held by what is above or below."""
    monkeypatch.setattr(schedule, "HOPS", 2)
    rng = random.Random(3)
    symbols = spark.createDataFrame([("f", "a.py", "file", "a.py", "a.py", None), ("h", "b.py", "file", "b.py", "b.py", None)] + [(f"m{i}", "a.py", "method", f"m{i}", f"m{i}", "f" if i % 2 else "h") for i in range(12)], "id string, path string, kind string, name string, fqn string, parent_id string")
    scope = spark.createDataFrame([(f"T{i:02d}", f"m{i}") for i in range(10)] + [("T10", "f"), ("T11", "gone")], "task_id string, symbol_id string")
    agents = spark.createDataFrame([("t", False, "testing")], "name string, paused boolean, capability string")
    for held, loop, want in ((["m6", "m11", "gone"], 5, 1), (["f", "m6", "h"], 0, 1), (["m0"], 5, 1), (["f", "h"], 5, 0)):
        made = [(f"T{i:02d}", "pending" if i == 0 or i >= loop and (want and i < 11) else "done", None, 9 if i < loop else rng.randint(0, 3), rng.randint(0, 3), rng.choice([None, "testing", "other"]) if i >= loop else None) for i in range(12)]
        made[9] = ("T09", "pending", None, 0, 0, None)
        if held == ["f", "m6", "h"]:
            made[11] = ("T11", "pending", None, 0, 1, None)
        tasks = spark.createDataFrame(made, "id string, state string, assignee string, priority long, created_at long, required_capability string")
        links = [(f"T{a:02d}", f"T{(a + 1) % loop:02d}") for a in range(loop)] + [("T08", "T06"), ("T05", "T99")]
        deps = spark.createDataFrame(links, "task_id string, depends_on string")
        leases = spark.createDataFrame([(f"L{s}", s, "other", "active", 150, 0) for s in held], "id string, symbol_id string, agent string, state string, expires_at long, priority long")
        planned = schedule.plan(tasks, deps, schedule.contention(tasks, scope, symbols, leases, 100))
        first = rows(schedule.claimable(planned, tasks, agents, "t").limit(1))
        assert len(first) == want
        assert rows(schedule.claim(tasks, deps, scope, symbols, leases, agents, "t", 100)) == first


def test_claim_makes_no_plan(spark, monkeypatch):
    for name in ("plan", "contention"):
        monkeypatch.delattr(schedule, name)
    monkeypatch.setattr(schedule.g, "components_of_cycles", None)
    symbols = spark.createDataFrame([("f", "a.py", "file", "a.py", "a.py", None)], "id string, path string, kind string, name string, fqn string, parent_id string")
    tasks = spark.createDataFrame([("T1", "pending", None, 5, 1, None), ("T2", "pending", None, 3, 2, None), ("T3", "pending", None, 4, 2, None)], "id string, state string, assignee string, priority long, created_at long, required_capability string")
    leases = spark.createDataFrame([("L", "f", "x", "active", 150, 0)], "id string, symbol_id string, agent string, state string, expires_at long, priority long")
    none = spark.createDataFrame([], "name string, paused boolean, capability string")
    deps = spark.createDataFrame([("T2", "T3")], "task_id string, depends_on string")
    scope = spark.createDataFrame([("T1", "f")], "task_id string, symbol_id string")
    assert rows(schedule.claim(tasks, deps, scope, symbols, leases, none, "a", 100)) == [("T3", 4, 2)]


def test_requests_and_tasks_are_replayed_without_a_frame_a_key(spark):
    schema = "id long, ts long, request string, op string, agent string, from_agent string, to_agent string, kind string, deadline_at long"
    log = spark.createDataFrame([(3 * k + i, 10 - 5 * i, f"r{k}", op, "b", "a", "b", "review", None) for k in range(400) for i, op in enumerate(["fulfill", "accept", "open"])], schema)
    got = state.request_fold(log)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert {r.id: (r.request, r.outcome, r.state) for r in got.collect()} == {3 * k + i: (f"r{k}", "done", x) for k in range(400) for i, x in enumerate(["fulfilled", "accepted", "open"])}


def test_conflicts_make_their_rows_in_the_last_join(spark):
    rng = random.Random(8)
    symbols = spark.createDataFrame([("s", None), ("f", "s")] + [(f"m{i}", "f" if i % 3 else "m0") for i in range(1, 30)] + [("m0", "f")], "id string, parent_id string")
    made = [(f"L{i:03d}", rng.choice(["s", "f", "m0", "m1", "m3", "gone"]), f"A{rng.randint(0, 3)}", rng.choice([50, 150]), 1, rng.choice(["active", "expired"])) for i in range(90)]
    leases = spark.createDataFrame(made, "id string, symbol_id string, agent string, expires_at long, priority long, state string")
    asked = [(f"T{i}", f"m{i % 30}" if i < 38 else "f", f"A{i % 4}") for i in range(40)]
    up = {"s": [], "f": ["s"], "m0": ["f", "s"]} | {f"m{i}": ["f", "s"] if i % 3 else ["m0", "f", "s"] for i in range(1, 30)}
    want = [
        (task, x, agent, lease, holder, "same" if x == at else "ancestor" if at in up[x] else "descendant")
        for task, x, agent in asked for lease, at, holder, until, _, state in made
        if state == "active" and until > 100 and holder != agent and (at == x or at in up[x] or x in up.get(at, []))
    ]
    got = relational.conflicts(leases, symbols, spark.createDataFrame(asked, "task string, symbol string, agent string"), 100)
    assert rows(got.select("task", "symbol", "agent", "lease", "holder", "relation")) == sorted(want) and want
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "holder" in joins[0]
