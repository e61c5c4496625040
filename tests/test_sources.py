import json

from loomgraph.operators import arch, parse, reports
from loomgraph.sources import repo, watch
from loomgraph.streaming import jobs
from pyspark.sql import functions as F

PAY = """import os
from .util import helper as h

LIMIT = 3


class Pay:
    def charge(self, x):
        return helper(x)

    def charge_all(self, xs):
        return [self.charge(x) for x in xs]


def test_charge():
    assert Pay().charge(1)
"""
UTIL = "def helper(x):\n    return db('select * from \"public\".orders')\n"
ROUTES = """import { charge } from './pay';
app.post("/pay", createPayment);
export async function createPayment(req) {
  // app.get("/no")
  return charge(req.body);
}
class Refunds {
  refund(x) { return "}"; }
}
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parse_symbols_and_edges(spark):
    files = spark.createDataFrame([("src/pay.py", PAY), ("src/util.py", UTIL), ("web/routes.ts", ROUTES), ("web/pay.ts", "export function charge(x: number) { return x; }\n"), ("db/a.sql", "CREATE TABLE orders (a int);"), ("bad.py", "def ("), ("web/package.json", '{"name": "web"}'), ("notes.txt", "x")], "path string, text string")
    made = parse.scan(files)
    s = made["symbols"]
    assert rows(s.filter("path = 'src/pay.py'").select("kind", "fqn", F.coalesce("role", F.lit("-")))) == [("class", "Pay", "-"), ("constant", "LIMIT", "-"), ("file", "src/pay.py", "-"), ("function", "Pay.charge", "-"), ("function", "Pay.charge_all", "-"), ("function", "test_charge", "test")]
    assert rows(s.filter("path = 'web/routes.ts' and kind <> 'file'").select("kind", "fqn", F.coalesce("role", F.lit("-")))) == [("class", "Refunds", "-"), ("function", "createPayment", "api"), ("method", "Refunds.refund", "-")]
    assert json.loads(s.filter("role = 'api'").first().meta) == {"method": "POST", "path": "/pay"}
    fqn = s.select("id", "path", "fqn")
    e = made["edges"].join(fqn.toDF("src", "p", "a"), "src").join(fqn.toDF("dst", "q", "b"), "dst")
    assert rows(e.filter("kind <> 'contains'").select("a", "b", "kind")) == [
        ("Pay.charge", "helper", "calls"), ("Pay.charge_all", "Pay.charge", "calls"), ("createPayment", "charge", "calls"), ("helper", "orders", "queries"), ("src/pay.py", "src/util.py", "imports"),
        ("test_charge", "Pay", "tests"), ("test_charge", "Pay.charge", "tests"), ("web/routes.ts", "web/pay.ts", "imports"),
    ]
    stats = made["stats"].first()
    assert (stats.files_seen, stats.files_indexed, stats.files_failed, stats.services) == (7, 4, 1, 1)
    # A scan of nothing new reads nothing; one without a file drops its symbols, and the leases on them.
    again = parse.scan(files, made["files"], s)
    assert again["stats"].first().files_indexed == 0 and again["dropped"].count() == 0
    gone = parse.scan(files.filter("path <> 'src/util.py'"), made["files"], s)["dropped"]
    assert gone.count() == 2
    leases = s.filter("fqn = 'helper'").select(F.lit("L").alias("id"), F.lit("a").alias("agent"), F.col("id").alias("symbol_id"), F.lit(None).cast("string").alias("task"), F.lit("active").alias("state"))
    assert parse.retire_leases(leases, gone).count() == 1


def test_a_nested_change_is_not_its_holder_s():
    before, after = parse.parse_text("a.py", PAY), parse.parse_text("a.py", PAY.replace("return helper(x)", "return helper(x + 1)"))
    changed = [x["fqn"] for x, y in zip(before["symbols"], after["symbols"], strict=True) if x["own_hash"] != y["own_hash"]]
    assert changed == ["Pay.charge"] and before["own_hash"] == after["own_hash"] and before["content_hash"] != after["content_hash"]


def test_import_resolution(spark):
    names = ["src/a/b.py", "src/a/__init__.py", "pkg/x.py", "r/src/lib.rs", "r/src/pay.rs", "r/src/net/mod.rs", "go/pkg/pay/one.go", "go/pkg/pay/two.go", "j/com/Ledger.java", "c/inc/u.h", "c/m.cpp", "w/i/index.ts", "w/q.ts"]
    lang = {"py": "python", "rs": "rust", "go": "go", "java": "java", "h": "cpp", "cpp": "cpp", "ts": "typescript"}
    asked = {"src/a/b.py": [".", ".b", "a", "os"], "pkg/x.py": ["src.a.b"], "r/src/lib.rs": ["pay", "crate::net::send", "std::io"], "go/pkg/pay/one.go": ["example.com/m/pkg/pay", "fmt"], "j/com/Ledger.java": ["x.y.Ledger", "x.y.*"], "c/m.cpp": ["u.h", "inc/u.h", "stdio.h"], "w/q.ts": ["./i", "react", "./q.js"]}
    parsed = spark.createDataFrame([(p, lang[p.rpartition(".")[2]], specs) for p, specs in asked.items()], "path string, lang string, imports array<string>")
    got = rows(parse.resolve_imports(parsed, spark.createDataFrame([(n,) for n in names], "path string")))
    assert got == [
        ("c/m.cpp", "inc/u.h", "c/inc/u.h"), ("c/m.cpp", "u.h", "c/inc/u.h"), ("go/pkg/pay/one.go", "example.com/m/pkg/pay", "go/pkg/pay/one.go"), ("go/pkg/pay/one.go", "example.com/m/pkg/pay", "go/pkg/pay/two.go"),
        ("j/com/Ledger.java", "x.y.Ledger", "j/com/Ledger.java"), ("pkg/x.py", "src.a.b", "src/a/b.py"), ("r/src/lib.rs", "crate::net::send", "r/src/net/mod.rs"), ("r/src/lib.rs", "pay", "r/src/pay.rs"),
        ("src/a/b.py", ".b", "src/a/b.py"), ("src/a/b.py", "a", "src/a/__init__.py"), ("w/q.ts", "./i", "w/i/index.ts"), ("w/q.ts", "./q.js", "w/q.ts"),
    ]


def test_two_locals_or_two_imports_stay_unresolved(spark):
    symbols = spark.createDataFrame([("1", "a", "f"), ("2", "a", "f"), ("3", "b", "g"), ("4", "c", "g"), ("5", "d", "h"), ("6", "e", "k"), ("7", "x", "k")], "id string, path string, name string")
    refs = spark.createDataFrame([("a", n) for n in ("f", "g", "h", "k", "none")], "path string, name string")
    imports = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "e")], "path string, target string")
    assert rows(parse.resolve_references(refs, symbols, imports).select("name", "dst")) == [("h", "5"), ("k", "6")]


def test_walk_skips_what_is_ignored(spark, tmp_path):
    made = {"a.py": "x", "sub/b.ts": "y", "sub/gen/c.ts": "z", "node_modules/m.js": "n", "out.py": "o", "sub/keep.py": "k", "big.py": "#" * (parse.MOST_BYTES + 1), "even.py": "#" * parse.MOST_BYTES, "readme.md": "r", "q.sql": "s", ".gitignore": "out.py\n*.log\n", "sub/.gitignore": "gen/\n*.py\n!keep.py\n", "sub/lost.py": "l", "sub/_x/__init__.ts": "u"}
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(r.path for r in repo.walk(spark, str(tmp_path)).select("path").collect()) == ["a.py", "even.py", "q.sql", "sub/_x/__init__.ts", "sub/b.ts", "sub/keep.py"]


def test_upsert_and_emit(spark, tmp_path):
    import os

    at = str(tmp_path / "t")
    table = lambda *r: spark.createDataFrame(r, "id string, n long")
    assert rows(repo.read_table(spark, at, "id string, n long")) == []
    before = repo.upsert(table(*[(f"k{i:02d}", i) for i in range(40)], (None, 7)), ["id"], at, buckets=8)
    held = {f: os.stat(f.removeprefix("file://").removeprefix("file:")).st_mtime_ns for f in before.inputFiles()}
    after = repo.upsert(table(("k03", 300), ("new", 1)), ["id"], at, buckets=8)
    want = sorted([(f"k{i:02d}", 300 if i == 3 else i) for i in range(40)] + [("new", 1)])
    assert rows(after.filter("id is not null")) == want and after.filter("id is null").count() == 1
    # Only the buckets of the two keys have new files; the others are the same files, untouched, and an older reader still has its own.
    kept = set(after.inputFiles()) & set(held)
    assert len(held) >= 6 and len(kept) >= len(held) - 2
    assert all(os.stat(f.removeprefix("file://").removeprefix("file:")).st_mtime_ns == t for f, t in held.items())
    assert rows(before.filter("id = 'k03'")) == [("k03", 3)] and rows(repo.read_table(spark, at, "id string, n long").filter("id = 'k03'")) == [("k03", 300)]
    # A manifest that isn't finished isn't read.
    (tmp_path / "t" / "manifests" / "9.tmp").write_text("{")
    assert repo.read_table(spark, at, "id string, n long").count() == 42
    events = spark.createDataFrame([(9, "y", None, None, None, None), (7, "x", "a", None, None, None)], "ts long, kind string, agent string, symbol_handle string, task string, detail string")
    repo.emit(events, str(tmp_path / "log"), 40)
    assert rows(spark.read.parquet(str(tmp_path / "log")).select("id", "kind")) == [(41, "x"), (42, "y")]


def test_boxes_by_depth(spark):
    schema = "id string, path string, kind string, name string, fqn string, parent_id string, start_byte long, role string, repo_id string"
    row = lambda i, path, kind, role=None: (i, path, kind, path.rpartition("/")[2], path, None, 0, role, "R1")
    symbols = spark.createDataFrame([row("s1", "api/package.json", "service"), row("s2", "api/lib/package.json", "service"), row("f1", "api/src/r.ts", "file"), row("f2", "api/lib/x.ts", "file"), row("f3", "main.ts", "file"), row("m1", "api/src/r.ts", "function", "api"), row("t1", "db/s.sql", "table")], schema)
    edges = spark.createDataFrame([("f1", "f2", "imports"), ("m1", "t1", "queries"), ("f2", "f1", "imports"), ("f1", "f1", "imports")], "src string, dst string, kind string")
    found = {}
    for depth in (0, 1, 2, 3, 9):
        boxes, owner = arch.layout(symbols, depth)
        found[depth] = {r.id: (r.kind, r.parent) for r in boxes.collect()}
        n = {r.node: r for r in arch.counts(symbols, boxes, owner).collect()}
        assert (n["s1"].files, n["s1"].symbols, n["s1"].endpoints, n["s2"].files, n["repo:R1"].files) == (1, 1, 1, 1, 1)
    assert found[0] == found[1] == {"s1": ("service", None), "s2": ("service", None), "repo:R1": ("repo", None), "t1": ("table", None)}
    assert found[2]["dir:R1:api/src"] == ("dir", "s1") and found[2]["dir:R1:api/lib"] == ("dir", "s2") and found[2]["dir:R1:"] == ("dir", "repo:R1")
    assert found[3] == found[9] and found[3]["f1"] == ("file", "s1")
    boxes, owner = arch.layout(symbols, 1)
    links = arch.box_edges(symbols, edges, boxes, owner)
    assert rows(links) == [("s1", "s2", "imports", 1), ("s1", "t1", "queries", 1), ("s2", "s1", "imports", 1)]
    assert rows(arch.cycles(links)) == [("s1", "s1"), ("s2", "s1")]


def test_notices_of_events(spark):
    events = spark.createDataFrame([(1, 0, "task.failed", "a", None, "T1", '{"reason": "no"}'), (2, 10_000_000, "task.failed", "a", None, "T1", '{"reason": "no"}'), (3, 10_000_000, "lease.denied", "b", "p:x", None, '{"conflicts": [{"holder": "c"}]}'), (4, 10_000_000, "lease.acquired", "b", "p:x", None, "{}"), (5, 10_000_000, "task.unblocked", None, None, "T2", "{}")], "id long, ts long, kind string, agent string, symbol_handle string, task string, detail string")
    got = {r.id: (r.severity, r.title, r.detail) for r in reports.event_notices(events, 10_000_000).collect()}
    assert got == {"evt:2": ("blocking", "T1 is stuck", "no"), "evt:3": ("warn", "b was refused p:x", "c is holding it."), "evt:5": ("info", "T2 can start", None)}


def test_timers(spark, tmp_path):
    import os

    schema = "key string, ms long, until long, ended boolean"
    for i, part in enumerate([[("x", 500, 1_000, False), ("y", 500, 1_000, False), ("w", 600, 900, False)], [("x", 900, 300_000, False), ("y", 950, 0, True)], [("z", 2_000_000, 9_000_000, False)], [("z", 2_100_000, 9_000_000, False)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        for f in (tmp_path / "in" / f"b{i}").iterdir():
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).select("key", F.timestamp_millis("ms").alias("at"), "until", "ended")
    assert dict(map(tuple, jobs.run_to_table(jobs.timer_expiry(stream), "append", "t").collect())) == {"x": 300_000, "w": 900}


def test_commands_end_with_a_code(spark):
    import os

    from loomgraph.api import Workspace, answer

    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    w = Workspace(spark, "/root/testdata/sf0.001")
    assert answer(w, "show", "C7")[0] == 0 and answer(w, "symbols", "no such thing")[0] == 1
    assert answer(w, "show", "nothing like it")[0] == 2 and answer(w, "no_command")[0] == 2
    assert answer(w, "guard", "A1", "not/indexed.py") == (0, ['{"path":"not/indexed.py","symbol":null,"verdict":"allowed","unindexed":true,"lease":null,"via":null,"holder":null,"suggestions":null}'])


def test_a_watched_folder_tells_of_what_appeared_changed_and_went(spark, tmp_path):
    root, state = tmp_path / "code", tmp_path / "state"
    (root / "sub" / "_x").mkdir(parents=True)
    (root / ".git").mkdir()

    def put(**texts):
        for name, text in texts.items():
            (root / name.replace("__", "/")).write_text(text)

    def step():
        """One run of the stream from its checkpoint, as after a restart."""
        stream = watch.watch(spark, str(root), str(state / "listings"), files_per_task=2)
        return jobs.run_to_table(stream, "append", "watched", str(state / "checkpoint"))

    def seen(out):
        return rows(out.select("path", "change", F.coalesce("text", F.lit("-"))))

    (root / "sub" / "_x" / "__init__.py").write_text("u")
    (root / ".git" / "no.py").write_text("n")
    (root / ".gitignore").write_text("*.log\n")
    put(a="1", b="2", **{"c.log": "x", "sub__d": "3"})
    assert seen(step()) == [("a", "added", "1"), ("b", "added", "2"), ("sub/_x/__init__.py", "added", "u"), ("sub/d", "added", "3")]
    put(a="changed", e="5")
    (root / "b").unlink()
    out = step()
    files, full = watch.to_look_at(out)
    assert full and rows(files) == [("a", "changed"), ("e", "5")]
    assert seen(out) == [("a", "modified", "changed"), ("b", "deleted", "-"), ("e", "added", "5")]
    put(b="again")
    out = step()
    assert not watch.to_look_at(out)[1]
    assert seen(out) == [("b", "added", "again")]
    assert len(list((state / "listings").iterdir())) <= 2


def test_a_listing_is_held_by_bucket_and_tasks_get_no_paths(tmp_path, monkeypatch):
    """As many files as wanted: what one process holds of a listing, and what is sent to tasks, is bounded."""
    root = tmp_path / "code"
    (root / "sub").mkdir(parents=True)
    (root / ".gitignore").write_text("*.log\n")
    (root / "sub" / ".gitignore").write_text("!kept.log\n/no*\n")
    wanted = {f"f{i}" for i in range(60)} | {f"sub/g{i}" for i in range(60)} | {"sub/kept.log"}
    for name in wanted | {"a.log", "sub/b.log", "sub/no1"}:
        (root / name).write_text(name)
    monkeypatch.setattr(watch, "HELD", 7)
    monkeypatch.setattr(watch, "BUCKETS", 4)
    reader = watch.FolderReader({"path": str(root), "listings": str(tmp_path / "listings"), "filespertask": "9"})
    loaded, load = [], reader._load
    monkeypatch.setattr(reader, "_load", lambda *x: (loaded.append(len(found := load(*x))), found)[1])
    one = reader.latestOffset()
    assert reader.latestOffset() == one
    parts = reader.partitions(reader.initialOffset(), one)
    assert len(parts) == -(-len(wanted) // 9) and not any("f1" in str(vars(p)) for p in parts)
    got = [x for p in parts for x in reader.read(p)]
    assert sorted(x[0] for x in got) == sorted(wanted) and all(x[1] == "added" and x[4] == x[0] for x in got)
    assert max(loaded) < len(wanted) // 2
    (root / "f3").unlink()
    (root / "f4").write_text("other")
    two = reader.latestOffset()
    assert sorted((x[0], x[1]) for p in reader.partitions(one, two) for x in reader.read(p)) == [("f3", "deleted"), ("f4", "modified")]
    reader.commit(two)
    assert [x.name for x in (tmp_path / "listings").iterdir()] == [str(two["listing"])]


def test_the_driver_lists_no_files_of_a_repository(spark, tmp_path, monkeypatch):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name in ("a.py", "src/_b.py", "src/.c.py", "src/node_modules/d.py"):
        (tmp_path / name).write_text("x")
    monkeypatch.setattr(spark, "createDataFrame", lambda data, *x, f=spark.createDataFrame: (sent.extend(data), f(data, *x))[1])
    sent = []
    assert sorted(r.path for r in repo.names(spark, str(tmp_path)).collect()) == ["a.py", "src/.c.py", "src/_b.py"]
    assert sorted(sent) == [(str(tmp_path), False), (f"{tmp_path}/src", False)]
