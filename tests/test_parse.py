"""Lexer and outline: constructs that are hard to tell apart, languages' canonical snippets, and references' owners."""

import os
import time

import pytest

from loomgraph.operators import parse
from loomgraph.operators import source_text as tx
from loomgraph.operators.lex import Outline


def named(path, text):
    return {f"{s['kind']}:{s['fqn']}" for s in parse.parse_text(path, text)["symbols"]}


def calls(path, text):
    made = parse.parse_text(path, text)
    return {(made["symbols"][r["owner"]]["fqn"] if r["owner"] >= 0 else "", r["name"]) for r in made["refs"]}


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.rs", "struct Wallet;\nimpl Wallet { fn balance(&self) -> u64 { 0 } }\n", {"class:Wallet", "function:Wallet.balance"}),
        ("a.rs", "impl<'a> Foo<'a> { fn bar(&'a self, c: char) { let x = 'b'; if c == '{' {} } }\nfn free() {}\n", {"class:Foo", "function:Foo.bar", "function:free"}),
        ("a.rs", 'fn a() { let s = r##"fn no() { "# "##; } /* fn x() { /* { */ */ fn b() {}', {"function:a", "function:b"}),
        ("a.rs", "impl<T: Into<String>> fmt::Display for Pair<T> where T: Copy { fn fmt(&self) {} }", {"class:Pair", "function:Pair.fmt"}),
        ("a.rs", "pub const LIMIT: usize = 3;\nstatic mut X: u8 = 1;\npub const fn f() {}\nmacro_rules! m { () => { fn no() {} } }", {"constant:LIMIT", "constant:X", "function:f", "macro:m", "function:m.no"}),
        ("a.ts", "export class Svc { pay(x: number) { return x; } }\nexport function top() {}\n", {"class:Svc", "method:Svc.pay", "function:top"}),
        ("a.tsx", "export class Svc { pay(x: number) { return x; } }\nexport function top() { return <div>it's {x}</div> }\nfunction next() {}", {"class:Svc", "method:Svc.pay", "function:top", "function:next"}),
        ("a.ts", "class A { f() { return `a ${g(`}${h()}`)} class B {`; } }\nconst r = async (id: string): Promise<Map<string, {a: number}>> => { return p(id); };\ninterface I { m(): void }\nnamespace N { function q() {} }", {"class:A", "method:A.f", "function:r", "interface:I", "method:I.m", "module:N", "function:N.q"}),
        ("a.js", "class Svc { pay(x) { return x; } constructor() { init(); } }\nfunction top() {}\nconst o = { go() {}, stop: () => 1 };\na.b = function () {}", {"class:Svc", "method:Svc.pay", "function:top", "method:go", "function:stop", "function:b"}),
        ("a.js", "const x = a / b; const re = /[/{]\\/}/g; function f() {}", {"function:f"}),
        ("a.go", "package main\ntype Svc struct{}\nfunc (s Svc) Pay() int { return 0 }\nfunc Top() {}\nconst (\n  A = 1\n  B\n)\nvar s = `func No() {`", {"type:Svc", "method:Pay", "function:Top", "constant:A", "constant:B"}),
        ("a.java", "class Svc { int pay(int x) { return x; } Svc() { init(); } }\n", {"class:Svc", "method:Svc.pay"}),
        ("a.java", 'class A {\n  String s = """\n } class No { "x" void n() {\n""";\n  List<Map<String, T>> m() throws E { return of(x); }\n}\ninterface I { int one(); }', {"class:A", "method:A.m", "interface:I", "method:I.one"}),
        ("a.cs", 'namespace N.M { class Svc : Base { int Pay(int x) { var s = $"a {F("}")}"; var v = @"c:\\"; return x; } int E() => 1; } }', {"module:N.M", "class:N.M.Svc", "method:N.M.Svc.Pay", "method:N.M.Svc.E"}),
        ("a.cpp", "class Svc { public: int pay(int x); };\nint top() { return 0; }\nint Svc::pay(int x) { return R\"(})\"[0]; }\n#define X {\nnamespace n { struct P { int q() const { return 1; } }; }", {"class:Svc", "function:Svc.pay", "function:top", "method:pay", "class:P", "function:P.q"}),
    ],
)
def test_symbols(path, text, want):
    assert named(path, text) == want


def test_calls_have_their_innermost_owner():
    text = "class A {\n  pay(x) { return this.charge(`a ${deep(x)}`); }\n  charge = (x) => { inner(x); new Thing(x) }\n}\ntop(1);\nfunction f() { function g() { h() } g() }\n"
    assert calls("a.ts", text) == {("A.pay", "charge"), ("A.pay", "deep"), ("A.charge", "inner"), ("A.charge", "Thing"), ("", "top"), ("f.g", "h"), ("f", "g")}
    assert calls("a.rs", "fn a() { b(); x.c(); D::e(); f!(g()); }") == {("a", "b"), ("a", "c"), ("a", "f"), ("a", "g")}


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.ts", "import { charge } from './pay';\nimport React from 'react';\nimport './side';\nexport * from './all';\nconst x = require('./util');\nconst y = await import('./lazy');\n// import z from './no'\nconst s = \"import q from 'no'\";", ["./pay", "react", "./side", "./all", "./util", "./lazy"]),
        ("a.py", "import os\nfrom app.models import User\n", ["os", "app.models"]),
        ("a.rs", "mod pay;\nuse crate::ledger::Entry;\nuse a::{b, c as d};", ["pay", "crate::ledger::Entry", "a::{b, c as d}"]),
        ("a.go", 'package main\nimport (\n  "fmt"\n  q "acme/pay"\n)\nimport "one"\n', ["fmt", "acme/pay", "one"]),
        ("a.java", "import com.acme.Ledger;\nimport static a.B.*;", ["com.acme.Ledger", "a.B"]),
        ("a.cs", "using Acme.Ledger;\nusing static System.Math;\nusing X = A.B;\nclass C { void M() { using var f = Open(); } }", ["Acme.Ledger", "System.Math", "A.B"]),
        ("a.cpp", '#include "pay.h"\n  # include <vector>\n// #include "no.h"\n', ["pay.h", "vector"]),
    ],
)
def test_imports(path, text, want):
    assert parse.parse_text(path, text)["imports"] == want


def test_positions_are_bytes_and_hashes_follow_the_text():
    text = "// ä中\nfunction é() { return ü(1) }\nfunction b() {}\n"
    made = parse.parse_text("a.js", text)
    data = text.encode()
    assert [data[s["start"] : s["end"]].decode() for s in made["symbols"]] == ["function é() { return ü(1) }", "function b() {}"]
    assert [s["start_line"] for s in made["symbols"]] == [1, 2]


def test_broken_texts_end():
    for text in ("fn a( {", "class A { f( }", "impl<", "`${`${", "'", '"""', "/* x", "import", "const x = ", "#include", "}}}", "type (", "func (", "a.b ="):
        for lang in ("rust", "typescript", "java", "go", "csharp", "cpp"):
            Outline(text, lang)


def test_many_definitions_are_read_in_about_linear_time():
    def took(n):
        text = "".join(f"function f{i}(x) {{ return f{i}(`a ${{g{i}(x)}}`); }}\napp.get('/p/{i}', f{i})\n" for i in range(n))
        began = time.process_time()
        made = parse.parse_text("a.ts", text)
        assert len(made["symbols"]) == n and made["symbols"][-1]["role"] == "api"
        return time.process_time() - began

    took(100)
    assert took(8000) < 8 * max(took(2000), 0.1)


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("routes.ts", "export function registerRoutes(app) {\n  app.get('/payments/:id', getPayment);\n  app.post('/payments', createPayment);\n}\n", {("registerRoutes", "GET /payments/:id"), ("registerRoutes", "POST /payments")}),
        ("api.py", '@app.get("/health")\ndef health():\n    return "ok"\n\n@app.route("/payments", methods=["POST", "PUT"])\ndef create_payment():\n    return 1\n', {("health", "GET /health"), ("create_payment", "POST|PUT /payments")}),
        ("P.java", 'class P {\n  @GetMapping("/payments/{id}")\n  public Payment get(String id) { return null; }\n}\n', {("P.get", "GET /payments/{id}")}),
        ("P.cs", 'class P {\n  [HttpPost("/payments")]\n  public int Create() { return 1; }\n}\n', {("P.Create", "POST /payments")}),
        ("router.rs", 'pub fn router() -> Router {\n    Router::new().route("/payments", get(list_payments))\n}\nfn list_payments() {}', {("list_payments", "GET /payments")}),
        ("routes.ts", "// Handles app.get(\"/legacy\") from the old router.\n/// See also app.post(\"/docs-only\").\nexport function actualHandler(req) {\n  return 1;\n}\nexport function register(app) {\n  app.get('/real', actualHandler);\n}\n", {("actualHandler", "GET /real")}),
        ("cache.ts", 'function lookup(cache) {\n  return cache.get("user-42");\n}\n', set()),
    ],
)
def test_routes(path, text, want):
    import json

    found = set()
    for s in parse.parse_text(path, text)["symbols"]:
        if s["role"] == "api":
            meta = json.loads(s["meta"])
            found |= {(s["fqn"], f"{m['method']} {m['path']}") for m in meta.get("routes", [meta])}
    assert found == want


def test_arguments_are_read_with_quotes_and_brackets():
    assert tx.arguments("f(a, 'b, )', [c, d], g(h, i)) , z", 1) == ["a", "'b, )'", "[c, d]", "g(h, i)"]
    hits = tx.route_hits("r.HandleFunc(\"/z\", func(w, r) { x.get('no') }).Methods(\"GET\")\nmux.Handle('/q', async pay.do)\n[HttpGet]\n@RequestMapping(value = \"/r\", method = RequestMethod.PUT)")
    assert [h[1:] for h in hits] == [("ANY", "/z", "func"), ("ANY", "/q", "do"), ("PUT", "/r", None), ("GET", "", None)]


def test_tests_are_found_by_mark_name_and_path():
    role = lambda path, text: [(s["name"], s["role"]) for s in parse.parse_text(path, text)["symbols"]]
    assert role("src/lib.rs", "#[test]\nfn checks() { assert!(true); }\n\nfn helper() {}\n") == [("checks", "test"), ("helper", None)]
    assert role("app.py", "def test_charges():\n    assert True\n\ndef helper():\n    pass\n") == [("test_charges", "test"), ("helper", None)]
    assert role("tests/pay_test.go", "package t\nfunc setup() {}\n") == [("setup", "test")]


def test_sql_names():
    assert list(tx.tables_named('SELECT * FROM "shop" . [Orders] o JOIN `b`.c, d INSERT INTO x(y) from(z) fromage q')) == ["orders", "c", "x"]
    assert list(tx.table_statements("ALTER TABLE pay ADD b int;\nCREATE  TABLE\n IF NOT EXISTS s.Pay (a int);\ndrop table if exists old")) == [("pay", "ALTER TABLE", 0), ("pay", "CREATE TABLE IF NOT EXISTS", 1), ("old", "DROP TABLE IF EXISTS", 3)]


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    files = spark.createDataFrame([(f"a{i}.py", f"def f{i}(): pass\n") for i in range(40)], "path string, text string").coalesce(1)
    parsed = parse.parse_files(files)
    assert parsed.rdd.getNumPartitions() >= 4
    assert parsed.count() == 40


def plans_parse(df) -> int:
    """How often a plan parses the sources anew."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_symbols_and_their_files_come_of_one_parse(spark):
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self): pass\n"), ("bad.py", "def ("), ("empty.py", None)], "path string, text string")
    found = parse.symbols_of(parse.parse_files(files))
    assert plans_parse(found) == 1
    rows = {(r.kind, r.fqn): r for r in found.collect()}
    assert set(rows) == {("file", "a.py"), ("class", "A"), ("function", "A.f"), ("file", "empty.py")}
    assert rows["file", "a.py"].parent_id is None and rows["class", "A"].parent_id == rows["file", "a.py"].id and rows["function", "A.f"].parent_id == rows["class", "A"].id


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no input tables here")
@pytest.mark.parametrize("name", ["diff_file", "check", "diff_ws", "check_ws", "scan_full", "scan_partial", "retire_leases", "rx_attribute"])
def test_queries_that_read_symbols_again_read_a_table(spark, name):
    import __spark_entry__ as entry

    assert plans_parse(entry.queries()[name](spark, "/root/testdata/sf0.001")) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no input tables here")
@pytest.mark.parametrize("name", ["imports_resolve", "ref_resolve"])
def test_only_the_candidates_of_imports_are_made_in_the_plan(spark, name):
    import __spark_entry__ as entry

    assert plans_parse(entry.queries()[name](spark, "/root/testdata/sf0.001")) <= 2  # tried in direct, and in what direct leaves


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no input tables here")
def test_an_edit_parses_what_it_touches_only(spark, monkeypatch):
    from loomgraph import queries_more as more
    from loomgraph.sources.adapter import Model

    seen, real = [], more.ps.parse_files
    monkeypatch.setattr(more.ps, "parse_files", lambda files: seen.append(files.count()) or real(files))
    model = Model(spark, "/root/testdata/sf0.001")
    more.edited(model)
    keys = [r[0] for r in model.raw("customer").select("c_custkey").collect()]
    assert seen == [len(keys), sum(k % 3 == 0 or k % 4 == 0 for k in keys)]


def test_ids_are_made_once_a_file(spark):
    parsed = spark.createDataFrame([], parse.PARSED)
    plan = parse.symbols_of(parsed)._jdf.queryExecution().optimizedPlan().toString()
    above, found, below = plan.partition("Generate posexplode")
    assert found and "transform(" not in above and "transform(" in below
