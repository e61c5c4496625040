"""Further queries, with their statements: lookups, plans, boxes, differences, sources, folds, timers and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as fn
from loomgraph.operators import arch as ar
from loomgraph.operators import diff as d
from loomgraph.operators import effects as ef
from loomgraph.operators import graph as g
from loomgraph.operators import parse as ps
from loomgraph.operators import relational as r
from loomgraph.operators import reports as rp
from loomgraph.operators import schedule as sc
from loomgraph.operators import source_text as tx
from loomgraph.operators import state as st
from loomgraph.queries import BFS, CLOSURE, RANK, RULES, VIEW, WAVES, WORKER
from loomgraph.registry import HANDLE, STORED, SYM, SYMS, handle_of, query
from loomgraph.sources import repo
from loomgraph.sources.adapter import DAY, millis
from loomgraph.sources.tables import shared_dir, written
from loomgraph.streaming import jobs as sj

c = F.col
S = lambda x: x.cast("string")


# Lookups


@query("repo_list", "SELECT id, name, root_path FROM repos")
def _(m):
    return m.repos.orderBy("id")


@query("repo_resolve", "SELECT id FROM repos WHERE id = 'asia' OR name = 'asia'")
def _(m):
    return m.repos.filter("id = 'asia' or name = 'asia'").select("id")


@query("qualified_handle", f"SELECT id, CASE WHEN (SELECT count(*) FROM repos) > 1 THEN 'root/' ELSE '' END || {HANDLE} AS handle FROM symbols")
def _(m):
    return r.qualified_handle(m.symbols, m.repos)


@query("path_locate", "SELECT path, CASE WHEN contains(path, '/') AND split_part(path, '/', 1) IN (SELECT r_name FROM region) THEN (SELECT id FROM repos WHERE root_path = split_part(path, '/', 1)) WHEN path IN (SELECT r_name FROM region) THEN (SELECT id FROM repos WHERE root_path = path) ELSE 'R1' END AS repo_id, CASE WHEN split_part(path, '/', 1) NOT IN (SELECT r_name FROM region) THEN path WHEN contains(path, '/') THEN substr(path, strpos(path, '/') + 1) ELSE '' END AS rel FROM (SELECT DISTINCT path FROM symbols)")
def _(m):
    return r.repo_of_path(m.symbols.select("path"), m.repos)


@query("sym_resolve_repo", f"SELECT {SYMS} FROM symbols WHERE id = 'C7'")
def _(m):
    path = m.symbols.filter("id = 'C7'").select(F.concat_ws(":", F.lit("root"), "path", "fqn")).first()[0]
    return r.resolve_one(m.symbols, path, m.repos).select(*SYM)


@query("session_for", "SELECT id, started_at, ended_at IS NULL AND now - heartbeat_at <= 60000 AS live, (coalesce(ended_at, now) - started_at) // 1000 AS uptime_secs FROM sessions, k WHERE agent = 'A3'")
def _(m):
    live = c("ended_at").isNull() & (F.lit(m.now) - c("heartbeat_at") <= 60_000)
    return m.sessions.filter("agent = 'A3'").orderBy(F.desc("started_at")).select("id", "started_at", live.alias("live"), fn.age_secs(c("started_at"), F.coalesce("ended_at", F.lit(m.now))).alias("uptime_secs"))


@query("act_all", "SELECT agent, path, started_at, updated_at FROM activity ORDER BY updated_at DESC, agent, path LIMIT 50")
def _(m):
    return m.activity.orderBy(F.desc("updated_at"), "agent", "path").limit(50).select("agent", "path", "started_at", "updated_at")


@query("act_agent", "SELECT path, started_at, updated_at FROM activity WHERE agent = 'A2'")
def _(m):
    return m.activity.filter("agent = 'A2'").orderBy(F.desc("updated_at")).select("path", "started_at", "updated_at")


@query("act_path", "SELECT agent, updated_at FROM activity WHERE path = (SELECT min(path) FROM nations) AND repo_id = 'R1'")
def _(m):
    first = m.nations.agg(F.min("path").alias("path"))
    return m.activity.filter("repo_id = 'R1'").join(F.broadcast(first), "path", "left_semi").select("agent", "updated_at")


@query("queue_list", "SELECT id, seq, agent, priority FROM lease_queue WHERE symbol_id = 'C1' AND state = 'waiting'")
def _(m):
    return m.lease_queue.filter("symbol_id = 'C1' and state = 'waiting'").orderBy(F.desc("priority"), "seq").select("id", "seq", "agent", "priority")


@query("lease_check", "SELECT cl.relation, l.id AS lease, l.agent AS holder FROM closure cl JOIN leases l ON l.symbol_id = cl.other, k WHERE cl.symbol = 'N3' AND l.state = 'active' AND l.expires_at > now AND l.agent <> 'A1'", CLOSURE)
def _(m):
    asked = m.spark.createDataFrame([("N3", "A1")], "symbol string, agent string")
    return r.conflicts(m.leases, m.symbols, asked, m.now).select("relation", "lease", "holder")


@query("tasks_for_symbol", "SELECT symbol_id, string_agg(task_id, ',' ORDER BY task_id) AS tasks FROM task_symbols GROUP BY symbol_id")
def _(m):
    return m.task_symbols.groupBy("symbol_id").agg(F.array_join(F.sort_array(F.collect_list("task_id")), ",").alias("tasks"))


@query("cnt_files", "SELECT count(*) AS n FROM files")
def _(m):
    return m.files.agg(F.count(F.lit(1)).alias("n"))


@query("goals_progress_all", "SELECT g.id, count(t.id) AS total, count(*) FILTER (WHERE t.state = 'done') AS done FROM (SELECT id FROM goals UNION ALL SELECT 'G-none') g LEFT JOIN task_goals tg ON tg.goal_id = g.id LEFT JOIN tasks t ON t.id = tg.task_id GROUP BY g.id")
def _(m):
    empty = m.spark.createDataFrame([("G-none", "nothing")], "id string, title string")
    return r.goal_progress(m.goals.select("id", "title").unionAll(empty), m.tasks, m.task_goals).select("id", "total", "done")


@query("impact_min_dist", "SELECT id, min(distance) AS distance FROM hit WHERE seed IN ('O10', 'O20', 'O30') GROUP BY id HAVING id NOT IN ('O10', 'O20', 'O30')", BFS.format(4).replace("role = 'api'", "id IN ('O10', 'O20', 'O30')"))
def _(m):
    return g.reach(m.edges, m.symbols.filter(c("id").isin("O10", "O20", "O30")).select("id"), 4)


@query("impact_sort", "SELECT h.id, h.distance, row_number() OVER (ORDER BY h.distance, s.path, s.start_byte, h.id) AS place FROM hit h JOIN symbols s ON s.id = h.id WHERE seed = 'P5'", BFS.format(3).replace("role = 'api'", "id = 'P5'"))
def _(m):
    from pyspark.sql import Window

    hit = g.impact(m.edges, m.symbols.filter("id = 'P5'").select(c("id").alias("seed")), 3).join(m.symbols.select("id", "path", "start_byte"), "id")
    return hit.select("id", "distance", F.row_number().over(Window.orderBy("distance", "path", "start_byte", "id")).cast("long").alias("place"))


# Scalars


@query("f_age_secs", "SELECT id, trunc((now - heartbeat_at) / 1000.0)::BIGINT AS secs FROM sessions, k")
def _(m):
    return m.sessions.select("id", fn.age_secs(c("heartbeat_at"), m.now).alias("secs"))


@query("f_normalize_path", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'd' || doc_id || '/c' WHEN 1 THEN 'x' WHEN 2 THEN 'a/b' WHEN 3 THEN 'q' ELSE '' END AS path FROM documents")
def _(m):
    i = S(c("doc_id"))
    raw = F.when(c("doc_id") % 5 == 0, F.concat(F.lit("d"), i, F.lit("/./b/../c"))).when(c("doc_id") % 5 == 1, "../../x").when(c("doc_id") % 5 == 2, "a//b/").when(c("doc_id") % 5 == 3, "p/r/../../q").otherwise("..")
    return m.raw("documents").select("doc_id", fn.normalize_path(raw).alias("path"))


@query("f_symbol_id", "SELECT id, 's_' || substr(sha256(repo_id || chr(0) || path || chr(0) || kind || chr(0) || fqn || chr(0) || '0'), 1, 16) AS sid FROM symbols")
def _(m):
    return m.symbols.select("id", fn.symbol_id(c("repo_id"), c("path"), c("kind"), c("fqn"), F.lit(0)).alias("sid"))


@query("f_own_hash", "SELECT 'src/m' || c_custkey || '.py' AS path, substr(sha256('class Holder_' || c_custkey || ':' || chr(10) || '    ' || chr(0) || '<nested>' || chr(0)), 1, 16) AS own_hash FROM customer")
def _(m):
    return ps.symbols_of(ps.parse_files(m.sources)).filter("kind = 'class'").select("path", "own_hash")


PATHS = "SELECT doc_id, ['tests/a' || doc_id || '.py', 'src/test_' || doc_id || '.rs', 'a/b_test.go', 'x.spec.ts', 'src/Main' || doc_id || '.java', 'lib/atests.cs', 'conftest.py', 'q/__tests__/z.TSX', 'package.json', 'db/s.SQL', 'README', 'a/b.JSX'][doc_id % 12 + 1] AS path FROM documents"


def paths(m) -> DataFrame:
    i = S(c("doc_id"))
    made = [F.concat(F.lit("tests/a"), i, F.lit(".py")), F.concat(F.lit("src/test_"), i, F.lit(".rs")), F.lit("a/b_test.go"), F.lit("x.spec.ts"), F.concat(F.lit("src/Main"), i, F.lit(".java")), *map(F.lit, ("lib/atests.cs", "conftest.py", "q/__tests__/z.TSX", "package.json", "db/s.SQL", "README", "a/b.JSX"))]
    return m.raw("documents").select("doc_id", F.element_at(F.array(*made), (c("doc_id") % 12 + 1).cast("int")).alias("path"))


@query("f_is_test_path", f"SELECT doc_id, doc_id % 12 IN (0, 1, 2, 3, 5, 7) AS test FROM ({PATHS})")
def _(m):
    return paths(m).select("doc_id", fn.is_test_path(c("path")).alias("test"))


@query("src_lang", f"SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'go' WHEN 3 THEN 'typescript' WHEN 4 THEN 'java' WHEN 5 THEN 'csharp' WHEN 6 THEN 'python' WHEN 7 THEN 'tsx' WHEN 11 THEN 'javascript' END AS lang FROM ({PATHS})")
def _(m):
    return paths(m).select("doc_id", ps.language(c("path")).alias("lang"))


@query("src_indexable", f"SELECT doc_id, doc_id % 12 <> 10 AS indexable FROM ({PATHS})")
def _(m):
    return paths(m).select("doc_id", ps.is_indexable(c("path")).alias("indexable"))


@query("f_norm_ident", "SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS name FROM part")
def _(m):
    raw = F.concat(F.lit('"Shop" . ['), F.regexp_replace("p_brand", "#", "_"), F.lit("]"))
    return m.raw("part").select("p_partkey", fn.normalize_ident(raw).alias("name"))


@query("f_top_dir", "SELECT DISTINCT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS top, path = 'db' OR starts_with(path, 'db/') AS under FROM symbols")
def _(m):
    return m.symbols.select("path").distinct().select("path", fn.top_dir(c("path")).alias("top"), fn.is_under(c("path"), F.lit("db")).alias("under"))


# Sources, sinks and the graph that is built from them


def folder(m, label: str) -> str:
    return f"{shared_dir(m.spark)}/loomgraph/{label}-{uuid.uuid4().hex}"


@query("sink_upsert_symbol", "SELECT id, kind, CASE WHEN kind = 'class' THEN 'changed' ELSE role END AS role FROM symbols WHERE kind IN ('class', 'file') UNION ALL SELECT 'new', 'class', 'added'")
def _(m):
    stored = m.symbols.filter("kind in ('class', 'file')").select("id", "kind", "role")
    fresh = m.spark.createDataFrame([("new", "class", "added")], "id string, kind string, role string")
    at = folder(m, "symbols")
    repo.upsert(stored, ["id"], at)
    return repo.upsert(stored.filter("kind = 'class'").withColumn("role", F.lit("changed")).unionAll(fresh), ["id"], at)


@query("sink_upsert_file", "SELECT path, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE substr(sha256(n_name), 1, 16) END AS content_hash FROM nations")
def _(m):
    even = m.nations.filter("n_nationkey % 2 = 0").select(F.lit("R1").alias("repo_id"), "path", F.lit("new").alias("content_hash"), F.lit(3).cast("long").alias("size"))
    at = folder(m, "files")
    repo.upsert(m.files, ["repo_id", "path"], at)
    return repo.upsert(even, ["repo_id", "path"], at).select("path", "content_hash")


@query("src_sqlite", "SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def _(m):
    path = folder(m, "store")
    m.symbols.write.partitionBy("repo_id").parquet(path)
    return m.spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("sink_emit", "SELECT id, kind FROM log WHERE id <= 50 UNION ALL SELECT 50 + row_number() OVER (ORDER BY ms, kind), kind FROM (SELECT max(ms) AS ms, event_type AS kind FROM ev GROUP BY event_type)")
def _(m):
    path = folder(m, "events")
    m.events.filter("id <= 50").write.parquet(path)
    null = F.lit(None).cast("string")
    more = m.raw_events.groupBy(c("event_type").alias("kind")).agg(F.max("ms").alias("ts")).select("ts", "kind", null.alias("agent"), null.alias("symbol_handle"), null.alias("task"), null.alias("detail"))
    repo.emit(more, path, 50)
    return m.spark.read.parquet(path).select("id", "kind")


@query("sink_json", "SELECT to_json({'id': id, 'state': state, 'priority': priority, 'assignee': assignee}) AS json FROM tasks")
def _(m):
    return repo.as_json(m.tasks.select("id", "state", "priority", "assignee"))


NL = "chr(10)"
ROUTE_TEXT = "app.get('/n/{k}', list)\n// app.post('/no')\nrouter . Route(`/all/{k}`, methods=['put', \"get\"])\n@PostMapping(value = \"/x/{k}\")\n@RequestMapping(\"/r\", method = RequestMethod.DELETE)\n[HttpGet(\"y\")]\nmux.HandleFunc(\"/z\",\n  serve)\nmap.get(\"key\")\n"


def route_files(m) -> DataFrame:
    return m.nations.select("path", F.replace(F.lit(ROUTE_TEXT), F.lit("{k}"), S(c("n_nationkey"))).alias("text"))


@query("rx_routes", "SELECT path, method, replace(route, 'K', n_nationkey::VARCHAR) AS route, handler FROM nations, (VALUES ('GET', '/n/K', 'list'), ('PUT|GET', '/all/K', 'methods'), ('POST', '/x/K', NULL), ('DELETE', '/r', NULL), ('GET', 'y', NULL), ('ANY', '/z', 'serve')) v(method, route, handler)")
def _(m):
    return tx.routes(route_files(m)).select("path", "method", "route", "handler")


@query("rx_in_comment", "SELECT path, 1::BIGINT AS commented FROM nations")
def _(m):
    calls = F.size(F.regexp_extract_all("text", F.lit(r"\.(?:get|post)\('(/[^']*)"), F.lit(1)))
    kept = tx.routes(route_files(m)).filter("route like '/n/%' or route = '/no'").groupBy("path").agg(F.count(F.lit(1)).alias("kept"))
    return route_files(m).select("path", calls.alias("calls")).join(kept, "path").select("path", (c("calls") - c("kept")).cast("long").alias("commented"))


@query("rx_ddl", "SELECT 'db/n' || n_nationkey || '.sql' AS path, CASE WHEN i = 0 THEN 'brand' ELSE 'old' END || n_nationkey AS \"table\", CASE WHEN i = 0 THEN 'CREATE TABLE IF NOT EXISTS' ELSE 'DROP TABLE' END AS statement, CASE WHEN i = 0 THEN 1 ELSE 3 END AS line FROM nation, range(2) t(i)")
def _(m):
    return tx.tables_defined(ddl_files(m))


def ddl_files(m) -> DataFrame:
    k = S(c("n_nationkey"))
    text = F.concat(F.lit("ALTER TABLE brand"), k, F.lit(" ADD x int;\ncreate  TABLE\n IF NOT EXISTS \"Shop\".\"Brand"), k, F.lit("\" (a int);\nDROP TABLE old"), k, F.lit(";"))
    return m.raw("nation").select(F.concat(F.lit("db/n"), k, F.lit(".sql")).alias("path"), text.alias("text"))


@query("manifest_read", "SELECT 'svc' || n_nationkey AS dir, ['svc-', 'crate-', 'go-', 'py-', 'svc', 'pom-'][n_nationkey % 6 + 1] || n_nationkey AS name, ['npm', 'cargo', 'go', 'python', 'gradle', 'maven'][n_nationkey % 6 + 1] AS ecosystem FROM nation")
def _(m):
    k = S(c("n_nationkey"))
    files = ["package.json", "Cargo.toml", "go.mod", "pyproject.toml", "build.gradle", "pom.xml"]
    texts = ['{"name": "svc-K", "version": "1"}', '[workspace]\nname = "no"\n[package]\nname = "crate-K"\n[dependencies]\nname = "x"', "module a.b/c/go-K\n", '[tool.poetry]\nname = "py-K"', "plugins {}", "<project><artifactId>pom-K</artifactId></project>"]
    at = (c("n_nationkey") % 6 + 1).cast("int")
    rows = m.raw("nation").select(F.concat(F.lit("svc"), k, F.lit("/"), F.element_at(F.array(*map(F.lit, files)), at)).alias("path"), F.replace(F.element_at(F.array(*map(F.lit, texts)), at), F.lit("K"), k).alias("text"))
    return tx.manifests(rows).select("dir", "name", "ecosystem")


@query("svc_parent", "SELECT n_name AS dir, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE '' END AS parent FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN path ELSE n_name END AS n_name, n_nationkey, split_part(path, '/', 1) AS r_name FROM nations) UNION ALL SELECT r_name, '' FROM region")
def _(m):
    dirs = m.nations.select(F.when(c("n_nationkey") % 2 == 0, c("path")).otherwise(c("n_name")).alias("dir")).union(m.raw("region").select("r_name")).union(m.spark.createDataFrame([("",)], "dir string"))
    return tx.parent_service(dirs)


#: What the generated modules hold: (path, kind, fqn, role).
EXPECTED = "expected AS (SELECT c_custkey AS k, 'src/m' || c_custkey || '.py' AS path, kind, CASE WHEN kind = 'file' THEN 'src/m' || c_custkey || '.py' ELSE replace(fqn, 'K', c_custkey::VARCHAR) END AS fqn, role FROM customer, (VALUES ('file', '', NULL, 1), ('class', 'Holder_K', NULL, 1), ('function', 'Holder_K.place', NULL, 1), ('function', 'run_K', NULL, 1), ('function', 'test_run_K', 'test', 5), ('function', 'serve_K', 'api', 7)) v(kind, fqn, role, every) WHERE c_custkey % every = 0)"


@query("parse_symbols", "SELECT path, kind, fqn, role FROM expected", EXPECTED)
def _(m):
    return ps.symbols_of(ps.parse_files(m.sources)).select("path", "kind", "fqn", "role")


@query("role_tests", "SELECT path, fqn FROM expected WHERE role = 'test'", EXPECTED)
def _(m):
    return ps.symbols_of(ps.parse_files(m.sources)).filter("role = 'test'").select("path", "fqn")


@query("role_merge", "SELECT fqn, 'POST' AS method, '/run/' || k AS route FROM expected WHERE role = 'api'", EXPECTED)
def _(m):
    return ps.symbols_of(ps.parse_files(m.sources)).filter("role = 'api'").select("fqn", F.get_json_object("meta", "$.method").alias("method"), F.get_json_object("meta", "$.path").alias("route"))


@query("rx_attribute", "SELECT path, '/run/' || k AS route, fqn FROM expected WHERE role = 'api'", EXPECTED)
def _(m):
    s = ps.symbols_of(ps.parse_once(m.sources)).filter("kind <> 'file'")
    found = tx.attribute_routes(tx.routes(m.sources), s)
    return found.join(s.select(c("id").alias("symbol"), "fqn"), "symbol").select("path", "route", "fqn")


@query("imports_extract", "SELECT 'src/m' || c_custkey || '.py' AS path, unnest(CASE WHEN c_custkey = 0 THEN ['os'] ELSE ['os', 'src.m' || (c_custkey - 1)] END) AS specifier FROM customer")
def _(m):
    return ps.parse_files(m.sources).select("path", F.explode("imports").alias("specifier"))


@query("imports_resolve", "SELECT 'src/m' || c_custkey || '.py' AS path, 'src/m' || (c_custkey - 1) || '.py' AS target FROM customer WHERE c_custkey > 0")
def _(m):
    return ps.resolve_imports(ps.parse_once(m.sources), m.sources.select("path")).select("path", "target")


CALLS = "calls AS (SELECT 'Holder_' || c_custkey || '.place' AS src, 'run_' || (c_custkey - 1) AS dst, 'calls' AS kind FROM customer WHERE c_custkey > 0 UNION ALL SELECT 'run_' || c_custkey, 'Holder_' || c_custkey, 'calls' FROM customer UNION ALL SELECT 'run_' || c_custkey, 'Holder_' || c_custkey || '.place', 'calls' FROM customer UNION ALL SELECT 'test_run_' || c_custkey, 'run_' || c_custkey, 'tests' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'serve_' || c_custkey, 'run_' || c_custkey, 'calls' FROM customer WHERE c_custkey % 7 = 0)"


def named(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    at = lambda x: symbols.select(c("id").alias(x), c("fqn").alias(f"{x}_fqn"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").select(c("src_fqn").alias("src"), c("dst_fqn").alias("dst"), "kind")


@query("ref_resolve", "SELECT src, dst FROM calls", CALLS)
def _(m):
    parsed = ps.parse_once(m.sources)
    symbols = written(ps.symbols_of(parsed), "symbols")
    refs = ps._owned(parsed, "refs", "R1").select("path", "src", "x.name")
    found = ps.resolve_references(refs, symbols.filter("kind <> 'file'").select("id", "path", "name"), ps.resolve_imports(parsed, m.sources.select("path")))
    return named(found.select("src", "dst", F.lit("calls").alias("kind")).distinct(), symbols).select("src", "dst")


EDGES = "SELECT src, dst, kind FROM calls UNION ALL SELECT a.path, b.fqn, 'contains' FROM expected a JOIN expected b ON b.path = a.path WHERE a.kind = 'file' AND b.kind <> 'file' AND b.fqn NOT LIKE '%.place' UNION ALL SELECT a.fqn, b.fqn, 'contains' FROM expected a JOIN expected b ON b.path = a.path AND a.kind = 'class' AND b.fqn LIKE '%.place' UNION ALL SELECT 'src/m' || c_custkey || '.py', 'src/m' || (c_custkey - 1) || '.py', 'imports' FROM customer WHERE c_custkey > 0 UNION ALL SELECT 'run_' || c_custkey, 'brand' || c_nationkey, 'queries' FROM customer"


#: What the files in six languages hold, by customer % 6: (kind, fqn, role), specifiers, (owner, name, kind) of references, routes.
POLY = "poly AS (SELECT c_custkey AS k, c_custkey % 6 AS n, 'poly/f' || c_custkey || '.' || ['rs', 'ts', 'java', 'go', 'cs', 'cpp'][c_custkey % 6 + 1] AS path FROM customer)"
HELD = """held(n, kind, fqn, role) AS (VALUES (0, 'module', 'nested_KK', NULL), (0, 'class', 'Acct_KK', NULL), (0, 'class', 'Acct_KK', NULL), (0, 'function', 'Acct_KK.pay_KK', NULL), (0, 'function', 'help_KK', NULL), (0, 'function', 'checks_KK', 'test'),
  (1, 'class', 'Acct_KK', NULL), (1, 'method', 'Acct_KK.pay_KK', NULL), (1, 'function', 'help_KK', 'api'), (2, 'class', 'Acct_KK', NULL), (2, 'method', 'Acct_KK.pay_KK', 'api'), (2, 'method', 'Acct_KK.help_KK', NULL),
  (3, 'type', 'Acct_KK', NULL), (3, 'method', 'pay_KK', NULL), (3, 'function', 'help_KK', NULL), (4, 'class', 'Acct_KK', NULL), (4, 'method', 'Acct_KK.pay_KK', 'api'), (4, 'method', 'Acct_KK.help_KK', NULL),
  (5, 'class', 'Acct_KK', NULL), (5, 'function', 'Acct_KK.pay_KK', NULL), (5, 'function', 'help_KK', NULL))"""
SPECIFIED = "specified(n, specifier) AS (VALUES (0, 'crate::base::{One, Two}'), (0, 'nested_KK'), (1, './fKK'), (1, 'react'), (1, './tool'), (2, 'com.acme.Base'), (2, 'java.util'), (3, 'fmt'), (3, 'acme/pay'), (4, 'Acme.Base'), (4, 'System.Math'), (5, 'base.h'), (5, 'vector'))"
REFERS = """refers(n, owner, name, kind) AS (VALUES (0, 'Acct_KK.pay_KK', 'help_KK', 'calls'), (0, 'checks_KK', 'help_KK', 'calls'), (0, 'checks_KK', 'assert', 'calls'), (1, 'Acct_KK', 'Base', 'uses'), (1, 'Acct_KK.pay_KK', 'help_KK', 'calls'), (1, 'help_KK', 'test', 'calls'), (1, '', 'post', 'calls'),
  (2, 'Acct_KK', 'Base', 'uses'), (2, 'Acct_KK.pay_KK', 'help_KK', 'calls'), (3, 'pay_KK', 'Println', 'calls'), (3, 'pay_KK', 'help_KK', 'calls'), (4, 'Acct_KK', 'Base', 'uses'), (4, 'Acct_KK', 'IPay', 'uses'), (4, 'Acct_KK.pay_KK', 'help_KK', 'calls'), (5, 'Acct_KK.pay_KK', 'help_KK', 'calls'))"""


@query("parse_symbols_languages", "SELECT path, kind, replace(fqn, 'KK', k::VARCHAR) AS fqn, role FROM poly JOIN held USING (n) UNION ALL SELECT path, 'file', path, NULL FROM poly", POLY, HELD)
def _(m):
    return ps.symbols_of(ps.parse_files(m.polyglot)).select("path", "kind", "fqn", "role")


@query("imports_extract_languages", "SELECT path, replace(specifier, 'KK', k::VARCHAR) AS specifier FROM poly JOIN specified USING (n)", POLY, SPECIFIED)
def _(m):
    return ps.parse_files(m.polyglot).select("path", F.explode("imports").alias("specifier"))


@query("refs_languages", "SELECT path, replace(owner, 'KK', k::VARCHAR) AS owner, replace(name, 'KK', k::VARCHAR) AS name, kind FROM poly JOIN refers USING (n)", POLY, REFERS)
def _(m):
    ref = F.explode("refs").alias("x")
    rows = ps.parse_files(m.polyglot).select("path", "symbols", ref)
    owner = F.when(c("x.owner") < 0, "").otherwise(c("symbols")[F.greatest(c("x.owner"), F.lit(0))]["fqn"])
    return rows.select("path", owner.alias("owner"), "x.name", "x.kind")


@query("routes_languages", "SELECT path, ['POST', 'GET', '', 'POST'][n] AS method, '/poly/' || k AS route, CASE n WHEN 1 THEN 'help_' || k ELSE 'Acct_' || k || '.pay_' || k END AS fqn FROM poly WHERE n IN (1, 2, 4)", POLY)
def _(m):
    s = ps.symbols_of(ps.parse_files(m.polyglot)).filter("role = 'api'")
    return s.select("path", F.get_json_object("meta", "$.method").alias("method"), F.get_json_object("meta", "$.path").alias("route"), "fqn")


#: Routes that stand in the text of documents and pages, as in a corpus with source code; the statement reads the same texts.
@query("routes_in_texts", "SELECT 'd' || doc_id AS path, 'GET' AS method, '/doc/' || doc_id AS route FROM documents UNION ALL SELECT 'd' || doc_id, 'ANY', '/all' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'p' || page_id, 'DELETE', '/page/' || page_id FROM pages")
def _(m):
    i = S(c("doc_id"))
    docs = m.raw("documents").select(F.concat(F.lit("d"), i).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\napp.get('/doc/"), i, F.lit("', (a, b) => [a, ')'])\n"), F.when(c("doc_id") % 3 == 0, "# app.post('/no')\nmux.Handle(\"/all\", http.FileServer(x))\n").otherwise("// router.put('/no', x)\n")).alias("text"))
    p = S(c("page_id"))
    pages = m.raw("pages").select(F.concat(F.lit("p"), p).alias("path"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n@RequestMapping(value = \"/page/"), p, F.lit("\", produces = \"a,b\", method = RequestMethod.DELETE)\n")).alias("text"))
    return tx.routes(docs.unionByName(pages)).select("path", "method", "route")


def code_folder(m, label: str) -> str:
    """The modules as files in the shared folder, with some that no scan reads."""
    at, k = folder(m, label), F.regexp_extract("path", "([0-9]+)", 1)
    n = k.cast("long")
    path = F.when(n % 5 == 0, F.concat(F.lit("src/_gen/.m"), k, F.lit(".py"))).when(n % 5 == 1, F.concat(F.lit("src/node_modules/m"), k, F.lit(".py"))).when(n % 5 == 2, F.concat(F.lit("src/old/m"), k, F.lit(".py"))).otherwise(c("path"))
    more = m.spark.createDataFrame([(".gitignore", "*.log\n/src/old/*\n!src/old/m7.py\n"), ("notes.txt", "x"), ("src/a.log", "x")], "path string, text string")
    repo.export(m.sources.withColumn("path", path).unionByName(more), at)
    return at


WALKED = "code AS (SELECT k, CASE k % 5 WHEN 0 THEN 'src/_gen/.m' || k || '.py' WHEN 2 THEN 'src/old/m' || k || '.py' ELSE 'src/m' || k || '.py' END AS path FROM (SELECT c_custkey AS k FROM customer) WHERE k % 5 <> 1 AND (k % 5 <> 2 OR k = 7))"


@query("src_repo_walk", "SELECT path, k AS at FROM code", WALKED)
def _(m):
    return repo.walk(m.spark, code_folder(m, "code")).select("path", F.regexp_extract("text", "class Holder_([0-9]+)", 1).cast("long").alias("at"))


@query("src_watch_fs", "SELECT 1 AS step, 'added' AS change, path, false AS full FROM code UNION ALL SELECT 1, 'added', 'notes.txt', false UNION ALL SELECT 2, CASE k % 3 WHEN 0 THEN 'deleted' ELSE 'modified' END, path, true FROM code WHERE k % 3 <> 2 UNION ALL SELECT 2, 'added', 'src/new' || k || '.py', true FROM code WHERE k % 7 = 0 UNION ALL SELECT 3, 'added', path, false FROM code WHERE k % 3 = 0", WALKED)
def _(m):
    from loomgraph.sources import watch

    at, state = code_folder(m, "watched"), folder(m, "watch-state")
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("long")

    def step(n: int) -> DataFrame:
        """What the stream tells since its last run; each run is a new one from the checkpoint."""
        seen = sj.run_to_table(watch.watch(m.spark, at, f"{state}/listings"), "append", f"watch-{n}", f"{state}/checkpoint")
        return seen.select(F.lit(n).alias("step"), "change", "path", F.lit(watch.to_look_at(seen)[1]).alias("full"))

    one = step(1)
    files = repo.walk(m.spark, at).select("path", "text").filter("path like 'src/%'").withColumn("k", k)
    files.write.parquet(f"{state}/files")
    files = m.spark.read.parquet(f"{state}/files")
    repo.remove(files.filter("k % 3 = 0"), at)
    repo.export(files.filter("k % 3 = 1").withColumn("text", F.concat("text", F.lit("# more\n"))).unionByName(files.filter("k % 7 = 0").withColumn("path", F.concat(F.lit("src/new"), S(c("k")), F.lit(".py")))), at)
    two = step(2)
    repo.export(files.filter("k % 3 = 0"), at)
    return one.unionByName(two).unionByName(step(3))


def whole(m) -> DataFrame:
    return m.sources.unionByName(ddl_files(m))


@query("edges_build", EDGES, EXPECTED, CALLS)
def _(m):
    made = ps.scan(whole(m))
    return named(made["edges"], made["symbols"])


def stored_part(m):
    """The index of two thirds of the modules."""
    parsed = ps.parse_once(m.sources.filter("cast(regexp_extract(path, '([0-9]+)', 1) as long) % 3 <> 0"))
    return parsed.select("path", "content_hash"), written(ps.symbols_of(parsed), "symbols")


@query("scan_full", "SELECT path, kind, fqn FROM expected WHERE k % 4 <> 1", EXPECTED)
def _(m):
    files, symbols = stored_part(m)
    present = m.sources.filter("cast(regexp_extract(path, '([0-9]+)', 1) as long) % 4 <> 1")
    return ps.scan(present, files, symbols)["symbols"].select("path", "kind", "fqn")


@query("scan_partial", "SELECT path, kind, fqn FROM expected WHERE k % 3 <> 0 OR k % 4 = 1", EXPECTED)
def _(m):
    files, symbols = stored_part(m)
    present = m.sources.filter("cast(regexp_extract(path, '([0-9]+)', 1) as long) % 4 = 1")
    return ps.scan(present, files, symbols, full=False)["symbols"].select("path", "kind", "fqn")


@query("scan_stats", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS files_seen, (SELECT count(*) FROM customer) AS files_indexed, 0::BIGINT AS files_failed, (SELECT count(*) FROM expected) + 2 * (SELECT count(*) FROM nation) AS symbols, (SELECT count(*) FROM expected WHERE role = 'api') AS endpoints, (SELECT count(*) FROM expected WHERE role = 'test') AS tests, 0::BIGINT AS services", EXPECTED)
def _(m):
    return ps.scan(whole(m))["stats"].select("files_seen", "files_indexed", "files_failed", "symbols", "endpoints", "tests", "services")


@query("scan_ws", "SELECT CASE WHEN k % 2 = 0 THEN 'R2' ELSE 'R1' END AS repo_id, count(*) AS symbols FROM expected GROUP BY ALL", EXPECTED)
def _(m):
    moved = m.sources.withColumn("path", F.when(F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 2 == 0, F.concat(F.lit("even/"), "path")).otherwise(c("path")))
    repos = m.spark.createDataFrame([("R1", "root", "."), ("R2", "even", "even")], "id string, name string, root_path string")
    at = d.by_repository(moved.select("path"), repos)
    return ps.symbols_of(ps.parse_files(moved)).drop("repo_id").join(at.select("path", "repo_id"), "path").groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"))


@query("retire_leases", "SELECT 'L' || k AS id FROM expected WHERE kind = 'class' AND k % 4 = 1 AND k % 3 <> 0", EXPECTED)
def _(m):
    files, symbols = stored_part(m)
    present = m.sources.filter("cast(regexp_extract(path, '([0-9]+)', 1) as long) % 4 <> 1")
    held = symbols.filter("kind = 'class'").select(F.concat(F.lit("L"), F.regexp_extract("path", "([0-9]+)", 1)).alias("id"), c("id").alias("symbol_id"), F.lit("A1").alias("agent"), F.lit(None).cast("string").alias("task"), F.lit("active").alias("state"))
    return ps.retire_leases(held, ps.scan(present, files, symbols)["dropped"]).select("id")


# Differences


def edited(m) -> tuple[DataFrame, DataFrame]:
    """Symbols before and after an edit: place changes in every third module, a function is added to every fourth."""
    k = F.regexp_extract("path", "([0-9]+)", 1)
    text = F.when(k.cast("long") % 3 == 0, F.replace("text", F.lit("def place(self, x):"), F.lit("def place(self, y):"))).otherwise(c("text"))
    text = F.when(k.cast("long") % 4 == 0, F.concat(text, F.lit("\n\ndef extra_"), k, F.lit("():\n    pass\n"))).otherwise(text)
    before = written(ps.symbols_of(ps.parse_files(m.sources)), "symbols")
    # What the edit leaves as it was isn't parsed again.
    touched = m.sources.withColumn("edited", text).filter("edited <> text").select("path", c("edited").alias("text"))
    after = ps.symbols_of(ps.parse_files(touched)).unionByName(before.join(touched.select("path"), "path", "left_anti"))
    return before, written(after, "symbols")


CHANGED = "changed AS (SELECT c_custkey AS k, 'Holder_' || c_custkey || '.place' AS fqn, 'modified' AS change FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'extra_' || c_custkey, 'added' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'src/m' || c_custkey || '.py', 'modified' FROM customer WHERE c_custkey % 4 = 0)"


@query("diff_file", "SELECT fqn, change FROM changed", CHANGED)
def _(m):
    before, after = edited(m)
    names = before.select("id", "fqn").union(after.select("id", "fqn")).distinct()
    return d.changed_symbols(before, after).join(names, "id").select("fqn", "change")


@query("check", "SELECT fqn, change, change = 'modified' AND fqn LIKE '%.place' AND k % 2 = 0 AS covered, CASE WHEN fqn LIKE '%.place' AND k % 2 = 1 THEN 'you' END AS holder FROM changed", CHANGED)
def _(m):
    before, after = edited(m)
    names = before.select("id", "fqn").union(after.select("id", "fqn")).distinct()
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    held = before.filter(((c("kind") == "class") & (k % 2 == 0)) | ((c("kind") == "file") & (k % 6 == 3)))
    leases = held.select(F.concat(F.lit("L"), "id").alias("id"), c("id").alias("symbol_id"), F.when(c("kind") == "class", "me").otherwise("you").alias("agent"), F.lit("active").alias("state"), F.lit(1).cast("long").alias("acquired_at"))
    return d.check(d.changed_symbols(before, after), before, leases, "me").join(names, "id").select("fqn", "change", "covered", "holder")


@query("diff_ws", "SELECT 'R2' AS repo_id, change, count(*) AS n FROM changed GROUP BY change", CHANGED)
def _(m):
    before, after = edited(m)
    repos = m.spark.createDataFrame([("R1", "root", "."), ("R2", "src", "src")], "id string, name string, root_path string")
    changes = d.changed_symbols(before, after)
    return changes.join(d.by_repository(changes.select("path"), repos), "path").groupBy("repo_id", "change").agg(F.count(F.lit(1)).alias("n"))


@query("check_ws", "SELECT 'R2' AS repo_id, count(*) AS violations FROM changed", CHANGED)
def _(m):
    before, after = edited(m)
    repos = m.spark.createDataFrame([("R1", "root", "."), ("R2", "src", "src")], "id string, name string, root_path string")
    changes = d.changed_symbols(before, after)
    none = m.leases.limit(0)
    found = d.check(changes, before, none, "me").filter("not covered").join(changes.select("id", "path"), "id")
    return found.join(d.by_repository(changes.select("path"), repos), "path").groupBy("repo_id").agg(F.count(F.lit(1)).alias("violations"))


GUARD = f"""asked AS (SELECT path, id AS symbol, false AS whole FROM symbols WHERE kind = 'class' UNION ALL SELECT path, id, true FROM symbols WHERE kind = 'file' UNION ALL SELECT 'nowhere', NULL, true),
con AS (SELECT a.symbol, a.whole, cl.other, l.id AS lease, l.agent AS holder, cl.relation, greatest(floor((l.expires_at - now) / 1000.0)::BIGINT, 0) AS secs, {handle_of('o')} AS handle FROM asked a JOIN closure cl ON cl.symbol = a.symbol JOIN leases l ON l.symbol_id = cl.other JOIN symbols o ON o.id = cl.other, k WHERE l.state = 'active' AND l.expires_at > now AND l.agent <> 'A1'),
denied AS (SELECT symbol, arg_min(holder, (other, lease)) AS holder, string_agg(CASE WHEN secs <= 30 THEN 'wait ' ELSE 'request-transfer ' END || handle, ';' ORDER BY other, lease) AS asks, arg_min(handle, (other, lease)) FILTER (WHERE relation = 'descendant' AND whole) AS narrow FROM con GROUP BY symbol),
own AS (SELECT up.start AS symbol, arg_min(l.id, (up.depth, l.acquired_at, l.id)) AS lease, arg_min({handle_of('o')}, (up.depth, l.acquired_at, l.id)) AS via FROM up JOIN leases l ON l.symbol_id = up.id JOIN symbols o ON o.id = up.id WHERE l.state = 'active' AND l.agent = 'A1' GROUP BY up.start)"""


@query("guard", f"SELECT a.path, a.symbol, CASE WHEN a.symbol IS NULL THEN 'allowed' WHEN dn.symbol IS NOT NULL THEN 'denied' WHEN own.symbol IS NOT NULL THEN 'allowed' ELSE 'warn' END AS verdict, CASE WHEN dn.symbol IS NULL THEN own.lease END AS lease, CASE WHEN dn.symbol IS NULL THEN own.via END AS via, dn.holder, CASE WHEN dn.symbol IS NOT NULL THEN dn.asks || coalesce(';narrow ' || dn.narrow, '') WHEN own.symbol IS NULL AND a.symbol IS NOT NULL THEN 'acquire ' || {handle_of('s')} END AS actions FROM asked a LEFT JOIN denied dn ON dn.symbol = a.symbol LEFT JOIN own ON own.symbol = a.symbol LEFT JOIN symbols s ON s.id = a.symbol", CLOSURE, GUARD)
def _(m):
    m = m.settled("symbols")
    null = F.lit(None).cast("string")
    asked = m.symbols.filter("kind = 'class'").select("path", c("id").alias("symbol")).unionAll(m.symbols.filter("kind = 'file'").select("path", null)).unionAll(m.spark.createDataFrame([("nowhere", None)], "path string, symbol string"))
    found = d.guard(asked, m.symbols, m.leases, "A1", m.now)
    actions = F.array_join(F.transform("suggestions", lambda x: F.concat_ws(" ", x["action"], x["symbol"])), ";")
    return found.select("path", "symbol", "verdict", "lease", "via", "holder", F.when(c("suggestions").isNotNull(), actions).alias("actions"))


TOUCHED = BFS.format(2).replace("role = 'api'", "role = 'api' AND start_byte % 4 = 0")


@query("api_change_impact", "SELECT DISTINCT h.seed AS symbol, l.agent FROM hit h JOIN leases l ON l.symbol_id = h.id AND l.state = 'active' LEFT JOIN (SELECT symbol_id, arg_min(agent, (acquired_at, id)) AS author FROM leases WHERE state = 'active' GROUP BY symbol_id) a ON a.symbol_id = h.seed WHERE l.agent IS DISTINCT FROM a.author", TOUCHED)
def _(m):
    changes = m.symbols.filter("start_byte % 4 = 0").select("id", F.lit("modified").alias("change"))
    return d.api_change_impact(changes, m.symbols, m.edges, m.leases)


@query("followup_tasks", f"SELECT x.goal_id, x.id AS symbol, 'Update ' || {handle_of('s')} AS title, CASE s.role WHEN 'test' THEN 'testing' WHEN 'schema' THEN 'database' END AS capability FROM (SELECT DISTINCT 'G' || o.o_custkey AS goal_id, h.id FROM hit h JOIN ord o ON 'O' || o.o_orderkey = h.seed) x JOIN symbols s ON s.id = x.id WHERE NOT EXISTS (SELECT 1 FROM task_symbols ts JOIN task_goals tg ON tg.task_id = ts.task_id WHERE ts.symbol_id = x.id AND tg.goal_id = x.goal_id AND (CAST(substr(ts.task_id, 2) AS BIGINT) % 3 <> 0 OR ts.symbol_id IN (SELECT id FROM symbols WHERE role = 'api' AND start_byte % 4 = 0)))", TOUCHED)
def _(m):
    changed = m.symbols.filter("role = 'api' and start_byte % 4 = 0").select("id")
    # A third of the scopes are taken away, but for those of the changed symbols, so that there is something to open.
    third = c("task_id").substr(F.lit(2), F.lit(20)).cast("long") % 3 == 0
    scope = m.task_symbols.filter(~third).unionByName(m.task_symbols.filter(third).join(changed.select(c("id").alias("symbol_id")), "symbol_id", "left_semi").select("task_id", "symbol_id"))
    return d.followup_tasks(changed, m.symbols, m.edges, scope, m.task_goals)


@query("goal_suggest", f"SELECT 'Update ' || split_part(s.path, '/', 1) AS title, string_agg(DISTINCT {handle_of('s')}, ',' ORDER BY {handle_of('s')}) AS symbols FROM (SELECT id FROM hit UNION SELECT 'O10') h JOIN symbols s ON s.id = h.id GROUP BY ALL", BFS.format(4).replace("role = 'api'", "id = 'O10'"))
def _(m):
    return d.clusters(r.resolve_one(m.symbols, "O10").select("id"), m.symbols, m.edges, 4).withColumn("symbols", F.array_join("symbols", ","))


@query("goal_plan", f"SELECT title, md5(string_agg(handle, ',' ORDER BY handle)) AS symbols FROM (SELECT DISTINCT 'Update ' || CASE WHEN s.kind = 'table' THEN s.path ELSE split_part(s.path, '/', 1) END AS title, {handle_of('s')} AS handle FROM (SELECT id FROM hit UNION SELECT id FROM seeds) h JOIN symbols s ON s.id = h.id) GROUP BY title", "words AS (SELECT id, row_number() OVER (PARTITION BY form ORDER BY path, start_byte, s.id) AS rn FROM (VALUES ('0000012'), ('rings'), ('ring')) f(form) JOIN symbols s ON s.name ILIKE '%' || form || '%' OR s.fqn ILIKE '%' || form || '%' OR s.path ILIKE '%' || form || '%'), seeds AS (SELECT DISTINCT id FROM words WHERE rn <= 50)", BFS.format(1).replace("symbols WHERE role = 'api'", "seeds"))
def _(m):
    seeds = r.keyword_matches(m.symbols, "Make the 0000012 rings").select("id")
    return d.clusters(seeds, m.symbols, m.edges, 1).withColumn("symbols", F.md5(F.array_join("symbols", ",")))


@query("svc_clusters", f"SELECT title, md5(string_agg(handle, ',' ORDER BY handle)) AS symbols FROM (SELECT DISTINCT 'Update ' || split_part(s.path, '/', 1) AS title, {handle_of('s')} AS handle FROM (SELECT id FROM hit UNION SELECT id FROM symbols WHERE role = 'api') h JOIN symbols s ON s.id = h.id) GROUP BY title", BFS.format(2))
def _(m):
    found = d.clusters(m.symbols.filter("role = 'api'").select("id"), m.symbols, m.edges, 2)
    return found.withColumn("symbols", F.md5(F.array_join("symbols", ",")))


DEPENDANTS = """around AS MATERIALIZED (SELECT h.seed, h.id, (h.distance, s.path, s.start_byte, h.id) AS place, s.name, split_part(s.path, '/', 1) AS svc, split_part(o.path, '/', 1) AS own FROM hit h JOIN symbols s ON s.id = h.id JOIN symbols o ON o.id = h.seed),
svcs AS MATERIALIZED (SELECT seed, svc AS who, row_number() OVER (PARTITION BY seed ORDER BY min(place)) AS rn, count(*) OVER (PARTITION BY seed) AS n FROM around WHERE svc <> own GROUP BY seed, svc),
names AS MATERIALIZED (SELECT seed, name AS who, row_number() OVER (PARTITION BY seed ORDER BY min(place)) AS rn, count(*) OVER (PARTITION BY seed) AS n FROM around GROUP BY seed, name)"""


@query("dependants", "SELECT a.seed AS id, coalesce(s.phrase, a.phrase) AS phrase FROM (SELECT seed, CASE WHEN max(n) > 3 THEN string_agg(who, '(), ' ORDER BY rn) || ' and ' || (max(n) - 3) || ' more call this.' WHEN max(n) = 1 THEN max(who) || '() calls this.' ELSE string_agg(who, '(), ' ORDER BY rn) || '() call this.' END AS phrase FROM names WHERE rn <= 3 GROUP BY seed) a LEFT JOIN (SELECT seed, CASE WHEN max(n) > 3 THEN string_agg(who, ', ' ORDER BY rn) || ' and ' || (max(n) - 3) || ' more depend on this.' WHEN max(n) = 1 THEN max(who) || ' depends on this.' ELSE string_agg(who, ', ' ORDER BY rn) || ' depend on this.' END AS phrase FROM svcs WHERE rn <= 3 GROUP BY seed) s ON s.seed = a.seed", BFS.format(2).replace("role = 'api'", "kind = 'file' OR (kind = 'method' AND start_byte % 50 = 0)"), DEPENDANTS)
def _(m):
    of = m.symbols.filter("kind = 'file' or (kind = 'method' and start_byte % 50 = 0)").select("id")
    return d.dependants(of, m.symbols, m.edges)


@query("kw_match_goals", "SELECT goal, id, row_number() OVER (PARTITION BY goal ORDER BY i, rn) AS place FROM (SELECT f.goal, h.id, min(f.i) AS i, arg_min(h.rn, f.i) AS rn FROM forms f JOIN hits h ON h.form = f.form GROUP BY f.goal, h.id)",
       "forms AS (SELECT 'G' || c_custkey AS goal, 1 AS i, right(c_name, 5) AS form FROM customer UNION ALL SELECT 'G' || c_custkey, 2, 'brand' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'G' || c_custkey, 2, 'qqq' FROM customer WHERE c_custkey % 4 = 1), hay AS MATERIALIZED (SELECT id, path, start_byte, lower(name || chr(10) || fqn || chr(10) || path) || '' AS hay FROM symbols), hits AS (SELECT f.form, s.id, row_number() OVER (PARTITION BY f.form ORDER BY s.path, s.start_byte, s.id) AS rn FROM (SELECT DISTINCT form FROM forms) f JOIN hay s ON strpos(s.hay, f.form) > 0 QUALIFY rn <= 50)")
def _(m):
    more = F.when(c("c_custkey") % 4 == 0, " and the BRAND").when(c("c_custkey") % 4 == 1, " for qqq").otherwise("")
    goals = m.raw("customer").select(F.concat(F.lit("G"), S(c("c_custkey"))).alias("goal"), F.concat(F.lit("Add "), F.expr("right(c_name, 5)"), more).alias("text"))
    return r.goal_matches(goals, m.symbols)


# Plans


CONTENDED = f"""scoped AS (SELECT t.id AS task_id, coalesce(t.assignee, '') AS agent, ts.symbol_id, {handle_of('s')} AS handle FROM tasks t JOIN task_symbols ts ON ts.task_id = t.id JOIN symbols s ON s.id = ts.symbol_id),
contended AS (SELECT x.task_id, x.symbol_id AS symbol, l.id AS lease, l.agent AS holder, cl.relation FROM scoped x JOIN closure cl ON cl.symbol = x.symbol_id JOIN leases l ON l.symbol_id = cl.other, k WHERE l.state = 'active' AND l.expires_at > now AND l.agent <> x.agent QUALIFY row_number() OVER (PARTITION BY x.task_id ORDER BY x.handle, cl.other, l.id) = 1)"""
LEVELS = "planned AS (SELECT t.id, 'wave' AS stage, lev.level, t.priority, t.created_at, t.state = 'pending' AND len(coalesce(d.blocked_by, [])) = 0 AS ready FROM lev JOIN tasks t ON t.id = lev.id LEFT JOIN d ON d.task_id = t.id WHERE lev.id NOT IN (SELECT id FROM stall) UNION ALL SELECT t.id, t.state, NULL, t.priority, t.created_at, false FROM tasks t WHERE t.state IN ('running', 'review')), plan AS (SELECT p.*, x.holder, p.ready AND x.holder IS NULL AS startable FROM planned p LEFT JOIN contended x ON x.task_id = p.id)"
PLAN = (CLOSURE, CONTENDED, VIEW, WAVES, LEVELS)


def contended(m) -> DataFrame:
    return sc.contention(m.tasks, m.task_symbols, m.symbols, m.leases, m.now)


def planned(m) -> DataFrame:
    return sc.plan(m.tasks, m.task_deps, sc.contention(sc.in_plan(m.tasks), m.task_symbols, m.symbols, m.leases, m.now))


def claimed(m, agent: str) -> DataFrame:
    return sc.claim(m.tasks, m.task_deps, m.task_symbols, m.symbols, m.leases, m.agents, agent, m.now)


def loops(m) -> DataFrame:
    return g.components_of_cycles(m.task_deps.select(c("task_id").alias("a"), c("depends_on").alias("b")))


@query("contention", "SELECT task_id, symbol, lease, holder, relation FROM contended", CLOSURE, CONTENDED)
def _(m):
    return contended(m)


@query("plan_running", "SELECT t.id, x.holder FROM tasks t LEFT JOIN contended x ON x.task_id = t.id WHERE t.state = 'running'", CLOSURE, CONTENDED)
def _(m):
    return sc.at_work(m.tasks, m.task_deps, contended(m)).filter("stage = 'running'").select("id", "holder")


@query("plan_review", "SELECT t.id, x.holder FROM tasks t LEFT JOIN contended x ON x.task_id = t.id WHERE t.state = 'review'", CLOSURE, CONTENDED)
def _(m):
    return sc.at_work(m.tasks, m.task_deps, contended(m)).filter("stage = 'review'").select("id", "holder")


@query("wave_sort", "SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY priority DESC, created_at, id) AS place FROM plan WHERE stage = 'wave'", *PLAN)
def _(m):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("priority"), "created_at", "id"))
    return sc.wave_order(planned(m)).select("id", "level", place.cast("long").alias("place"))


@query("schedule_summary", "SELECT count(*) FILTER (WHERE level = 0 AND startable) AS startable_now, (SELECT max(n) FROM (SELECT count(*) AS n FROM plan WHERE stage = 'wave' GROUP BY level)) AS max_parallel, count(DISTINCT level) AS waves, (SELECT count(DISTINCT component) FROM cyc) AS cycles, count(*) FILTER (WHERE level = 0 AND holder IS NOT NULL) AS contended FROM plan WHERE stage = 'wave'", *PLAN)
def _(m):
    cyclic = loops(m)
    return sc.summary(sc.plan(m.tasks, m.task_deps, sc.contention(sc.in_plan(m.tasks), m.task_symbols, m.symbols, m.leases, m.now), cyclic), cyclic)


@query("task_claim", "SELECT p.id, 'running' AS state, 'A1' AS assignee FROM plan p JOIN tasks t ON t.id = p.id WHERE p.level = 0 AND p.startable AND (t.required_capability IS NULL OR t.required_capability = (SELECT capability FROM agents WHERE name = 'A1')) AND NOT (SELECT paused FROM agents WHERE name = 'A1') ORDER BY p.priority DESC, p.created_at, p.id LIMIT 1", *PLAN)
def _(m):
    return claimed(m, "A1").select("id", F.lit("running").alias("state"), F.lit("A1").alias("assignee"))


@query("continue", "SELECT 'renew' AS action, l.id FROM leases l, k WHERE l.agent = 'A2' AND l.state = 'active' AND EXISTS (SELECT 1 FROM leases WHERE agent = 'A2' AND state = 'active' AND task IS NOT NULL) AND l.expires_at > now UNION ALL SELECT * FROM (SELECT 'claim', p.id FROM plan p JOIN tasks t ON t.id = p.id WHERE NOT EXISTS (SELECT 1 FROM leases WHERE agent = 'A2' AND state = 'active' AND task IS NOT NULL) AND p.level = 0 AND p.startable AND (t.required_capability IS NULL OR t.required_capability = (SELECT capability FROM agents WHERE name = 'A2')) AND NOT (SELECT paused FROM agents WHERE name = 'A2') ORDER BY p.priority DESC, p.created_at, p.id LIMIT 1)", *PLAN)
def _(m):
    mine = r.agent_view(m.agents.filter("name = 'A2'"), m.leases, m.task_goals, m.now).first()
    if mine is not None and mine.current_task is not None:
        return m.leases.filter((c("agent") == "A2") & (c("state") == "active") & (c("expires_at") > m.now)).select(F.lit("renew").alias("action"), "id")
    return claimed(m, "A2").select(F.lit("claim").alias("action"), "id")


@query("assign_goal", "SELECT t.id, 'A4' AS assignee FROM tasks t LEFT JOIN d ON d.task_id = t.id JOIN task_goals tg ON tg.task_id = t.id WHERE tg.goal_id IN ('G1', 'G2', 'G4', 'G5', 'G7') AND t.state = 'pending' AND len(coalesce(d.blocked_by, [])) = 0 ORDER BY t.priority DESC, t.created_at, t.id LIMIT 1", VIEW)
def _(m):
    mine = m.task_goals.filter(c("goal_id").isin("G1", "G2", "G4", "G5", "G7")).select(c("task_id").alias("id"))
    ready = r.task_view(m.tasks, m.task_deps).filter("ready").join(mine, "id", "left_semi")
    return ready.orderBy(F.desc("priority"), "created_at", "id").limit(1).select("id", F.lit("A4").alias("assignee"))


# Boxes


def boxed(m) -> DataFrame:
    """Symbols with services at manifests, as a scan makes them."""
    return m.symbols.withColumn("path", F.when(c("kind") == "service", F.concat("path", F.lit("/service.toml"))).otherwise(c("path")))


BOXES = """inside AS (SELECT s.*, split_part(s.path, '/', 1) AS top FROM symbols s WHERE kind IN ('file', 'class', 'method')),
svc AS (SELECT id, name FROM symbols WHERE kind = 'service'),
boxes AS (SELECT 1 AS depth, id, 'service' AS kind, name, NULL AS parent FROM svc UNION ALL SELECT 1, id, 'table', name, NULL FROM symbols WHERE kind = 'table'
  UNION ALL SELECT 2, 'dir:R1:' || name, 'dir', name || '/' || name, id FROM svc UNION ALL SELECT 3, f.id, 'file', split_part(f.path, '/', 2), svc.id FROM symbols f JOIN svc ON svc.name = split_part(f.path, '/', 1) WHERE f.kind = 'file'),
held AS (SELECT box, count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind <> 'file') AS symbols, count(*) FILTER (WHERE kind <> 'file' AND role = 'api') AS endpoints, count(*) FILTER (WHERE kind <> 'file' AND role = 'test') AS tests FROM (SELECT i.kind, i.role, unnest([svc.id, 'dir:R1:' || svc.name, f.id]) AS box FROM inside i JOIN svc ON svc.name = i.top JOIN symbols f ON f.kind = 'file' AND f.path = i.path) GROUP BY box)"""


@query("arch_graph", "SELECT b.depth, b.id, b.kind, b.name, b.parent, coalesce(h.files, 0) AS files, coalesce(h.symbols, 0) AS symbols, coalesce(h.endpoints, 0) AS endpoints, coalesce(h.tests, 0) AS tests FROM (SELECT * FROM boxes UNION ALL SELECT 2, id, kind, name, parent FROM boxes WHERE depth = 1 UNION ALL SELECT 3, id, kind, name, parent FROM boxes WHERE depth = 1) b LEFT JOIN held h ON h.box = b.id", BOXES)
def _(m):
    out = None
    for depth in (1, 2, 3):
        boxes, owner = ar.layout(boxed(m), depth)
        n = ar.counts(m.symbols, boxes, owner).withColumnRenamed("node", "id")
        rows = boxes.join(n, "id", "left").select(F.lit(depth).alias("depth"), "id", "kind", "name", "parent", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("files", "symbols", "endpoints", "tests")])
        out = rows if out is None else out.unionByName(rows)
    return out


LINKS = "links AS (SELECT a.id AS src, b.id AS dst, e.kind, count(*) AS weight FROM edges e JOIN symbols x ON x.id = e.src JOIN symbols y ON y.id = e.dst JOIN symbols a ON a.kind = 'file' AND a.path = x.path JOIN symbols b ON (y.kind = 'table' AND b.id = y.id) OR (y.kind <> 'table' AND b.kind = 'file' AND b.path = y.path) WHERE e.kind IN ('imports', 'queries') AND a.id <> b.id GROUP BY ALL)"


@query("arch_edges", "SELECT src, dst, kind, weight FROM links", LINKS)
def _(m):
    boxes, owner = ar.layout(boxed(m), 3)
    return ar.box_edges(m.symbols, m.edges, boxes, owner)


@query("arch_overlay", """SELECT node, count(*) FILTER (WHERE what = 'lease') AS leases, coalesce(string_agg(CASE WHEN what = 'worker' THEN key END, ',' ORDER BY key), '') AS workers, count(*) FILTER (WHERE what = 'activity') AS activity, count(*) FILTER (WHERE what = 'task') AS tasks, count(*) FILTER (WHERE what = 'goal') AS goals, count(*) FILTER (WHERE what = 'task' AND flag = 1) AS review_pending, count(*) FILTER (WHERE what = 'event') AS changed_recently FROM (SELECT DISTINCT node, what, key, flag FROM (
SELECT path, 'lease' AS what, l.id AS key, 0 AS flag FROM leases l JOIN symbols s ON s.id = l.symbol_id WHERE l.state = 'active' AND s.kind <> 'table'
UNION ALL SELECT path, 'worker', l.agent, 0 FROM leases l JOIN symbols s ON s.id = l.symbol_id WHERE l.state = 'active' AND s.kind <> 'table'
UNION ALL SELECT path, unnest(['worker', 'activity']), unnest([agent, agent || ' ' || path]), 0 FROM activity, k WHERE updated_at >= now - 86400000
UNION ALL SELECT s.path, 'task', t.id, (t.state = 'review')::INT FROM tasks t JOIN task_symbols ts ON ts.task_id = t.id JOIN symbols s ON s.id = ts.symbol_id
UNION ALL SELECT s.path, 'goal', tg.goal_id, 0 FROM task_goals tg JOIN task_symbols ts ON ts.task_id = tg.task_id JOIN symbols s ON s.id = ts.symbol_id
UNION ALL SELECT split_part(symbol_handle, ':', 1), 'event', id::VARCHAR, 0 FROM (SELECT * FROM log ORDER BY id DESC LIMIT 500), k WHERE ts >= now - 3600000
) x JOIN (SELECT f.path AS at, unnest([f.id, svc.id]) AS node FROM symbols f JOIN svc ON svc.name = split_part(f.path, '/', 1) WHERE f.kind = 'file') b ON b.at = x.path) GROUP BY node""", BOXES)
def _(m):
    boxes, owner = ar.layout(boxed(m), 3)
    rows = ar.overlay(m.symbols, boxes, owner, m.leases, m.activity, m.tasks, m.task_symbols, m.task_goals, m.events, m.now, DAY)
    return rows.select("node", "leases", F.array_join("workers", ",").alias("workers"), F.size("activity").cast("long").alias("activity"), F.size("tasks").cast("long").alias("tasks"), F.size("goals").cast("long").alias("goals"), "review_pending", "changed_recently")


@query("arch_node", f"""SELECT section, key, value FROM (SELECT 'depends_on' AS section, l.dst AS key, split_part(f.path, '/', 2) AS value FROM links l JOIN symbols f ON f.id = l.dst WHERE l.src = 'N3' AND l.kind = 'imports'
UNION ALL SELECT 'depended_on_by', l.src, split_part(f.path, '/', 2) FROM links l JOIN symbols f ON f.id = l.src WHERE l.dst = 'N3' AND l.kind = 'imports'
UNION ALL SELECT 'tables', l.dst, f.name FROM links l JOIN symbols f ON f.id = l.dst WHERE l.src = 'N3' AND l.kind = 'queries'
UNION ALL SELECT * FROM (SELECT 'symbols', id, {HANDLE} FROM symbols WHERE path = (SELECT path FROM nations WHERE n_nationkey = 3) AND kind IN ('class', 'method') ORDER BY path, start_byte, id LIMIT 50)
UNION ALL SELECT 'routes', id, {HANDLE} FROM symbols WHERE path = (SELECT path FROM nations WHERE n_nationkey = 3) AND role = 'api'
UNION ALL SELECT 'held', l.id, l.agent FROM leases l JOIN symbols s ON s.id = l.symbol_id WHERE l.state = 'active' AND s.path = (SELECT path FROM nations WHERE n_nationkey = 3)
UNION ALL SELECT * FROM (SELECT 'impact', h.id, h.distance::VARCHAR FROM hit h JOIN symbols s ON s.id = h.id ORDER BY h.distance, s.path, s.start_byte, h.id LIMIT 40)
UNION ALL SELECT * FROM (SELECT 'events', id::VARCHAR, kind FROM (SELECT * FROM log ORDER BY id DESC LIMIT 300) WHERE split_part(symbol_handle, ':', 1) = (SELECT path FROM nations WHERE n_nationkey = 3) ORDER BY id DESC LIMIT 20))""", LINKS, BFS.format(2).replace("role = 'api'", "id = 'N3'"))
def _(m):
    boxes, owner = ar.layout(boxed(m), 3)
    return ar.node_panel("N3", m.symbols, m.edges, boxes, owner, m.leases, m.events)


@query("architecture", "SELECT src, dst, kind, weight FROM (SELECT split_part(x.path, '/', 1) AS a, CASE WHEN y.kind = 'table' THEN y.id ELSE split_part(y.path, '/', 1) END AS b, e.kind, count(*) AS weight FROM edges e JOIN symbols x ON x.id = e.src JOIN symbols y ON y.id = e.dst WHERE e.kind IN ('imports', 'queries') GROUP BY 1, 2, 3) t JOIN (SELECT name, id AS src FROM svc) s ON s.name = t.a JOIN (SELECT name AS b, id AS dst FROM svc UNION ALL SELECT id, id FROM symbols WHERE kind = 'table') z ON z.b = t.b WHERE t.a <> t.b", BOXES)
def _(m):
    boxes, owner = ar.layout(boxed(m), 1)
    return ar.box_edges(m.symbols, m.edges, boxes, owner)


@query("activity_under", "SELECT s.id AS root, a.agent, a.path FROM symbols s JOIN activity a ON a.path = s.path OR starts_with(a.path, s.path || '/'), k WHERE s.kind IN ('service', 'file') AND a.updated_at >= now - 86400000")
def _(m):
    roots = m.symbols.filter("kind in ('service', 'file')").select(c("id").alias("root"))
    own = roots.join(m.symbols.select(c("id").alias("root"), "path"), "root")
    nested = g.descendants(m.symbols, roots).join(m.symbols.select("id", "path"), "id").select("root", "path")
    live = m.activity.filter(c("updated_at") >= m.now - DAY).select("agent", "path")
    return own.unionByName(nested).distinct().join(live, "path").select("root", "agent", "path")


# Folds


@query("agent_register", "SELECT name, kind, joined_at, heartbeat_at, paused FROM (SELECT agent AS name, last(kind ORDER BY event_id) AS kind, min(ms) AS joined_at, max(ms) AS heartbeat_at, coalesce(arg_max(paused, event_id) FILTER (WHERE paused IS NOT NULL), false) AS paused FROM (SELECT e.agent, e.event_id, e.ms, e.event_type AS kind, CASE WHEN e.event_type IN ('error', 'view') THEN e.event_type = 'error' END AS paused FROM ev e JOIN (SELECT agent, max(event_id) FILTER (WHERE event_id % 97 = 0) AS gone FROM ev GROUP BY agent) x ON x.agent = e.agent WHERE e.event_id % 97 <> 0 AND (x.gone IS NULL OR e.event_id > x.gone)) GROUP BY agent)")
def _(m):
    log = m.raw_events.select(c("agent").alias("name"), "event_id", "ms", (-c("ms")).alias("first"), c("event_type").alias("kind"), F.when(c("event_type").isin("error", "view"), c("event_type") == "error").alias("paused"))
    gone = c("event_id") % 97 == 0
    kept = st.last_values(log, "name", c("event_id"), ["kind", "ms", "paused"], gone)
    dead = log.groupBy("name").agg(F.max(F.when(gone, c("event_id"))).alias("dead"))
    joined = log.join(dead, "name").filter(~gone & (c("dead").isNull() | (c("event_id") > c("dead")))).groupBy("name").agg(F.min("ms").alias("joined_at"))
    return kept.join(joined, "name").select("name", "kind", "joined_at", c("ms").alias("heartbeat_at"), F.coalesce("paused", F.lit(False)).alias("paused"))


@query("goal_state", "SELECT 'G' || (event_id % 50) AS id, arg_max(event_type, event_id) AS state, count(*) AS n FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL")
def _(m):
    log = m.raw_events.filter("event_type in ('click', 'view')").select(F.concat(F.lit("G"), S(c("event_id") % 50)).alias("id"), "event_id", c("event_type").alias("state"))
    n = log.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return st.last_values(log, "id", c("event_id"), ["state"]).join(n, "id").select("id", "state", "n")


@query("memory_set", "SELECT key, arg_max(value, event_id) AS value, arg_max(author, event_id) AS author FROM (SELECT e.*, max(CASE WHEN event_id % 11 = 0 THEN event_id END) OVER (PARTITION BY key) AS gone FROM (SELECT event_id, 'k' || (event_id % 300) AS key, event_type AS value, agent AS author FROM ev) e) WHERE event_id % 11 <> 0 AND (gone IS NULL OR event_id > gone) GROUP BY key")
def _(m):
    log = m.raw_events.select("event_id", F.concat(F.lit("k"), S(c("event_id") % 300)).alias("key"), c("event_type").alias("value"), c("agent").alias("author"))
    return st.last_values(log, "key", c("event_id"), ["value", "author"], c("event_id") % 11 == 0)


@query("message_read", "SELECT id, max(sent) AS sent_at, max(read) AS read_at FROM (SELECT conv_id * 1000 + turn AS id, turn AS sent, CASE WHEN turn % 2 = 0 THEN turn + 1 END AS read FROM conversations) GROUP BY id")
def _(m):
    t = m.raw("conversations")
    key = (c("conv_id") * 1000 + c("turn")).alias("id")
    none = F.lit(None).cast("long")
    log = t.select(key, F.lit(1).alias("at"), c("turn").cast("long").alias("sent_at"), none.alias("read_at")).unionAll(t.filter("turn % 2 = 0").select(key, F.lit(2), none, (c("turn") + 1).cast("long")))
    return st.last_values(log, "id", c("at"), ["sent_at", "read_at"])


REPORTS = "reports AS (SELECT event_id AS id, agent, event_id % 140 - 20 AS percent, ms AS ts FROM ev WHERE event_type = 'view'), latest AS (SELECT agent, max(ts) AS ts FROM reports GROUP BY agent)"


@query("progress_record", "SELECT 'progress' AS effect, id::VARCHAR AS id, agent, least(greatest(percent, 0), 100) AS value FROM reports UNION ALL SELECT 'heartbeat', agent, agent, ts FROM latest UNION ALL SELECT 'renewed', l.id, l.agent, r.ts + l.ttl_secs * 1000 FROM leases l JOIN latest r ON r.agent = l.agent WHERE l.state = 'active' AND l.acquired_at <= r.ts AND l.expires_at > r.ts", REPORTS)
def _(m):
    reports = m.raw_events.filter("event_type = 'view'").select(c("event_id").alias("id"), "agent", (c("event_id") % 140 - 20).alias("percent"), c("ms").alias("ts"))
    return ef.progress_reported(reports, m.leases)


@query("activity_record", "SELECT a.agent, a.path, a.started_at, a.updated_at, (SELECT count(*) FROM opened w WHERE w.agent = a.agent AND w.path = a.path) AS opened FROM activity a", "half AS (SELECT (min(ms) + max(ms)) // 2 AS at FROM ev), opened AS (SELECT agent, path FROM (SELECT agent, path, ts, ts - lag(ts) OVER (PARTITION BY agent, path ORDER BY ts, event_id) AS gap FROM touches), half WHERE ts > half.at AND (gap IS NULL OR gap > 86400000))")
def _(m):
    # The first half of the touches makes the records that the second half goes on with.
    cut = m.raw_events.agg(F.expr("(min(ms) + max(ms)) div 2")).first()[0]
    none = m.activity.limit(0)
    stored = ef.activity_recorded(none, m.touches.filter(c("ts") <= cut), DAY)
    return ef.activity_recorded(stored, m.touches.filter(c("ts") > cut), DAY).select("agent", "path", "started_at", "updated_at", "opened")


@query("orphan_reclaim", "SELECT t.id, t.assignee, 'pending' AS state FROM tasks t LEFT JOIN agents a ON t.assignee = a.name, k WHERE t.state = 'running' AND (a.name IS NULL OR a.heartbeat_at < now - 60000)")
def _(m):
    return st.orphans(m.tasks, m.agents, m.now).withColumn("state", F.lit("pending"))


@query("req_autoresolve", "SELECT id FROM requests WHERE state IN ('open', 'accepted') AND ((kind = 'lease-transfer' AND resource_symbol IN (SELECT symbol_id FROM leases WHERE state = 'expired')) OR resource_task IN (SELECT id FROM tasks WHERE state = 'done'))")
def _(m):
    return st.autoresolved(m.requests, m.leases.filter("state = 'expired'"), m.tasks.filter("state = 'done'").select(c("id").alias("task"))).select("id")


@query("task_unblocked", "SELECT t.id, x.depends_on AS by FROM tasks t LEFT JOIN d ON d.task_id = t.id JOIN task_deps x ON x.task_id = t.id JOIN tasks o ON o.id = x.depends_on AND o.state = 'done' AND CAST(substr(o.id, 2) AS BIGINT) % 10 = 3 WHERE t.state = 'pending' AND len(coalesce(d.blocked_by, [])) = 0", VIEW)
def _(m):
    done = m.tasks.filter("state = 'done' and cast(substring(id, 2) as long) % 10 = 3").select(c("id").alias("task"))
    return st.unblocked(r.task_view(m.tasks, m.task_deps), m.task_deps, done)


@query("task_add", "SELECT 'T' || ((SELECT count(*) FROM tasks) + row_number() OVER (ORDER BY id)) AS id, title FROM goals WHERE id IN ('G1', 'G2', 'G3')")
def _(m):
    more = m.goals.filter(c("id").isin("G1", "G2", "G3")).select(c("id").alias("goal"), "title")
    return st.next_ids(m.tasks.count(), more, "T", c("goal")).select("id", "title")


@query("task_scope_set", "SELECT task_id, symbol_id FROM task_symbols UNION SELECT 'T1', id FROM symbols WHERE id IN ('O1', 'O2')")
def _(m):
    more = m.symbols.filter(c("id").isin("O1", "O2")).select(F.lit("T1").alias("task_id"), c("id").alias("symbol_id"))
    return m.task_symbols.union(more).distinct()


OPS = ("claim", "state", "submit", "approve", "reject", "assign", "reclaim", "priority", "capability")


def task_log(m) -> DataFrame:
    """A command log over tasks, from the events: each is added first, then what its events say."""
    e = c("event_id")
    op = F.element_at(F.array(*map(F.lit, OPS)), (F.floor(e / 400) % 9 + 1).cast("int"))
    value = F.when(op == "state", F.element_at(F.array(F.lit("done"), F.lit("blocked"), F.lit("failed")), (e % 3 + 1).cast("int"))).when(op == "assign", F.concat(F.lit("A"), S(e % 10))).when(op == "priority", S(e % 5)).when(op == "capability", F.concat(F.lit("skill"), S(e % 3)))
    rows = m.raw_events.select((e + 1_000_000_000).alias("id"), c("ms").alias("ts"), F.concat(F.lit("T"), S(e % 400)).alias("task"), op.alias("op"), F.concat(F.lit("A"), S(F.when(op == "approve", e % 7).otherwise(e % 400 % 10))).alias("agent"), value.alias("value"), (e % 13 == 0).alias("force"))
    null = F.lit(None).cast("string")
    first = m.spark.range(400).select("id", F.lit(0).cast("long").alias("ts"), F.concat(F.lit("T"), S(c("id"))).alias("task"), F.lit("add").alias("op"), null.alias("agent"), null.alias("value"), F.lit(False).alias("force"))
    return first.unionByName(rows)


#: The log, and each task's states one command after the other.
COMMANDS = f"""commands AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, id) AS rn FROM (SELECT i AS id, 0::BIGINT AS ts, 'T' || i AS task, 'add' AS op, NULL AS agent, NULL AS value, false AS force FROM range(400) r(i)
  UNION ALL SELECT event_id + 1000000000, ms, 'T' || (event_id % 400), op, 'A' || CASE op WHEN 'approve' THEN event_id % 7 ELSE event_id % 400 % 10 END, CASE op WHEN 'state' THEN ['done', 'blocked', 'failed'][event_id % 3 + 1] WHEN 'assign' THEN 'A' || (event_id % 10) WHEN 'priority' THEN (event_id % 5)::VARCHAR WHEN 'capability' THEN 'skill' || (event_id % 3) END, event_id % 13 = 0 FROM (SELECT *, {list(OPS)}[event_id // 400 % 9 + 1] AS op FROM ev))),
run AS (SELECT DISTINCT task, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS state, NULL::VARCHAR AS assignee, NULL::VARCHAR AS event, NULL::VARCHAR AS priority, NULL::VARCHAR AS capability FROM commands
  UNION ALL SELECT task, rn, id, CASE WHEN ok THEN 'done' WHEN op = 'assign' AND was IS NOT NULL THEN 'unchanged' ELSE 'refused' END, CASE WHEN NOT ok THEN was WHEN op IN ('add', 'reclaim') THEN 'pending' WHEN op IN ('claim', 'reject', 'assign') THEN 'running' WHEN op = 'state' THEN value WHEN op = 'submit' THEN 'review' WHEN op = 'approve' THEN 'done' ELSE was END,
    CASE WHEN NOT ok THEN had WHEN op = 'claim' THEN agent WHEN op = 'assign' THEN value WHEN op = 'reclaim' THEN NULL ELSE had END,
    CASE WHEN NOT ok THEN NULL WHEN op = 'add' THEN 'task.created' WHEN op IN ('claim', 'reject') THEN 'task.started' WHEN op = 'state' THEN CASE value WHEN 'done' THEN 'task.completed' ELSE 'task.' || value END WHEN op = 'submit' THEN 'task.submitted_for_review' WHEN op = 'approve' THEN 'task.completed' WHEN op IN ('assign', 'reclaim') THEN 'task.reassigned' WHEN op = 'priority' THEN 'task.reprioritised' END,
    CASE WHEN ok AND op = 'priority' THEN value ELSE priority END, CASE WHEN ok AND op = 'capability' THEN value ELSE capability END
  FROM (SELECT x.task, x.rn, x.id, x.op, x.agent, x.value, run.state AS was, run.assignee AS had, run.priority, run.capability, CASE WHEN x.op = 'add' THEN run.state IS NULL WHEN run.state IS NULL THEN false WHEN x.op = 'claim' THEN run.state = 'pending' WHEN x.op = 'state' THEN NOT (x.value IN ('done', 'failed') AND NOT x.force AND run.assignee IS NOT NULL AND run.assignee <> x.agent) WHEN x.op = 'submit' THEN coalesce(run.assignee = x.agent, false)
    WHEN x.op = 'approve' THEN x.force OR run.assignee IS DISTINCT FROM x.agent WHEN x.op = 'assign' THEN run.assignee IS DISTINCT FROM x.value WHEN x.op = 'reclaim' THEN run.state = 'running' ELSE true END AS ok FROM run JOIN commands x ON x.task = run.task AND x.rn = run.rn + 1))"""


@query("task_state", "SELECT id, task, outcome, state, assignee, event, priority, capability FROM run WHERE rn > 0", COMMANDS)
def _(m):
    return st.task_fold(task_log(m))


@query("review_submit", "SELECT id, task, assignee FROM run WHERE event = 'task.submitted_for_review'", COMMANDS)
def _(m):
    return st.task_fold(task_log(m)).filter("event = 'task.submitted_for_review'").select("id", "task", "assignee")


@query("task_assign", "SELECT id, task, assignee FROM run WHERE event = 'task.reassigned'", COMMANDS)
def _(m):
    return st.task_fold(task_log(m)).filter("event = 'task.reassigned'").select("id", "task", "assignee")


#: Tasks that end now: a tenth of the running and the reviewed ones, every third of them as failed.
ENDED = "ended AS (SELECT id AS task, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 30 = 0 THEN 'failed' ELSE 'done' END AS state FROM tasks WHERE CAST(substr(id, 2) AS BIGINT) % 10 = 0 OR state IN ('running', 'review'))"
AFTER = """after AS (SELECT t.id, coalesce(e.state, t.state) AS state FROM tasks t LEFT JOIN ended e ON e.task = t.id),
free AS (SELECT l.id AS lease, l.agent, l.symbol_id, l.task FROM leases l JOIN ended e ON e.task = l.task WHERE l.state = 'active'),
freed AS (SELECT q.id, coalesce(q.to_agent, q.from_agent) AS agent, min(f.lease) AS lease FROM requests q JOIN free f ON f.symbol_id = q.resource_symbol WHERE q.kind = 'lease-transfer' AND q.state IN ('open', 'accepted') GROUP BY ALL),
open_deps AS (SELECT DISTINCT d.task_id FROM task_deps d LEFT JOIN after o ON o.id = d.depends_on WHERE o.state IS DISTINCT FROM 'done')"""


@query("task_finish", "SELECT 'task.ended' AS effect, task AS id, NULL AS agent, state AS cause FROM ended UNION SELECT 'lease.released', lease, agent, task FROM free UNION SELECT 'request.fulfilled', id, agent, lease FROM freed UNION SELECT 'request.fulfilled', q.id, coalesce(q.to_agent, q.from_agent), q.resource_task FROM requests q JOIN ended e ON e.task = q.resource_task AND e.state = 'done' WHERE q.state IN ('open', 'accepted') AND q.id NOT IN (SELECT id FROM freed) UNION SELECT 'task.unblocked', d.task_id, NULL, d.depends_on FROM task_deps d JOIN ended e ON e.task = d.depends_on AND e.state = 'done' JOIN after a ON a.id = d.task_id AND a.state = 'pending' WHERE d.task_id NOT IN (SELECT task_id FROM open_deps)", ENDED, AFTER)
def _(m):
    n = F.substring("id", 2, 20).cast("long")
    ended = m.tasks.filter((n % 10 == 0) | c("state").isin("running", "review")).select(c("id").alias("task"), F.when(n % 30 == 0, "failed").otherwise("done").alias("state"))
    return ef.finished(ended, m.tasks, m.task_deps, m.leases, m.requests)


@query("req_accept", """SELECT r.id AS request, CASE WHEN NOT r.may THEN CASE WHEN r.state = 'open' AND r.due THEN 'expired' ELSE 'refused' END WHEN r.kind <> 'lease-transfer' THEN 'accepted' WHEN v.lease IS NOT NULL THEN 'transferred' ELSE 'not held' END AS outcome, v.lease, v.from_agent AS agent, v.expires_at, (SELECT min(q.id) FROM lease_queue q WHERE q.state = 'waiting' AND q.agent = v.from_agent AND q.symbol_id = v.resource_symbol) AS waiter FROM answers r LEFT JOIN moved v ON v.id = r.id""",
       """asked AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 'O' || (seq % 40) ELSE resource_symbol END AS resource_symbol, 'open' AS state, CASE WHEN seq % 3 = 0 THEN 'lease-transfer' ELSE kind END AS kind) FROM requests),
answers AS (SELECT *, coalesce(state = 'open' AND NOT due AND coalesce(to_agent = who, true) AND who <> from_agent, false) AS may FROM (SELECT *, CASE WHEN seq % 5 = 0 THEN from_agent ELSE coalesce(to_agent, 'A' || (seq % 10)) END AS who, coalesce(deadline_at <= created_at + 3600000 * (seq % 100), false) AS due, created_at + 3600000 * (seq % 100) AS at FROM asked)),
moved AS (SELECT * FROM (SELECT r.*, l.id AS lease, r.at + l.ttl_secs * 1000 AS expires_at, row_number() OVER (PARTITION BY l.id ORDER BY r.seq) AS rn FROM answers r JOIN (SELECT * FROM leases WHERE state = 'active' QUALIFY row_number() OVER (PARTITION BY agent, symbol_id ORDER BY acquired_at, id) = 1) l ON l.agent = r.who AND l.symbol_id = r.resource_symbol WHERE r.may AND r.kind = 'lease-transfer') WHERE rn = 1)""")
def _(m):
    # Every third request asks for one of forty symbols, so that there are leases to move and two requests for one.
    third = c("seq") % 3 == 0
    asked = m.requests.withColumn("resource_symbol", F.when(third, F.concat(F.lit("O"), S(c("seq") % 40))).otherwise(c("resource_symbol"))).withColumn("state", F.lit("open")).withColumn("kind", F.when(third, "lease-transfer").otherwise(c("kind")))
    who = F.when(c("seq") % 5 == 0, c("from_agent")).otherwise(F.coalesce("to_agent", F.concat(F.lit("A"), S(c("seq") % 10))))
    answers = asked.select(c("id").alias("request"), who.alias("agent"), (c("created_at") + 3_600_000 * (c("seq") % 100)).alias("ts"))
    return ef.accepted(answers, asked, m.leases, m.lease_queue)


@query("task_claim_scope", "SELECT p.id AS task, 'A1' AS agent, ts.symbol_id, 'L:' || p.id || ':' || ts.symbol_id AS lease, now + 300000 AS expires_at FROM (SELECT p.id FROM plan p JOIN tasks t ON t.id = p.id WHERE p.level = 0 AND p.startable AND (t.required_capability IS NULL OR t.required_capability = (SELECT capability FROM agents WHERE name = 'A1')) AND NOT (SELECT paused FROM agents WHERE name = 'A1') ORDER BY p.priority DESC, p.created_at, p.id LIMIT 1) p JOIN task_symbols ts ON ts.task_id = p.id, k", *PLAN)
def _(m):
    best = claimed(m, "A1").select("id")
    return ef.claimed(best, m.task_symbols, "A1", m.now)


@query("req_open", "SELECT seq AS id, id AS request, CASE WHEN from_agent IS DISTINCT FROM to_agent THEN 'done' ELSE 'refused' END AS outcome, CASE WHEN from_agent IS DISTINCT FROM to_agent THEN 'open' END AS state FROM requests UNION ALL SELECT seq + 1000000000, id, CASE WHEN NOT opened THEN 'refused' WHEN op = 'sweep' THEN CASE WHEN due THEN 'done' ELSE 'ignored' END WHEN op = 'accept' AND due THEN 'refused' WHEN op IN ('symbol_free', 'task_done') THEN CASE WHEN op = 'task_done' OR kind = 'lease-transfer' THEN 'done' ELSE 'ignored' END WHEN op = 'cancel' THEN CASE WHEN agent = from_agent THEN 'done' ELSE 'refused' END WHEN NOT answers THEN 'refused' WHEN op = 'accept' AND kind = 'lease-transfer' THEN 'transferred' ELSE 'done' END, CASE WHEN NOT opened THEN NULL WHEN op IN ('sweep', 'accept') AND due THEN 'expired' WHEN op = 'sweep' THEN 'open' WHEN op IN ('symbol_free', 'task_done') THEN CASE WHEN op = 'task_done' OR kind = 'lease-transfer' THEN 'fulfilled' ELSE 'open' END WHEN op = 'cancel' THEN CASE WHEN agent = from_agent THEN 'cancelled' ELSE 'open' END WHEN NOT answers THEN 'open' WHEN op = 'accept' THEN CASE kind WHEN 'lease-transfer' THEN 'fulfilled' ELSE 'accepted' END WHEN op = 'decline' THEN 'declined' ELSE 'fulfilled' END FROM told",
       "told AS (SELECT *, (to_agent IS NULL OR to_agent = agent) AND agent IS DISTINCT FROM from_agent AS answers FROM (SELECT *, from_agent IS DISTINCT FROM to_agent AS opened, ['accept', 'decline', 'fulfill', 'cancel', 'sweep', 'symbol_free', 'task_done'][seq % 7 + 1] AS op, CASE WHEN seq % 2 = 0 THEN to_agent ELSE from_agent END AS agent, coalesce(deadline_at <= created_at + 1000 * (seq % 100000), false) AS due FROM requests))")
def _(m):
    null, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    opened = m.requests.select(c("seq").alias("id"), c("created_at").alias("ts"), c("id").alias("request"), F.lit("open").alias("op"), c("from_agent").alias("agent"), "from_agent", "to_agent", "kind", "deadline_at")
    op = F.element_at(F.array(*map(F.lit, ("accept", "decline", "fulfill", "cancel", "sweep", "symbol_free", "task_done"))), (c("seq") % 7 + 1).cast("int"))
    later = m.requests.select((c("seq") + 1_000_000_000).alias("id"), (c("created_at") + 1000 * (c("seq") % 100_000)).alias("ts"), c("id").alias("request"), op.alias("op"), F.when(c("seq") % 2 == 0, c("to_agent")).otherwise(c("from_agent")).alias("agent"), null.alias("from_agent"), null.alias("to_agent"), null.alias("kind"), none.alias("deadline_at"))
    return st.request_fold(opened.unionByName(later))


#: Commands on sessions, and each agent's live sessions one command after the other.
ATTACHED = """calls AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts, id) AS rn FROM (SELECT CAST(substr(id, 2) AS BIGINT) AS id, started_at AS ts, agent, id AS session, 'open' AS op, transport FROM sessions
  UNION ALL SELECT CAST(substr(id, 2) AS BIGINT) + 1000000000, heartbeat_at, agent, id, 'heartbeat', NULL FROM sessions UNION ALL SELECT CAST(substr(id, 2) AS BIGINT) + 2000000000, ended_at, agent, id, 'end', NULL FROM sessions WHERE ended_at IS NOT NULL UNION ALL SELECT CAST(substr(id, 2) AS BIGINT) + 3000000000, started_at + 200000, agent, NULL, 'sweep', NULL FROM sessions)),
attached AS (SELECT DISTINCT agent, 0::BIGINT AS rn, []::STRUCT(s VARCHAR, b BIGINT, t VARCHAR)[] AS live, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, false AS released FROM calls
  UNION ALL SELECT x.agent, x.rn, CASE x.op WHEN 'open' THEN list_append(list_filter(a.live, lambda v: v.s <> x.session), {'s': x.session, 'b': x.ts, 't': x.transport}) WHEN 'heartbeat' THEN list_transform(a.live, lambda v: CASE WHEN v.s = x.session THEN {'s': v.s, 'b': x.ts, 't': v.t} ELSE v END) WHEN 'end' THEN list_filter(a.live, lambda v: v.s <> x.session) ELSE list_filter(a.live, lambda v: v.b >= x.ts - 60000) END, x.id,
    CASE WHEN x.op = 'open' THEN 'opened' WHEN x.op = 'sweep' THEN 'expired ' || len(list_filter(a.live, lambda v: v.b < x.ts - 60000)) WHEN len(list_filter(a.live, lambda v: v.s = x.session)) = 0 THEN 'ignored' WHEN x.op = 'end' THEN 'ended' ELSE 'alive' END,
    CASE x.op WHEN 'end' THEN len(list_filter(a.live, lambda v: v.s = x.session)) > 0 AND len(list_filter(a.live, lambda v: v.s <> x.session AND v.b >= x.ts - 60000)) = 0 WHEN 'sweep' THEN len(list_filter(a.live, lambda v: v.b < x.ts - 60000 AND v.t = 'mcp')) > 0 AND len(list_filter(a.live, lambda v: v.b >= x.ts - 60000)) = 0 ELSE false END
  FROM attached a JOIN calls x ON x.agent = a.agent AND x.rn = a.rn + 1)"""


@query("session_open", "SELECT id, agent, outcome, released FROM attached WHERE rn > 0", ATTACHED)
def _(m):
    null = F.lit(None).cast("string")
    number = F.substring("id", 2, 20).cast("long")
    opened = m.sessions.select(number.alias("id"), c("started_at").alias("ts"), "agent", c("id").alias("session"), F.lit("open").alias("op"), "transport", F.lit(False).alias("keep"))
    beat = m.sessions.select((number + 1_000_000_000).alias("id"), c("heartbeat_at").alias("ts"), "agent", c("id").alias("session"), F.lit("heartbeat").alias("op"), null.alias("transport"), F.lit(False).alias("keep"))
    ended = m.sessions.filter("ended_at is not null").select((number + 2_000_000_000).alias("id"), c("ended_at").alias("ts"), "agent", c("id").alias("session"), F.lit("end").alias("op"), null.alias("transport"), F.lit(False).alias("keep"))
    swept = m.sessions.select((number + 3_000_000_000).alias("id"), (c("started_at") + 200_000).alias("ts"), "agent", null.alias("session"), F.lit("sweep").alias("op"), null.alias("transport"), F.lit(False).alias("keep"))
    return st.session_fold(opened.unionByName(beat).unionByName(ended).unionByName(swept))


# Streams


def signs(m, key, until, ended, kind: str):
    stream = sj.event_stream(m.spark, f"{m.dir}/events.parque[t]", m.raw("events").schema).filter(c("event_type") == kind)
    ms = millis(stream, "ts")
    return stream.select(key.alias("key"), F.timestamp_millis(ms).alias("at"), until(ms).cast("long").alias("until"), ended.alias("ended"))


@query("st_lease_ttl", "SELECT 'L' || event_id AS key, expires_at AS expired_at FROM (SELECT event_id, ms + CAST(3600 * (1 + floor(value)) AS BIGINT) * 1000 AS expires_at FROM ev WHERE event_type = 'click') WHERE expires_at < (SELECT max(ms) FROM ev WHERE event_type = 'click') - 600000")
def _(m):
    rows = signs(m, F.concat(F.lit("L"), S(c("event_id"))), lambda ms: ms + (3600 * (1 + F.floor("value"))).cast("long") * 1000, F.lit(False), "click")
    return sj.run_to_table(sj.timer_expiry(rows), "append", "lease-ttl")


@query("st_queue_ttl", "SELECT 'Q' || event_id AS key, polled_at + 15000 AS expired_at FROM (SELECT event_id, ms + (user_id % 5) * 5000 AS polled_at FROM ev WHERE event_type = 'signup') WHERE polled_at + 15000 < (SELECT max(ms) FROM ev WHERE event_type = 'signup') - 600000 AND event_id % 4 <> 0")
def _(m):
    rows = signs(m, F.concat(F.lit("Q"), S(c("event_id"))), lambda ms: ms + (c("user_id") % 5) * 5000 + 15_000, c("event_id") % 4 == 0, "signup")
    return sj.run_to_table(sj.timer_expiry(rows), "append", "queue-ttl")


@query("st_session_expire", "SELECT 'S' || event_id AS key, ms + event_id % 7 * 20000 + 60000 AS expired_at FROM ev WHERE event_type = 'view' AND event_id % 2 = 0 AND ms + event_id % 7 * 20000 + 60000 < (SELECT max(ms) FROM ev WHERE event_type = 'view') - 600000")
def _(m):
    rows = signs(m, F.concat(F.lit("S"), S(c("event_id"))), lambda ms: ms + c("event_id") % 7 * 20_000 + 60_000, c("event_id") % 2 != 0, "view")
    return sj.run_to_table(sj.timer_expiry(rows), "append", "session-ttl")


@query("st_request_deadline", "SELECT 'RQ' || event_id AS key, ms + 86400000 * (1 + event_id % 20) AS expired_at FROM ev WHERE event_type = 'error' AND event_id % 7 % 6 IN (0, 1) AND ms + 86400000 * (1 + event_id % 20) < (SELECT max(ms) FROM ev WHERE event_type = 'error') - 600000")
def _(m):
    rows = signs(m, F.concat(F.lit("RQ"), S(c("event_id"))), lambda ms: ms + DAY * (1 + c("event_id") % 20), ~(c("event_id") % 7 % 6).isin(0, 1), "error")
    return sj.run_to_table(sj.timer_expiry(rows), "append", "deadlines")


SWEEP = "SELECT 1 AS step, 'lease' AS what, id FROM leases, k WHERE state = 'active' AND expires_at <= now UNION ALL SELECT 2, 'request', id FROM requests, k WHERE state IN ('open', 'accepted') AND deadline_at <= now UNION ALL SELECT 3, 'session', id FROM sessions, k WHERE ended_at IS NULL AND heartbeat_at < now - 60000 UNION ALL SELECT 4, 'activity', agent || ' ' || path FROM activity, k WHERE updated_at < now - 60000 UNION ALL SELECT 5, 'task', t.id FROM tasks t LEFT JOIN agents a ON t.assignee = a.name, k WHERE t.state = 'running' AND (a.name IS NULL OR a.heartbeat_at < now - 60000)"


@query("st_sweep", SWEEP)
def _(m):
    stream = sj.event_stream(m.spark, f"{m.dir}/events.parque[t]", m.raw("events").schema)
    ticks = stream.select(millis(stream, "ts").alias("ts"))
    return sj.swept(ticks, lambda now: st.sweep(m.leases, m.requests, m.sessions, m.activity, m.tasks, m.agents, now), "sweep")


@query("sink_ws_snapshot", "SELECT max(event_id) AS last_id, count(*) AS events, (SELECT count(*) FROM tasks) AS tasks FROM ev")
def _(m):
    stream = sj.event_stream(m.spark, f"{m.dir}/events.parque[t]", m.raw("events").schema)
    headline = lambda: rp.section(m.tasks.agg(F.count(F.lit(1)).alias("n")), "tasks", F.lit("count"), c("n"))
    rows = sj.snapshots(stream.select(c("event_id").alias("id")), headline, "snapshots")
    return rows.select("last_id", "events", F.get_json_object("json", "$[0].value").cast("long").alias("tasks"))


@query("st_snapshot", "SELECT 'agents' AS section, agent AS key FROM ev GROUP BY agent UNION ALL SELECT 'waiting', 'count'")
def _(m):
    stream = sj.event_stream(m.spark, f"{m.dir}/events.parque[t]", m.raw("events").schema)

    def status():
        return rp.together([rp.section(m.agents, "agents", c("name"), c("kind")), rp.section(m.lease_queue.filter("state = 'waiting'").agg(F.count(F.lit(1)).alias("n")), "waiting", F.lit("count"), c("n"))])

    rows = sj.snapshots(stream.select(c("event_id").alias("id")), status, "status")
    items = F.from_json("json", "array<struct<section: string, key: string, value: string>>")
    return rows.select(F.explode(items).alias("x")).select("x.section", "x.key")


@query("st_debounce", "SELECT root, min(ts) AS started_at, max(ts) AS ended_at, string_agg(DISTINCT path, ',' ORDER BY path) AS paths, count(*) AS changes FROM (SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY ts, event_id) AS grp FROM (SELECT *, split_part(path, '/', 1) AS root, CASE WHEN ts - lag(ts) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY ts, event_id) <= 3600000 THEN 0 ELSE 1 END AS fresh FROM touches)) GROUP BY root, grp")
def _(m):
    stream = sj.event_stream(m.spark, f"{m.dir}/events.parque[t]", m.raw("events").schema).filter("event_type = 'click'")
    touched = stream.select((c("event_id") % 25).alias("n_nationkey"), F.timestamp_millis(millis(stream, "ts")).alias("at")).join(F.broadcast(m.nations.select("n_nationkey", "path")), "n_nationkey")
    found = sj.bursts(touched.select(fn.top_dir(c("path")).alias("root"), "path", "at"), 3_600_000)
    return sj.run_to_table(found.withColumn("paths", F.array_join("paths", ",")), "complete", "bursts")


@query("st_notices", "SELECT * FROM (SELECT 'inbox' AS section, id AS key, kind AS value FROM requests WHERE (to_agent = 'A3' OR to_agent IS NULL) AND from_agent <> 'A3' AND state IN ('open', 'accepted') ORDER BY priority DESC, seq LIMIT 5) UNION ALL SELECT * FROM (SELECT 'events', id::VARCHAR, kind FROM (SELECT * FROM log WHERE id > 500 ORDER BY id LIMIT 200) WHERE agent <> 'A3' AND (kind IN ('lease.released', 'task.completed') OR task = (SELECT arg_min(task, (acquired_at, id)) FROM leases WHERE agent = 'A3' AND state = 'active' AND task IS NOT NULL)) ORDER BY id LIMIT 8) UNION ALL SELECT 'expiring', l.id, " + STORED + " FROM leases l JOIN symbols s ON s.id = l.symbol_id, k WHERE l.agent = 'A3' AND l.state = 'active' AND floor((l.expires_at - now) / 1000.0) <= 60")
def _(m):
    return rp.news(m, "A3", 500, m.now)[0]


# Reports


AGENTS = "views AS (SELECT a.*, now - a.heartbeat_at <= 60000 AS online, coalesce(n, 0) AS n_leases, t.task AS current_task FROM agents a LEFT JOIN (SELECT agent, count(*) AS n FROM leases WHERE state = 'active' GROUP BY agent) l ON l.agent = a.name LEFT JOIN (SELECT agent, task FROM leases WHERE state = 'active' AND task IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent ORDER BY acquired_at, id) = 1) t ON t.agent = a.name, k)"
WORKERS = f"""picked AS (SELECT * FROM tasks WHERE {RANK} IS NOT NULL AND assignee IS NOT NULL QUALIFY row_number() OVER (PARTITION BY assignee ORDER BY {RANK}, priority DESC, created_at, id) = 1),
crew AS (SELECT v.name, v.kind, v.paused, v.online, v.n_leases, v.heartbeat_at, s.tool, s.transport, a.path AS current_file, p.percent, t.id AS task, t.state, x.holder, d.blocked_by[1] AS waits_for, tg.goal_id AS goal FROM views v LEFT JOIN (SELECT * FROM sessions, k WHERE ended_at IS NULL AND now - heartbeat_at <= 86400000 QUALIFY row_number() OVER (PARTITION BY agent ORDER BY started_at DESC, id) = 1) s ON s.agent = v.name LEFT JOIN (SELECT * FROM activity, k WHERE updated_at >= now - 86400000 QUALIFY row_number() OVER (PARTITION BY agent ORDER BY updated_at DESC, path) = 1) a ON a.agent = v.name LEFT JOIN (SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY agent ORDER BY id DESC) = 1) p ON p.agent = v.name LEFT JOIN picked t ON t.assignee = v.name LEFT JOIN contended x ON x.task_id = t.id LEFT JOIN d ON d.task_id = t.id LEFT JOIN task_goals tg ON tg.task_id = t.id),
staff AS (SELECT *, CASE WHEN NOT online THEN 'offline' WHEN task IS NULL THEN CASE WHEN current_file IS NOT NULL THEN 'working' ELSE 'idle' END WHEN state = 'review' THEN 'reviewing' WHEN holder IS NOT NULL OR state = 'blocked' THEN 'blocked' ELSE 'working' END AS status FROM crew)"""


@query("workers", f"SELECT name, {WORKER} AS type, status, tool, task, goal, percent, current_file, n_leases AS leases, CASE WHEN status = 'blocked' THEN coalesce(holder, waits_for) END AS blocked_by, (now - heartbeat_at) // 1000 AS silent_for FROM staff, k", CLOSURE, CONTENDED, VIEW, AGENTS, WORKERS)
def _(m):
    return rp.worker_order(rp.workers(m.settled("symbols"), m.now, DAY)).select("name", "type", "status", "tool", "task", "goal", "percent", "current_file", "leases", "blocked_by", "silent_for")


@query("worker_view", "SELECT name, status, task FROM staff", CLOSURE, CONTENDED, VIEW, AGENTS, WORKERS)
def _(m):
    return rp.workers(m, m.now, DAY).select("name", "status", "task")


@query("worker_sort", "SELECT name, row_number() OVER (ORDER BY CASE status WHEN 'working' THEN 0 WHEN 'blocked' THEN 1 WHEN 'reviewing' THEN 2 WHEN 'idle' THEN 3 ELSE 4 END, name) AS place FROM staff", CLOSURE, CONTENDED, VIEW, AGENTS, WORKERS)
def _(m):
    from pyspark.sql import Window

    rank = F.when(c("status") == "working", 0).when(c("status") == "blocked", 1).when(c("status") == "reviewing", 2).when(c("status") == "idle", 3).otherwise(4)
    return rp.workers(m, m.now, DAY).select("name", F.row_number().over(Window.orderBy(rank, "name")).cast("long").alias("place"))


NOTICES = f"""said AS MATERIALIZED (SELECT a.seed AS id, coalesce(s.phrase, a.phrase) AS phrase FROM (SELECT seed, CASE WHEN max(n) > 3 THEN string_agg(who, '(), ' ORDER BY rn) || ' and ' || (max(n) - 3) || ' more call this.' WHEN max(n) = 1 THEN max(who) || '() calls this.' ELSE string_agg(who, '(), ' ORDER BY rn) || '() call this.' END AS phrase FROM names WHERE rn <= 3 GROUP BY seed) a LEFT JOIN (SELECT seed, string_agg(who, ', ' ORDER BY rn) || ' depends on this.' AS phrase FROM svcs WHERE rn <= 3 GROUP BY seed) s ON s.seed = a.seed),
told AS MATERIALIZED (SELECT 'req:' || q.id AS id, q.kind, CASE WHEN q.kind IN ('review', 'lease-transfer') THEN 'blocking' WHEN q.kind IN ('api-change', 'dependency', 'interface') THEN 'warn' ELSE 'info' END AS severity,
 CASE q.kind WHEN 'api-change' THEN coalesce({STORED} || ' changed', q.subject) WHEN 'review' THEN 'Review sent back: ' || q.subject WHEN 'lease-transfer' THEN q.from_agent || ' wants ' || coalesce({STORED}, q.subject) WHEN 'dependency' THEN q.from_agent || ' is blocked on ' || coalesce(q.resource_task, 'a task') WHEN 'interface' THEN q.from_agent || ' needs an interface: ' || q.subject ELSE q.subject END AS title,
 CASE q.kind WHEN 'api-change' THEN said.phrase WHEN 'review' THEN json_extract_string(q.body, '$.reason') WHEN 'lease-transfer' THEN 'Held by ' || coalesce(q.to_agent, 'nobody') || '. Accepting hands it over atomically.' WHEN 'dependency' THEN q.subject END AS detail, q.from_agent AS actor, q.to_agent AS audience, q.created_at AS ts FROM requests q LEFT JOIN symbols s ON s.id = q.resource_symbol LEFT JOIN said ON said.id = q.resource_symbol WHERE q.state IN ('open', 'accepted')
 UNION ALL SELECT 'evt:' || id, 'contention', 'warn', coalesce(agent, 'someone') || ' was refused ' || coalesce(symbol_handle, 'a symbol'), NULL, agent, NULL, ts FROM (SELECT * FROM log ORDER BY id DESC LIMIT 400), k WHERE kind = 'lease.denied' AND ts >= now - 7200000)"""
CHANGED_API = BFS.format(2).replace("role = 'api'", "id IN (SELECT resource_symbol FROM requests WHERE kind = 'api-change' AND state IN ('open', 'accepted'))")


@query("notice_union", "SELECT id, kind, severity, title, detail FROM told", CHANGED_API, DEPENDANTS, NOTICES)
def _(m):
    return rp.request_notices(m, m.now).unionByName(rp.event_notices(m.events, m.now)).select("id", "kind", "severity", "title", "detail")


@query("notice_topk", "SELECT id, ts FROM told ORDER BY ts DESC, id LIMIT 25", CHANGED_API, DEPENDANTS, NOTICES)
def _(m):
    return rp.notifications(m, m.now).select("id", "ts")


@query("notifications", "SELECT id, kind, severity, title FROM told WHERE audience IS NULL OR audience = 'A3' OR (actor = 'A3' AND starts_with(id, 'req:')) ORDER BY ts DESC, id LIMIT 40", CHANGED_API, DEPENDANTS, NOTICES)
def _(m):
    return rp.notifications(m.settled("symbols"), m.now, "A3", 40).select("id", "kind", "severity", "title")


@query("status", "SELECT 'files' AS section, 'count' AS key, (SELECT count(*) FROM files)::VARCHAR AS value UNION ALL SELECT 'symbols', 'count', (SELECT count(*) FROM symbols)::VARCHAR UNION ALL SELECT 'edges', 'count', (SELECT count(*) FROM edges)::VARCHAR UNION ALL SELECT 'knowledge', unnest(['services', 'endpoints', 'tables', 'tests']), unnest([count(*) FILTER (WHERE kind = 'service'), count(*) FILTER (WHERE role = 'api'), count(*) FILTER (WHERE kind = 'table'), count(*) FILTER (WHERE role = 'test')])::VARCHAR FROM symbols UNION ALL SELECT 'agents', name, n_leases::VARCHAR FROM views UNION ALL SELECT 'leases', id, agent FROM leases WHERE state = 'active' UNION ALL SELECT 'waiting', 'count', count(*)::VARCHAR FROM lease_queue WHERE state = 'waiting' UNION ALL SELECT 'tasks', id, state FROM tasks UNION ALL SELECT 'requests', id, kind FROM requests WHERE state IN ('open', 'accepted') UNION ALL SELECT 'progress', agent, arg_max(percent, id)::VARCHAR FROM progress GROUP BY agent UNION ALL SELECT 'schedule', unnest(['startable_now', 'max_parallel', 'waves', 'cycles', 'contended']), unnest([count(*) FILTER (WHERE level = 0 AND startable), (SELECT max(n) FROM (SELECT count(*) AS n FROM plan WHERE stage = 'wave' GROUP BY level)), count(DISTINCT level), (SELECT count(DISTINCT component) FROM cyc), count(*) FILTER (WHERE level = 0 AND holder IS NOT NULL)])::VARCHAR FROM plan WHERE stage = 'wave' UNION ALL SELECT * FROM (SELECT 'events', id::VARCHAR, kind FROM log ORDER BY id DESC LIMIT 20)", *PLAN, AGENTS)
def _(m):
    return rp.status(m, m.now)


@query("observe", "SELECT 'agents' AS section, name AS key, online::VARCHAR AS value FROM views UNION ALL SELECT 'tasks', id, state FROM tasks WHERE id IN (SELECT task_id FROM task_goals WHERE goal_id = 'G1') UNION ALL SELECT 'plan', id, coalesce(level::VARCHAR, stage) FROM plan", *PLAN, AGENTS)
def _(m):
    return rp.observe(m, m.now, "G1")


def context_sql(task: str, section: str = "") -> str:
    """The statement of a task's context."""
    sym = f"O{task[1:]}"
    p = f"'{section}' || " if section else ""
    return f"""SELECT {p}section AS section, key, value FROM (SELECT 'task' AS section, id AS key, state AS value FROM tasks WHERE id = '{task}'
UNION ALL SELECT 'goal', g.id, g.title FROM goals g JOIN task_goals tg ON tg.goal_id = g.id WHERE tg.task_id = '{task}'
UNION ALL SELECT 'goal_progress', tg.goal_id, count(*) FILTER (WHERE t.state = 'done')::VARCHAR FROM task_goals tg JOIN tasks t ON t.id = tg.task_id WHERE tg.goal_id = (SELECT goal_id FROM task_goals WHERE task_id = '{task}') GROUP BY tg.goal_id
UNION ALL SELECT 'scope', {HANDLE}, (SELECT arg_min(agent, (acquired_at, id)) FROM leases WHERE state = 'active' AND symbol_id = '{sym}') FROM symbols WHERE id = '{sym}'
UNION ALL SELECT * FROM (SELECT 'impact', h.id, h.distance::VARCHAR FROM hit h JOIN symbols s ON s.id = h.id ORDER BY h.distance, s.path, h.id LIMIT 40)
UNION ALL SELECT DISTINCT 'tests', e.src, 'test' FROM edges e JOIN symbols s ON s.id = e.src WHERE e.dst = '{sym}' AND e.kind <> 'contains' AND (e.kind = 'tests' OR s.role = 'test')
UNION ALL SELECT * FROM (SELECT 'memory', key, tags FROM memory, symbols s WHERE s.id = '{sym}' AND (contains(lower(key || ' ' || value), lower(s.path)) OR (length(s.name) >= 3 AND contains(lower(key || ' ' || value), lower(s.name)))) ORDER BY updated_at DESC, key LIMIT 20)
UNION ALL SELECT 'blocked_by', x.depends_on, t.state FROM task_deps x JOIN tasks t ON t.id = x.depends_on WHERE x.task_id = '{task}'
UNION ALL SELECT 'blocks', x.task_id, t.state FROM task_deps x JOIN tasks t ON t.id = x.task_id WHERE x.depends_on = '{task}'
UNION ALL SELECT DISTINCT 'neighbors', a.name, a.kind FROM agents a JOIN leases l ON l.agent = a.name AND l.state = 'active' WHERE (l.symbol_id = '{sym}' OR l.symbol_id IN (SELECT id FROM top)) AND a.name <> coalesce((SELECT assignee FROM tasks WHERE id = '{task}'), '')
UNION ALL SELECT * FROM (SELECT 'events', id::VARCHAR, kind FROM (SELECT * FROM log ORDER BY id DESC LIMIT 200) WHERE task = '{task}' OR symbol_handle IN (SELECT {handle_of('s')} FROM symbols s WHERE s.id = '{sym}' OR s.id IN (SELECT id FROM top)) ORDER BY CAST(id AS BIGINT) LIMIT 20)
UNION ALL SELECT 'notices', q.id, q.kind FROM requests q JOIN tasks t ON t.id = '{task}' WHERE t.assignee IS NOT NULL AND (q.to_agent = t.assignee OR q.to_agent IS NULL) AND q.from_agent <> t.assignee AND q.state IN ('open', 'accepted') AND (q.kind = 'api-change' OR q.resource_task = '{task}' OR q.resource_symbol = '{sym}' OR q.resource_symbol IN (SELECT id FROM top)))"""


TOP = "top AS (SELECT h.id FROM hit h JOIN symbols s ON s.id = h.id ORDER BY h.distance, s.path, h.id LIMIT 40)"


@query("task_context", context_sql("T7"), BFS.format(2).replace("role = 'api'", "id = 'O7'"), TOP)
def _(m):
    return rp.task_context(m.settled("symbols"), "T7", m.now)


@query("neighbors_at_work", "SELECT DISTINCT l.agent AS name FROM leases l WHERE l.state = 'active' AND l.agent <> 'A1' AND (l.symbol_id IN (SELECT id FROM hit) OR l.symbol_id IN (SELECT id FROM symbols WHERE role = 'api'))", BFS.format(2))
def _(m):
    seeds = m.symbols.filter("role = 'api'").select("id")
    near = g.reach(m.edges, seeds, 2).select("id").union(seeds)
    held = m.leases.filter("state = 'active' and agent <> 'A1'").join(near.select(c("id").alias("symbol_id")), "symbol_id", "left_semi")
    return held.select(c("agent").alias("name")).distinct()


@query("agent_context", None)
def _(m):
    return rp.agent_context(m.settled("symbols"), "A3", m.now)


@query("show", f"SELECT 'symbol' AS section, id AS key, {HANDLE} AS value FROM symbols WHERE id = 'C7' UNION ALL SELECT CASE side WHEN 'caller' THEN 'callers' WHEN 'callee' THEN 'callees' ELSE 'children' END, other, kind FROM (SELECT e.dst AS id, 'caller' AS side, e.kind, e.src AS other FROM edges e JOIN symbols x ON e.src = x.id WHERE e.kind <> 'contains' UNION ALL SELECT e.src, 'callee', e.kind, e.dst FROM edges e JOIN symbols x ON e.dst = x.id WHERE e.kind <> 'contains' UNION ALL SELECT parent_id, 'child', 'contains', id FROM symbols) WHERE id = 'C7' UNION ALL SELECT 'leases', id, agent FROM leases WHERE state = 'active' AND symbol_id = 'C7'")
def _(m):
    return rp.show(m, "C7")


@query("graph", f"SELECT h.distance, {handle_of('s')} AS handle, l.holder FROM hit h JOIN symbols s ON s.id = h.id LEFT JOIN (SELECT symbol_id, arg_max(agent, (acquired_at, id)) AS holder FROM leases WHERE state = 'active' GROUP BY symbol_id) l ON l.symbol_id = h.id", BFS.format(3).replace("role = 'api'", "id = 'P5'"))
def _(m):
    return rp.impact_of(m, "P5", 3)


@query("api", f"SELECT {HANDLE} AS handle, json_extract_string(meta, '$.method') || ' ' || json_extract_string(meta, '$.path') AS route FROM symbols WHERE role = 'api'")
def _(m):
    return m.symbols.filter("role = 'api'").orderBy("path", "start_byte").select(rp.shown().alias("handle"), fn.route(c("role"), c("meta")).alias("route"))


@query("tests", f"SELECT {handle_of('s')} AS handle, count(e.dst) AS covers FROM symbols s LEFT JOIN edges e ON e.src = s.id AND e.kind = 'tests' WHERE s.role = 'test' GROUP BY ALL")
def _(m):
    covers = m.edges.filter("kind = 'tests'").groupBy(c("src").alias("id")).agg(F.count(F.lit(1)).alias("covers"))
    return m.symbols.filter("role = 'test'").join(covers, "id", "left").select(rp.shown().alias("handle"), F.coalesce("covers", F.lit(0)).alias("covers"))


@query("tables", "SELECT t.name, t.id, count(e.src) AS accessors FROM (SELECT * FROM symbols WHERE kind = 'table' ORDER BY path, start_byte, id LIMIT 500) t LEFT JOIN edges e ON e.dst = t.id AND e.kind <> 'contains' GROUP BY ALL")
def _(m):
    first = r.list_symbols(m.symbols, kind="table", limit=500).select("id", "name")
    users = m.edges.filter("kind <> 'contains'").groupBy(c("dst").alias("id")).agg(F.count(F.lit(1)).alias("accessors"))
    return first.join(users, "id", "left").select("name", "id", F.coalesce("accessors", F.lit(0)).alias("accessors"))


@query("services", "SELECT s.name, (SELECT count(*) FROM symbols f WHERE f.parent_id = s.id) AS files, coalesce((SELECT string_agg(DISTINCT b.name, ',' ORDER BY b.name) FROM edges e JOIN symbols x ON x.id = e.src AND x.kind = 'file' JOIN symbols y ON y.id = e.dst AND y.kind = 'file' JOIN symbols b ON b.id = y.parent_id WHERE e.kind = 'imports' AND x.parent_id = s.id AND y.parent_id <> s.id), '') AS depends_on FROM symbols s WHERE s.kind = 'service'")
def _(m):
    s = r.list_symbols(m.symbols, kind="service", limit=200).select("id", "name")
    links = r.service_links(m.edges, m.symbols).filter("src <> dst").distinct().join(m.symbols.select(c("id").alias("dst"), c("name").alias("to")), "dst")
    deps = links.groupBy(c("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("to")), ",").alias("depends_on"))
    n = m.symbols.filter("kind = 'file'").groupBy(c("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("files"))
    return s.join(n, "id", "left").join(deps, "id", "left").select("name", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("depends_on", F.lit("")).alias("depends_on"))


@query("owners", f"SELECT 'codeowners' AS section, 'ASIA/NATION_12' AS key, 'ones pm' AS value UNION ALL SELECT 'rule', 'ASIA/NATION_12', 'NATION_1*' UNION ALL SELECT 'leases', l.id, l.agent FROM leases l JOIN symbols s ON s.id = l.symbol_id WHERE l.state = 'active' AND starts_with({STORED}, 'ASIA/NATION_12')")
def _(m):
    return rp.owners(m, RULES, "ASIA/NATION_12")


@query("who_owns", "SELECT CASE WHEN EXISTS (SELECT 1 FROM leases WHERE state = 'active' AND agent = 'A1' AND symbol_id = 'N3') THEN 'yours' WHEN x.holder IS NOT NULL THEN 'held' ELSE 'nobody' END AS answer, x.holder FROM (SELECT 1) LEFT JOIN (SELECT l.agent AS holder FROM closure cl JOIN leases l ON l.symbol_id = cl.other, k WHERE cl.symbol = 'N3' AND l.state = 'active' AND l.expires_at > now AND l.agent <> 'A1' ORDER BY cl.other, l.id LIMIT 1) x ON true", CLOSURE)
def _(m):
    return rp.who_owns(m, "N3", "A1", m.now).select("answer", "holder")


@query("find_symbols", f"SELECT {SYMS} FROM symbols WHERE kind = 'method' AND (name ILIKE '%o1_0%' OR fqn ILIKE '%o1_0%' OR path ILIKE '%o1_0%') ORDER BY path, start_byte, id LIMIT 200")
def _(m):
    return r.list_symbols(m.symbols, kind="method", pattern="o1_0", limit=max(1, min(200, 5000))).select(*SYM)


@query("whoami", "SELECT 'agent' AS section, name AS key, kind AS value FROM views WHERE name = 'A3' UNION ALL SELECT 'task', name, current_task FROM views WHERE name = 'A3' UNION ALL SELECT 'sessions', id, tool FROM sessions WHERE agent = 'A3' AND ended_at IS NULL UNION ALL SELECT 'leases', id, symbol_id FROM leases WHERE agent = 'A3' AND state = 'active'", AGENTS)
def _(m):
    return rp.whoami(m, "A3", m.now)
