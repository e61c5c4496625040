"""One query for each operator over the driver's tables, with the DuckDB statement it is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import scalars as fn
from loomgraph.operators import diff as df_
from loomgraph.operators import graph as g
from loomgraph.operators import relational as r
from loomgraph.operators import source_text as tx
from loomgraph.operators import state as st
from loomgraph.registry import HANDLE, ORACLE, QUERIES, STORED, SYM, SYMS, query
from loomgraph.sources.adapter import DAY, HOUR, millis
from loomgraph.sources.tables import shared_dir, written
from loomgraph.streaming import jobs as sj
from loomgraph.streaming import leases as ls

c = F.col

# Lookups


@query("sym_by_id", f"SELECT {SYMS} FROM symbols WHERE id = 'C7'")
def _(m):
    return m.symbols.filter("id = 'C7'").select(*SYM)


@query("sym_in_file", f"SELECT {SYMS} FROM symbols WHERE path = 'ASIA/NATION_12' OR path = (SELECT min(path) FROM nations)")
def _(m):
    first = m.nations.agg(F.min("path").alias("p"))
    return m.symbols.join(F.broadcast(first), (c("path") == c("p")) | (c("path") == "ASIA/NATION_12")).select(*SYM)


@query("sym_list", f"SELECT {SYMS} FROM symbols WHERE kind = 'class' AND (name ILIKE '%00%1%' OR fqn ILIKE '%00%1%' OR path ILIKE '%00%1%') ORDER BY path, start_byte, id LIMIT 50")
def _(m):
    return r.list_symbols(m.symbols, kind="class", pattern="00%1", limit=50).select(*SYM)


@query("sym_role", f"SELECT {SYMS} FROM symbols WHERE role = 'api'")
def _(m):
    return m.symbols.filter("role = 'api'").select(*SYM)


@query("sym_list_role", f"SELECT * FROM (SELECT {SYMS} FROM symbols WHERE kind = 'method' ORDER BY path, start_byte, id LIMIT 200) WHERE role = 'test'")
def _(m):
    return r.list_symbols(m.symbols, kind="method", role="test").select(*SYM)


@query("sym_resolve_all", f"SELECT {SYMS} FROM symbols WHERE kind = 'service' AND name = 'ASIA'")
def _(m):
    return r.resolve(m.symbols, "service:ASIA").select(*SYM)


@query("sym_resolve", f"SELECT {SYMS} FROM symbols WHERE name = 'O12'")
def _(m):
    return r.resolve(m.symbols, "O12").select(*SYM)


@query("sym_resolve_fuzzy", f"SELECT {SYMS} FROM symbols WHERE fqn ILIKE '%00003.o%' OR path ILIKE '%00003.o%' ORDER BY path, start_byte, id LIMIT 25")
def _(m):
    return r.resolve(m.symbols, "00003.o").select(*SYM)


@query("f_handle", f"SELECT id, {HANDLE} AS handle FROM symbols")
def _(m):
    return m.symbols.select("id", fn.handle(c("path"), c("kind"), c("name"), c("fqn")).alias("handle"))


@query("ep_list", f"SELECT id, {HANDLE} AS handle, json_extract_string(meta, '$.method') || ' ' || json_extract_string(meta, '$.path') AS route FROM symbols WHERE role = 'api' AND contains(json_extract_string(meta, '$.method') || ' ' || json_extract_string(meta, '$.path'), 'GET /orders/1')")
def _(m):
    route = fn.route(c("role"), c("meta"))
    return m.symbols.filter((c("role") == "api") & route.contains("GET /orders/1")).select("id", fn.handle(c("path"), c("kind"), c("name"), c("fqn")).alias("handle"), route.alias("route"))


@query("f_route", "SELECT id, CASE WHEN role = 'api' THEN json_extract_string(meta, '$.method') || ' ' || json_extract_string(meta, '$.path') END AS route FROM symbols")
def _(m):
    return m.symbols.select("id", fn.route(c("role"), c("meta")).alias("route"))


@query("lease_active", f"SELECT l.id, l.agent, l.symbol_id, coalesce({STORED}, l.symbol_id) AS symbol_handle, l.acquired_at FROM leases l LEFT JOIN symbols s ON l.symbol_id = s.id WHERE l.state = 'active'")
def _(m):
    return r.with_handle(m.leases.filter("state = 'active'"), m.symbols, "symbol_id").select("id", "agent", "symbol_id", "symbol_handle", "acquired_at")


@query("lease_by_id", "SELECT id, agent, symbol_id, state FROM leases ORDER BY id LIMIT 1")
def _(m):
    return m.leases.orderBy("id").limit(1).select("id", "agent", "symbol_id", "state")


@query("lease_history", "SELECT id, agent, acquired_at FROM leases ORDER BY acquired_at DESC, id LIMIT 50")
def _(m):
    return m.leases.orderBy(F.desc("acquired_at"), "id").limit(50).select("id", "agent", "acquired_at")


@query("lease_handle", f"SELECT l.id, coalesce({STORED}, l.symbol_id) AS symbol_handle FROM leases l LEFT JOIN symbols s ON l.symbol_id = s.id")
def _(m):
    return r.with_handle(m.leases, m.symbols, "symbol_id").select("id", "symbol_handle")


@query("owner_leases", f"SELECT l.id, {STORED} AS handle FROM leases l JOIN symbols s ON l.symbol_id = s.id WHERE l.state = 'active' AND starts_with({STORED}, 'ASIA')")
def _(m):
    return r.with_handle(m.leases.filter("state = 'active'"), m.symbols, "symbol_id", "handle", fallback=False).filter(c("handle").startswith("ASIA")).select("id", "handle")


@query("f_secs_left", "SELECT id, CAST(floor((expires_at - now) / 1000.0) AS BIGINT) AS secs FROM leases, k")
def _(m):
    return m.leases.select("id", fn.secs_left(c("expires_at"), m.now).alias("secs"))


@query("f_human_secs", "SELECT id, CASE WHEN ttl_secs < 60 THEN ttl_secs || 's' ELSE (ttl_secs // 60) || 'm ' || (ttl_secs % 60) || 's' END AS human FROM leases")
def _(m):
    return m.leases.select("id", fn.human_secs(c("ttl_secs")).alias("human"))


@query("inbox_msgs", "SELECT id, from_agent, to_agent FROM messages WHERE to_agent = 'A3' AND read_at IS NULL")
def _(m):
    return m.messages.filter("to_agent = 'A3' AND read_at IS NULL").select("id", "from_agent", "to_agent")


@query("mem_get", "SELECT key, author, tags FROM memory WHERE key = '5'")
def _(m):
    return m.memory.filter("key = '5'").select("key", "author", "tags")


@query("mem_list", "SELECT key, tags FROM memory WHERE list_contains(string_split(tags, ','), 'fr')")
def _(m):
    return m.memory.filter(F.array_contains(F.filter(F.split("tags", ","), lambda x: x != ""), "fr")).select("key", "tags")


@query("mem_standing", "SELECT key FROM memory WHERE len(list_intersect(string_split(lower(tags), ','), ['de', 'src3'])) > 0")
def _(m):
    return m.memory.filter(F.arrays_overlap(F.split(F.lower("tags"), ","), F.array(F.lit("de"), F.lit("src3")))).select("key")


@query("req_list", "SELECT id, kind, from_agent, to_agent, priority FROM requests WHERE (to_agent = 'A3' OR to_agent IS NULL) AND from_agent <> 'A3' AND state IN ('open', 'accepted')")
def _(m):
    return m.requests.filter("(to_agent = 'A3' OR to_agent IS NULL) AND from_agent <> 'A3' AND state IN ('open', 'accepted')").select("id", "kind", "from_agent", "to_agent", "priority")


@query("req_handle", f"SELECT q.id, {STORED} AS handle FROM requests q LEFT JOIN symbols s ON q.resource_symbol = s.id")
def _(m):
    return r.with_handle(m.requests, m.symbols, "resource_symbol", "handle", fallback=False).select("id", "handle")


@query("req_expire", "SELECT id FROM requests, k WHERE state IN ('open', 'accepted') AND deadline_at <= now")
def _(m):
    return m.requests.filter(c("state").isin("open", "accepted") & (c("deadline_at") <= m.now)).select("id")


@query("session_list", "SELECT id, agent, started_at FROM sessions WHERE ended_at IS NULL")
def _(m):
    return m.sessions.filter("ended_at IS NULL").select("id", "agent", "started_at")


@query("session_by_key", "SELECT agent, id FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ended_at IS NULL DESC, started_at DESC, id) AS rn FROM sessions) WHERE rn = 1")
def _(m):
    return r.latest(m.sessions, ["agent"], c("ended_at").isNull().desc(), F.desc("started_at"), c("id")).select("agent", "id")


@query("live_sessions_count", "SELECT agent, count(*) AS n FROM sessions WHERE ended_at IS NULL AND id IS DISTINCT FROM 'S5' GROUP BY agent")
def _(m):
    return m.sessions.filter(c("ended_at").isNull() & ~c("id").eqNullSafe("S5")).groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


@query("progress_for", "SELECT id, percent, ts FROM progress WHERE agent = 'A2' ORDER BY id DESC LIMIT 10")
def _(m):
    return m.progress.filter("agent = 'A2'").orderBy(F.desc("id")).limit(10).select("id", "percent", "ts")


@query("progress_handle", f"SELECT p.id, {STORED} AS handle FROM progress p LEFT JOIN symbols s ON p.symbol_id = s.id")
def _(m):
    return r.with_handle(m.progress, m.symbols, "symbol_id", "handle", fallback=False).select("id", "handle")


@query("progress_latest", "SELECT agent, id, percent FROM progress WHERE id IN (SELECT max(id) FROM progress GROUP BY agent)")
def _(m):
    return r.latest(m.progress, ["agent"], F.desc("id")).select("agent", "id", "percent")


@query("goal_list", "SELECT id, title, priority FROM goals WHERE state = 'open'")
def _(m):
    return m.goals.filter("state = 'open'").select("id", "title", "priority")


@query("task_list", "SELECT id, state, priority, assignee FROM tasks")
def _(m):
    return m.tasks.select("id", "state", "priority", "assignee")


@query("tasks_in_review", "SELECT id, assignee FROM tasks WHERE state = 'review'")
def _(m):
    return m.tasks.filter("state = 'review'").select("id", "assignee")


# Sources


@query("src_events_tail", "SELECT id, ts, kind FROM log WHERE id > 100 ORDER BY id LIMIT 200")
def _(m):
    return m.events.filter("id > 100").orderBy("id").limit(200).select("id", "ts", "kind")


@query("src_events_recent", "SELECT id, ts, kind FROM log ORDER BY id DESC LIMIT 50")
def _(m):
    return r.recent(m.events, 50).select("id", "ts", "kind")


@query("src_last_event_id", "SELECT coalesce(max(id), 0) AS last_id FROM log")
def _(m):
    return m.events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


@query("recent_then_filter", "SELECT id FROM (SELECT * FROM log ORDER BY id DESC LIMIT 200) WHERE kind = 'task.completed'")
def _(m):
    return r.recent(m.events, 200).filter("kind = 'task.completed'").select("id")


# Joins


@query("nbr_in", f"SELECT e.dst AS id, e.kind, e.src AS other, {HANDLE.replace('kind', 's.kind')} AS handle FROM edges e JOIN symbols s ON e.src = s.id WHERE e.kind <> 'contains'")
def _(m):
    return r.neighbours(m.edges, m.symbols, incoming=True)


@query("nbr_out", f"SELECT e.src AS id, e.kind, e.dst AS other, {HANDLE.replace('kind', 's.kind')} AS handle FROM edges e JOIN symbols s ON e.dst = s.id WHERE e.kind <> 'contains'")
def _(m):
    return r.neighbours(m.edges, m.symbols, incoming=False)


@query("children", f"SELECT {SYMS} FROM symbols WHERE parent_id = 'N3'")
def _(m):
    return m.symbols.filter("parent_id = 'N3'").select(*SYM)


NEIGHBORS = "SELECT e.dst AS id, 'caller' AS side, e.kind, e.src AS other FROM edges e JOIN symbols x ON e.src = x.id WHERE e.kind <> 'contains' UNION ALL SELECT e.src, 'callee', e.kind, e.dst FROM edges e JOIN symbols x ON e.dst = x.id WHERE e.kind <> 'contains' UNION ALL SELECT parent_id, 'child', 'contains', id FROM symbols WHERE parent_id IS NOT NULL"


@query("neighbors", f"SELECT id, string_agg(CASE side WHEN 'caller' THEN kind || ' ' || other END, ',' ORDER BY kind || ' ' || other) AS callers, string_agg(CASE side WHEN 'callee' THEN kind || ' ' || other END, ',' ORDER BY kind || ' ' || other) AS callees, string_agg(CASE side WHEN 'child' THEN kind || ' ' || other END, ',' ORDER BY kind || ' ' || other) AS children FROM ({NEIGHBORS}) GROUP BY id")
def _(m):
    lists = r.neighbor_lists(m.edges, m.symbols)
    joined = lambda x: F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda n: F.concat_ws(" ", n["kind"], n["other"])), ",")).alias(x)
    return lists.select("id", joined("callers"), joined("callees"), joined("children"))


@query("svc_edge_rollup", "SELECT DISTINCT a.parent_id AS src, b.parent_id AS dst FROM edges e JOIN symbols a ON e.src = a.id JOIN symbols b ON e.dst = b.id WHERE e.kind = 'imports' AND a.parent_id <> b.parent_id")
def _(m):
    return r.service_links(m.edges, m.symbols).filter("src <> dst").distinct()


@query("svc_deps", "SELECT s.id, (SELECT count(*) FROM symbols f WHERE f.parent_id = s.id) AS files, count(DISTINCT x.dst) AS imports FROM symbols s LEFT JOIN (SELECT DISTINCT a.parent_id AS src, b.parent_id AS dst FROM edges e JOIN symbols a ON e.src = a.id JOIN symbols b ON e.dst = b.id WHERE e.kind = 'imports' AND a.parent_id <> b.parent_id) x ON x.src = s.id WHERE s.kind = 'service' GROUP BY s.id")
def _(m):
    files = m.symbols.filter("kind = 'file'").select("id", "parent_id")
    rolled = m.edges.filter("kind = 'imports'").join(files.select(c("id").alias("src"), c("parent_id").alias("a")), "src").join(files.select(c("id").alias("dst"), c("parent_id").alias("b")), "dst").filter("a <> b")
    imports = rolled.groupBy(c("a").alias("id")).agg(F.count_distinct("b").alias("imports"))
    n = files.groupBy(c("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("files"))
    return m.symbols.filter("kind = 'service'").select("id").join(n, "id", "left").join(imports, "id", "left").select("id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("imports", F.lit(0)).alias("imports"))


@query("orphan_tasks", "SELECT t.id, t.assignee FROM tasks t LEFT JOIN agents a ON t.assignee = a.name, k WHERE t.state = 'running' AND (a.name IS NULL OR a.heartbeat_at < now - 60000)")
def _(m):
    return st.orphans(m.tasks, m.agents, m.now)


@query("goal_covers", "SELECT s.id FROM symbols s WHERE s.kind = 'method' AND EXISTS (SELECT 1 FROM task_symbols ts JOIN task_goals tg ON ts.task_id = tg.task_id WHERE ts.symbol_id = s.id AND tg.goal_id IN ('G1', 'G2', 'G4', 'G5'))")
def _(m):
    covered = m.task_symbols.join(m.task_goals.filter(c("goal_id").isin("G1", "G2", "G4", "G5")), "task_id").select(c("symbol_id").alias("id"))
    return m.symbols.filter("kind = 'method'").join(covered, "id", "left_semi").select("id")


@query("goal_tasks", "SELECT id FROM tasks WHERE id IN (SELECT task_id FROM task_goals WHERE goal_id = 'G1')")
def _(m):
    return m.tasks.join(m.task_goals.filter("goal_id = 'G1'").select(c("task_id").alias("id")), "id", "left_semi").select("id")


@query("task_scope", "SELECT task_id, symbol_id FROM task_symbols JOIN symbols ON symbol_id = id")
def _(m):
    return m.task_symbols.join(m.symbols.select(c("id").alias("symbol_id")), "symbol_id").select("task_id", "symbol_id")


VIEW = "d AS (SELECT task_id, list(depends_on ORDER BY depends_on) AS deps, coalesce(list(depends_on ORDER BY depends_on) FILTER (WHERE coalesce(t.state, '') <> 'done'), []) AS blocked_by FROM task_deps LEFT JOIN tasks t ON depends_on = t.id GROUP BY task_id)"


@query("task_deps_attach", "SELECT t.id, t.state, array_to_string(coalesce(d.deps, []), ',') AS deps, array_to_string(coalesce(d.blocked_by, []), ',') AS blocked_by, t.state = 'pending' AND len(coalesce(d.blocked_by, [])) = 0 AS ready FROM tasks t LEFT JOIN d ON d.task_id = t.id", VIEW)
def _(m):
    return r.task_view(m.tasks, m.task_deps).select("id", "state", F.array_join("deps", ",").alias("deps"), F.array_join("blocked_by", ",").alias("blocked_by"), "ready")


@query("ready_tasks", "SELECT t.id FROM tasks t LEFT JOIN d ON d.task_id = t.id WHERE t.state = 'pending' AND len(coalesce(d.blocked_by, [])) = 0", VIEW)
def _(m):
    return r.task_view(m.tasks, m.task_deps).filter("ready").select("id")


@query("blocked_by", "SELECT task_id AS id, depends_on AS other, 'blocked_by' AS relation FROM task_deps WHERE task_id = 'T7' UNION ALL SELECT depends_on, task_id, 'blocks' FROM task_deps WHERE depends_on = 'T7'")
def _(m):
    d = m.task_deps
    return d.filter("task_id = 'T7'").select(c("task_id").alias("id"), c("depends_on").alias("other"), F.lit("blocked_by").alias("relation")).unionAll(d.filter("depends_on = 'T7'").select("depends_on", "task_id", F.lit("blocks")))


@query("table_accessors", "SELECT t.id, string_agg(e.kind || ' ' || e.src, ',' ORDER BY e.kind || ' ' || e.src) AS accessors, string_agg(CASE WHEN e.kind = 'queries' THEN e.src END, ',' ORDER BY e.src) AS querying FROM symbols t JOIN edges e ON e.dst = t.id JOIN symbols s ON e.src = s.id WHERE t.kind = 'table' AND e.kind <> 'contains' GROUP BY t.id")
def _(m):
    tables = m.symbols.filter("kind = 'table'").select("id")
    return r.neighbours(m.edges, m.symbols, incoming=True).join(tables, "id", "left_semi").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "kind", "other"))), ",").alias("accessors"), F.array_join(F.sort_array(F.collect_list(F.when(c("kind") == "queries", c("other")))), ",").alias("querying"))


@query("tests_of", "SELECT e.dst AS id, e.src AS test FROM edges e JOIN symbols s ON e.src = s.id WHERE e.kind = 'tests'")
def _(m):
    return r.neighbours(m.edges, m.symbols, incoming=True).filter("kind = 'tests'").select("id", c("other").alias("test"))


@query("tests_reaching", "SELECT id, string_agg(src, ',' ORDER BY src) AS tests FROM (SELECT e.dst AS id, e.src FROM edges e JOIN symbols s ON e.src = s.id WHERE e.kind <> 'contains' AND (e.kind = 'tests' OR s.role = 'test') GROUP BY e.dst, e.src QUALIFY row_number() OVER (PARTITION BY e.dst ORDER BY e.src) <= 15) GROUP BY id")
def _(m):
    first = r.tests_reaching(m.edges, m.symbols)
    return first.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("test")), ",").alias("tests"))


@query("agent_view", "SELECT a.name, a.kind, a.paused, now - a.heartbeat_at <= 60000 AS online, coalesce(n, 0) AS leases, t.task AS current_task, tg.goal_id AS current_goal FROM agents a LEFT JOIN (SELECT agent, count(*) AS n FROM leases WHERE state = 'active' GROUP BY agent) l ON l.agent = a.name LEFT JOIN (SELECT agent, task FROM leases WHERE state = 'active' AND task IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent ORDER BY acquired_at, id) = 1) t ON t.agent = a.name LEFT JOIN task_goals tg ON tg.task_id = t.task, k")
def _(m):
    return r.agent_view(m.agents, m.leases, m.task_goals, m.now).select("name", "kind", "paused", "online", "leases", "current_task", "current_goal")


RANK = "CASE state WHEN 'running' THEN 0 WHEN 'review' THEN 1 WHEN 'blocked' THEN 2 WHEN 'pending' THEN 3 END"


@query("worker_task_pick", f"SELECT assignee, id FROM (SELECT *, row_number() OVER (PARTITION BY assignee ORDER BY {RANK}, priority DESC, created_at, id) AS rn FROM tasks WHERE {RANK} IS NOT NULL AND assignee IS NOT NULL) WHERE rn = 1")
def _(m):
    rank = F.when(c("state") == "running", 0).when(c("state") == "review", 1).when(c("state") == "blocked", 2).when(c("state") == "pending", 3)
    open_ = m.tasks.withColumn("rank", rank).filter("rank is not null and assignee is not null")
    return r.latest(open_, ["assignee"], c("rank"), F.desc("priority"), c("created_at"), c("id")).select("assignee", "id")


@query("worker_session_pick", "SELECT agent, id FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY started_at DESC, id) AS rn FROM sessions WHERE ended_at IS NULL) WHERE rn = 1")
def _(m):
    return r.latest(m.sessions.filter("ended_at is null"), ["agent"], F.desc("started_at"), c("id")).select("agent", "id")


WORKER = "CASE WHEN transport = 'ide' THEN 'human' WHEN lower(kind) IN ('human', 'person', 'dev') THEN 'human' WHEN regexp_matches(lower(coalesce(tool, kind)) || ' ' || lower(kind), 'claude|cursor|copilot|gemini|opencode|codex|windsurf|aider|cody|continue|zed') THEN 'ai' WHEN regexp_matches(lower(coalesce(tool, kind)) || ' ' || lower(kind), 'ci|bot|agent|runner|worker|pipeline') THEN 'service' ELSE 'human' END"


@query("f_worker_type", f"SELECT sessions.id, {WORKER} AS type FROM sessions JOIN agents ON agent = name")
def _(m):
    kinds = m.agents.select(c("name").alias("agent"), "kind")
    return m.sessions.join(kinds, "agent").select("id", fn.worker_type(c("tool"), c("kind"), c("transport")).alias("type"))


@query("repo_for_path", "SELECT n.path, max_by(r.r_name, length(r.r_name)) AS repo FROM nations n JOIN region r ON n.path = r.r_name OR starts_with(n.path, r.r_name || '/') GROUP BY n.path")
def _(m):
    roots = m.raw("region").select(c("r_name").alias("id"), c("r_name").alias("root_path"))
    return r.repo_of_path(m.nations.select("path"), roots).select("path", c("repo_id").alias("repo"))


RULES = [("*", "core"), ("ASIA/", "east pm"), ("/EUROPE/NATION_*", "west"), ("db", "data"), ("NATION_1*", "ones pm"), ("*/NATION_2?", "twos")]


@query("owner_rule", "SELECT path, CASE WHEN regexp_full_match(path, '.*/NATION_2.') THEN 5 WHEN regexp_full_match(path, 'NATION_1.*') OR regexp_full_match(path, '(.*/)?NATION_1.*') THEN 4 WHEN path = 'db' OR starts_with(path, 'db/') THEN 3 WHEN starts_with(path, 'EUROPE/NATION_') THEN 2 WHEN starts_with(path, 'ASIA/') THEN 1 ELSE 0 END AS rule_no FROM (SELECT DISTINCT path FROM symbols)")
def _(m):
    return r.owner_rule(m.symbols.select("path").distinct(), RULES).select("path", "rule_no")


# Aggregates


@query("cnt_symbols", "SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def _(m):
    return m.symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("cnt_edges", "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def _(m):
    return m.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("cnt_waiting", "SELECT count(*) AS n FROM lease_queue WHERE state = 'waiting'")
def _(m):
    return m.lease_queue.filter("state = 'waiting'").agg(F.count(F.lit(1)).alias("n"))


@query("knowledge", "SELECT count(*) FILTER (WHERE kind = 'service') AS services, count(*) FILTER (WHERE role = 'api') AS endpoints, count(*) FILTER (WHERE kind = 'table') AS tables, count(*) FILTER (WHERE role = 'test') AS tests, md5(string_agg(CASE WHEN role = 'api' THEN json_extract_string(meta, '$.method') || ' ' || json_extract_string(meta, '$.path') END, ',' ORDER BY path, start_byte, id)) AS routes FROM symbols")
def _(m):
    routes = F.transform(F.array_sort(F.collect_list(F.when(c("role") == "api", F.struct("path", "start_byte", "id", fn.route(c("role"), c("meta")).alias("route"))))), lambda x: x["route"])
    return m.symbols.agg(F.count_if(c("kind") == "service").alias("services"), F.count_if(c("role") == "api").alias("endpoints"), F.count_if(c("kind") == "table").alias("tables"), F.count_if(c("role") == "test").alias("tests"), F.md5(F.array_join(routes, ",")).alias("routes"))


@query("throughput_counts", "SELECT count(*) FILTER (WHERE kind = 'task.completed') AS tasks_completed, count(*) FILTER (WHERE kind = 'task.started') AS tasks_started, count(*) FILTER (WHERE kind = 'task.reassigned') AS tasks_reassigned, count(*) FILTER (WHERE kind = 'lease.acquired') AS leases_acquired, count(*) FILTER (WHERE kind = 'lease.denied') AS leases_denied, count(*) FILTER (WHERE kind = 'lease.expired') AS leases_expired, count(*) FILTER (WHERE kind = 'lease.transferred') AS handovers, count(DISTINCT agent) AS agents_active FROM log, k WHERE ts >= now - 604800000")
def _(m):
    return r.throughput(m.events, m.now, 7 * DAY)


@query("throughput_agents", "SELECT count(DISTINCT agent) AS agents FROM log, k WHERE ts >= now - 7200000")
def _(m):
    return m.events.filter(c("ts") >= m.now - 2 * HOUR).agg(F.count_distinct("agent").alias("agents"))


@query("throughput_mean", "SELECT round(avg(updated_at - claimed_at) / 1000.0, 6) AS mean_secs FROM tasks WHERE state = 'done' AND claimed_at IS NOT NULL AND updated_at >= (SELECT max(updated_at) - 7776000000 FROM tasks)")
def _(m):
    latest = m.tasks.agg(F.max("updated_at").alias("latest"))
    recent = m.tasks.crossJoin(F.broadcast(latest)).filter(c("updated_at") >= c("latest") - 90 * DAY)  # one row
    return recent.filter("state = 'done' and claimed_at is not null").agg(F.round(F.avg(c("updated_at") - c("claimed_at")) / 1000.0, 6).alias("mean_secs"))


@query("throughput_series", "SELECT b.bucket, count(l.id) AS n FROM range(24) b(bucket) CROSS JOIN k LEFT JOIN log l ON l.kind = 'task.completed' AND l.ts >= now - 604800000 AND least((l.ts - (now - 604800000)) // 25200000, 23) = b.bucket GROUP BY b.bucket")
def _(m):
    return r.throughput_series(m.events, m.now, 7 * DAY, 24, "task.completed")


@query("goal_progress", "SELECT g.id, g.title, count(t.id) AS total, count(*) FILTER (WHERE t.state = 'done') AS done, count(*) FILTER (WHERE t.state = 'running') AS running, count(*) FILTER (WHERE t.state = 'review') AS review, count(*) FILTER (WHERE t.state IN ('pending', 'blocked')) AS pending, CASE WHEN count(t.id) = 0 THEN 0.0 ELSE round(100.0 * count(*) FILTER (WHERE t.state = 'done') / count(t.id), 6) END AS percent, coalesce(string_agg(DISTINCT t.assignee, ',' ORDER BY t.assignee), '') AS agents FROM goals g LEFT JOIN task_goals tg ON tg.goal_id = g.id LEFT JOIN tasks t ON t.id = tg.task_id GROUP BY g.id, g.title")
def _(m):
    return r.goal_progress(m.goals, m.tasks, m.task_goals).withColumn("agents", F.array_join("agents", ","))


@query("owners_by_owner", "SELECT * FROM (VALUES ('core', '*'), ('east', 'ASIA/'), ('pm', 'ASIA/ NATION_1*'), ('west', '/EUROPE/NATION_*'), ('data', 'db'), ('ones', 'NATION_1*'), ('twos', '*/NATION_2?')) t(owner, patterns)")
def _(m):
    return r.owners_by_owner(m.spark, RULES).withColumn("patterns", F.array_join("patterns", " "))


@query("arch_counts", "SELECT s.path AS node, count(*) FILTER (WHERE x.kind = 'file') AS files, count(*) FILTER (WHERE x.kind NOT IN ('file', 'service')) AS symbols, count(*) FILTER (WHERE x.role = 'api') AS endpoints, count(*) FILTER (WHERE x.role = 'test') AS tests FROM symbols s JOIN symbols x ON x.path = s.path OR starts_with(x.path, s.path || '/') WHERE s.kind = 'service' GROUP BY s.path")
def _(m):
    # A path counts for each directory above it: expand once, then one aggregate.
    x = m.symbols.withColumn("node", F.explode(F.filter(F.array(fn.top_dir(c("path")), c("path")), lambda p: p != ""))).filter((c("node") == c("path")) | c("path").contains("/"))
    services = m.symbols.filter("kind = 'service'").select(c("path").alias("node"))
    counts = [F.count_if(c("kind") == "file").alias("files"), F.count_if(~c("kind").isin("file", "service")).alias("symbols"), F.count_if(c("role") == "api").alias("endpoints"), F.count_if(c("role") == "test").alias("tests")]
    return x.join(services, "node", "left_semi").groupBy("node").agg(*counts)


@query("arch_edge_weight", "SELECT split_part(a.path, '/', 1) AS src, split_part(b.path, '/', 1) AS dst, e.kind, count(*) AS weight FROM edges e JOIN symbols a ON e.src = a.id JOIN symbols b ON e.dst = b.id WHERE e.kind <> 'contains' AND split_part(a.path, '/', 1) <> split_part(b.path, '/', 1) GROUP BY ALL")
def _(m):
    top = lambda name: m.symbols.select(c("id").alias(name), F.substring_index("path", "/", 1).alias(f"{name}_top"))
    e = m.edges.filter("kind <> 'contains'").join(top("src"), "src").join(top("dst"), "dst").filter("src_top <> dst_top")
    return e.groupBy(c("src_top").alias("src"), c("dst_top").alias("dst"), "kind").agg(F.count(F.lit(1)).alias("weight"))


# Windows and rankings


@query("lease_queue", "SELECT id, symbol_id, row_number() OVER (PARTITION BY symbol_id ORDER BY priority DESC, seq) AS place FROM lease_queue WHERE state = 'waiting'")
def _(m):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol_id").orderBy(F.desc("priority"), "seq")
    return m.lease_queue.filter("state = 'waiting'").select("id", "symbol_id", F.row_number().over(w).cast("long").alias("place"))


HEAD = "SELECT q.symbol_id, q.id, q.agent, q.priority, q.seq FROM lease_queue q WHERE q.state = 'waiting' AND q.agent <> 'A1' QUALIFY row_number() OVER (PARTITION BY q.symbol_id ORDER BY q.priority DESC, q.seq) = 1"


@query("waiter_ahead", f"SELECT h.symbol_id, h.id, h.agent FROM (SELECT x.*, y.polled_at FROM ({HEAD}) x JOIN lease_queue y ON y.id = x.id) h LEFT JOIN (SELECT symbol_id, max(priority) AS p, min(seq) AS s FROM (SELECT * FROM lease_queue WHERE state = 'waiting' AND agent = 'A1' QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY seq) = 1) GROUP BY symbol_id) m ON m.symbol_id = h.symbol_id, (SELECT max(polled_at) - 2592000000 AS present FROM lease_queue) WHERE h.polled_at >= present - 15000 AND (h.priority > coalesce(m.p, 2) OR (h.priority = coalesce(m.p, 2) AND h.seq < coalesce(m.s, 9223372036854775807)))")
def _(m):
    latest = m.lease_queue.agg(F.max("polled_at")).first()[0]
    return r.waiter_ahead(m.lease_queue, "A1", 2, latest - 30 * DAY)


@query("queue_next_seq", "SELECT coalesce(max(seq), 0) + 1 AS next_seq FROM lease_queue")
def _(m):
    return m.lease_queue.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


# Sets


@query("svc_distinct", "SELECT DISTINCT a.parent_id AS src, b.parent_id AS dst FROM edges e JOIN symbols a ON e.src = a.id AND a.kind = 'file' JOIN symbols b ON e.dst = b.id AND b.kind = 'file' WHERE e.kind = 'imports'")
def _(m):
    return r.service_links(m.edges, m.symbols).distinct()


@query("edge_set", "SELECT DISTINCT src, dst, kind FROM (SELECT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst, 'queries' AS kind FROM lineitem UNION ALL SELECT 'O' || o_orderkey, 'O' || prev, 'calls' FROM chain WHERE prev IS NOT NULL)")
def _(m):
    calls = m.order_chain.filter("prev is not null").select(F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("O"), "prev").alias("dst"), F.lit("calls").alias("kind"))
    lines = m.raw("lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.lit("queries").alias("kind"))
    return r.edge_set(lines.unionByName(calls))


@query("missing_symbols", "SELECT s.id FROM symbols s WHERE s.kind <> 'service' AND s.path LIKE 'A%' AND NOT EXISTS (SELECT 1 FROM symbols p WHERE p.id = s.id AND p.kind IN ('file', 'class') OR p.id = s.id AND p.start_byte % 3 <> 0)")
def _(m):
    stored = m.symbols.filter(c("path").startswith("A"))
    parsed = m.symbols.filter("kind in ('file', 'class') or start_byte % 3 <> 0")
    return df_.missing_symbols(stored, parsed).select("id")


@query("missing_files", "SELECT path FROM nations WHERE path NOT IN (SELECT path FROM nations WHERE n_nationkey % 4 <> 1)")
def _(m):
    present = m.nations.filter("n_nationkey % 4 <> 1").select(F.lit("R1").alias("repo_id"), "path")
    return df_.missing_files(m.files, present).select("path")


@query("missing_services", "SELECT id FROM symbols WHERE kind = 'service' AND path NOT IN (SELECT r_name FROM region WHERE r_regionkey < 3)")
def _(m):
    manifests = m.raw("region").filter("r_regionkey < 3").select(F.lit("R1").alias("repo_id"), c("r_name").alias("manifest"))
    return df_.missing_services(m.symbols, manifests).select("id")


@query("diff_targets", "SELECT path FROM symbols WHERE kind = 'file' UNION SELECT 'db/' || p_brand FROM part")
def _(m):
    return m.symbols.filter("kind = 'file'").select("path").union(m.raw("part").select(F.concat(F.lit("db/"), c("p_brand")).alias("path"))).distinct()


# Graph


@query("descendants", "SELECT root, id, depth FROM down WHERE depth > 0", "down AS (SELECT id AS root, id, 0 AS depth FROM symbols WHERE kind IN ('service', 'file') UNION ALL SELECT root, s.id, depth + 1 FROM down JOIN symbols s ON s.parent_id = down.id)")
def _(m):
    return g.descendants(m.symbols, m.symbols.filter("kind in ('service', 'file')").select(c("id").alias("root")))


UP = "up AS (SELECT id AS start, id, 0 AS depth FROM symbols WHERE kind IN ('method', 'class') UNION ALL SELECT start, s.parent_id, depth + 1 FROM up JOIN symbols s ON s.id = up.id WHERE s.parent_id IS NOT NULL)"


@query("ancestors", "SELECT start, id, depth FROM up", UP)
def _(m):
    return g.ancestors(m.symbols, m.symbols.filter("kind in ('method', 'class')").select(c("id").alias("start")))


@query("owning_service", "SELECT start, min(up.id) AS service FROM up JOIN symbols s ON s.id = up.id WHERE s.kind = 'service' GROUP BY start", UP)
def _(m):
    up = g.ancestors(m.symbols, m.symbols.filter("kind in ('method', 'class')").select(c("id").alias("start")))
    services = m.symbols.filter("kind = 'service'").select("id")
    return up.join(services, "id").groupBy("start").agg(F.min_by("id", "depth").alias("service"))


BFS = "bfs AS (SELECT id AS seed, id, 0 AS distance FROM symbols WHERE role = 'api' UNION SELECT seed, e.src, distance + 1 FROM bfs JOIN edges e ON e.dst = bfs.id WHERE e.kind <> 'contains' AND distance < {}), hit AS MATERIALIZED (SELECT seed, id, min(distance) AS distance FROM bfs WHERE id <> seed GROUP BY seed, id)"


@query("impact", "SELECT h.seed, h.id AS symbol_id, h.distance, s.path, s.start_byte, l.agent AS lease_agent FROM hit h JOIN symbols s ON s.id = h.id LEFT JOIN (SELECT symbol_id, max_by(agent, acquired_at) AS agent FROM leases WHERE state = 'active' GROUP BY symbol_id) l ON l.symbol_id = h.id", BFS.format(3))
def impact(m):
    hit = g.impact(m.edges, m.symbols.filter("role = 'api'").select(c("id").alias("seed")), 3)
    held = m.leases.filter("state = 'active'").groupBy("symbol_id").agg(F.max_by("agent", "acquired_at").alias("lease_agent"))
    s = m.symbols.select("id", "path", "start_byte")
    return hit.join(s, "id").withColumnRenamed("id", "symbol_id").join(held, "symbol_id", "left").select("seed", "symbol_id", "distance", "path", "start_byte", "lease_agent")


@query("impact_multi", "SELECT id, min(distance) AS distance FROM hit WHERE id NOT IN (SELECT id FROM symbols WHERE role = 'api') GROUP BY id", BFS.format(4))
def _(m):
    seeds = m.symbols.filter("role = 'api'").select(c("id").alias("seed"))
    return g.reach(m.edges, seeds.select(c("seed").alias("id")), 4)


@query("impact_topk", "SELECT h.id, h.distance FROM (SELECT id, min(distance) AS distance FROM hit WHERE id NOT IN (SELECT id FROM symbols WHERE role = 'api') GROUP BY id) h JOIN symbols s ON s.id = h.id ORDER BY h.distance, s.path, h.id LIMIT 40", BFS.format(2))
def _(m):
    hit = g.reach(m.edges, m.symbols.filter("role = 'api'").select("id"), 2)
    return hit.join(m.symbols.select("id", "path"), "id").orderBy("distance", "path", "id").limit(40).select("id", "distance")


CLOSURE = UP.replace(" WHERE kind IN ('method', 'class')", "") + ", closure AS (SELECT start AS symbol, id AS other, CASE WHEN depth = 0 THEN 'same' ELSE 'ancestor' END AS relation FROM up UNION ALL SELECT id, start, 'descendant' FROM up WHERE depth > 0)"


def closure_of(m):
    up = g.ancestors(m.symbols, m.symbols.select(c("id").alias("start")))
    same = up.select(c("start").alias("symbol"), c("id").alias("other"), F.when(c("depth") == 0, "same").otherwise("ancestor").alias("relation"))
    return same.unionAll(up.filter("depth > 0").select("id", "start", F.lit("descendant")))


@query("conflict_relation", "SELECT symbol, relation, count(*) AS n FROM closure GROUP BY symbol, relation", CLOSURE)
def _(m):
    return closure_of(m).groupBy("symbol", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("conflicts", "SELECT t.id AS task, x.symbol, x.agent, x.lease, x.holder, x.relation FROM (SELECT ts.task_id AS id, cl.symbol, t.assignee AS agent, l.id AS lease, l.agent AS holder, cl.relation FROM tasks t JOIN task_symbols ts ON ts.task_id = t.id JOIN closure cl ON cl.symbol = ts.symbol_id JOIN leases l ON l.symbol_id = cl.other, k WHERE t.assignee IS NOT NULL AND l.state = 'active' AND l.expires_at > now AND l.agent <> t.assignee) x JOIN tasks t ON t.id = x.id", CLOSURE)
def _(m):
    asking = m.tasks.filter("assignee is not null").join(m.task_symbols, c("id") == c("task_id")).select(c("id").alias("task"), c("symbol_id").alias("symbol"), c("assignee").alias("agent"))
    return r.conflicts(m.leases, m.symbols, written(asking, "asking"), m.now).select("task", "symbol", "agent", "lease", "holder", "relation")


REACH = "reach AS (SELECT task_id AS a, depends_on AS b FROM task_deps UNION SELECT reach.a, d.depends_on FROM reach JOIN task_deps d ON d.task_id = reach.b), cyc AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query("dep_cycles", "SELECT node, component FROM cyc", REACH)
def _(m):
    return g.components_of_cycles(m.task_deps.select(c("task_id").alias("a"), c("depends_on").alias("b")))


@query("would_cycle", "SELECT c.task_id, c.depends_on, c.task_id = c.depends_on OR EXISTS (SELECT 1 FROM reach WHERE reach.a = c.depends_on AND reach.b = c.task_id) AS closes FROM (SELECT 'T' || prev AS task_id, 'T' || o_orderkey AS depends_on FROM chain WHERE prev IS NOT NULL AND o_custkey % 3 = 0 UNION SELECT 'T' || first_order, 'T' || o_orderkey FROM chain WHERE o_custkey % 7 = 0 UNION SELECT 'T' || o_orderkey, 'T' || first_order FROM chain WHERE o_custkey % 7 = 1) c", REACH)
def _(m):
    t = lambda x: F.concat(F.lit("T"), x)
    chain = m.order_chain
    asked = chain.filter("prev is not null and o_custkey % 3 = 0").select(t("prev").alias("task_id"), t("o_orderkey").alias("depends_on"))
    asked = asked.unionByName(chain.filter("o_custkey % 7 = 0").select(t("first_order").alias("task_id"), t("o_orderkey").alias("depends_on")))
    asked = asked.unionByName(chain.filter("o_custkey % 7 = 1").select(t("o_orderkey").alias("task_id"), t("first_order").alias("depends_on")))
    return g.would_cycle(asked, m.task_deps)


# A level per round: a task is at level n when its longest chain of unmet dependencies is n long and all of them are open and off cycles.
WAVES = REACH + """, cand AS (SELECT id FROM tasks WHERE state IN ('pending', 'blocked') AND id NOT IN (SELECT node FROM cyc)),
need AS (SELECT DISTINCT task_id, depends_on FROM task_deps JOIN tasks t ON t.id = depends_on WHERE t.state <> 'done' AND task_id IN (SELECT id FROM cand)),
stall AS (SELECT task_id AS id FROM need WHERE depends_on NOT IN (SELECT id FROM cand) UNION SELECT n.task_id FROM need n JOIN stall ON n.depends_on = stall.id),
walk AS (SELECT id, 0 AS level FROM cand WHERE id NOT IN (SELECT id FROM stall) UNION SELECT n.task_id, level + 1 FROM walk JOIN need n ON n.depends_on = walk.id),
lev AS (SELECT id, max(level) AS level FROM walk GROUP BY id)"""


def waves_of(m):
    cyclic = g.components_of_cycles(m.task_deps.select(c("task_id").alias("a"), c("depends_on").alias("b")))
    return g.waves(m.tasks, m.task_deps, cyclic, most=None)


@query("plan_waves", "SELECT id, level FROM lev WHERE id NOT IN (SELECT id FROM stall)", WAVES)
def _(m):
    return waves_of(m)


@query("plan_parallelism", "SELECT count(*) FILTER (WHERE level = 0) AS startable, max(n) AS max_parallel, max(level) + 1 AS n_waves FROM (SELECT level, count(*) OVER (PARTITION BY level) AS n FROM lev WHERE id NOT IN (SELECT id FROM stall))", WAVES)
def _(m):
    per = waves_of(m).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum(F.when(c("level") == 0, c("n")).otherwise(0)).alias("startable"), F.max("n").alias("max_parallel"), (F.max("level") + 1).alias("n_waves"))


DEEPEST = "placed AS (SELECT id, level FROM lev WHERE id NOT IN (SELECT id FROM stall)), below AS (SELECT t.id, min(x.id) AS nxt FROM placed t JOIN task_deps d ON d.task_id = t.id JOIN placed x ON x.id = d.depends_on AND x.level = t.level - 1 GROUP BY t.id), path AS (SELECT (SELECT max(level) FROM placed) AS step, (SELECT min(id) FROM placed WHERE level = (SELECT max(level) FROM placed)) AS id UNION ALL SELECT path.step - 1, below.nxt FROM path JOIN below ON below.id = path.id)"


@query("critical_path", "SELECT step, id FROM path WHERE id IS NOT NULL", WAVES, DEEPEST)
def _(m):
    return g.critical_path(waves_of(m), m.task_deps)


@query("arch_cycles", "SELECT x.a AS node, min(x.b) AS component FROM reach2 x JOIN reach2 y ON x.a = y.b AND x.b = y.a GROUP BY x.a", "reach2 AS (SELECT src AS a, dst AS b FROM edges WHERE kind = 'imports' UNION SELECT reach2.a, e.dst FROM reach2 JOIN edges e ON e.src = reach2.b AND e.kind = 'imports')")
def _(m):
    return g.components_of_cycles(m.edges.filter("kind = 'imports'").select(c("src").alias("a"), c("dst").alias("b")))


# Activity windows


WINDOWS = "SELECT agent, path, min(ts) AS started_at, max(ts) AS updated_at, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY agent, path ORDER BY ts, event_id) AS grp FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY agent, path ORDER BY ts, event_id) <= 86400000 THEN 0 ELSE 1 END AS fresh FROM touches)) GROUP BY agent, path, grp"


@query("activity_windows", WINDOWS)
def _(m):
    w = F.session_window(F.timestamp_millis("ts"), "86400000 milliseconds")
    return m.touches.groupBy("agent", "path", w).agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n")).drop("session_window")


@query("act_live", "SELECT agent, path, max(ts) AS updated_at FROM touches, k GROUP BY agent, path, now HAVING max(ts) >= now - 86400000")
def _(m):
    return m.touches.groupBy("agent", "path").agg(F.max("ts").alias("updated_at")).filter(c("updated_at") >= m.now - DAY)


@query("lease_expire", "SELECT id FROM leases, k WHERE state = 'active' AND expires_at <= now")
def _(m):
    return m.leases.filter((c("state") == "active") & (c("expires_at") <= m.now)).select("id")


# Text


#: Words of a text without blanks around dots; a name is what is left of the part behind the last dot without quotes.
REFERRED = "words AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text || chr(10) || 'UPDATE `Shop` . [brand' || (doc_id % 40) || '] SET a = 1; select x FROM' || chr(10) || 'nowhere' || doc_id, '\\s*\\.\\s*', '.', 'g'), '\\s+'), lambda x: x <> '') AS w FROM documents), named AS (SELECT doc_id, regexp_extract(lower(w[i]), '[a-z0-9_]*$') AS word, lower(regexp_extract(list_last(string_split(regexp_extract(w[i + 1], '^[A-Za-z0-9_.\"`\\[\\]]*'), '.')), '[A-Za-z0-9_]+')) AS tbl FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words))"


@query("rx_table_refs", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path, tbl AS \"table\" FROM named WHERE word IN ('from', 'join', 'into', 'update', 'table') AND tbl IN (SELECT lower(replace(p_brand, '#', '')) FROM part)", REFERRED)
def _(m):
    more = F.concat(F.lit("\nUPDATE `Shop` . [brand"), (c("doc_id") % 40).cast("string"), F.lit("] SET a = 1; select x FROM\nnowhere"), c("doc_id").cast("string"))
    files = m.raw("documents").select(c("doc_id").cast("string").alias("path"), F.concat("text", more).alias("text"))
    known = m.raw("part").select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("table"))
    return tx.table_references(files, known)


@query("f_keywords", "SELECT id, CASE WHEN list_contains(['the', 'implement', 'add', 'support', 'for', 'and', 'with', 'build', 'create', 'make', 'new'], w) THEN '' WHEN ends_with(w, 'es') THEN w || ',' || left(w, -2) WHEN ends_with(w, 's') THEN w || ',' || left(w, -1) ELSE w END AS words FROM (SELECT key AS id, lower(regexp_extract(value, '[A-Za-z]{3,}')) AS w FROM memory)")
def _(m):
    first = F.regexp_extract("value", "[A-Za-z]{3,}", 0)
    return m.memory.select(c("key").alias("id"), F.array_join(fn.keywords(first), ",").alias("words"))


@query("kw_match", "SELECT * FROM (SELECT id, row_number() OVER (ORDER BY form, rn) AS place FROM (SELECT id, min(form) AS form, arg_min(rn, form) AS rn FROM (SELECT f.form, s.id, row_number() OVER (PARTITION BY f.form ORDER BY s.path, s.start_byte, s.id) AS rn FROM (VALUES (1, '%0000012%'), (2, '%nation%'), (3, '%boxes%'), (4, '%box%'), (5, '%brand%')) f(form, likely) JOIN symbols s ON s.name ILIKE f.likely OR s.fqn ILIKE f.likely OR s.path ILIKE f.likely) WHERE rn <= 50 GROUP BY id))")
def _(m):
    return r.keyword_matches(m.symbols, "Add the 0000012 NATION, boxes to: brand").select("id", "place")


@query("mem_near", "SELECT key FROM memory WHERE (len(list_intersect(string_split(lower(tags), ','), ['architecture', 'convention', 'decision', 'interface', 'standard'])) > 0 OR contains(lower(key || ' ' || value), 'tion a') OR contains(lower(key || ' ' || value), 'asia/nation_12')) ORDER BY updated_at DESC, key LIMIT 20")
def _(m):
    return r.memory_near(m.memory, ["Tion A", "ASIA/NATION_12", "ab"]).select("key")


@query("f_slug", "SELECT id, trim(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 32), '-') AS slug FROM goals")
def _(m):
    return m.goals.select("id", fn.slug(c("title")).alias("slug"))


@query("json_get", "SELECT id, CAST(json_extract_string(detail, '$.k') AS BIGINT) AS k, agent AS holder FROM log")
def _(m):
    nested = F.concat(F.lit('{"conflicts": [{"holder": "'), "agent", F.lit('"}]}'))
    return m.events.select("id", F.get_json_object("detail", "$.k").cast("long").alias("k"), F.get_json_object(nested, "$.conflicts[0].holder").alias("holder"))


@query("f_hash", "SELECT item_id, substr(sha256(text), 1, 16) AS hash FROM benchmark")
def _(m):
    return m.raw("benchmark").select("item_id", fn.content_hash(c("text")).alias("hash"))


@query("f_dir", "SELECT DISTINCT path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir, regexp_extract(path, '([^/]*)$', 1) AS leaf FROM symbols")
def _(m):
    return m.symbols.select("path", fn.parent_dir(c("path")).alias("dir"), fn.leaf(c("path")).alias("leaf")).distinct()


# Sources and extraction


@query("svc_of_path", "SELECT path, r_name AS dir FROM symbols JOIN region ON starts_with(path, r_name || '/') WHERE kind = 'file'")
def _(m):
    return tx.owning_service(m.symbols.filter("kind = 'file'").select("path"), m.symbols.filter("kind = 'service'").select(c("path").alias("dir"))).select("path", "dir")


@query("changed_files", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h")
def _(m):
    docs = m.raw("documents").select("doc_id", c("doc_id").cast("string").alias("path"), "text")
    old = docs.filter("doc_id % 7 <> 0").select("path", fn.content_hash(c("text")).alias("content_hash"))
    new = docs.filter("doc_id % 11 <> 0").select("path", fn.content_hash(F.when(c("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(c("text"))).alias("content_hash"))
    return df_.changed_files(old, new)


@query("deps_infer", "SELECT a.task_id, b.task_id AS depends_on, min(e.src) AS via FROM task_symbols a JOIN edges e ON e.src = a.symbol_id AND e.kind IN ('calls', 'uses', 'imports', 'queries') JOIN task_symbols b ON b.symbol_id = e.dst JOIN tasks ta ON ta.id = a.task_id AND ta.state NOT IN ('done', 'failed') JOIN tasks tb ON tb.id = b.task_id AND tb.state NOT IN ('done', 'failed') WHERE a.task_id <> b.task_id AND (CAST(substr(a.task_id, 2) AS BIGINT) % 3 = 0) GROUP BY a.task_id, b.task_id")
def _(m):
    # Scopes here hold no containers and links run along each customer's chain, so what is left out of the known ones is found again, and no cycle is closed.
    known = m.task_deps.filter("cast(substring(task_id, 2) as long) % 3 <> 0")
    chain = m.order_chain.filter("prev is not null").select(F.concat(F.lit("T"), "o_orderkey").alias("task_id"), F.concat(F.lit("T"), "prev").alias("depends_on"))
    return st.infer_dependencies(m.task_symbols, m.edges, m.tasks, known.join(chain, ["task_id", "depends_on"], "left_semi"), m.symbols).select("task_id", "depends_on", "via")


def lease_log(m) -> DataFrame:
    """Commands of all kinds on the leases, from the clicks: most take a lease, others give it back, hand it on, keep it or leave the line."""
    leases = m.leases.join(m.symbols.select(c("id").alias("symbol_id"), "parent_id", "path"), "symbol_id")
    files = m.nations.select("path", F.concat(F.lit("N"), c("n_nationkey").cast("string")).alias("root"))
    rows = leases.join(F.broadcast(files), "path").withColumn("ancestors", F.array_distinct(F.filter(F.array("parent_id", "root"), lambda x: x.isNotNull() & (x != c("symbol_id")))))
    e = F.substring("id", 2, 20).cast("long")
    op = F.element_at(F.array(*map(F.lit, ("acquire", "acquire", "acquire", "acquire", "release", "transfer", "heartbeat", "settle", "dequeue", "release_all", "sweep", "acquire"))), (e % 12 + 1).cast("int"))
    scope = F.array(F.struct(c("symbol_id").alias("symbol"), "ancestors"))
    to = F.concat(F.lit("A"), (e % 10).cast("string"))
    rows = rows.withColumns({"number": e, "op": op, "scope": scope, "to": to})
    return rows.select(c("number").alias("id"), c("acquired_at").alias("ts"), "op", F.when(c("op") != "heartbeat", c("symbol_id")).alias("symbol"), "ancestors", "agent", "priority", "ttl_secs", (c("number") % 2 == 0).alias("preempt"), (c("number") % 3 > 0).alias("queue"), "to", "scope", "root")


#: The same log, and each root's leases and line one command after the other, as lists that every command goes through.
ORDERS = """orders_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts, id) AS rn FROM (SELECT e AS id, acquired_at AS ts, ['acquire', 'acquire', 'acquire', 'acquire', 'release', 'transfer', 'heartbeat', 'settle', 'dequeue', 'release_all', 'sweep', 'acquire'][e % 12 + 1] AS op, symbol_id AS symbol,
    list_distinct(list_filter([parent_id, root], lambda y: y IS NOT NULL AND y <> symbol_id)) AS above, agent, priority, ttl_secs * 1000 AS ttl, e % 2 = 0 AS preempt, e % 3 > 0 AS queue, 'A' || (e % 10) AS heir, root
    FROM (SELECT l.*, s.parent_id, 'N' || n.n_nationkey AS root, CAST(substr(l.id, 2) AS BIGINT) AS e FROM leases l JOIN symbols s ON s.id = l.symbol_id JOIN nations n ON n.path = s.path))),
told AS (SELECT DISTINCT root, 0::BIGINT AS rn, []::STRUCT(lease VARCHAR, symbol VARCHAR, above VARCHAR[], agent VARCHAR, priority BIGINT, until BIGINT, ttl BIGINT)[] AS live, []::STRUCT(symbol VARCHAR, agent VARCHAR, priority BIGINT, polled BIGINT, seq BIGINT)[] AS line, 0::BIGINT AS seq, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS lease, NULL::VARCHAR AS holder FROM orders_
  UNION ALL SELECT root, rn,
    CASE way WHEN 'extended' THEN list_transform(live, lambda v: CASE WHEN v.lease = mine THEN {'lease': v.lease, 'symbol': v.symbol, 'above': v.above, 'agent': v.agent, 'priority': priority, 'until': ts + ttl, 'ttl': ttl} ELSE v END) WHEN 'behind' THEN spared WHEN 'taken' THEN list_append(spared, {'lease': 'L' || id, 'symbol': symbol, 'above': above, 'agent': agent, 'priority': priority, 'until': ts + ttl, 'ttl': ttl})
      WHEN 'refreshed' THEN list_transform(live, lambda v: CASE WHEN v.agent = agent_ THEN {'lease': v.lease, 'symbol': v.symbol, 'above': v.above, 'agent': v.agent, 'priority': v.priority, 'until': ts + v.ttl, 'ttl': v.ttl} ELSE v END) WHEN 'all' THEN list_filter(live, lambda v: v.agent <> agent_) WHEN 'released' THEN list_filter(live, lambda v: v.lease <> mine)
      WHEN 'transferred' THEN list_transform(live, lambda v: CASE WHEN v.lease = mine THEN {'lease': v.lease, 'symbol': v.symbol, 'above': v.above, 'agent': heir, 'priority': v.priority, 'until': ts + v.ttl, 'ttl': v.ttl} ELSE v END) ELSE live END,
    CASE WHEN way IN ('blocked', 'behind') AND queue THEN CASE WHEN stands THEN list_transform(line, lambda w: CASE WHEN w.symbol = symbol_ AND w.agent = agent_ THEN {'symbol': w.symbol, 'agent': w.agent, 'priority': priority, 'polled': ts, 'seq': w.seq} ELSE w END) ELSE list_append(line, {'symbol': symbol, 'agent': agent, 'priority': priority, 'polled': ts, 'seq': seq + 1}) END
      WHEN way IN ('taken', 'dequeued') THEN list_filter(line, lambda w: w.symbol <> symbol_ OR w.agent <> agent_) WHEN way = 'transferred' THEN list_filter(line, lambda w: w.symbol <> symbol_ OR w.agent <> heir) ELSE line END,
    seq + CASE WHEN way IN ('blocked', 'behind') AND queue AND NOT stands THEN 1 ELSE 0 END, id,
    CASE WHEN op = 'settle' THEN CASE WHEN acts THEN 'settled' ELSE 'denied' END WHEN way IN ('blocked', 'behind') THEN 'denied' WHEN way = 'taken' THEN CASE WHEN len(met) > 0 THEN 'preempted' ELSE 'acquired' END WHEN way = 'all' THEN 'released' WHEN way = 'dequeued' THEN 'cancelled' ELSE way END,
    CASE WHEN op = 'settle' THEN NULL WHEN way = 'taken' THEN 'L' || id WHEN way = 'refreshed' THEN list_min(list_transform(list_filter(live, lambda v: v.agent = agent_), lambda v: v.lease)) WHEN way IN ('extended', 'released', 'transferred') OR op IN ('release', 'transfer') THEN mine END,
    CASE WHEN op = 'settle' THEN CASE WHEN NOT acts THEN list_min(list_transform(near, lambda v: v.agent)) END WHEN way = 'blocked' THEN list_min(list_transform(met, lambda v: v.agent)) WHEN way = 'behind' THEN head.agent WHEN way = 'transferred' THEN heir END
  FROM (SELECT *, CASE WHEN acts THEN CASE WHEN mine IS NOT NULL THEN 'extended' WHEN len(met) > 0 AND NOT (preempt AND len(list_filter(met, lambda v: v.priority >= priority_)) = 0) THEN 'blocked' WHEN head IS NOT NULL AND head.polled >= ts - 15000 AND (head.p < own.p OR (head.p = own.p AND head.q < own.q)) THEN 'behind' ELSE 'taken' END
      WHEN op = 'settle' THEN 'ignored' WHEN op = 'sweep' THEN 'swept' WHEN op = 'heartbeat' THEN CASE WHEN len(list_filter(live, lambda v: v.agent = agent_)) > 0 THEN 'refreshed' ELSE 'ignored' END WHEN op = 'release_all' THEN CASE WHEN len(list_filter(live, lambda v: v.agent = agent_)) > 0 THEN 'all' ELSE 'ignored' END
      WHEN op = 'dequeue' THEN CASE WHEN stands THEN 'dequeued' ELSE 'ignored' END WHEN mine IS NULL OR (op = 'transfer' AND heir = agent) THEN 'ignored' WHEN op = 'release' THEN 'released' ELSE 'transferred' END AS way, list_filter(live, lambda v: NOT list_contains(list_transform(met, lambda y: y.lease), v.lease)) AS spared
    FROM (SELECT *, list_min(list_transform(list_filter(live, lambda v: v.symbol = symbol_ AND v.agent = agent_), lambda v: v.lease)) AS mine, list_filter(live, lambda v: v.agent <> agent_ AND (v.symbol = symbol_ OR list_contains(above_, v.symbol) OR list_contains(v.above, symbol_))) AS met,
        list_min(list_transform(list_filter(line, lambda w: w.symbol = symbol_ AND w.agent <> agent_), lambda w: {'p': -w.priority, 'q': w.seq, 'polled': w.polled, 'agent': w.agent})) AS head, coalesce(list_min(list_transform(list_filter(line, lambda w: w.symbol = symbol_ AND w.agent = agent_), lambda w: {'p': -w.priority, 'q': w.seq})), {'p': -priority, 'q': 4611686018427387904}) AS own,
        len(list_filter(line, lambda w: w.symbol = symbol_ AND w.agent = agent_)) > 0 AS stands
      FROM (SELECT * EXCLUDE (live, line), CASE WHEN acts OR op IN ('heartbeat', 'sweep') THEN list_filter(live, lambda v: v.until > ts) ELSE live END AS live, CASE WHEN acts THEN list_filter(line, lambda w: w.polled >= ts - 15000) ELSE line END AS line
        FROM (SELECT *, op = 'acquire' OR (op = 'settle' AND (len(near) = 0 OR (preempt AND len(list_filter(near, lambda v: v.priority >= priority_)) = 0))) AS acts
          FROM (SELECT x.*, x.agent AS agent_, x.symbol AS symbol_, x.above AS above_, x.priority AS priority_, t.live, t.line, t.seq, list_filter(t.live, lambda v: v.agent <> x.agent AND (v.symbol = x.symbol OR list_contains(x.above, v.symbol) OR list_contains(v.above, x.symbol))) AS near FROM told t JOIN orders_ x ON x.root = t.root AND x.rn = t.rn + 1))))))"""
OUTCOMES = "SELECT id, outcome, lease, holder FROM told WHERE rn > 0"


@query("lease_fold", OUTCOMES, ORDERS)
def _(m):
    return st.lease_fold(lease_log(m))


@query("st_lease_commands", OUTCOMES, ORDERS)
def _(m):
    """The same log as a stream of files, in five micro-batches."""
    at = f"{shared_dir(m.spark)}/loomgraph/commands-{uuid.uuid4().hex}"
    rows = lease_log(m)
    rows.repartitionByRange(5, "ts", "id").sortWithinPartitions("ts", "id").write.parquet(at)
    # One file a batch, the oldest events first: a file source takes files by their time, so they are dated by their order.
    parts = sorted({f for f in m.spark.read.parquet(at).inputFiles()})
    hadoop = m.spark._jvm.org.apache.hadoop.fs
    for i, f in enumerate(parts):
        path = hadoop.Path(f)
        path.getFileSystem(m.spark._jsc.hadoopConfiguration()).setTimes(path, 1_000_000_000_000 + 1000 * i, -1)
    return sj.run_to_table(ls.lease_stream(sj.event_stream(m.spark, at, rows.schema, files_per_batch=1)), "append", "lease-commands")


# Streams


@query("st_event_tail", "SELECT event_id, event_type FROM ev WHERE event_id > 500")
def _(m):
    stream = sj.event_stream(m.spark, f"{m.dir}/events.parque[t]", m.raw("events").schema)
    return sj.run_to_table(stream.filter("event_id > 500").select("event_id", "event_type"), "append", "tail")


@query("st_activity_window", WINDOWS)
def _(m):
    stream = sj.event_stream(m.spark, f"{m.dir}/events.parque[t]", m.raw("events").schema)
    ms = millis(stream, "ts")
    touches = stream.filter("event_type = 'click'").select("event_id", F.concat(F.lit("A"), (c("user_id") % 10).cast("string")).alias("agent"), ms.alias("ts"))
    touches = touches.join(F.broadcast(m.nations.select("n_nationkey", "path")), c("event_id") % 25 == c("n_nationkey"))
    return sj.run_to_table(sj.activity_windows(touches, DAY), "complete", "windows")


@query("st_presence", "SELECT agent, max(ms) AS heartbeat_at, max(ms) >= now - 60000 AS online FROM ev, k GROUP BY agent, now")
def _(m):
    stream = sj.event_stream(m.spark, f"{m.dir}/events.parque[t]", m.raw("events").schema)
    beats = stream.select(F.concat(F.lit("A"), (c("user_id") % 10).cast("string")).alias("agent"), millis(stream, "ts").alias("ts"))
    return sj.online(sj.run_to_table(sj.presence(beats), "complete", "presence"), m.now)


from loomgraph import queries_more as _more  # noqa: E402, F401  registers its queries


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
