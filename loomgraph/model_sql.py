"""The same derivation as sources/adapter.py in DuckDB SQL, written on its own, for the oracle."""

MODEL = r"""
ev AS (SELECT event_id, (epoch_us(ts) // 1000) AS ms, user_id, event_type, value, props, 'A' || (user_id % 10) AS agent FROM events),
k AS (SELECT (SELECT max(ms) FROM ev) AS now, (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers),
nations AS (SELECT n_nationkey, n_regionkey, n_name, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
ord AS (SELECT o_orderkey, o_custkey, o_orderstatus, (epoch_us(o_orderdate) // 1000) AS ms, o_orderpriority FROM orders),
chain AS (SELECT *, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS first_order FROM ord WINDOW w AS (PARTITION BY o_custkey ORDER BY ms, o_orderkey)),
symbols AS (
  SELECT 'R' || r_regionkey AS id, r_name AS path, 'service' AS kind, r_name AS name, r_name AS fqn, CAST(NULL AS VARCHAR) AS parent_id, CAST(r_regionkey AS BIGINT) AS start_byte, CAST(NULL AS VARCHAR) AS role, 'R1' AS repo_id, CAST(NULL AS VARCHAR) AS meta FROM region
  UNION ALL SELECT 'N' || n_nationkey, path, 'file', n_name, path, 'R' || n_regionkey, 0, NULL, 'R1', NULL FROM nations
  UNION ALL SELECT 'C' || c_custkey, path, 'class', c_name, c_name, 'N' || c_nationkey, c_custkey, NULL, 'R1', NULL FROM customer JOIN nations ON c_nationkey = n_nationkey
  UNION ALL SELECT 'O' || o_orderkey, path, 'method', 'O' || o_orderkey, c_name || '.O' || o_orderkey, 'C' || o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'api' WHEN '5-LOW' THEN 'test' END, 'R1', CASE WHEN o_orderpriority = '1-URGENT' THEN '{"method":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END || '","path":"/orders/' || o_orderkey || '"}' END FROM ord JOIN customer ON o_custkey = c_custkey JOIN nations ON c_nationkey = n_nationkey
  UNION ALL SELECT 'P' || p_partkey, 'db/' || p_brand, 'table', p_name, p_name, NULL, p_partkey, NULL, 'R1', NULL FROM part),
repos AS (SELECT 'R1' AS id, 'root' AS name, '.' AS root_path UNION ALL SELECT 'R' || (r_regionkey + 2), lower(r_name), r_name FROM region),
files AS (SELECT 'R1' AS repo_id, path, substr(sha256(n_name), 1, 16) AS content_hash, length(n_name) AS size FROM nations),
edges AS (
  SELECT 'O' || o_orderkey AS src, 'O' || prev AS dst, CASE WHEN o_orderpriority = '5-LOW' THEN 'tests' ELSE 'calls' END AS kind FROM chain WHERE prev IS NOT NULL
  UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey, 'queries' FROM lineitem
  UNION ALL SELECT DISTINCT 'N' || c_nationkey, 'N' || s_nationkey, 'imports' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN ((7 * c_nationkey + 3) % 25, (5 * c_nationkey + 1) % 25) AND s_nationkey <> c_nationkey
  UNION ALL SELECT parent_id, id, 'contains' FROM symbols WHERE kind IN ('class', 'method')),
tasks AS (SELECT *, CASE WHEN state <> 'pending' THEN a END AS assignee, CASE WHEN state <> 'pending' THEN created_at END AS claimed_at FROM (
  SELECT 'T' || o_orderkey AS id, 'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE ['running', 'review', 'blocked', 'failed'][o_orderkey % 4 + 1] END AS state,
  6 - CAST(o_orderpriority[1] AS BIGINT) AS priority, 'A' || (o_custkey % 10) AS a, ms AS created_at, ms + (o_orderkey % 1000) * 1000 AS updated_at, CASE WHEN o_orderpriority = '5-LOW' THEN 'testing' END AS required_capability FROM ord)),
task_deps AS (SELECT 'T' || o_orderkey AS task_id, 'T' || prev AS depends_on FROM chain WHERE prev IS NOT NULL
  UNION ALL SELECT 'T' || first_order, 'T' || o_orderkey FROM chain WHERE nxt IS NULL AND o_custkey % 50 = 0 AND first_order <> o_orderkey),
task_symbols AS (SELECT 'T' || o_orderkey AS task_id, 'O' || o_orderkey AS symbol_id FROM ord),
goals AS (SELECT 'G' || c_custkey AS id, c_name AS title, ['open', 'done', 'abandoned'][c_custkey % 3 + 1] AS state, c_custkey % 5 AS priority, c_custkey AS created_at FROM customer),
task_goals AS (SELECT 'T' || o_orderkey AS task_id, 'G' || o_custkey AS goal_id FROM ord),
agents AS (SELECT agent AS name, ['human', 'ai', 'service', 'person', 'bot'][min(user_id) % 5 + 1] AS kind, min(ms) AS joined_at, max(ms) AS heartbeat_at, min(user_id) % 5 = 3 AS paused, CASE WHEN min(user_id) % 5 = 1 THEN 'testing' END AS capability FROM ev GROUP BY agent),
log AS (SELECT event_id AS id, ms AS ts, CASE event_type WHEN 'purchase' THEN 'task.completed' WHEN 'signup' THEN 'task.started' WHEN 'error' THEN 'lease.denied' WHEN 'click' THEN 'lease.acquired' WHEN 'view' THEN 'lease.released' END AS kind, agent, 'O' || (event_id % n_orders) AS symbol_handle, 'T' || (event_id % n_orders) AS task, props AS detail FROM ev, k),
leases AS (SELECT *, CASE WHEN expires_at > (SELECT now FROM k) - 86400000 THEN 'active' ELSE 'expired' END AS state FROM (SELECT 'L' || event_id AS id, CASE WHEN event_id % 101 = 0 THEN 'N' || (event_id % 25) WHEN event_id % 7 = 0 THEN 'C' || (event_id % n_customers) ELSE 'O' || (event_id % n_orders) END AS symbol_id, agent, event_id % 5 AS priority, CAST(3600 * (1 + floor(value)) AS BIGINT) AS ttl_secs, ms AS acquired_at, ms + CAST(3600 * (1 + floor(value)) AS BIGINT) * 1000 AS expires_at, CASE WHEN event_id % 3 = 0 THEN 'T' || (event_id % n_orders) END AS task FROM ev, k WHERE event_type = 'click')),
lease_queue AS (SELECT 'Q' || event_id AS id, event_id AS seq, 'C' || (event_id % (n_customers // 10 + 1)) AS symbol_id, agent, event_id % 5 AS priority, ms AS requested_at, ms + (user_id % 5) * 5000 AS polled_at, CASE WHEN event_id % 4 = 0 THEN 'granted' ELSE 'waiting' END AS state FROM ev, k WHERE event_type = 'signup'),
requests AS (SELECT 'RQ' || event_id AS id, event_id AS seq, ['lease-transfer', 'interface', 'dependency', 'review', 'api-change', 'question'][event_id % 6 + 1] AS kind, agent AS from_agent, CASE WHEN event_id % 4 <> 0 THEN 'A' || ((user_id + 3) % 10) END AS to_agent, event_id % 5 AS priority, ['open', 'accepted', 'declined', 'fulfilled', 'cancelled', 'expired'][event_id % 7 % 6 + 1] AS state, ms AS created_at, CASE WHEN event_id % 3 <> 0 THEN ms + 86400000 * (1 + event_id % 20) END AS deadline_at, 'O' || (event_id % (n_orders + 50)) AS resource_symbol, props AS body, 'Request ' || event_id AS subject, CASE WHEN event_id % 6 = 2 THEN 'T' || (event_id % n_orders) END AS resource_task FROM ev, k WHERE event_type = 'error'),
progress AS (SELECT event_id AS id, agent, 'T' || (event_id % n_orders) AS task, 'O' || (event_id % (n_orders + 50)) AS symbol_id, event_id % 101 AS percent, ms AS ts FROM ev, k WHERE event_type = 'view'),
sessions AS (SELECT 'S' || event_id AS id, agent, ['editor', 'copilot', 'jenkins', 'shell'][user_id % 4 + 1] AS tool, ['mcp', 'hook', 'ide', 'cli'][event_id % 4 + 1] AS transport, ms AS started_at, ms + event_id % 7 * 20000 AS heartbeat_at, CASE WHEN event_id % 2 <> 0 THEN ms + 60000 END AS ended_at FROM ev WHERE event_type = 'view' AND event_id % 5 = 0),
touches AS (SELECT event_id, agent, 'R1' AS repo_id, path, ms AS ts FROM ev JOIN nations ON event_id % 25 = n_nationkey WHERE event_type = 'click'),
activity AS (SELECT agent, repo_id, path, min(ts) AS started_at, max(ts) AS updated_at FROM (SELECT *, sum(fresh) OVER (PARTITION BY agent, path ORDER BY ts, event_id) AS grp FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY agent, path ORDER BY ts, event_id) <= 86400000 THEN 0 ELSE 1 END AS fresh FROM touches)) GROUP BY agent, repo_id, path, grp QUALIFY row_number() OVER (PARTITION BY agent, repo_id, path ORDER BY grp DESC) = 1),
memory AS (SELECT CAST(doc_id AS VARCHAR) AS key, text AS value, source AS author, concat_ws(',', lang, source) AS tags, doc_id AS updated_at FROM documents),
messages AS (SELECT conv_id * 1000 + turn AS id, 'A' || (conv_id % 10) AS to_agent, role AS from_agent, text AS body, CASE WHEN turn % 2 = 0 THEN turn END AS read_at FROM conversations)
"""


def oracle(select: str, *more: str) -> str:
    """A statement over the model's tables; `more`: further common table expressions."""
    return f"WITH RECURSIVE {', '.join([MODEL.strip(), *more])}\n{select}"
