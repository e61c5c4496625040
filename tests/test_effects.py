"""What commands do to other entities."""

import pytest
from loomgraph import api
from loomgraph.operators import effects


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


REQUEST = "id string, seq long, kind string, from_agent string, to_agent string, state string, deadline_at long, resource_symbol string, resource_task string"
LEASE = "id string, symbol_id string, agent string, state string, task string, ttl_secs long, acquired_at long, expires_at long"


def test_a_finished_task_frees_answers_and_unblocks(spark):
    tasks = spark.createDataFrame([(t, s, None, 0, 0, 0) for t, s in (("T1", "running"), ("T2", "pending"), ("T3", "pending"), ("T4", "running"), ("T5", "pending"))], "id string, state string, assignee string, priority long, created_at long, updated_at long")
    deps = spark.createDataFrame([("T2", "T1"), ("T3", "T1"), ("T3", "T4"), ("T5", "T4")], "task_id string, depends_on string")
    leases = spark.createDataFrame([("L1", "s1", "a", "active", "T1", 10, 0, 10), ("L2", "s2", "b", "active", "T1", 10, 0, 10), ("L3", "s3", "a", "active", None, 10, 0, 10), ("L4", "s4", "c", "released", "T1", 10, 0, 10), ("L5", "s5", "c", "active", "T4", 10, 0, 10)], LEASE)
    requests = spark.createDataFrame([("r1", 1, "lease-transfer", "x", "a", "open", None, "s1", None), ("r2", 2, "question", "x", None, "accepted", None, "s1", "T1"), ("r3", 3, "lease-transfer", "x", "a", "open", None, "s3", None), ("r4", 4, "dependency", "x", "a", "declined", None, None, "T1"), ("r5", 5, "dependency", "y", "b", "open", None, None, "T4"), ("r6", 6, "lease-transfer", "y", "b", "open", None, "s2", "T1")], REQUEST)
    ended = spark.createDataFrame([("T1", "done"), ("T4", "failed"), ("T2", "running")], "task string, state string")
    assert rows(effects.finished(ended, tasks, deps, leases, requests)) == [
        ("lease.released", "L1", "a", "T1"), ("lease.released", "L2", "b", "T1"), ("lease.released", "L5", "c", "T4"), ("request.fulfilled", "r1", "a", "L1"), ("request.fulfilled", "r2", "x", "T1"), ("request.fulfilled", "r6", "b", "L2"),
        ("task.ended", "T1", None, "done"), ("task.ended", "T4", None, "failed"), ("task.unblocked", "T2", None, "T1"),
    ]


def test_an_accepted_transfer_moves_the_lease_once(spark):
    leases = spark.createDataFrame([("L1", "s1", "a", "active", None, 10, 0, 5000), ("L2", "s2", "b", "active", None, 20, 0, 5000)], LEASE)
    requests = spark.createDataFrame([("r1", 1, "lease-transfer", "x", "a", "open", None, "s1", None), ("r2", 2, "lease-transfer", "y", "a", "open", None, "s1", None), ("r3", 3, "question", "x", None, "open", None, None, None), ("r4", 4, "question", "x", None, "open", None, None, None), ("r5", 5, "question", "x", "b", "open", 900, None, None), ("r6", 6, "lease-transfer", "x", "b", "accepted", None, "s2", None), ("r7", 7, "lease-transfer", "x", "b", "open", None, "s9", None)], REQUEST)
    queue = spark.createDataFrame([("Q1", "s1", "x", "waiting"), ("Q2", "s1", "y", "waiting"), ("Q0", "s1", "x", "granted")], "id string, symbol_id string, agent string, state string")
    answers = spark.createDataFrame([("r1", "a", 1000), ("r2", "a", 1001), ("r3", "b", 1000), ("r4", "x", 1000), ("r5", "b", 1000), ("r6", "b", 1000), ("r7", "b", 1000)], "request string, agent string, ts long")
    assert rows(effects.accepted(answers, requests, leases, queue)) == [
        ("r1", "transferred", "L1", "x", 11_000, "Q1"), ("r2", "not held", None, None, None, None), ("r3", "accepted", None, None, None, None), ("r4", "refused", None, None, None, None),
        ("r5", "expired", None, None, None, None), ("r6", "refused", None, None, None, None), ("r7", "not held", None, None, None, None),
    ]


def test_a_claim_leases_the_whole_scope(spark):
    scope = spark.createDataFrame([("T1", "s1"), ("T1", "s2"), ("T2", "s3")], "task_id string, symbol_id string")
    best = spark.createDataFrame([("T1",)], "id string")
    assert rows(effects.claimed(best, scope, "a", 1000, 2)) == [("T1", "a", "s1", "L:T1:s1", 3000), ("T1", "a", "s2", "L:T1:s2", 3000)]
    assert rows(effects.claimed(spark.createDataFrame([("T9",)], "id string"), scope, "a", 1000)) == [("T9", "a", None, None, None)]
    assert rows(effects.claimed(best.limit(0), scope, "a", 1000)) == []


def test_progress_renews_what_is_still_held(spark):
    leases = spark.createDataFrame([("L1", "s1", "a", "active", None, 10, 0, 5000), ("L2", "s2", "a", "active", None, 10, 0, 900), ("L3", "s3", "a", "active", None, 10, 2000, 9000), ("L4", "s4", "b", "active", None, 10, 0, 9000)], LEASE)
    reports = spark.createDataFrame([(1, "a", 120, 500), (2, "a", -3, 1000)], "id long, agent string, percent long, ts long")
    assert rows(effects.progress_reported(reports, leases)) == [("heartbeat", "a", "a", 1000), ("progress", "1", "a", 100), ("progress", "2", "a", 0), ("renewed", "L1", "a", 11_000)]


def test_activity_goes_on_or_opens_a_window(spark):
    stored = spark.createDataFrame([("a", "R", "p", 100, 200), ("a", "R", "q", 100, 200)], "agent string, repo_id string, path string, started_at long, updated_at long")
    touches = spark.createDataFrame([("a", "R", "p", 60_200, 1), ("a", "R", "p", 60_201, 2), ("b", "R", "p", 7, 3), ("a", "R", "q", 60_201, 4), ("a", "R", "q", 200_000, 5)], "agent string, repo_id string, path string, ts long, event_id long")
    assert rows(effects.activity_recorded(stored, touches)) == [("a", "R", "p", 100, 60_201, 0), ("a", "R", "q", 200_000, 200_000, 2), ("b", "R", "p", 7, 7, 1)]


def test_commands_that_write(spark, tmp_path):
    tasks = spark.createDataFrame([("T1", "running", "a", 0, 0, 0), ("T2", "pending", None, 0, 0, 0)], "id string, state string, assignee string, priority long, created_at long, updated_at long")
    deps = spark.createDataFrame([("T2", "T1")], "task_id string, depends_on string")
    leases = spark.createDataFrame([("L1", "s1", "a", "active", "T1", 10, 0, 9000), ("L2", "s2", "a", "active", None, 10, 0, 9000)], LEASE)
    requests = spark.createDataFrame([("r1", 1, "dependency", "x", "a", "open", None, None, "T1"), ("r2", 2, "lease-transfer", "x", "a", "open", None, "s2", None)], REQUEST)
    queue = spark.createDataFrame([("Q1", "s2", "x", "waiting")], "id string, symbol_id string, agent string, state string")
    agents = spark.createDataFrame([("a", 0)], "name string, heartbeat_at long")
    progress = spark.createDataFrame([(1, "a", 5, 0)], "id long, agent string, percent long, ts long")
    store = api.Store.create(spark, str(tmp_path / "store"), {"tasks": tasks, "task_deps": deps, "leases": leases, "requests": requests, "lease_queue": queue, "agents": agents, "progress": progress})
    with pytest.raises(api.Refused):
        store.finish("T1", "done", "b", 1000)
    store.report("a", 150, 2000)
    assert rows(store.table("progress")) == [(1, "a", 5, 0), (2, "a", 100, 2000)] and rows(store.table("agents")) == [("a", 2000)]
    assert rows(store.table("leases").select("id", "expires_at")) == [("L1", 12_000), ("L2", 12_000)]
    assert [r.outcome for r in store.accept("r2", "a", 3000).collect()] == ["transferred"]
    assert rows(store.table("leases").select("id", "agent", "expires_at")) == [("L1", "a", 12_000), ("L2", "x", 13_000)] and rows(store.table("lease_queue").select("state")) == [("granted",)]
    assert ("task.unblocked", "T2", None, "T1") in rows(store.finish("T1", "done", "a", 4000))
    assert rows(store.table("tasks").select("id", "state")) == [("T1", "done"), ("T2", "pending")] and rows(store.table("leases").select("id", "state")) == [("L1", "released"), ("L2", "active")]
    assert rows(store.table("requests").select("id", "state")) == [("r1", "fulfilled"), ("r2", "fulfilled")]
    log = rows(store.log().select("id", "ts", "kind"))
    assert [x[0] for x in log] == [1, 2, 3, 4, 5] and sorted(k for _, _, k in log) == ["lease.released", "lease.transferred", "request.fulfilled", "task.completed", "task.unblocked"]
