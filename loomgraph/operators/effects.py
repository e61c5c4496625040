"""What one command does to other entities, for many commands at once: joins over the state's tables, no fold.

Commands of a batch are told apart by an order column; where two want the same thing the first one has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.relational import task_view
from loomgraph.operators.state import LIVE_REQUEST

#: A gap in edits up to which a window stays open.
ACTIVITY_MS = 60_000
TERMINAL = ("done", "failed")


def _rows(df: DataFrame, effect: str, **columns) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(F.lit(effect).alias("effect"), *[columns.get(x, null).cast("string").alias(x) for x in ("id", "agent", "cause")]).distinct()


def finished(ended: DataFrame, tasks: DataFrame, deps: DataFrame, leases: DataFrame, requests: DataFrame) -> DataFrame:
    """(effect, id, agent, cause) of tasks that reach a terminal state. ended: (task, state).

    Their leases are released, whoever holds them. A done task answers the requests that wait for it, a symbol that a released
    lease frees the requests for its transfer. Tasks that are ready once the ended ones are in their state, and depend on a
    done one, are unblocked.
    """
    c = F.col
    ended = ended.filter(c("state").isin(*TERMINAL)).select("task", "state").distinct()
    done = ended.filter("state = 'done'").select("task")
    released = leases.filter("state = 'active'").join(ended.select("task"), "task")
    live = requests.filter(c("state").isin(*LIVE_REQUEST)).withColumn("resolver", F.coalesce("to_agent", "from_agent"))
    by_task = live.join(done.select(c("task").alias("resource_task")), "resource_task")
    freed = live.filter("kind = 'lease-transfer'").join(released.groupBy(c("symbol_id").alias("resource_symbol")).agg(F.min("id").alias("lease")), "resource_symbol")
    # A request that both answer is the lease's: leases go first.
    by_task = by_task.join(freed.select("id"), "id", "left_anti")
    after = tasks.join(ended.withColumnsRenamed({"task": "id", "state": "new"}), "id", "left").withColumn("state", F.coalesce("new", "state")).drop("new")
    ready = task_view(after, deps).filter("ready").select("id")
    unblocked = deps.join(done.select(c("task").alias("depends_on")), "depends_on").join(ready.select(c("id").alias("task_id")), "task_id")
    out = _rows(ended, "task.ended", id=c("task"), cause=c("state")).unionByName(_rows(released, "lease.released", id=c("id"), agent=c("agent"), cause=c("task")))
    out = out.unionByName(_rows(freed, "request.fulfilled", id=c("id"), agent=c("resolver"), cause=c("lease")))
    out = out.unionByName(_rows(by_task, "request.fulfilled", id=c("id"), agent=c("resolver"), cause=c("resource_task")))
    return out.unionByName(_rows(unblocked, "task.unblocked", id=c("task_id"), cause=c("depends_on")))


def accepted(answers: DataFrame, requests: DataFrame, leases: DataFrame, queue: DataFrame) -> DataFrame:
    """(request, outcome, lease, agent, expires_at, waiter) of accepted requests. answers: (request, agent, ts), one a request.

    Only the addressee of an open request accepts, or anyone but the sender where there is none, before its deadline. A lease
    transfer moves the lease that the accepter holds on the symbol to the sender, with its whole time ahead of it, and grants the
    sender's place in line; a lease moves once, to the first request for it, and without one the request stays open.
    """
    c = F.col
    r = requests.select(c("id").alias("request"), "seq", "kind", "state", "from_agent", "to_agent", "deadline_at", "resource_symbol")
    met = answers.join(r, "request")
    due = F.coalesce(c("deadline_at") <= c("ts"), F.lit(False))
    may = (c("state") == "open") & ~due & (F.coalesce(c("to_agent") == c("agent"), F.lit(True)) & (c("agent") != c("from_agent")))
    met = met.withColumn("may", F.coalesce(may, F.lit(False)))
    held = leases.filter("state = 'active'").select("agent", c("symbol_id").alias("resource_symbol"), c("id").alias("lease"), "ttl_secs", "acquired_at")
    first = W.partitionBy("agent", "resource_symbol").orderBy("acquired_at", "lease")
    held = held.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "acquired_at")
    moves = met.filter("may and kind = 'lease-transfer'").join(held, ["agent", "resource_symbol"])
    moves = moves.withColumn("n", F.row_number().over(W.partitionBy("lease").orderBy("seq"))).filter("n = 1")
    waits = queue.filter("state = 'waiting'").groupBy(c("agent").alias("from_agent"), c("symbol_id").alias("resource_symbol")).agg(F.min("id").alias("waiter"))
    moves = moves.join(waits, ["from_agent", "resource_symbol"], "left").select("request", "lease", c("from_agent").alias("owner"), (c("ts") + c("ttl_secs") * 1000).alias("expires_at"), "waiter")
    out = met.join(moves, "request", "left")
    outcome = F.when(~c("may"), F.when((c("state") == "open") & due, "expired").otherwise("refused")).when(c("kind") != "lease-transfer", "accepted").when(c("lease").isNotNull(), "transferred").otherwise("not held")
    return out.select("request", outcome.alias("outcome"), "lease", c("owner").alias("agent"), "expires_at", "waiter")


def claimed(best: DataFrame, task_symbols: DataFrame, agent: str, now: int, ttl_secs: int = 300) -> DataFrame:
    """(task, agent, symbol_id, lease, expires_at): the task an agent claims (best: one row, id, startable as nothing holds its scope) with a lease on each symbol of its scope."""
    scope = best.select(F.col("id").alias("task")).join(task_symbols.select(F.col("task_id").alias("task"), "symbol_id"), "task", "left")
    lease = F.when(F.col("symbol_id").isNotNull(), F.concat(F.lit("L:"), "task", F.lit(":"), "symbol_id"))
    return scope.select("task", F.lit(agent).alias("agent"), "symbol_id", lease.alias("lease"), F.when(lease.isNotNull(), F.lit(now + ttl_secs * 1000)).alias("expires_at"))


def progress_reported(reports: DataFrame, leases: DataFrame) -> DataFrame:
    """(effect, id, agent, value) of progress reports (id, agent, percent, ts): the record with its percentage between 0 and 100, the agent's sign of life, and its leases renewed from its last report on.

    A report renews leases that were taken before it and haven't run out by then.
    """
    c = F.col
    text = lambda df, effect, key, value: df.select(F.lit(effect).alias("effect"), key.cast("string").alias("id"), "agent", value.cast("long").alias("value"))
    last = reports.groupBy("agent").agg(F.max("ts").alias("ts"))
    held = leases.filter("state = 'active'").select("id", "agent", "ttl_secs", "acquired_at", "expires_at").join(last, "agent").filter((c("acquired_at") <= c("ts")) & (c("expires_at") > c("ts")))
    out = text(reports, "progress", c("id"), F.least(F.greatest("percent", F.lit(0)), F.lit(100))).unionByName(text(last, "heartbeat", c("agent"), c("ts")))
    return out.unionByName(text(held, "renewed", c("id"), c("ts") + c("ttl_secs") * 1000))


def activity_recorded(stored: DataFrame, touches: DataFrame, gap_ms: int = ACTIVITY_MS) -> DataFrame:
    """(agent, repo_id, path, started_at, updated_at, opened) after touches (agent, repo_id, path, ts, event_id) on the stored windows: a touch within the gap goes on with the last window, a later one opens a new one. opened: how many were, which is what the log tells of.

    The stored window is the first touch of its key: one pass over each key's touches in order.
    """
    key = ["agent", "repo_id", "path"]
    c = F.col
    old = stored.select(*key, c("started_at").alias("started"), c("updated_at").alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    rows = old.unionByName(touches.select(*key, F.lit(None).cast("long").alias("started"), "ts", "event_id"))
    w = W.partitionBy(*key).orderBy("ts", "event_id")
    fresh = c("started").isNull() & F.coalesce(c("ts") - F.lag("ts").over(w) > gap_ms, F.lit(True))
    rows = rows.withColumn("opens", fresh).withColumn("began", F.when(c("opens"), c("ts")).otherwise(c("started")))
    return rows.groupBy(*key).agg(F.max("began").alias("started_at"), F.max("ts").alias("updated_at"), F.count_if("opens").alias("opened"))
