"""The plan: what can start, in what waves, and what is in the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import handle
from loomgraph.operators import graph as g
from loomgraph.operators import relational as r
from loomgraph.sources.tables import tidy, written

#: How many of the best free tasks a claim follows on their own, and how many links behind them, before all cycles are searched.
BEST, HOPS = 1_000, 8


def task_scope(task_symbols: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, symbol_id, handle); symbols that aren't known are left out."""
    s = symbols.select(F.col("id").alias("symbol_id"), handle(F.col("path"), F.col("kind"), F.col("name"), F.col("fqn")).alias("handle"))
    return task_symbols.join(s, "symbol_id").select("task_id", "symbol_id", "handle")


def first_leases(leases: DataFrame, now: int) -> DataFrame:
    """Of the live leases on a symbol the first, and the first of another holder: whoever asks, the first lease of others is one of them.

    All leases on a file would meet all that the file holds, which grows with the square of both.
    """
    live = leases.filter((F.col("state") == "active") & (F.col("expires_at") > now))
    per = live.groupBy("symbol_id", "agent").agg(F.min(F.struct("id", "expires_at", "priority")).alias("x"))
    rows = per.select("symbol_id", "agent", F.lit("active").alias("state"), "x.*")
    return written(r.latest(rows, ["symbol_id"], F.col("id"), most=2), "first-leases")  # walks from them read them again and again


def contention(tasks: DataFrame, task_symbols: DataFrame, symbols: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """(task_id, symbol, lease, holder, relation): the first lease in the way of each task that has one.

    In the way is what conflicts with the task's assignee; a task without one is asked for by nobody, so all leases count. First
    by the scope's handle, then by the leased symbol and the lease.
    """
    scope = task_scope(task_symbols, symbols)
    asked = tasks.select(F.col("id").alias("task_id"), F.coalesce("assignee", F.lit("")).alias("agent")).join(scope, "task_id").withColumnRenamed("symbol_id", "symbol")
    asked = written(asked, "asked")  # read by each walk and join below
    found = r.conflicts(first_leases(leases, now), symbols, asked.select("symbol", "agent").distinct(), now)
    first = F.min(F.struct("handle", "other", "lease", "symbol", "holder", "relation")).alias("x")
    return asked.join(found, ["symbol", "agent"]).groupBy("task_id").agg(first).select("task_id", "x.symbol", "x.lease", "x.holder", "x.relation")


def in_plan(tasks: DataFrame) -> DataFrame:
    """Tasks that a plan has: contention of the others isn't asked for."""
    return tasks.filter("state in ('pending', 'blocked', 'running', 'review')")


def _placed(view: DataFrame, contended: DataFrame) -> DataFrame:
    rows = view.join(contended.select(F.col("task_id").alias("id"), "holder"), "id", "left")
    return rows.select("id", "stage", "level", "priority", "created_at", "ready", "holder", (F.col("ready") & F.col("holder").isNull()).alias("startable"))


def at_work(tasks: DataFrame, deps: DataFrame, contended: DataFrame) -> DataFrame:
    """The plan's running and reviewed tasks, without a search for waves."""
    view = r.task_view(tasks, deps).filter("state in ('running', 'review')")
    return _placed(view.select("id", "priority", "created_at", "ready", F.lit(None).cast("long").alias("level"), F.col("state").alias("stage")), contended)


def plan(tasks: DataFrame, deps: DataFrame, contended: DataFrame, cyclic: DataFrame | None = None) -> DataFrame:
    """(id, stage, level, priority, created_at, ready, holder, startable): pending and blocked tasks by wave, running and reviewed ones.

    stage: wave, running or review; waves are as many as the longest chain asks for. Tasks on cycles and those behind failed or unfinished work that is no wave's are in none.
    cyclic: the nodes of cycles, where they are at hand.
    """
    deps = written(deps.select("task_id", "depends_on"), "deps")
    if cyclic is None:
        cyclic = g.components_of_cycles(deps.select(F.col("task_id").alias("a"), F.col("depends_on").alias("b")))
    view = r.task_view(tasks, deps).select("id", "priority", "created_at", "ready")
    in_wave = view.join(g.waves(tasks, deps, cyclic, most=None), "id").withColumn("stage", F.lit("wave"))
    return _placed(in_wave, contended).unionByName(at_work(tasks, deps, contended))


def wave_order(planned: DataFrame) -> DataFrame:
    """Waves in order: level, then priority, then age."""
    return planned.filter("stage = 'wave'").orderBy("level", F.desc("priority"), "created_at", "id")


def summary(planned: DataFrame, cycles: DataFrame) -> DataFrame:
    """(startable_now, max_parallel, waves, cycles, contended): one row. cycles: (node, component)."""
    w = planned.filter("stage = 'wave'")
    first = F.col("level") == 0
    widest = w.groupBy("level").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_parallel"), F.count(F.lit(1)).alias("waves"))
    now = w.agg(F.count_if(first & F.col("startable")).alias("startable_now"), F.count_if(first & F.col("holder").isNotNull()).alias("contended"))
    n = cycles.agg(F.count_distinct("component").alias("cycles"))
    return now.crossJoin(widest).crossJoin(n).select("startable_now", "max_parallel", "waves", "cycles", "contended")  # one row each


def claimable(planned: DataFrame, tasks: DataFrame, agents: DataFrame, agent: str, task_goals: DataFrame | None = None, goal: str | None = None) -> DataFrame:
    """First-wave tasks an agent may claim, best first: startable, without a required capability or with the agent's own, of a goal if one is named.

    A paused agent gets none; an unknown one counts as an unpaused one without a capability.
    """
    first = planned.filter("stage = 'wave' and level = 0 and startable").join(tasks.select("id", "required_capability"), "id")
    return _best_first(_allowed(first, agents, agent, task_goals, goal).select("id", "priority", "created_at"))


def _best_first(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("priority"), "created_at", "id")


def _allowed(tasks: DataFrame, agents: DataFrame, agent: str, task_goals: DataFrame | None, goal: str | None) -> DataFrame:
    me = agents.filter(F.col("name") == agent).agg(F.coalesce(F.max("paused"), F.lit(False)).alias("off"), F.max("capability").alias("own"))
    if goal is not None:
        tasks = tasks.join(task_goals.filter(F.col("goal_id") == goal).select(F.col("task_id").alias("id")), "id", "left_semi")
    fits = F.col("required_capability").isNull() | F.coalesce(F.col("required_capability") == F.col("own"), F.lit(False))
    return tasks.crossJoin(F.broadcast(me)).filter(~F.col("off") & fits)  # one row


@tidy
def claim(tasks: DataFrame, deps: DataFrame, task_symbols: DataFrame, symbols: DataFrame, leases: DataFrame, agents: DataFrame, agent: str, now: int, task_goals: DataFrame | None = None, goal: str | None = None) -> DataFrame:
    """(id, priority, created_at): the first of claimable() for the whole plan, or no row, without making that plan.

    A pending task whose dependencies are all done is in the first wave unless it lies on a cycle. All such tasks are held against
    the leases; cycles are only looked for behind the best that are free.
    """
    deps = written(deps.select("task_id", "depends_on"), "deps")
    done = tasks.filter("state = 'done'").select(F.col("id").alias("depends_on"))
    held_up = deps.filter("depends_on is not null").join(done, "depends_on", "left_anti").select(F.col("task_id").alias("id"))
    may = _allowed(tasks.filter("state = 'pending'"), agents, agent, task_goals, goal).select("id", "assignee", "priority", "created_at")
    ready = written(may.join(held_up, "id", "left_anti"), "ready")
    held = _held(ready, task_symbols, symbols, leases, now)
    free = written(ready.join(held, "id", "left_anti").select("id", "priority", "created_at"), "free")
    return _first_off_cycles(free, deps)


def _held(tasks: DataFrame, task_symbols: DataFrame, symbols: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """(id) of the tasks that contention() has, without saying which lease it is.

    Whoever asks, a lease of others is among the holders with the smallest and the largest name. What lies above is looked up once
    for each symbol that holds others, not for each symbol of a task.
    """
    known = written(symbols.select("id", "parent_id"), "nesting")
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    live = leases.filter((F.col("state") == "active") & (F.col("expires_at") > now)).groupBy(F.col("symbol_id").alias("id")).agg(F.min("agent").alias("low"), F.max("agent").alias("high"))
    live = written(live, "live")
    below = g.ancestors(known, live.select(F.col("id").alias("start"))).join(live.select(F.col("id").alias("start"), "low", "high"), "start")
    at = below.groupBy(F.col("id").alias("symbol_id")).agg(*ends)  # what is leased, and all that holds it
    asked = tasks.select("id", F.coalesce("assignee", F.lit("")).alias("agent")).join(task_symbols.select(F.col("task_id").alias("id"), "symbol_id"), "id")
    asked = written(asked.join(known.select(F.col("id").alias("symbol_id"), "parent_id"), "symbol_id"), "asked")
    up = g.ancestors(known, asked.filter("parent_id is not null").select(F.col("parent_id").alias("start")).distinct()).join(live, "id").groupBy(F.col("start").alias("parent_id")).agg(*ends)
    others = (F.col("low") != F.col("agent")) | (F.col("high") != F.col("agent"))
    return asked.join(at, "symbol_id").filter(others).select("id").unionAll(asked.join(up, "parent_id").filter(others).select("id"))


def _first_off_cycles(free: DataFrame, deps: DataFrame) -> DataFrame:
    """The best of free (id, priority, created_at) that doesn't reach itself: links behind the BEST first are followed until that is known of one, or, beyond HOPS, all cycles are searched."""
    links = deps.select(F.col("task_id").alias("node"), F.col("depends_on").alias("next"))
    left = written(_best_first(free).limit(BEST), "left")
    reached = left.select(F.col("id").alias("start"), F.col("id").alias("node"))
    for _ in range(HOPS):
        step = written(reached.join(links, "node").select("start", F.col("next").alias("node")).distinct(), "step")
        left = written(left.join(step.filter("start = node").select(F.col("start").alias("id")), "id", "left_anti"), "left")
        best = _best_first(left).first()
        if best is None:
            break
        if step.filter(F.col("start") == best["id"]).isEmpty():
            return left.filter(F.col("id") == best["id"])
        reached = step.join(left.select(F.col("id").alias("start")), "start", "left_semi")
    if free.isEmpty():
        return free
    cyclic = g.components_of_cycles(deps.select(F.col("task_id").alias("a"), F.col("depends_on").alias("b"))).select(F.col("node").alias("id"))
    return _best_first(free.join(cyclic, "id", "left_anti")).limit(1)
