"""State as folds over ordered command logs, and other rules of state.

Commands on symbols of one containment root can conflict, others can't: the root is the key of leases, and each key's commands
are replayed in order (ts, id) by one Python function. Tasks, requests and sessions are keyed by themselves (sessions by agent).
The result is the same however keys are spread.
"""

from __future__ import annotations

from collections import defaultdict, namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgraph.operators.graph import components_of_cycles, descendants
from loomgraph.sources.tables import ship, spread, written

#: How long a waiter, a session and an agent count as there without a sign of life.
WAITER_MS, SESSION_MS, AGENT_MS = 15_000, 60_000, 60_000
LIVE_REQUEST = ("open", "accepted")
COLUMNS = "id long, outcome string, lease string, holder string"


class Leases:
    """Active leases and waiting lines of one containment root.

    What is kept lies in maps by symbol, agent and holding symbol, so a command costs what is near its symbol. Nothing is walked to
    expire: a lease is gone if a command that sweeps came after it at or past its end, a waiter if an acquire did 15 s after its
    last sign; both are seen when they are looked at. maps: dicts, or what keeps a stream's state.
    """

    MAPS = ("at", "within", "held", "line")

    def __init__(self, maps: dict | None = None, clock: dict | None = None):
        maps = maps or {name: {} for name in self.MAPS}
        #: Leases of a symbol; symbols with leases inside one; symbols an agent has leases on; waiters of a symbol.
        self.at, self.within, self.held, self.line = (maps[name] for name in self.MAPS)
        #: Number of commands, the last sweep and the last acquire (number, time), the last place in line.
        self.clock = clock if clock is not None else {"n": 0, "sweep": [0, 0], "acquire": [0, 0], "seq": 0}

    def _gone(self, since: int, until: int, last: list[int]) -> bool:
        return last[0] > since and until <= last[1]

    def on_symbol(self, symbol: str) -> list[dict]:
        """Live leases of a symbol; expired ones are dropped here."""
        found = self.at.get(symbol)
        if not found:
            return []
        live = [v for v in found if not self._gone(v["since"], v["until"], self.clock["sweep"])]
        if len(live) < len(found):
            self._keep(symbol, found, live)
        return live

    def _keep(self, symbol: str, before: list[dict], now: list[dict]) -> None:
        if now:
            self.at[symbol] = now
        else:
            self.at.pop(symbol, None)
        for a in {a for v in (*before, *now) for a in v["ancestors"]}:
            self._member(self.within, a, symbol, any(a in v["ancestors"] for v in now))
        for agent in {v["agent"] for v in before} | {v["agent"] for v in now}:
            self._member(self.held, agent, symbol, any(v["agent"] == agent for v in now))

    @staticmethod
    def _member(of: dict, key: str, symbol: str, inside: bool) -> None:
        there = of.get(key) or []
        if inside != (symbol in there):
            there = [*there, symbol] if inside else [x for x in there if x != symbol]
            if there:
                of[key] = there
            else:
                of.pop(key, None)

    def change(self, symbol: str, now: list[dict]) -> None:
        self._keep(symbol, self.on_symbol(symbol), now)

    def sweep(self, ts: int) -> None:
        self.clock["sweep"] = [self.clock["n"], ts]

    def on(self, symbol: str, agent: str) -> dict | None:
        return min((v for v in self.on_symbol(symbol) if v["agent"] == agent), key=lambda v: v["lease"], default=None)

    def of_agent(self, agent: str) -> list[tuple[str, dict]]:
        return [(symbol, v) for symbol in list(self.held.get(agent) or []) for v in self.on_symbol(symbol) if v["agent"] == agent]

    def against(self, symbol: str, ancestors, agent: str) -> list[tuple[str, dict]]:
        """Others' leases on a symbol, what holds it and what it holds."""
        near = {symbol, *ancestors, *(self.within.get(symbol) or [])}
        return sorted(((x, v) for x in near for v in self.on_symbol(x) if v["agent"] != agent), key=lambda p: p[1]["lease"])

    def waiting(self, symbol: str) -> list[dict]:
        found = self.line.get(symbol) or []
        return [w for w in found if not self._gone(w["since"], w["polled"] + WAITER_MS + 1, self.clock["acquire"])]

    def _stand(self, symbol: str, waiters: list[dict]) -> None:
        if waiters:
            self.line[symbol] = waiters
        else:
            self.line.pop(symbol, None)

    def wait(self, symbol: str, agent: str, priority: int, ts: int) -> None:
        """A new place in line, or a sign of life for the one there is."""
        waiters = self.waiting(symbol)
        mine = next((w for w in waiters if w["agent"] == agent), None)
        if mine is None:
            self.clock["seq"] += 1
            mine = {"agent": agent, "seq": self.clock["seq"]}
            waiters.append(mine)
        mine.update(polled=ts, priority=priority, since=self.clock["n"])
        self._stand(symbol, waiters)

    def ahead(self, symbol: str, agent: str, priority: int, ts: int) -> dict | None:
        here = self.waiting(symbol)
        head = min((w for w in here if w["agent"] != agent), key=lambda w: (-w["priority"], w["seq"]), default=None)
        if head is None or head["polled"] < ts - WAITER_MS:
            return None
        mine = next(((w["priority"], w["seq"]) for w in here if w["agent"] == agent), (priority, 1 << 62))
        return head if head["priority"] > mine[0] or (head["priority"] == mine[0] and head["seq"] < mine[1]) else None

    def leave(self, symbol: str, agent: str) -> bool:
        waiters = self.waiting(symbol)
        rest = [w for w in waiters if w["agent"] != agent]
        self._stand(symbol, rest)
        return len(rest) < len(waiters)

    def _blocks(self, x, against: list) -> bool:
        return bool(against) and not (getattr(x, "preempt", True) and all(v["priority"] < x.priority for _, v in against))

    def acquire(self, x, symbol: str, ancestors) -> tuple[str, str | None, str | None]:
        """Sweep, extend an own lease, then conflicts, then the line."""
        self.clock["n"] += 1  # a settling takes several, each with a sweep of its own
        self.sweep(x.ts)
        self.clock["acquire"] = [self.clock["n"], x.ts]
        until = x.ts + x.ttl_secs * 1000
        mine = self.on(symbol, x.agent)
        if mine:
            mine.update(until=until, ttl=x.ttl_secs, priority=x.priority, since=self.clock["n"])
            self.change(symbol, [mine if v["lease"] == mine["lease"] else v for v in self.on_symbol(symbol)])
            return "extended", mine["lease"], None
        against = self.against(symbol, ancestors, x.agent)
        if self._blocks(x, against):
            if getattr(x, "queue", False):
                self.wait(symbol, x.agent, x.priority, x.ts)
            return "denied", None, min(v["agent"] for _, v in against)
        for at, v in against:
            self.change(at, [o for o in self.on_symbol(at) if o["lease"] != v["lease"]])
        first = self.ahead(symbol, x.agent, x.priority, x.ts)
        if first:
            if getattr(x, "queue", False):
                self.wait(symbol, x.agent, x.priority, x.ts)
            return "denied", None, first["agent"]
        lease = f"L{x.id}" if symbol == x.symbol else f"L{x.id}:{symbol}"
        new = {"lease": lease, "agent": x.agent, "ancestors": sorted(set(ancestors)), "priority": x.priority, "until": until, "ttl": x.ttl_secs, "since": self.clock["n"]}
        self.change(symbol, [*self.on_symbol(symbol), new])
        self.leave(symbol, x.agent)
        return ("preempted" if against else "acquired"), lease, None

    def run(self, x) -> tuple[str, str | None, str | None]:
        """Outcome, lease and holder of one command."""
        self.clock["n"] += 1
        if x.op == "acquire":
            return self.acquire(x, x.symbol, x.ancestors)
        if x.op == "settle":
            # All or nothing, but checked before anything is swept; whether someone waits ahead isn't asked.
            scope = [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in x.scope]
            for symbol, ancestors in scope:
                against = self.against(symbol, ancestors, x.agent)
                if self._blocks(x, against):
                    return "denied", None, min(v["agent"] for _, v in against)
            for symbol, ancestors in scope:
                self.acquire(x, symbol, ancestors)
            return "settled", None, None
        if x.op == "heartbeat":
            self.sweep(x.ts)
            held = [(symbol, v) for symbol, v in self.of_agent(x.agent) if x.symbol in (None, symbol)]
            for symbol, v in held:
                v.update(until=x.ts + v["ttl"] * 1000, since=self.clock["n"])
                self.change(symbol, [v if o["lease"] == v["lease"] else o for o in self.on_symbol(symbol)])
            return ("refreshed" if held else "ignored"), min((v["lease"] for _, v in held), default=None), None
        if x.op == "release_all":
            held = self.of_agent(x.agent)
            for symbol, v in held:
                self.change(symbol, [o for o in self.on_symbol(symbol) if o["lease"] != v["lease"]])
            return ("released" if held else "ignored"), None, None
        if x.op == "sweep":
            self.sweep(x.ts)
            return "swept", None, None
        if x.op == "dequeue":
            return ("cancelled" if self.leave(x.symbol, x.agent) else "ignored"), None, None
        mine = self.on(x.symbol, x.agent)
        if not mine or (x.op == "transfer" and x.to == x.agent):
            return "ignored", mine and mine["lease"], None
        rest = [o for o in self.on_symbol(x.symbol) if o["lease"] != mine["lease"]]
        if x.op == "release":
            self.change(x.symbol, rest)
            return "released", mine["lease"], None
        if x.op == "transfer":
            self.change(x.symbol, [*rest, mine | {"agent": x.to, "until": x.ts + mine["ttl"] * 1000, "since": self.clock["n"]}])
            self.leave(x.symbol, x.to)
            return "transferred", mine["lease"], x.to
        raise ValueError(f"unknown command {x.op}")


def replay(commands: pd.DataFrame) -> pd.DataFrame:
    """Outcome of each command of a key: acquired, extended, preempted, denied, released, refreshed, transferred, settled, swept, cancelled or ignored.

    Columns: id, ts, op, symbol (null in heartbeats of all of an agent's leases), ancestors (list), agent, priority, ttl_secs; where
    commands use them also preempt (else allowed), queue (else not), to, scope (list of symbol and ancestors). An expired lease
    stands until something sweeps: acquire, heartbeat and sweep do.
    """
    return outcomes(Leases(), commands)


def outcomes(state: Leases, commands: pd.DataFrame) -> pd.DataFrame:
    """Run commands on a state, in order."""
    out = [(x.id, *state.run(x)) for x in commands.sort_values(["ts", "id"]).itertuples(index=False)]
    return pd.DataFrame(out, columns=["id", "outcome", "lease", "holder"])


def lease_fold(commands: DataFrame) -> DataFrame:
    """Outcomes of all commands; `root` is the containment root of a command's symbol. A key's commands are replayed in one task."""
    ship(commands.sparkSession)
    return commands.groupBy("root").applyInPandas(replay, COLUMNS)


def replayed(commands: DataFrame, key: str, replay_key: Callable[[Iterable], Iterator[tuple]], schema: str) -> DataFrame:
    """What replay_key makes of each key's commands, which it gets one after the other in order (ts, id).

    For keys of few commands, of which there are many: a task goes over its sorted commands once, and nothing is set up for a key.
    """
    ship(commands.sparkSession)
    names, arrow = commands.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        command = namedtuple("Command", names)
        rows = (command(*x) for batch in batches for x in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        at = names.index(key)
        out = (made for _, mine in groupby(rows, key=lambda x: x[at]) for made in replay_key(mine))
        while some := list(islice(out, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return spread(commands, key).sortWithinPartitions(key, "ts", "id").mapInArrow(run, schema)


#: What the log calls a task's new state.
TASK_EVENTS = {"done": "task.completed", "blocked": "task.blocked", "failed": "task.failed", "running": "task.started", "review": "task.submitted_for_review", "pending": "task.reset"}


def replay_task(commands: Iterable) -> Iterator[tuple]:
    """Outcome, state, assignee, event, priority and capability of each command on one task, in order (ts, id).

    op: add, claim, state (value), submit, approve, reject, assign (value), reclaim, priority, capability (value). Only the
    assignee ends a task, unless forced; only the assignee submits, anyone else approves.
    """
    state, assignee, priority, capability = None, None, None, None
    for x in commands:
        outcome, event = "refused", None
        if x.op == "add":
            if state is None:
                state, outcome, event = "pending", "done", "task.created"
        elif state is None:
            pass
        elif x.op == "claim":
            if state == "pending":
                state, assignee, outcome, event = "running", x.agent, "done", "task.started"
        elif x.op == "state":
            ends = x.value in ("done", "failed")
            if not (ends and not x.force and assignee and x.agent and assignee != x.agent):
                state, outcome, event = x.value, "done", TASK_EVENTS[x.value]
        elif x.op == "submit":
            if assignee == x.agent:
                state, outcome, event = "review", "done", TASK_EVENTS["review"]
        elif x.op == "approve":
            if x.force or assignee != x.agent:
                state, outcome, event = "done", "done", TASK_EVENTS["done"]
        elif x.op == "reject":
            state, outcome, event = "running", "done", TASK_EVENTS["running"]
        elif x.op == "assign":
            outcome = "unchanged" if assignee == x.value else "done"
            if outcome == "done":
                state, assignee, event = "running", x.value, "task.reassigned"
        elif x.op == "reclaim":
            if state == "running":
                state, assignee, outcome, event = "pending", None, "done", "task.reassigned"
        elif x.op == "priority":
            priority, outcome, event = x.value, "done", "task.reprioritised"
        elif x.op == "capability":
            capability, outcome = x.value, "done"
        yield x.id, x.task, outcome, state, assignee, event, priority, capability


def task_fold(commands: DataFrame) -> DataFrame:
    """(id, task, outcome, state, assignee, event, priority, capability). commands: id, ts, task, op, agent, value, force."""
    return replayed(commands, "task", replay_task, "id long, task string, outcome string, state string, assignee string, event string, priority string, capability string")


def replay_request(commands: Iterable) -> Iterator[tuple]:
    """Outcome and state of each command on one request, in order (ts, id).

    op: open, accept, decline, fulfill, cancel, sweep (deadlines), symbol_free, task_done. The addressee answers, or anyone but the
    sender where there is none; accepting a lease transfer is the transfer; the sender cancels.
    """
    r, state = None, None
    for x in commands:
        outcome = "refused"
        due = state in LIVE_REQUEST and r.deadline_at is not None and r.deadline_at <= x.ts
        if x.op == "open":
            if state is None and x.from_agent != x.to_agent:
                r, state, outcome = x, "open", "done"
        elif state is None:
            pass
        elif x.op == "sweep" or (x.op == "accept" and due):
            state, outcome = ("expired", "done" if x.op == "sweep" else "refused") if due else (state, "ignored")
        elif x.op in ("symbol_free", "task_done"):
            hit = state in LIVE_REQUEST and (x.op == "task_done" or r.kind == "lease-transfer")
            state, outcome = ("fulfilled", "done") if hit else (state, "ignored")
        elif x.op == "cancel":
            if state in LIVE_REQUEST and x.agent == r.from_agent:
                state, outcome = "cancelled", "done"
        elif state in LIVE_REQUEST and (r.to_agent is None or r.to_agent == x.agent) and x.agent != r.from_agent and not (x.op == "accept" and state != "open"):
            if x.op == "accept":
                state, outcome = ("fulfilled", "transferred") if r.kind == "lease-transfer" else ("accepted", "done")
            else:
                state, outcome = {"decline": "declined", "fulfill": "fulfilled"}[x.op], "done"
        yield x.id, x.request, outcome, state


def request_fold(commands: DataFrame) -> DataFrame:
    """(id, request, outcome, state). commands: id, ts, request, op, agent, from_agent, to_agent, kind, deadline_at (of the open command)."""
    return replayed(commands, "request", replay_request, "id long, request string, outcome string, state string")


def replay_sessions(commands: pd.DataFrame) -> pd.DataFrame:
    """Outcome of each command on an agent's sessions, and whether the agent's leases are released.

    op: open, heartbeat, end, sweep. The last session that ends releases (unless `keep`); of those that go stale only `mcp`
    ones do, when nothing else of the agent's is attached.
    """
    live: dict[str, list] = {}
    out = []
    for x in commands.sort_values(["ts", "id"]).itertuples(index=False):
        outcome, released = "ignored", False
        if x.op == "open":
            live[x.session], outcome = [x.ts, x.transport], "opened"
        elif x.op == "heartbeat" and x.session in live:
            live[x.session][0], outcome = x.ts, "alive"
        elif x.op == "end" and x.session in live:
            del live[x.session]
            released = not x.keep and not any(beat >= x.ts - SESSION_MS for beat, _ in live.values())
            outcome = "ended"
        elif x.op == "sweep":
            stale = {k for k, (beat, _) in live.items() if beat < x.ts - SESSION_MS}
            released = any(live[k][1] == "mcp" for k in stale) and len(stale) == len(live)
            for k in stale:
                del live[k]
            outcome = f"expired {len(stale)}"
        out.append((x.id, x.agent, outcome, released))
    return pd.DataFrame(out, columns=["id", "agent", "outcome", "released"])


def session_fold(commands: DataFrame) -> DataFrame:
    """(id, agent, outcome, released). commands: id, ts, agent, session, op, transport, keep."""
    ship(commands.sparkSession)
    return commands.groupBy("agent").applyInPandas(replay_sessions, "id long, agent string, outcome string, released boolean")


def last_values(log: DataFrame, key: str, order: Column, values: list[str], gone: Column | None = None) -> DataFrame:
    """One row a key with the last value that isn't null of each column, of what came after the key's last deletion; a key that was deleted last has no row.

    The fold of all logs in which a write stands by itself: agents, goals, memory, messages, edit windows. One aggregate with
    partial sums, so a key with many writes costs no more than one row a task.
    """
    rows = log.withColumn("__at", order).withColumn("__gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
    dead = rows.groupBy(key).agg(F.max(F.when(F.col("__gone"), F.col("__at"))).alias("__dead"))
    alive = rows.join(dead, key).filter("not __gone and (__dead is null or __at > __dead)")
    return alive.groupBy(key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("__at"))).alias(v) for v in values])


def autoresolved(requests: DataFrame, freed: DataFrame, done: DataFrame) -> DataFrame:
    """(id, reason) of live requests that are answered by themselves: lease transfers on a symbol that is freed (symbol_id), and all that wait for a task that is done (task)."""
    live = requests.filter(F.col("state").isin(*LIVE_REQUEST))
    by_symbol = live.filter("kind = 'lease-transfer'").join(freed.select(F.col("symbol_id").alias("resource_symbol")).distinct(), "resource_symbol", "left_semi")
    by_task = live.join(done.select(F.col("task").alias("resource_task")).distinct(), "resource_task", "left_semi")
    return by_symbol.select("id", F.lit("symbol").alias("reason")).unionByName(by_task.select("id", F.lit("task").alias("reason"))).groupBy("id").agg(F.min("reason").alias("reason"))


def unblocked(view: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """(id, by): ready tasks that depend on one that was just done (task). view: from task_view, after the change."""
    hit = deps.join(done.select(F.col("task").alias("depends_on")).distinct(), "depends_on", "left_semi")
    return view.filter("ready").select("id").join(hit.select(F.col("task_id").alias("id"), F.col("depends_on").alias("by")), "id")


def orphans(tasks: DataFrame, agents: DataFrame, now: int) -> DataFrame:
    """(id, assignee) of running tasks whose agent is gone or silent for more than AGENT_MS; they go back to pending."""
    t = tasks.filter("state = 'running' and assignee is not null").join(agents.select(F.col("name").alias("assignee"), "heartbeat_at"), "assignee", "left")
    return t.filter(F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < now - AGENT_MS)).select("id", "assignee")


def sweep(leases: DataFrame, requests: DataFrame, sessions: DataFrame, activity: DataFrame, tasks: DataFrame, agents: DataFrame, now: int) -> DataFrame:
    """(step, what, id) of all that lapses by now: leases, requests, sessions, edit windows, orphaned tasks, in that order."""
    row = lambda df, step, what, key: df.select(F.lit(step).cast("long").alias("step"), F.lit(what).alias("what"), key.alias("id"))
    c = F.col
    out = row(leases.filter((c("state") == "active") & (c("expires_at") <= now)), 1, "lease", c("id"))
    out = out.unionAll(row(requests.filter(c("state").isin(*LIVE_REQUEST) & (c("deadline_at") <= now)), 2, "request", c("id")))
    out = out.unionAll(row(sessions.filter(c("ended_at").isNull() & (c("heartbeat_at") < now - SESSION_MS)), 3, "session", c("id")))
    out = out.unionAll(row(activity.filter(c("updated_at") < now - SESSION_MS), 4, "activity", F.concat_ws(" ", "agent", "path")))
    return out.unionAll(row(orphans(tasks, agents, now), 5, "task", c("id")))


def next_ids(count: int, rows: DataFrame, prefix: str, *order: Column) -> DataFrame:
    """rows with an id of the prefix and the next numbers, as new tasks, goals and repositories get them. rows: what one command adds, so one window holds them."""
    return rows.withColumn("id", F.concat(F.lit(prefix), (F.row_number().over(W.orderBy(*order)) + count).cast("string")))


def without_cycles(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one component that close no cycle, taken one after the other by (task_id, depends_on).

    Columns: task_id, depends_on, via, edge, known (a dependency that is there already).
    """
    after: dict[str, set[str]] = defaultdict(set)
    for x in rows[rows["known"]].itertuples(index=False):
        after[x.task_id].add(x.depends_on)
    out = []
    for x in rows[~rows["known"]].sort_values(["task_id", "depends_on"]).itertuples(index=False):
        seen, stack = {x.depends_on}, [x.depends_on]
        while stack and x.task_id not in seen:
            more = after[stack.pop()] - seen
            seen |= more
            stack += more
        if x.task_id not in seen:
            after[x.task_id].add(x.depends_on)
            out.append((x.task_id, x.depends_on, x.via, x.edge))
    return pd.DataFrame(out, columns=["task_id", "depends_on", "via", "edge"])


def infer_dependencies(task_symbols: DataFrame, edges: DataFrame, tasks: DataFrame, deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, depends_on, via, edge): a scope symbol's out-edge lands in another open task's scope or in what is nested in it.

    Dependencies that are there already are left out, and so are those that would close a cycle with them and with the ones
    accepted before, in (task_id, depends_on) order. A cycle lies in one component of all links, so components are gone
    through apart and what is in none is accepted. A symbol in the scopes of several tasks counts for each.
    """
    open_ = tasks.filter("state not in ('done', 'failed')").select(F.col("id").alias("task_id"))
    scope = task_symbols.join(open_, "task_id", "left_semi").select("task_id", "symbol_id")
    out = edges.filter(F.col("kind").isin("calls", "uses", "imports", "queries"))
    met = scope.join(out, scope["symbol_id"] == out["src"]).select("task_id", F.col("src").alias("via"), "dst", F.col("kind").alias("edge"))
    nested = descendants(symbols, scope.select(F.col("symbol_id").alias("root")).distinct()).select(F.col("root").alias("symbol_id"), F.col("id").alias("dst"))
    owner = scope.withColumn("dst", F.col("symbol_id")).unionByName(scope.join(nested, "symbol_id")).select(F.col("task_id").alias("depends_on"), "dst").distinct()
    found = met.join(owner, "dst").filter("task_id <> depends_on").groupBy("task_id", "depends_on").agg(F.min(F.struct("via", "edge")).alias("by"))
    known = deps.select("task_id", "depends_on").distinct()
    new = written(found.join(known, ["task_id", "depends_on"], "left_anti").select("task_id", "depends_on", "by.via", "by.edge"), "candidates")
    if new.isEmpty():
        return new
    none = F.lit(None).cast("string")
    links = written(new.withColumn("known", F.lit(False)).unionByName(known.select("task_id", "depends_on", none.alias("via"), none.alias("edge"), F.lit(True).alias("known"))), "links")
    parts = components_of_cycles(links.select(F.col("task_id").alias("a"), F.col("depends_on").alias("b")))
    a, b = (parts.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")) for end in ("task_id", "depends_on"))
    placed = links.join(a, "task_id", "left").join(b, "depends_on", "left").withColumn("together", F.coalesce(F.col("c_task_id") == F.col("c_depends_on"), F.lit(False)))
    ship(deps.sparkSession)
    checked = placed.filter("together").groupBy("c_task_id").applyInPandas(without_cycles, "task_id string, depends_on string, via string, edge string")
    return placed.filter("not together and not known").select("task_id", "depends_on", "via", "edge").unionByName(checked)
