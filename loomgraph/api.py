"""What a caller asks for by name: each command gives a DataFrame over the tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import route
from loomgraph.operators import arch, diff, effects, graph, reports, schedule
from loomgraph.operators import relational as r
from loomgraph.operators import state as st
from loomgraph.sources import repo
from loomgraph.sources.adapter import Model
from loomgraph.sources.repo import as_json
from loomgraph.sources.tables import written

#: What a command ends with: an answer, a negative answer, an error.
ANSWER, NEGATIVE, ERROR = 0, 1, 2


class Workspace:
    """The commands. `now` is the present in epoch milliseconds; without it, that of the last event."""

    def __init__(self, spark: SparkSession, folder: str, now: int | None = None):
        self.m = Model(spark, folder)
        self.now = self.m.now if now is None else now

    def symbols(self, pattern: str | None = None, kind: str | None = None, path: str | None = None, limit: int = 40) -> DataFrame:
        return r.list_symbols(self.m.symbols, path=path, kind=kind, pattern=pattern, limit=max(1, min(200, limit)))

    def resolve(self, text: str) -> DataFrame:
        return r.resolve(self.m.symbols, text, self.m.repos)

    def show(self, text: str) -> DataFrame:
        return reports.show(self.m, text)

    def graph(self, text: str, depth: int = 2) -> DataFrame:
        return reports.impact_of(self.m, text, depth)

    def endpoints(self, part: str | None = None) -> DataFrame:
        rows = self.m.symbols.filter("role = 'api'").withColumn("route", route(F.col("role"), F.col("meta")))
        return (rows if part is None else rows.filter(F.col("route").contains(part))).orderBy("path", "start_byte", "id")

    def tests(self, text: str) -> DataFrame:
        found = r.resolve_one(self.m.symbols, text, self.m.repos)
        return r.tests_reaching(self.m.edges, self.m.symbols).join(found.select("id"), "id", "left_semi")

    def owners(self, rules: list[tuple[str, str]], path: str | None = None) -> DataFrame:
        return r.owners_by_owner(self.m.spark, rules) if path is None else reports.owners(self.m, rules, path)

    def who_owns(self, text: str, agent: str) -> DataFrame:
        return reports.who_owns(self.m, text, agent, self.now)

    def whoami(self, agent: str) -> DataFrame:
        return reports.whoami(self.m, agent, self.now)

    def guard(self, agent: str, path: str, symbol: str | None = None) -> DataFrame:
        at = None if symbol is None else r.resolve_one(self.m.symbols, symbol, self.m.repos).first().id
        asked = self.m.spark.createDataFrame([(path.replace("\\", "/"), at)], "path string, symbol string")
        return diff.guard(asked, self.m.symbols, self.m.leases, agent, self.now)

    def contention(self) -> DataFrame:
        return schedule.contention(self.m.tasks, self.m.task_symbols, self.m.symbols, self.m.leases, self.now)

    def plan(self) -> DataFrame:
        held = schedule.contention(schedule.in_plan(self.m.tasks), self.m.task_symbols, self.m.symbols, self.m.leases, self.now)
        return schedule.plan(self.m.tasks, self.m.task_deps, held)

    def claim(self, agent: str, goal: str | None = None) -> DataFrame:
        m = self.m
        return schedule.claim(m.tasks, m.task_deps, m.task_symbols, m.symbols, m.leases, m.agents, agent, self.now, m.task_goals, goal)

    def infer(self) -> DataFrame:
        return st.infer_dependencies(self.m.task_symbols, self.m.edges, self.m.tasks, self.m.task_deps, self.m.symbols)

    def suggest(self, near: str, depth: int = 2) -> DataFrame:
        return diff.clusters(r.resolve_one(self.m.symbols, near, self.m.repos).select("id"), self.m.symbols, self.m.edges, depth)

    def plan_goal(self, goal: str, depth: int = 2) -> DataFrame:
        """Suggestions for a goal by the words of its title; without any match no row."""
        text = self.m.goals.filter(F.col("id") == goal).select("title").first()
        if text is None:
            raise r.NotFound(f"no such goal: {goal}")
        return diff.clusters(r.keyword_matches(self.m.symbols, text.title).select("id"), self.m.symbols, self.m.edges, depth)

    def architecture(self, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """Boxes and the links between them."""
        boxes, owner = arch.layout(self.m.symbols, depth)
        return boxes, arch.box_edges(self.m.symbols, self.m.edges, boxes, owner)

    def cycles(self) -> DataFrame:
        return graph.components_of_cycles(self.m.task_deps.select(F.col("task_id").alias("a"), F.col("depends_on").alias("b")))

    def sweep(self) -> DataFrame:
        return st.sweep(self.m.leases, self.m.requests, self.m.sessions, self.m.activity, self.m.tasks, self.m.agents, self.now)

    def workers(self) -> DataFrame:
        return reports.worker_order(reports.workers(self.m, self.now))

    def notifications(self, audience: str | None = None, limit: int = 0) -> DataFrame:
        return reports.notifications(self.m, self.now, audience, limit)

    def requests(self, agent: str | None = None, direction: str = "inbox", live_only: bool = True) -> DataFrame:
        return reports.inbox(self.m.requests, agent, direction, live_only)

    def news(self, agent: str, cursor: int) -> tuple[DataFrame, int]:
        return reports.news(self.m, agent, cursor, self.now)

    def status(self) -> DataFrame:
        return reports.status(self.m, self.now)

    def observe(self, goal: str | None = None) -> DataFrame:
        return reports.observe(self.m, self.now, goal)

    def task_context(self, task: str, depth: int = 2) -> DataFrame:
        return reports.task_context(self.m, task, self.now, depth)

    def agent_context(self, agent: str, depth: int = 2) -> DataFrame:
        return reports.agent_context(self.m, agent, self.now, depth)


#: Tables that commands change, with their keys.
KEYS = {"tasks": ["id"], "leases": ["id"], "requests": ["id"], "lease_queue": ["id"], "task_deps": ["task_id", "depends_on"], "task_symbols": ["task_id", "symbol_id"], "agents": ["name"], "progress": ["id"]}


class Refused(ValueError):
    """A command that its caller may not give."""


class Store:
    """Commands that write: bucketed tables below a folder, one writer at a time. Each command's effects on all tables are computed from one state, then written table by table, the log last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> Store:
        """A store that starts with tables by name (KEYS)."""
        made = cls(spark, folder)
        for name, df in tables.items():
            repo.upsert(df, KEYS[name], f"{folder}/{name}")
        return made

    def table(self, name: str) -> DataFrame:
        return repo.read_table(self.spark, f"{self.folder}/{name}")

    def log(self) -> DataFrame:
        return self.spark.read.schema("id long, ts long, kind string, agent string, symbol_handle string, task string, detail string").parquet(f"{self.folder}/log")

    def _put(self, name: str, changed: DataFrame) -> None:
        repo.upsert(written(changed.select(*self.table(name).columns), "changed"), KEYS[name], f"{self.folder}/{name}")

    def _tell(self, rows: DataFrame, now: int) -> None:
        """Append (kind, agent, task, detail) to the log."""
        files, at = repo._files(self.spark, f"{self.folder}/log")
        last = self.log().agg(F.max("id")).first()[0] if files.exists(at) else None
        null = F.lit(None).cast("string")
        repo.emit(rows.select(F.lit(now).cast("long").alias("ts"), "kind", "agent", null.alias("symbol_handle"), "task", "detail"), f"{self.folder}/log", last or 0)

    def finish(self, task: str, state: str, agent: str | None, now: int, force: bool = False) -> DataFrame:
        """End a task as done or failed: (effect, id, agent, cause). Only its assignee does, unless forced."""
        tasks = self.table("tasks")
        row = tasks.filter(F.col("id") == task).select("assignee").first()
        if row is None or state not in effects.TERMINAL:
            raise r.NotFound(f"no such task or state: {task} {state}")
        if not force and row.assignee and agent and row.assignee != agent:
            raise Refused(f"{task} is assigned to {row.assignee}, not {agent}")
        ended = self.spark.createDataFrame([(task, state)], "task string, state string")
        out = written(effects.finished(ended, tasks, self.table("task_deps"), self.table("leases"), self.table("requests")), "effects")
        of = lambda effect: out.filter(F.col("effect") == effect).select("id").distinct()
        self._put("tasks", tasks.filter(F.col("id") == task).withColumns({"state": F.lit(state), "updated_at": F.lit(now).cast("long")}))
        self._put("leases", self.table("leases").join(of("lease.released"), "id", "left_semi").withColumn("state", F.lit("released")))
        self._put("requests", self.table("requests").join(of("request.fulfilled"), "id", "left_semi").withColumn("state", F.lit("fulfilled")))
        kind = F.when(F.col("effect") == "task.ended", F.lit(st.TASK_EVENTS[state])).otherwise(F.col("effect"))
        about = F.when(F.col("effect").startswith("task."), F.col("id")).otherwise(F.lit(task))
        self._tell(out.select(kind.alias("kind"), F.when(F.col("effect") == "task.ended", F.lit(agent)).otherwise(F.col("agent")).alias("agent"), about.alias("task"), F.to_json(F.struct("id", "cause")).alias("detail")), now)
        return out

    def accept(self, request: str, agent: str, now: int) -> DataFrame:
        """Accept a request: (request, outcome, lease, agent, expires_at, waiter); a transfer moves the lease."""
        answers = self.spark.createDataFrame([(request, agent, now)], "request string, agent string, ts long")
        out = written(effects.accepted(answers, self.table("requests"), self.table("leases"), self.table("lease_queue")), "accepted")
        state = F.when(F.col("outcome") == "transferred", "fulfilled").when(F.col("outcome").isin("accepted", "expired"), F.col("outcome"))
        asked = self.table("requests").drop("state").join(out.select(F.col("request").alias("id"), state.alias("state")).filter("state is not null"), "id")
        moved = out.filter("lease is not null").select(F.col("lease").alias("id"), F.col("agent").alias("new"), F.col("expires_at").alias("until"))
        leases = self.table("leases").join(moved, "id").withColumns({"agent": F.col("new"), "expires_at": F.col("until"), "acquired_at": F.lit(now).cast("long")})
        granted = self.table("lease_queue").join(out.filter("waiter is not null").select(F.col("waiter").alias("id")), "id", "left_semi").withColumn("state", F.lit("granted"))
        for name, rows in (("requests", asked), ("leases", leases), ("lease_queue", granted)):
            self._put(name, rows)
        kind = F.when(F.col("outcome") == "transferred", "lease.transferred").otherwise(F.concat(F.lit("request."), "outcome"))
        self._tell(out.select(kind.alias("kind"), F.lit(agent).alias("agent"), F.lit(None).cast("string").alias("task"), F.to_json(F.struct("request", "lease")).alias("detail")), now)
        return out

    def report(self, agent: str, percent: int, now: int) -> DataFrame:
        """Progress of an agent: its sign of life, and its leases renewed."""
        last = self.table("progress").agg(F.max("id")).first()[0] or 0
        reports = self.spark.createDataFrame([(last + 1, agent, percent, now)], "id long, agent string, percent long, ts long")
        out = written(effects.progress_reported(reports, self.table("leases")), "progress")
        value = lambda effect: out.filter(F.col("effect") == effect).select("id", "value")
        self._put("progress", value("progress").select(F.col("id").cast("long").alias("id"), F.lit(agent).alias("agent"), F.col("value").alias("percent"), F.lit(now).cast("long").alias("ts")))
        self._put("agents", self.table("agents").join(value("heartbeat").select(F.col("id").alias("name"), "value"), "name").withColumn("heartbeat_at", F.col("value")))
        self._put("leases", self.table("leases").join(value("renewed"), "id").withColumn("expires_at", F.col("value")))
        return out


def answer(workspace: Workspace, command: str, *args, **named) -> tuple[int, list[str]]:
    """Run a command by name: its exit code and its rows as JSON texts, as a command line prints them.

    Rows come to the caller, so this is for commands whose answer a reader can read. A refusal and an empty answer are negative.
    """
    try:
        out = getattr(workspace, command)(*args, **named)
    except (LookupError, AttributeError, TypeError) as e:
        return ERROR, [str(e)]
    rows = [row.json for row in as_json(out).collect()]
    refused = command == "guard" and any('"verdict":"denied"' in x for x in rows)
    return (NEGATIVE if refused or not rows else ANSWER), rows
