"""Snapshot differences, their coverage by leases, and what changes mean for others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.scalars import handle
from loomgraph.operators import relational as r
from loomgraph.operators.graph import ancestors, impact
from loomgraph.sources.tables import written

#: A wait of up to so many seconds is advised rather than a request; how far an API change is followed.
WAIT_SECS, NOTICE_DEPTH = 30, 2


def changed_files(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """(path, change) by content hash; unchanged files don't appear."""
    a, b = indexed.select("path", F.col("content_hash").alias("old")), present.select("path", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def missing_files(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """Indexed files (repo_id, path) that aren't there any more; asked only by full scans."""
    return indexed.join(present.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def missing_symbols(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored symbols other than services that a file no longer has."""
    return stored.filter("kind <> 'service'").join(parsed.select("id"), "id", "left_anti")


def missing_services(symbols: DataFrame, manifests: DataFrame) -> DataFrame:
    """Services whose manifest (repo_id, manifest) is gone."""
    return symbols.filter("kind = 'service'").join(manifests.select("repo_id", F.col("manifest").alias("path")), ["repo_id", "path"], "left_anti")


def changed_symbols(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, path, change, covering): a symbol is modified when its own text is, not that of what it contains.

    covering: of a new symbol the nearest stored one that holds it; of the others their stored parent. A file that isn't
    there has no parsed symbol, so all it had is removed.
    """
    a = stored.select("id", F.col("path").alias("p1"), F.col("parent_id").alias("u1"), F.col("own_hash").alias("old"), F.lit(True).alias("was"))
    b = parsed.select("id", F.col("path").alias("p2"), F.col("own_hash").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    found = written(a.join(b, "id", "full_outer").select("id", F.coalesce("p1", "p2").alias("path"), change.alias("change"), "u1").filter("change is not null"), "changes")
    up = ancestors(parsed.select("id", "parent_id"), found.filter("change = 'added'").select(F.col("id").alias("start"))).filter("depth > 0")
    held = up.join(stored.select("id"), "id", "left_semi").groupBy(F.col("start").alias("id")).agg(F.min_by(F.col("id"), "depth").alias("above"))
    return found.join(held, "id", "left").select("id", "path", "change", F.when(F.col("change") == "added", F.col("above")).otherwise(F.col("u1")).alias("covering"))


def check(changes: DataFrame, symbols: DataFrame, leases: DataFrame, agent: str) -> DataFrame:
    """(id, change, covered, lease, holder): covered where the agent holds the anchor or what is around it, or where nothing could be held.

    The anchor of an addition is its covering symbol, else the symbol itself. lease: the agent's nearest one; holder: else
    whoever holds the nearest one. symbols: (id, parent_id) before the change.
    """
    anchored = changes.withColumn("anchor", F.when(F.col("change") == "added", F.col("covering")).otherwise(F.col("id")))
    up = ancestors(symbols.select("id", "parent_id"), anchored.filter("anchor is not null").select(F.col("anchor").alias("start")).distinct())
    live = leases.filter("state = 'active'").select(F.col("symbol_id").alias("other"), F.col("id").alias("lease"), F.col("agent").alias("holder"), "acquired_at")
    met = up.select(F.col("start").alias("anchor"), F.col("id").alias("other"), "depth").join(live, "other")
    mine = F.when(F.col("holder") == agent, F.struct("depth", "acquired_at", "lease"))
    first = met.groupBy("anchor").agg(F.min(mine).alias("own"), F.min(F.struct("depth", "acquired_at", "lease", "holder")).alias("any"))
    rows = anchored.join(first, "anchor", "left")
    covered = F.col("anchor").isNull() | F.col("own").isNotNull()
    return rows.select("id", "change", covered.alias("covered"), F.col("own.lease").alias("lease"), F.when(~covered, F.col("any.holder")).alias("holder"))


def by_repository(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """(path, repo_id, rel) by which changes, checks and scans of a workspace are gone through; the results of all repositories are one table."""
    return r.repo_of_path(paths, repos)


def guard(asked: DataFrame, symbols: DataFrame, leases: DataFrame, agent: str, now: int) -> DataFrame:
    """May an agent edit each of `asked` (path, symbol; symbol null: the whole file)?

    (path, symbol, verdict, unindexed, lease, via, holder, suggestions): denied where others hold the symbol, what is around it or what
    it holds; allowed where the agent holds it or what is around it, or where nothing is indexed; else a warning. suggestions: arrays of
    (action, symbol, holder, secs) in the order of the conflicts: wait for a short lease, else request it; narrow to a symbol where
    a whole file was asked for and something inside it is held; acquire what nobody holds.
    """
    files = symbols.filter("kind = 'file'").select("path", F.col("id").alias("file"))
    at = asked.join(files, "path", "left").select("path", F.coalesce("symbol", "file").alias("symbol"), F.col("symbol").isNull().alias("whole"))
    known = at.filter("symbol is not null")
    named = symbols.select(F.col("id").alias("other"), handle(F.col("path"), F.col("kind"), F.col("name"), F.col("fqn")).alias("handle"))
    found = r.conflicts(leases, symbols, known.select("symbol").distinct().withColumn("agent", F.lit(agent)), now).join(named, "other")
    secs = F.greatest(F.floor((F.col("expires_at") - F.lit(now)) / 1000).cast("long"), F.lit(0))
    one = F.struct("other", "lease", "holder", "relation", "handle", secs.alias("secs"))
    against = found.groupBy("symbol").agg(F.sort_array(F.collect_list(one)).alias("conflicts"))
    held = leases.filter((F.col("state") == "active") & (F.col("agent") == agent)).select(F.col("symbol_id").alias("other"), F.col("id").alias("lease"), "acquired_at")
    up = ancestors(symbols.select("id", "parent_id"), known.select(F.col("symbol").alias("start")).distinct()).select(F.col("start").alias("symbol"), F.col("id").alias("other"), "depth")
    own = up.join(held, "other").join(named, "other").groupBy("symbol").agg(F.min(F.struct("depth", "acquired_at", "lease", "handle")).alias("own"))
    rows = at.join(against, "symbol", "left").join(own, "symbol", "left").join(named.withColumnRenamed("other", "symbol"), "symbol", "left")
    step = lambda action, x: F.struct(action.alias("action"), x["handle"].alias("symbol"), x["holder"].alias("holder"), x["secs"].alias("secs"))
    asks = F.transform("conflicts", lambda x: step(F.when(x["secs"] <= WAIT_SECS, "wait").otherwise("request-transfer"), x))
    inside = F.slice(F.filter("conflicts", lambda x: x["relation"] == "descendant"), 1, 1)
    narrow = F.when(F.col("whole"), F.transform(inside, lambda x: step(F.lit("narrow"), x))).otherwise(F.slice(asks, 1, 0))
    take = F.array(F.struct(F.lit("acquire").alias("action"), F.col("handle").alias("symbol"), F.lit(None).cast("string").alias("holder"), F.lit(None).cast("long").alias("secs")))
    denied, unindexed = F.col("conflicts").isNotNull(), F.col("symbol").isNull()
    verdict = F.when(unindexed, "allowed").when(denied, "denied").when(F.col("own").isNotNull(), "allowed").otherwise("warn")
    mine = F.when(~denied, F.col("own"))
    return rows.select("path", "symbol", verdict.alias("verdict"), unindexed.alias("unindexed"), mine["lease"].alias("lease"), mine["handle"].alias("via"), F.get("conflicts", F.lit(0))["holder"].alias("holder"), F.when(verdict == "denied", F.concat(asks, narrow)).when(verdict == "warn", take).alias("suggestions"))


def api_change_impact(changes: DataFrame, symbols: DataFrame, edges: DataFrame, leases: DataFrame) -> DataFrame:
    """(symbol, agent): who is told that an endpoint changed: those with an active lease on what it reaches in two steps, but for its own holder.

    changes: (id, change) of a scan of named paths. The holder of the endpoint with the oldest lease is taken for its author.
    """
    api = changes.filter("change = 'modified'").join(symbols.filter("role = 'api'").select("id"), "id", "left_semi").select(F.col("id").alias("seed"))
    hit = impact(edges, api, NOTICE_DEPTH)
    live = leases.filter("state = 'active'")
    author = live.groupBy(F.col("symbol_id").alias("seed")).agg(F.min_by("agent", F.struct("acquired_at", "id")).alias("author"))
    holders = live.select(F.col("symbol_id").alias("id"), "agent").distinct()
    told = hit.join(holders, "id").join(author, "seed", "left").filter(~F.col("agent").eqNullSafe(F.col("author")))
    return told.select(F.col("seed").alias("symbol"), "agent").distinct()


def followup_tasks(changed: DataFrame, symbols: DataFrame, edges: DataFrame, task_symbols: DataFrame, task_goals: DataFrame) -> DataFrame:
    """(goal_id, symbol, title, capability): a task for each symbol a changed one reaches in two steps that its goal has no task for.

    changed: (id). Its goal is that of the first of its tasks (in order of id) that has one; without a goal nothing is opened.
    """
    goal = changed.join(task_symbols.select("task_id", F.col("symbol_id").alias("id")), "id").join(task_goals, "task_id").groupBy(F.col("id").alias("seed")).agg(F.min_by("goal_id", "task_id").alias("goal_id"))
    hit = impact(edges, goal.select("seed"), NOTICE_DEPTH).join(goal, "seed").select("goal_id", "id").distinct()
    covered = task_symbols.join(task_goals, "task_id").select("goal_id", F.col("symbol_id").alias("id")).distinct()
    gap = hit.join(covered, ["goal_id", "id"], "left_anti").join(symbols.select("id", "path", "kind", "name", "fqn", "role"), "id")
    capability = F.when(F.col("role") == "test", "testing").when(F.col("role") == "schema", "database")
    return gap.select("goal_id", F.col("id").alias("symbol"), F.concat(F.lit("Update "), handle(F.col("path"), F.col("kind"), F.col("name"), F.col("fqn"))).alias("title"), capability.alias("capability"))


def clusters(seeds: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(title, symbols): the seeds (id) and what reaches them, grouped by the service they are in, else by their file; sorted handles."""
    near = impact(edges, seeds.select(F.col("id").alias("seed")), depth).select("id").union(seeds.select("id")).distinct()
    owner = owning_services(symbols, near)
    s = symbols.select("id", "path", handle(F.col("path"), F.col("kind"), F.col("name"), F.col("fqn")).alias("handle"))
    rows = near.join(s, "id").join(owner, "id", "left")
    return rows.groupBy(F.concat(F.lit("Update "), F.coalesce("service", "path")).alias("title")).agg(F.sort_array(F.collect_set("handle")).alias("symbols"))


def owning_services(symbols: DataFrame, of: DataFrame) -> DataFrame:
    """(id, service, service_id): the nearest service around each of `of` (id), itself included."""
    up = ancestors(symbols.select("id", "parent_id"), of.select(F.col("id").alias("start")).distinct())
    services = symbols.filter("kind = 'service'").select("id", "name")
    return up.join(services, "id").groupBy(F.col("start").alias("own")).agg(F.min(F.struct("depth", "name", "id")).alias("s")).select(F.col("own").alias("id"), F.col("s.name").alias("service"), F.col("s.id").alias("service_id"))


def dependants(of: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(id, phrase): whose work depends on each symbol: the first services other than its own that it reaches in two steps, else the callers.

    In the order of the impact (distance, path, start); `most` names and how many more there are.
    """
    hit = impact(edges, of.select(F.col("id").alias("seed")).distinct(), NOTICE_DEPTH)
    s = symbols.select("id", "name", "path", "start_byte")
    owner = owning_services(symbols, hit.select("id").union(hit.select(F.col("seed").alias("id"))))
    own = owner.select(F.col("id").alias("seed"), F.col("service").alias("own_service"))
    rows = hit.join(s, "id").join(owner.select("id", "service"), "id", "left").join(own, "seed", "left")
    place = F.struct("distance", "path", "start_byte", "id")
    other = F.when(~F.col("service").eqNullSafe(F.col("own_service")), F.col("service"))

    def firsts(name):
        return rows.withColumn("who", name).filter("who is not null").groupBy("seed", "who").agg(F.min(place).alias("place")).withColumn("rn", F.row_number().over(W.partitionBy("seed").orderBy("place", "who"))).groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.struct("rn", "who")))), lambda x: x["who"]).alias("shown"))

    a, b = (firsts(x).select("seed", F.struct("n", "shown").alias(y)) for x, y in ((other, "services"), (F.col("name"), "callers")))
    more = lambda x: F.col(x)["n"] - F.size(F.col(x)["shown"])
    shown = lambda x, sep: F.array_join(F.col(x)["shown"], sep)
    say_services = F.when(more("services") > 0, F.concat(shown("services", ", "), F.lit(" and "), more("services").cast("string"), F.lit(" more depend on this."))).when(F.size(F.col("services")["shown"]) == 1, F.concat(shown("services", ", "), F.lit(" depends on this."))).otherwise(F.concat(shown("services", ", "), F.lit(" depend on this.")))
    say_callers = F.when(more("callers") > 0, F.concat(shown("callers", "(), "), F.lit(" and "), more("callers").cast("string"), F.lit(" more call this."))).when(F.size(F.col("callers")["shown"]) == 1, F.concat(shown("callers", "(), "), F.lit("() calls this."))).otherwise(F.concat(shown("callers", "(), "), F.lit("() call this.")))
    return b.join(a, "seed", "left").select(F.col("seed").alias("id"), F.when(F.col("services").isNotNull(), say_services).otherwise(say_callers).alias("phrase"))
