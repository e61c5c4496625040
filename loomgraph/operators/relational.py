"""Lookups, joins, rankings and aggregates over the model's tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.scalars import handle, keywords, stored_handle
from loomgraph.operators.graph import ancestors
from loomgraph.sources.tables import counted, spread, written

SYMBOL_ORDER = ("path", "start_byte", "id")


def list_symbols(symbols: DataFrame, *, path: str | None = None, kind: str | None = None, pattern: str | None = None, role: str | None = None, limit: int = 200) -> DataFrame:
    """Filters, then the first `limit` in order; the role is looked at after the limit."""
    df = symbols
    if path is not None:
        df = df.filter(F.col("path") == path)
    if kind is not None:
        df = df.filter(F.col("kind") == kind)
    if pattern is not None:
        like = f"%{pattern}%"
        df = df.filter(F.col("name").ilike(like) | F.col("fqn").ilike(like) | F.col("path").ilike(like))
    df = df.orderBy(*SYMBOL_ORDER).limit(limit)
    return df if role is None else df.filter(F.col("role") == role)


def resolve(symbols: DataFrame, text: str, repos: DataFrame | None = None, limit: int = 25) -> DataFrame:
    """Symbols of the first tier that has any: id, service:NAME, repository:path:fqn, path:fqn, file path, fqn, name, part of fqn or path.

    Only the last tier has a limit, for which its matches are taken in the usual order of symbols.
    """
    c, text = F.col, text.strip()
    if not text:
        return symbols.limit(0)
    norm = text.replace("\\", "/")
    like = f"%{norm}%"
    tiers = [c("id") == text]
    if norm.startswith("service:"):
        tiers.append((c("kind") == "service") & (c("name") == norm.removeprefix("service:")))
    first, _, rest = norm.partition(":")
    path, _, fqn = rest.rpartition(":")
    if path and repos is not None:
        named = [r.id for r in repos.filter((c("id") == first) | (c("name") == first)).select("id").orderBy("id").limit(1).collect()]
        if named:
            tiers.append((c("repo_id") == named[0]) & (c("path") == path) & (c("fqn") == fqn))
    head, _, tail = norm.rpartition(":")
    if head:
        tiers.append((c("path") == head) & (c("fqn") == tail))
    tiers += [(c("kind") == "file") & (c("path") == norm), c("fqn") == norm, c("name") == norm, c("fqn").ilike(like) | c("path").ilike(like)]
    hits = symbols.withColumn("tier", F.coalesce(*[F.when(t, i) for i, t in enumerate(tiers)])).filter("tier is not null")
    best = hits.agg(F.min("tier")).first()[0]
    found = hits.filter(c("tier") == best) if best is not None else hits.limit(0)
    found = found.orderBy(*SYMBOL_ORDER).drop("tier")
    return found.limit(limit) if best == len(tiers) - 1 else found


class NotFound(LookupError):
    """Nothing answers to a text."""


class Ambiguous(LookupError):
    """Several symbols answer to a text; the message lists ten of them."""


def resolve_one(symbols: DataFrame, text: str, repos: DataFrame | None = None) -> DataFrame:
    """The one symbol a text means. NotFound where none does, Ambiguous where several do."""
    found = resolve(symbols, text, repos)
    n = found.count()
    if n == 1:
        return found
    if not n:
        raise NotFound(f"no symbol matches '{text}'")
    shown = found.limit(10).select(handle(F.col("path"), F.col("kind"), F.col("name"), F.col("fqn")).alias("handle"), "kind").collect()
    raise Ambiguous(f"'{text}' is ambiguous, {n} matches: " + ", ".join(f"{r.handle} [{r.kind}]" for r in shown))


def qualified_handle(symbols: DataFrame, repos: DataFrame) -> DataFrame:
    """(id, handle): with its repository's name in front where there are several repositories. repos: one row a repository."""
    many = repos.agg((F.count(F.lit(1)) > 1).alias("many"))
    named = symbols.join(F.broadcast(repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))), "repo_id", "left").crossJoin(F.broadcast(many))  # one row
    plain = handle(F.col("path"), F.col("kind"), F.col("name"), F.col("fqn"))
    return named.select("id", F.when(F.col("many"), F.concat_ws("/", F.coalesce("repo", "repo_id"), plain)).otherwise(plain).alias("handle"))


def repo_of_path(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """(path, repo_id, rel): the repository with the longest root above a path, and the path below that root.

    A path looks up its own parent folders, so the join is by equality; `.` holds all. A path of no repository goes to the first one.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths.select("path").distinct().withColumn("root_path", F.explode(F.concat(F.array(F.lit(".")), above)))
    roots = repos.select("root_path", F.col("id").alias("repo_id"))
    found = up.join(roots, "root_path").groupBy("path").agg(F.max_by(F.struct("repo_id", "root_path"), F.when(F.col("root_path") == ".", -1).otherwise(F.length("root_path"))).alias("r"))
    rel = F.when((F.col("r.root_path") == ".") | F.col("r").isNull(), F.col("path")).when(F.col("path") == F.col("r.root_path"), "").otherwise(F.expr("substring(path, length(r.root_path) + 2)"))
    fallback = repos.agg(F.min("id").alias("fallback"))
    return paths.select("path").distinct().join(found, "path", "left").crossJoin(F.broadcast(fallback)).select("path", F.coalesce("r.repo_id", "fallback").alias("repo_id"), rel.alias("rel"))  # one row


def with_handle(df: DataFrame, symbols: DataFrame, key: str, name: str = "symbol_handle", fallback: bool = True) -> DataFrame:
    """Left join on a symbol's handle; a dangling key keeps itself (fallback) or null."""
    s = symbols.select(F.col("id").alias("__id"), stored_handle(F.col("path"), F.col("kind"), F.col("fqn")).alias("__handle"))
    found = F.coalesce("__handle", key) if fallback else F.col("__handle")
    return df.join(s, F.col(key) == F.col("__id"), "left").withColumn(name, found).drop("__id", "__handle")


def neighbours(edges: DataFrame, symbols: DataFrame, *, incoming: bool) -> DataFrame:
    """(id, kind, other, handle) over edges other than containment; dangling ends vanish."""
    own, far = ("dst", "src") if incoming else ("src", "dst")
    s = symbols.select(F.col("id").alias("other"), handle(F.col("path"), F.col("kind"), F.col("name"), F.col("fqn")).alias("handle"))
    e = edges.filter("kind <> 'contains'").select(F.col(own).alias("id"), F.col("kind"), F.col(far).alias("other"))
    return e.join(s, "other").select("id", "kind", "other", "handle")


def task_view(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Tasks with their dependencies, those not done, and whether they can start. An unknown dependency blocks."""
    d = deps.join(tasks.select(F.col("id").alias("depends_on"), F.col("state").alias("dep_state")), "depends_on", "left")
    open_ = F.when(F.coalesce("dep_state", F.lit("")) != "done", F.col("depends_on"))
    lists = d.groupBy(F.col("task_id").alias("id")).agg(F.sort_array(F.collect_list("depends_on")).alias("deps"), F.sort_array(F.collect_list(open_)).alias("blocked_by"))
    none = F.array().cast("array<string>")
    df = tasks.join(lists, "id", "left").withColumns({"deps": F.coalesce("deps", none), "blocked_by": F.coalesce("blocked_by", none)})
    return df.withColumn("ready", (F.col("state") == "pending") & (F.size("blocked_by") == 0))


def goal_progress(goals: DataFrame, tasks: DataFrame, task_goals: DataFrame) -> DataFrame:
    """One row for each goal; blocked counts as pending, failed only in the total; no task is 0 percent."""
    t = task_goals.join(tasks, task_goals["task_id"] == tasks["id"]).select("goal_id", "state", "assignee")
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    per = t.groupBy(F.col("goal_id").alias("id")).agg(F.count(F.lit(1)).alias("total"), n("done").alias("done"), n("running").alias("running"), n("review").alias("review"), n("pending", "blocked").alias("pending"), F.sort_array(F.collect_set("assignee")).alias("agents"))
    df = goals.select("id", "title").join(per, "id", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "done", "running", "review", "pending")}
    df = df.withColumns(counts).withColumn("agents", F.coalesce("agents", F.array().cast("array<string>")))
    return df.withColumn("percent", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("done") / F.col("total"), 6)))


def latest(df: DataFrame, keys: list[str], *order: Column, most: int = 1) -> DataFrame:
    """First row for each key, or the first `most`."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= most).drop("__rn")


def throughput(events: DataFrame, now: int, window_ms: int) -> DataFrame:
    kinds = {
        "tasks_completed": "task.completed", "tasks_started": "task.started", "tasks_reassigned": "task.reassigned", "leases_acquired": "lease.acquired",
        "leases_denied": "lease.denied", "leases_expired": "lease.expired", "handovers": "lease.transferred",
    }
    inside = events.filter(F.col("ts") >= now - window_ms)
    return inside.agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()], F.count_distinct("agent").alias("agents_active"))


def throughput_series(events: DataFrame, now: int, window_ms: int, buckets: int, kind: str) -> DataFrame:
    """Zero-filled counts; buckets are clamped to 1..240 and the last one takes the remainder."""
    n = max(1, min(240, buckets))
    width, since = max(1, window_ms // n), now - window_ms
    at = F.least(F.expr(f"(ts - {since}) div {width}"), F.lit(n - 1))
    counts = events.filter((F.col("ts") >= since) & (F.col("kind") == kind)).groupBy(at.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return events.sparkSession.range(n).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def recent(events: DataFrame, n: int) -> DataFrame:
    """The last n by id; filters come after."""
    return events.orderBy(F.desc("id")).limit(n)


def related(symbols: DataFrame, asked: DataFrame, others: DataFrame) -> DataFrame:
    """(symbol, other, relation) for each of `asked` (symbol) and each of `others` (other) that is the same, above or below it.

    Only the symbols asked for and the others walk up the containment tree; the rest of the table isn't closed over. What lies above
    is looked up once for each symbol that holds some of those asked for, not for each of them.
    """
    symbols = written(symbols.filter("parent_id is not null").select("id", "parent_id"), "nesting")  # each hop reads it
    mine = written(asked.select("symbol").distinct().join(symbols.withColumnRenamed("id", "symbol"), "symbol", "left"), "asked")
    leased = others.select("other").distinct()
    same = mine.select("symbol", F.col("symbol").alias("other")).distinct().join(leased, "other", "left_semi").select("symbol", "other", F.lit("same").alias("relation"))
    up = ancestors(symbols, mine.filter("parent_id is not null").select(F.col("parent_id").alias("start")).distinct())
    up = up.select(F.col("start").alias("parent_id"), F.col("id").alias("other")).join(leased, "other", "left_semi")
    above = mine.join(up, "parent_id").select("symbol", "other", F.lit("ancestor").alias("relation"))
    down = ancestors(symbols, leased.select(F.col("other").alias("start"))).filter("depth > 0").select(F.col("id").alias("symbol"), F.col("start").alias("other"), F.lit("descendant").alias("relation"))
    return same.unionByName(above).unionByName(down.join(mine.select("symbol"), "symbol", "left_semi"))


#: Tasks among which the symbols below one leased symbol are dealt.
WAYS = 16


def conflicts(leases: DataFrame, symbols: DataFrame, asking: DataFrame, now: int) -> DataFrame:
    """(symbol, agent, lease, holder, relation, ...): unexpired active leases of others on a symbol, what holds it and what it holds.

    asking: (symbol, agent), and what else shall go along. All leases on a file meet all that it holds, so rows grow with the product
    of both: they are made by the last join, which deals a file's symbols to WAYS tasks, and whoever asks joins nothing behind it.
    """
    live = leases.filter((F.col("state") == "active") & (F.col("expires_at") > now)).select(F.col("id").alias("lease"), F.col("symbol_id").alias("other"), F.col("agent").alias("holder"), F.col("expires_at"), F.col("priority"))
    met = asking.join(related(symbols, asking, live), "symbol").withColumn("way", F.pmod(F.xxhash64("symbol"), F.lit(WAYS)).cast("int"))
    against = live.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    return met.join(against, ["other", "way"]).filter("holder <> agent").select(*asking.columns, "lease", "holder", "relation", "other", "expires_at", "priority")


def waiter_ahead(queue: DataFrame, agent: str, priority: int, now: int, alive_ms: int = 15_000) -> DataFrame:
    """(symbol_id, id, agent) of the head of each line, where the head is someone else, still polls and beats the agent's place.

    Without a place in line the agent asks with `priority`, behind all of that priority.
    """
    waiting = queue.filter("state = 'waiting'")
    head = latest(waiting.filter(F.col("agent") != agent), ["symbol_id"], F.desc("priority"), F.col("seq"))
    mine = latest(waiting.filter(F.col("agent") == agent), ["symbol_id"], F.col("seq")).select("symbol_id", F.col("priority").alias("own"), F.col("seq").alias("place"))
    both = head.filter(F.col("polled_at") >= now - alive_ms).join(mine, "symbol_id", "left")
    own = F.coalesce("own", F.lit(priority))
    return both.filter((F.col("priority") > own) | ((F.col("priority") == own) & (F.col("seq") < F.coalesce("place", F.lit((1 << 63) - 1))))).select("symbol_id", "id", "agent")


def service_links(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): the services of two files one of which imports the other; repeated where several files do."""
    files = symbols.filter("kind = 'file' and parent_id is not null").select("id", "parent_id")
    e = edges.filter("kind = 'imports'").join(files.select(F.col("id").alias("src"), F.col("parent_id").alias("a")), "src")
    return e.join(files.select(F.col("id").alias("dst"), F.col("parent_id").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def edge_set(edges: DataFrame) -> DataFrame:
    """Each (src, dst, kind) once."""
    return edges.select("src", "dst", "kind").distinct()


def neighbor_lists(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, callers, callees, children): sorted arrays of (kind, other) for each symbol that has any. A list is as long as a symbol has neighbours."""
    side = lambda df, name: df.select("id", F.lit(name).alias("side"), F.struct("kind", "other").alias("n"))
    nested = symbols.filter("parent_id is not null").select(F.col("parent_id").alias("id"), F.lit("contains").alias("kind"), F.col("id").alias("other"))
    rows = side(neighbours(edges, symbols, incoming=True), "callers").unionAll(side(neighbours(edges, symbols, incoming=False), "callees")).unionAll(side(nested, "children"))
    return rows.groupBy("id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == x, F.col("n")))).alias(x) for x in ("callers", "callees", "children")])


def tests_reaching(edges: DataFrame, symbols: DataFrame, most: int = 15) -> DataFrame:
    """(id, test): the first tests in order of id that reach a symbol, over an edge of kind tests or from a symbol with that role."""
    e = edges.filter("kind <> 'contains'").join(symbols.select(F.col("id").alias("src"), "role"), "src")
    hit = e.filter((F.col("kind") == "tests") | (F.col("role") == "test")).select(F.col("dst").alias("id"), F.col("src").alias("test")).distinct()
    return hit.withColumn("__rn", F.row_number().over(W.partitionBy("id").orderBy("test"))).filter(F.col("__rn") <= most).drop("__rn")


def agent_view(agents: DataFrame, leases: DataFrame, task_goals: DataFrame, now: int, alive_ms: int = 60_000) -> DataFrame:
    """Agents with online, the number of active leases (unswept ones too), and the task of the first of them that names one, with its goal."""
    held = leases.filter("state = 'active'").groupBy(F.col("agent").alias("name")).agg(F.count(F.lit(1)).alias("leases"), F.min_by(F.when(F.col("task").isNotNull(), F.col("task")), F.when(F.col("task").isNotNull(), F.struct("acquired_at", "id"))).alias("current_task"))
    goal = task_goals.select(F.col("task_id").alias("current_task"), F.col("goal_id").alias("current_goal"))
    df = agents.join(held, "name", "left").withColumn("leases", F.coalesce("leases", F.lit(0))).withColumn("online", F.lit(now) - F.col("heartbeat_at") <= alive_ms)
    return df.join(goal, "current_task", "left")


def keyword_matches(symbols: DataFrame, text: str, most: int = 50) -> DataFrame:
    """Symbols that match a keyword of a goal's text, in the order of the first keyword that finds them; `place` counts from 1.

    Each keyword finds at most `most`; a text has few keywords, each of which is one top-k over the symbols.
    """
    one_row = symbols.sparkSession.range(1)
    forms = one_row.select(keywords(F.lit(text)).alias("k")).first().k
    found = None
    for i, form in enumerate(forms):
        hit = list_symbols(symbols, pattern=form, limit=most).withColumn("form", F.lit(i))
        found = hit if found is None else found.unionAll(hit)
    if found is None:
        return symbols.limit(0).withColumn("place", F.lit(0).cast("long"))
    first = found.withColumn("__rn", F.row_number().over(W.partitionBy("id").orderBy("form"))).filter("__rn = 1")
    return first.withColumn("place", F.row_number().over(W.orderBy("form", *SYMBOL_ORDER)).cast("long")).drop("__rn", "form")  # at most `most` rows a keyword


#: Tags of memory that is read before any work.
STANDING_TAGS = ["architecture", "convention", "decision", "interface", "standard"]


def is_standing(tags: Column) -> Column:
    return F.arrays_overlap(F.transform(F.split(tags, ","), lambda t: F.lower(t)), F.array(*map(F.lit, STANDING_TAGS)))


def memory_near(memory: DataFrame, names: list[str], most: int = 20) -> DataFrame:
    """The newest entries that are standing or name one of the given names or paths (of three bytes or more) in key or value, in any case."""
    hay = F.lower(F.concat_ws(" ", "key", "value"))
    near = is_standing(F.col("tags"))
    for n in sorted({n.lower() for n in names if len(n.encode()) >= 3}):
        near = near | hay.contains(n)
    return memory.filter(F.coalesce(near, F.lit(False))).orderBy(F.desc("updated_at"), "key").limit(most)


def _rule_key(glob: str) -> tuple[str, str | None] | None:
    """What a path must have for a glob to match it: a folder at or above it, or an ending; and the pattern to test behind that, if any. None: nothing of the kind."""
    g = glob.lstrip("/")
    segments = g.rstrip("/").split("/")
    plain = next((i for i, x in enumerate(segments) if re.search(r"[*?\[{]", x)), len(segments))
    if plain == len(segments):
        folder = "/".join(segments)
        return f"dir:{folder}", (glob_pattern(glob) if g.endswith("/") else None)
    if plain:
        return f"dir:{'/'.join(segments[:plain])}", glob_pattern(glob)
    ending = re.search(r"\.(\w+)$", g)
    return (f"end:{ending[1]}", glob_pattern(glob)) if ending else None


def owner_rule(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(path, rule_no, owner) of the last glob that matches; rules: (glob, owners) in file order.

    A path looks up its own folders and its ending among the rules, an equi-join, and tests the patterns that it meets. Only globs
    without a literal folder or ending, such as `*`, are tested on every path.
    """
    spark = paths.sparkSession
    keys = [(i, _rule_key(g)) for i, (g, _) in enumerate(rules)]
    loose = [(i, rules[i][0]) for i, k in keys if k is None]
    own = paths.select("path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("dir:"), F.array_join(F.slice(parts, 1, n), "/")))
    ending = F.concat(F.lit("end:"), F.regexp_extract("path", r"\.(\w+)$", 1))
    table = spark.createDataFrame([(k[0], i, k[1]) for i, k in keys if k], "key string, rule_no long, pattern string")
    met = own.select("path", F.explode(F.concat(above, F.array(ending))).alias("key")).join(table, "key")
    met = met.filter(F.col("pattern").isNull() | F.expr("path rlike pattern")).groupBy("path").agg(F.max("rule_no").alias("indexed"))
    last = F.coalesce(*[F.when(F.col("path").rlike(glob_pattern(g)), F.lit(i)) for i, g in reversed(loose)], F.lit(-1)).cast("long")
    found = own.join(met, "path", "left").select("path", F.greatest(last, F.coalesce("indexed", F.lit(-1).cast("long"))).alias("rule_no"))
    owners = spark.createDataFrame([(i, o) for i, (_, o) in enumerate(rules)], "rule_no long, owner string")
    return paths.join(found.join(owners, "rule_no", "left"), "path").select("path", "rule_no", "owner")


def owners_by_owner(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(owner, patterns) in file order."""
    rows = spark.createDataFrame([(i, p, o) for i, (p, owners) in enumerate(rules) for o in owners.split()], "rule_no long, pattern string, owner string")
    return rows.groupBy("owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("rule_no", "pattern"))), lambda x: x["pattern"]).alias("patterns"))


def owner_rules(text: str) -> list[tuple[str, str]]:
    """(glob, owners) of an ownership file: comments and lines without an owner don't count."""
    lines = (line.partition("#")[0].split() for line in text.splitlines())
    return [(words[0], " ".join(words[1:])) for words in lines if len(words) > 1]


def _glob(text: str) -> str:
    """A glob as a regular expression; * and ? go over slashes too, [..] is a class, {a,b} a choice."""
    out, i, depth = "", 0, 0
    while i < len(text):
        x = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        close = text.find("]", i + 2) if x == "[" else -1
        if x == "*":
            while text[i + 1 : i + 2] == "*":
                i += 1
            out += ".*"
        elif x == "?":
            out += "."
        elif close > 0:
            inner = text[i + 1 : close].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", close
        elif x == "{":
            out, depth = out + "(?:", depth + 1
        elif x == "}" and depth:
            out, depth = out + ")", depth - 1
        elif x == "," and depth:
            out += "|"
        else:
            out += "\\" + x if x in ".+()[]{}^$|\\" else x
        i += 1
    return out


def glob_pattern(glob: str) -> str:
    """Regular expression of an ownership glob over paths from the root.

    `*` owns all; a folder (`a/`) what is in it; a glob with a slash is matched from the root, one without at any depth; a
    plain path owns itself and what is below it.
    """
    g = glob.lstrip("/")
    if g == "*":
        return "^.*$"
    if g.endswith("/"):
        return f"^{_glob(g)}.+$"
    if "*" in g or "?" in g:
        return f"^{_glob(g)}$" if "/" in g else f"^(?:.*/)?{_glob(g)}$"
    return f"^{_glob(g)}(?:/.+)?$"


#: Letters of a keyword that it is looked up by, and keywords that are looked up in one reading of the symbols.
PIECE, KEYWORDS = 6, 200_000


def goal_matches(goals: DataFrame, symbols: DataFrame, most: int = 50) -> DataFrame:
    """(goal, id, place): keyword_matches for the texts of many goals (goal, text) at once.

    A symbol is held against all keywords where it is read: each piece of its text that is as long as a keyword, or as the last PIECE
    letters of a longer one, is looked up among the keywords, and only what has the whole keyword goes on, so that no list of a piece's
    symbols is ever moved. A keyword that many goals have is looked up once. Keywords are broadcast, KEYWORDS at a time.
    """
    asked = written(goals.select("goal", F.posexplode(keywords(F.col("text"))).alias("i", "form")), "asked")
    forms, n = counted(asked.select("form").distinct().withColumn("key", F.expr(f"right(form, {PIECE})")), "forms")
    lengths = [x.n for x in forms.select(F.length("key").alias("n")).distinct().collect()]  # at most PIECE
    hay = F.lower(F.concat_ws("\n", "name", "fqn", "path"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("hay") - n + 1, F.lit(1))), lambda i: F.col("hay").substr(i, F.lit(n)))
    read = spread(symbols.select("id", "path", "start_byte", hay.alias("hay")), "id")
    read = read.select("*", F.explode(F.array_distinct(F.flatten(F.array(*map(cut, lengths))) if lengths else F.array().cast("array<string>"))).alias("key"))
    blocks, found = max(1, -(-n["n"] // KEYWORDS)), None
    for block in range(blocks):
        mine = forms.filter(F.pmod(F.xxhash64("form"), F.lit(blocks)) == block)
        hit = read.join(F.broadcast(mine), "key").filter(F.contains("hay", "form")).select("form", "path", "start_byte", "id")  # bounded by KEYWORDS
        found = hit if found is None else found.unionAll(hit)
    top = W.partitionBy("form").orderBy("path", "start_byte", "id")
    found = written(found.withColumn("rn", F.row_number().over(top)).filter(F.col("rn") <= most).select("form", "id", "rn"), "found")
    first = asked.join(found, "form").groupBy("goal", "id").agg(F.min(F.struct("i", "rn")).alias("at"))
    return first.select("goal", "id", F.row_number().over(W.partitionBy("goal").orderBy("at.i", "at.rn", "id")).cast("long").alias("place"))
