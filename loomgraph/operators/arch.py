"""The repository collapsed to boxes: services, their folders or their files, with what they hold, how they depend on one another and who is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import handle, leaf, parent_dir
from loomgraph.operators import graph as g
from loomgraph.operators import relational as r
from loomgraph.operators.source_text import parents_of

#: How many of a box's symbols, reached symbols and events its panel shows; how many events are looked back on.
SYMBOLS, IMPACT, EVENTS, LOOK_BACK, RECENT_MS = 50, 40, 20, 300, 3_600_000


def layout(symbols: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Boxes (id, kind, name, path, repo_id, parent) and the box of each file (repo_id, path, box); depth 1: services, 2: folders, 3: files.

    A file belongs to the service whose folder is the longest above it (the folder of the service's path), else to a box for its
    repository. Tables are boxes of their own. A path looks its parents up, so nothing is compared by prefix.
    """
    depth = max(1, min(3, depth))
    c = F.col
    services = symbols.filter("kind = 'service'").select("repo_id", F.when(c("path").contains("/"), parent_dir(c("path"))).otherwise("").alias("root"), c("id").alias("service"), c("name").alias("service_name"), c("path").alias("service_path"))
    files = symbols.filter("kind = 'file'").select("repo_id", "path", c("id").alias("file"))
    up = files.select("repo_id", "path", F.explode(F.array_append(parents_of(c("path")), c("path"))).alias("root"))
    best = up.join(services, ["repo_id", "root"]).groupBy("repo_id", "path").agg(F.max(F.struct(F.length("root").alias("n"), c("service").alias("service"), c("root").alias("root"), c("service_name").alias("service_name"))).alias("s"))
    loose = F.concat(F.lit("repo:"), "repo_id")
    owned = files.join(best, ["repo_id", "path"], "left").select("repo_id", "path", "file", c("s.service").alias("service"), F.coalesce("s.service", loose).alias("top"), F.coalesce("s.root", F.lit("")).alias("root"), F.coalesce("s.service_name", "repo_id").alias("top_name"))
    null = F.lit(None).cast("string")

    def box(df: DataFrame, id_: Column, kind: str, name: Column, path: Column, parent: Column) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), F.when(name == "", "(root)").otherwise(name).alias("name"), path.alias("path"), "repo_id", parent.alias("parent")).distinct()

    boxes = box(services, c("service"), "service", c("service_name"), c("service_path"), null)
    boxes = boxes.unionByName(box(owned.filter("service is null"), c("top"), "repo", c("repo_id"), null, null))
    boxes = boxes.unionByName(box(symbols.filter("kind = 'table'"), c("id"), "table", c("name"), c("path"), null))
    if depth == 1:
        return boxes, owned.select("repo_id", "path", c("top").alias("box"))
    if depth == 3:
        boxes = boxes.unionByName(box(owned, c("file"), "file", leaf(c("path")), c("path"), c("top")))
        return boxes, owned.select("repo_id", "path", c("file").alias("box"))
    rest = F.when(c("root") == "", c("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    below = F.substring_index(rest, "/", 1)
    folder = F.when(rest.contains("/"), F.when(c("root") == "", below).otherwise(F.concat_ws("/", "root", below))).otherwise(F.when(c("path").contains("/"), parent_dir(c("path"))).otherwise(""))
    owned = owned.withColumn("folder", folder).withColumn("box", F.concat(F.lit("dir:"), "repo_id", F.lit(":"), "folder"))
    # Files of one folder can belong to several services; the first in order names the box.
    first = owned.groupBy("box", "repo_id", "folder").agg(F.min(F.struct("path", "top", "top_name")).alias("s"))
    boxes = boxes.unionByName(box(first, c("box"), "dir", F.concat(c("s.top_name"), F.lit("/"), leaf(c("folder"))), c("folder"), c("s.top")))
    return boxes, owned.select("repo_id", "path", "box")


def rolled_up(boxes: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (box, …) once for their box and once for its parent, as `node`. There are two levels at most."""
    parent = boxes.filter("parent is not null").select(F.col("id").alias("box"), "parent")
    return rows.withColumn("node", F.col("box")).unionByName(rows.join(parent, "box").withColumnRenamed("parent", "node").select(*rows.columns, "node"))


def counts(symbols: DataFrame, boxes: DataFrame, owner: DataFrame) -> DataFrame:
    """(node, files, symbols, endpoints, tests), with what the boxes below hold."""
    inside = symbols.filter("kind not in ('service', 'table')").select("repo_id", "path", "kind", "role").join(owner, ["repo_id", "path"])
    c = F.col
    per = inside.groupBy("box").agg(F.count_if(c("kind") == "file").alias("files"), F.count_if(c("kind") != "file").alias("symbols"), F.count_if((c("kind") != "file") & (c("role") == "api")).alias("endpoints"), F.count_if((c("kind") != "file") & (c("role") == "test")).alias("tests"))
    return rolled_up(boxes, per).groupBy("node").agg(*[F.sum(x).alias(x) for x in ("files", "symbols", "endpoints", "tests")])


def box_of_symbols(symbols: DataFrame, boxes: DataFrame, owner: DataFrame) -> DataFrame:
    """(id, box) of each symbol that lies in a box; a table is its own."""
    tables = symbols.filter("kind = 'table'").select("id", F.col("id").alias("box"))
    return symbols.filter("kind <> 'table'").join(owner, ["repo_id", "path"]).select("id", "box").unionByName(tables)


def box_edges(symbols: DataFrame, edges: DataFrame, boxes: DataFrame, owner: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): how many import and query edges go from box to box; none within one."""
    at = box_of_symbols(symbols, boxes, owner)
    e = edges.filter("kind in ('imports', 'queries')").join(at.select(F.col("id").alias("src"), F.col("box").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("box").alias("b")), "dst")
    return e.filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst"), "kind").agg(F.count(F.lit(1)).alias("weight"))


def overlay(symbols: DataFrame, boxes: DataFrame, owner: DataFrame, leases: DataFrame, activity: DataFrame, tasks: DataFrame, task_symbols: DataFrame, task_goals: DataFrame, events: DataFrame, now: int, live_ms: int = 60_000) -> DataFrame:
    """(node, leases, workers, activity, tasks, goals, review_pending, changed_recently) of the boxes where anything is going on.

    workers: agents with an active lease or a live edit window inside; changed_recently: of the last 500 events those of the last
    hour that name a file inside. Rolled up to the parents like the counts.
    """
    c = F.col
    at = symbols.select(c("id").alias("symbol_id"), "repo_id", "path").join(owner, ["repo_id", "path"]).select("symbol_id", "box")
    row = ("box", "what", "key", "flag")
    held = leases.filter("state = 'active'").join(at, "symbol_id")
    parts = [
        held.select("box", F.lit("lease").alias("what"), c("id").alias("key"), F.lit(0).alias("flag")),
        held.select("box", F.lit("worker").alias("what"), c("agent").alias("key"), F.lit(0).alias("flag")),
    ]
    open_ = activity.filter(c("updated_at") >= now - live_ms).join(owner, ["repo_id", "path"])
    parts += [open_.select("box", F.lit(x).alias("what"), (F.concat_ws(" ", "agent", "path") if x == "activity" else c("agent")).alias("key"), F.lit(0).alias("flag")) for x in ("activity", "worker")]
    scope = tasks.select(c("id").alias("task_id"), (c("state") == "review").cast("int").alias("flag")).join(task_symbols, "task_id").join(at, "symbol_id")
    parts.append(scope.select("box", F.lit("task").alias("what"), c("task_id").alias("key"), "flag"))
    parts.append(scope.join(task_goals, "task_id").select("box", F.lit("goal").alias("what"), c("goal_id").alias("key"), F.lit(0).alias("flag")))
    recent = r.recent(events, 500).filter((c("ts") >= now - RECENT_MS) & c("symbol_handle").isNotNull())
    file_of = owner.groupBy("path").agg(F.min(F.struct("repo_id", "box")).alias("o")).select("path", c("o.box").alias("box"))
    parts.append(recent.select(F.substring_index("symbol_handle", ":", 1).alias("path"), c("id").cast("string").alias("key")).join(file_of, "path").select("box", F.lit("event").alias("what"), "key", F.lit(0).alias("flag")))
    rows = parts[0].select(*row)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*row))
    seen = rolled_up(boxes, rows).select("node", "what", "key", "flag").distinct()
    n = lambda what: F.count_if(c("what") == what)
    keys = lambda what: F.sort_array(F.collect_set(F.when(c("what") == what, c("key"))))
    return seen.groupBy("node").agg(n("lease").alias("leases"), keys("worker").alias("workers"), keys("activity").alias("activity"), keys("task").alias("tasks"), keys("goal").alias("goals"), F.count_if((c("what") == "task") & (c("flag") == 1)).alias("review_pending"), n("event").alias("changed_recently"))


def cycles(links: DataFrame) -> DataFrame:
    """(node, component) of boxes on import cycles. Cycles that share a box are one component."""
    return g.components_of_cycles(links.filter("kind = 'imports'").select(F.col("src").alias("a"), F.col("dst").alias("b")))


def node_panel(node: str, symbols: DataFrame, edges: DataFrame, boxes: DataFrame, owner: DataFrame, leases: DataFrame, events: DataFrame) -> DataFrame:
    """(section, key, value) of one box: depends_on, depended_on_by, tables, children, symbols, routes, held, impact, events.

    Symbols and events are the first 50 in order and the newest 20 of the last 300; impact only of boxes that are symbols.
    """
    c = F.col
    links = box_edges(symbols, edges, boxes, owner)
    kinds = boxes.select("id", "kind", "name")
    section = lambda df, name, key, value: df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    to = lambda df, end: df.select(c(end).alias("id")).join(kinds, "id")
    out = [
        section(to(links.filter((c("src") == node) & (c("kind") == "imports")), "dst"), "depends_on", c("id"), c("name")),
        section(to(links.filter((c("dst") == node) & (c("kind") == "imports")), "src"), "depended_on_by", c("id"), c("name")),
        section(to(links.filter((c("src") == node) & (c("kind") == "queries")), "dst"), "tables", c("id"), c("name")),
        section(boxes.filter(c("parent") == node), "children", c("id"), c("name")),
    ]
    mine = rolled_up(boxes, owner.select("box", "repo_id", "path")).filter(c("node") == node).select("repo_id", "path").distinct()
    own_path = boxes.filter((c("id") == node) & (c("kind") == "table")).select("repo_id", "path")
    paths = mine.unionByName(own_path).distinct()
    inside = symbols.join(paths, ["repo_id", "path"], "left_semi")
    shown = handle(c("path"), c("kind"), c("name"), c("fqn"))
    out.append(section(inside.filter("kind not in ('file', 'service')").orderBy("path", "start_byte", "id").limit(SYMBOLS), "symbols", c("id"), shown))
    out.append(section(inside.filter("role = 'api'"), "routes", c("id"), shown))
    held = r.with_handle(leases.filter("state = 'active'"), symbols, "symbol_id").withColumn("path", F.substring_index("symbol_handle", ":", 1))
    out.append(section(held.join(paths.select("path").distinct(), "path", "left_semi"), "held", c("id"), c("agent")))
    seed = symbols.filter(c("id") == node).select(c("id").alias("seed"))
    hit = g.impact(edges, seed, 2).join(symbols.select("id", "path", "start_byte"), "id").orderBy("distance", "path", "start_byte", "id").limit(IMPACT)
    out.append(section(hit, "impact", c("id"), c("distance")))
    seen = r.recent(events, LOOK_BACK).withColumn("path", F.substring_index("symbol_handle", ":", 1)).join(paths.select("path").distinct(), "path", "left_semi")
    out.append(section(seen.orderBy(F.desc("id")).limit(EVENTS), "events", c("id"), c("kind")))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows
