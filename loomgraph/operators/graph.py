"""Graph operators as bounded iterations of joins over written frontiers."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.sources.tables import counted, dropped, tidy, written

def _nested(links: DataFrame, level: DataFrame, key: str, hops: int) -> DataFrame:
    """(key, id, depth) of what lies below level (key, id, depth 0) along links (id, next), which are a forest; `hops` levels are written at a time."""
    found, base, most = level.limit(0), 0, None
    while True:
        rows, steps = level, []
        for _ in range(hops):
            rows = rows.join(links, "id").select(key, F.col("next").alias("id"), (F.col("depth") + 1).alias("depth"))
            steps.append(rows)
        made = steps[0]
        for more in steps[1:]:
            made = made.unionAll(more)
        made, n = counted(made, "nested")
        if not n["n"]:
            return found
        found, base = found.unionAll(made), base + hops
        level = made.filter(F.col("depth") == base)
        if base % 64 == 0:  # a way longer than all links together is a circle
            most = most or links.count()
            if base > most:
                raise ValueError("containment has a circle")


def descendants(symbols: DataFrame, roots: DataFrame, hops: int = 2) -> DataFrame:
    """(root, id, depth) of all nested symbols of `roots` (root), whatever their depth."""
    links = symbols.filter("parent_id is not null").select(F.col("parent_id").alias("id"), F.col("id").alias("next"))
    return _nested(links, roots.select("root", F.col("root").alias("id"), F.lit(0).cast("long").alias("depth")), "root", hops)


def ancestors(symbols: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(start, id, depth): each symbol itself at depth 0, then outward, whatever the depth."""
    links = symbols.filter("parent_id is not null").select("id", F.col("parent_id").alias("next"))
    level = starts.select("start", F.col("start").alias("id"), F.lit(0).cast("long").alias("depth"))
    return level.unionAll(_nested(links, level, "start", hops))


def impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, distance): what reaches a seed over edges other than containment within `depth` steps, at its least distance.

    The frontier is distinct and without what was reached before, so cycles end and rows don't multiply with paths.
    """
    into = edges.filter("kind <> 'contains'").select("src", "dst").distinct()
    reached = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).cast("long").alias("distance"))
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.join(into, frontier["id"] == into["dst"]).select("seed", F.col("src").alias("id")).distinct()
        frontier = written(step.join(reached, ["seed", "id"], "left_anti").withColumn("distance", F.lit(d).cast("long")), "impact")
        reached = reached.unionAll(frontier)
    return reached.filter("distance > 0")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of what reaches any of `seeds` (id), without the seeds: one search from all of them, so a symbol is a row whatever the number of seeds."""
    into = edges.filter("kind <> 'contains'").select("src", "dst").distinct()
    reached = seeds.select("id").distinct().withColumn("distance", F.lit(0).cast("long"))
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.join(into, frontier["id"] == into["dst"]).select(F.col("src").alias("id")).distinct()
        frontier = written(step.join(reached, "id", "left_anti").withColumn("distance", F.lit(d).cast("long")), "reach")
        reached = reached.unionAll(frontier)
    return reached.filter("distance > 0")


def along(links: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Follow links (id, to), one for each id, to their ends, by steps that double.

    Returns jumps, where jumps[k] has (id, to, least) of what lies 2^k links on among the ids and the smallest node on the way;
    ends (id, end, dist), the first node that is no id and its distance; and the last jump of those that never end, as their way
    leads into a cycle. A round is one join of a row an id at most, and rounds grow with the logarithm of the longest way.
    """
    ids = links.select(F.col("id").alias("to"))
    none, left = F.lit(None), {"left": F.count_if(F.col("end").isNull()), "met": F.count_if(F.col("end").isNull() & (F.col("least") == F.col("id")))}
    first = links.join(ids.withColumn("inside", F.lit(True)), "to", "left")
    made, n = counted(first.select("id", "to", F.col("to").alias("least"), F.when(F.col("inside").isNull(), F.col("to")).alias("end"), F.lit(1).cast("long").alias("dist")), "along", **left)
    jumps, ends, steps, before, image = [], made.filter("end is not null").select("id", "end", "dist"), 1, -1, -1
    while True:
        jump = made.filter("end is null").select("id", "to", "least")
        if not n["left"]:
            return jumps, ends, jump
        jumps.append(jump)
        # Nothing ran off in this round, what is reached grows no smaller, so it is all on cycles, and each cycle has met its smallest node.
        if n["left"] == before and n["met"]:
            reached, image = image, jump.agg(F.count_distinct("to")).first()[0]
            if reached == image and _all_closed(jump):
                return jumps, ends, jump
        before = n["left"]
        on = ends.select(F.col("id").alias("to"), "end", F.col("dist").alias("more"), none.cast("string").alias("next"), none.cast("string").alias("low"))
        on = on.unionByName(jump.select(F.col("id").alias("to"), none.cast("string").alias("end"), none.cast("long").alias("more"), F.col("to").alias("next"), F.col("least").alias("low")))
        made, n = counted(jump.join(on, "to").select("id", F.col("next").alias("to"), F.least("least", "low").alias("least"), "end", (F.col("more") + steps).alias("dist")), "along", **left)
        ends = ends.unionAll(made.filter("end is not null").select("id", "end", "dist"))
        steps *= 2


def _all_closed(jump: DataFrame) -> bool:
    """Whether the smallest nodes that lie ahead of what is reached have met themselves."""
    leaders = jump.filter("least = id").select(F.col("id").alias("least"))
    reached = jump.join(jump.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
    return reached.join(leaders, "least", "left_anti").isEmpty()


def passed(starts: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(id, label) of all that lies on the way from starts (id, label) along the jumps, the starts too: each jump, the longest first, doubles what is known."""
    for jump in reversed(jumps):
        more = starts.join(jump.select("id", F.col("to").alias("next")), "id").select(F.col("next").alias("id"), "label")
        starts = written(starts.unionByName(more).distinct(), "passed")
    return starts


def trim_to_cycles(links: DataFrame, n: int, hops: int = 3) -> tuple[DataFrame, int]:
    """Links (a, b) without many of those whose ends lie on no cycle, and their number; n: about how many there are.

    A round takes nodes without an incoming or an outgoing link away, `hops` times before it is written. It ends when a round
    takes away less than a fiftieth: the search that follows doesn't need the rest to be gone.
    """
    while True:
        kept = links
        for _ in range(hops):
            kept = kept.join(kept.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(kept.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
        links, left = counted(kept, "trim")
        if not left["n"] or n - left["n"] < max(1, n // 50):
            return links, left["n"]
        n = left["n"]


@tidy
def components_of_cycles(links: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components with more than one node or a self link; component: smallest node.

    Nodes with one outgoing link are chains: they are followed by doubling, which finds the cycles that are made of them alone. What
    is left is a graph of the nodes with several outgoing links, each led along a chain to the next of its kind; its components
    are found by labels, and the chains between two nodes of one component belong to it.
    """
    per = F.count(F.lit(1)).over(W.partitionBy("a"))
    links, n = counted(links.select(F.col("a").cast("string"), F.col("b").cast("string")).distinct().withColumn("n", per), "links", forks=F.count_if(F.col("n") > 1))
    jumps, ends, basin = along(links.filter("n = 1").select(F.col("a").alias("id"), F.col("b").alias("to")))
    found = basin.join(basin.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("node"), F.col("least").alias("component"))
    if n["forks"]:
        forks = links.filter("n > 1").select("a", "b")
        ways = ends.join(forks.select(F.col("a").alias("end")).distinct(), "end", "left_semi").select(F.col("id").alias("b"), "end")
        led = forks.join(ways, "b", "left").join(forks.select(F.col("a").alias("b")).distinct().withColumn("fork", F.lit(True)), "b", "left")
        led, n = counted(led.select("a", F.col("b").alias("first"), F.coalesce("end", F.when(F.col("fork"), F.col("b"))).alias("b")).filter("b is not null"), "led")
        parts = _components_by_labels(led.select("a", "b").distinct(), n["n"])
        if jumps or not ends.isEmpty():
            a, b = (parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
            inner = led.join(a, "a").join(b, "b").filter("ca = cb and first <> b").select(F.col("first").alias("id"), F.col("ca").alias("label"))
            between = passed(inner.distinct(), jumps).select(F.col("id").alias("node"), F.col("label").alias("component"))
            # A component's smallest node can be one of a chain.
            whole = parts.unionByName(between).distinct()
            least = whole.groupBy("component").agg(F.min("node").alias("least"))
            parts = whole.join(least, "component").select("node", F.col("least").alias("component"))
        found = found.unionByName(parts)
    return found


def _components_by_labels(links: DataFrame, n: int) -> DataFrame:
    """The same by two labels a node: the smallest node that reaches it and the smallest one that it reaches. Where they are equal, that node is its component's.

    A round passes labels on along all links, both ways, and by way of the nodes they name, which halves what is left. Then links
    between nodes with other labels can't lie on a cycle; what is left without the components that are found is searched again.
    """
    found = None
    links, n = trim_to_cycles(links, n)
    while n:
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        label, changed = nodes.select("node", F.col("node").alias("behind"), F.col("node").alias("ahead")), 1
        while changed:
            told = links.join(label, links["a"] == label["node"]).select(F.col("b").alias("node"), "behind", F.lit(None).cast("string").alias("ahead"))
            told = told.unionByName(links.join(label, links["b"] == label["node"]).select(F.col("a").alias("node"), F.lit(None).cast("string").alias("behind"), "ahead"))
            own = label.select("node", "behind", "ahead", F.col("behind").alias("b0"), F.col("ahead").alias("a0")).unionByName(told, allowMissingColumns=True)
            step = own.groupBy("node").agg(*[F.min(x).alias(x) for x in ("behind", "ahead", "b0", "a0")])
            by = lambda x, name: step.select(F.col("node").alias(x), F.col(x).alias(name))  # noqa: B023, E731
            step = step.join(by("behind", "b2"), "behind").join(by("ahead", "a2"), "ahead")
            step = step.select("node", F.least("behind", "b2").alias("behind"), F.least("ahead", "a2").alias("ahead"), "b0", "a0")
            label, seen = counted(step, "labels", changed=F.count_if((F.col("behind") < F.col("b0")) | (F.col("ahead") < F.col("a0"))))
            label, changed = label.select("node", "behind", "ahead"), seen["changed"]
        a, b = (label.withColumnsRenamed({"node": x, "behind": f"{x}_behind", "ahead": f"{x}_ahead"}) for x in "ab")
        same = links.join(a, "a").join(b, "b").filter("a_behind = b_behind and a_ahead = b_ahead")
        # A node alone is a component only with a link to itself.
        part = same.filter("a_behind = a_ahead").select(F.col("a").alias("node"), F.col("a_behind").alias("component")).distinct()
        found = part if found is None else found.unionAll(part)
        links, n = trim_to_cycles(same.filter("a_behind <> a_ahead").select("a", "b"), n)
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return found


def would_cycle(asked: DataFrame, deps: DataFrame) -> DataFrame:
    """(task_id, depends_on, closes) for each pair of `asked`: whether the new dependency would close a cycle with those of `deps`, that is, whether depends_on reaches task_id.

    All pairs are searched at once, over frontiers of distinct (start, node); each round follows the links of the last one.
    """
    links = deps.select(F.col("task_id").alias("node"), F.col("depends_on").alias("next")).distinct()
    pairs = asked.select("task_id", "depends_on").distinct()
    starts = pairs.select(F.col("depends_on").alias("start")).distinct()
    seen = frontier = written(starts.withColumn("node", F.col("start")), "reach")
    while True:
        step = frontier.join(links, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = written(step.join(seen, ["start", "node"], "left_anti"), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    hit = seen.select(F.col("start").alias("depends_on"), F.col("node").alias("task_id")).distinct().withColumn("hit", F.lit(True))
    return pairs.join(hit, ["task_id", "depends_on"], "left").select("task_id", "depends_on", F.coalesce("hit", F.lit(False)).alias("closes"))


@tidy
def waves(tasks: DataFrame, deps: DataFrame, cyclic: DataFrame, most: int | None = 64) -> DataFrame:
    """(id, level) of pending and blocked tasks off cycles: a task's level is the longest chain of unmet dependencies below it; tasks behind open work that is in no wave have none, nor those at `most` or above. Without `most` all levels are found.

    Tasks with one unmet dependency are chains, which are followed by doubling. Those with several take the largest level of theirs
    plus its distance once all are known, a round for each that lies behind another.
    """
    open_ = written(tasks.filter("state in ('pending', 'blocked')").select("id").join(cyclic.select(F.col("node").alias("id")), "id", "left_anti"), "open")
    known = tasks.filter("state <> 'done'").select(F.col("id").alias("to"))
    unmet = deps.select(F.col("task_id").alias("id"), F.col("depends_on").alias("to")).distinct().join(open_, "id", "left_semi").join(known, "to", "left_semi")
    per = F.count(F.lit(1)).over(W.partitionBy("id"))
    unmet, n = counted(unmet.select("id", "to", per.alias("n")), "unmet", several=F.count_if(F.col("n") > 1))
    roots = open_.join(unmet.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(0).cast("long"))
    _, ends, _ = along(unmet.filter("n = 1").select("id", "to"))
    several = unmet.filter("n > 1").select("id", "to")
    fixed = roots
    if n["several"]:
        led = several.join(ends.withColumnsRenamed({"id": "to"}), "to", "left").select("id", F.coalesce("end", "to").alias("on"), (F.coalesce("dist", F.lit(0)) + 1).alias("more"))
        waiting = written(led.groupBy("id", "on").agg(F.max("more").alias("more")).withColumn("level", F.lit(None).cast("long")), "waiting")
        new, fixed = roots, written(roots, "levels")
        for _ in count() if most is None else range(most):  # a round without a new level is the last one
            told = waiting.join(new.select(F.col("id").alias("on"), F.col("level").alias("now")), "on", "left")
            waiting, before = written(told.select("id", "on", "more", F.coalesce("level", F.col("now") + F.col("more")).alias("level")), "waiting"), waiting
            dropped(before)
            ready = waiting.groupBy("id").agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("left")).filter("left = 0").select("id", "level")
            new, more = counted(ready, "levels")
            if not more["n"]:
                break
            fixed = fixed.unionByName(new)
            waiting, before = written(waiting.join(new, "id", "left_anti"), "waiting"), waiting
            dropped(before)
    chained = ends.join(fixed.withColumnsRenamed({"id": "end"}), "end").select("id", (F.col("level") + F.col("dist")).alias("level"))
    found = fixed.unionByName(chained)
    return found if most is None else found.filter(F.col("level") < most)


@tidy
def critical_path(levels: DataFrame, deps: DataFrame) -> DataFrame:
    """(step, id) of a longest chain: from the deepest task (smallest id) back, each time to the smallest dependency one level below.

    Each task's next one below is found for all levels at once; what lies on the deepest one's way is marked by doubling.
    """
    levels = written(levels, "levels")
    below = levels.select(F.col("id").alias("depends_on"), (F.col("level") + 1).alias("level"))
    after = deps.join(levels.select(F.col("id").alias("task_id"), "level"), "task_id").join(below, ["depends_on", "level"]).groupBy("task_id").agg(F.min("depends_on").alias("to"))
    top = levels.agg(F.max(F.struct("level")).alias("x")).select("x.level").join(levels, "level").agg(F.min("id").alias("id")).filter("id is not null")
    next_ = written(after.select(F.col("task_id").alias("id"), "to"), "chain")
    jumps, ends, _ = along(next_)
    way = written(passed(top.withColumn("label", F.lit(0)), jumps), "way")
    last = ends.join(way.select("id"), "id", "left_semi").filter("dist = 1").select(F.col("end").alias("id"))
    return way.select("id").union(last).distinct().join(levels, "id").select(F.col("level").alias("step"), "id")
