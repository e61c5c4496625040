"""Derivation of the model's tables (see FIXTURES.md) from the driver's tables.

Every table is a lazy DataFrame: a query that needs two columns of one of them scans only what those need.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.sources.tables import read, written

HOUR, DAY = 3_600_000, 86_400_000
#: Kinds and states as the model's tables have them.
REQUEST_KINDS = ["lease-transfer", "interface", "dependency", "review", "api-change", "question"]
REQUEST_STATES = ["open", "accepted", "declined", "fulfilled", "cancelled", "expired"]
EVENT_KINDS = {"purchase": "task.completed", "signup": "task.started", "error": "lease.denied", "click": "lease.acquired", "view": "lease.released"}


#: Source files by language; KK is the customer's key.
POLYGLOT = [
    ("rs", """use crate::base::{One, Two};
mod nested_KK;
pub struct Acct_KK<'a> { name: &'a str }
impl<'a> Acct_KK<'a> {
    pub fn pay_KK(&'a self, c: char) -> u64 {
        let open = '{';
        let text = r#"fn no() { " }"#; /* fn neither() { /* nor */ */
        help_KK(c == open)
    }
}
fn help_KK(x: bool) -> u64 { 1 }
#[test]
fn checks_KK() { assert!(help_KK(true) == 1); }
"""),
    ("ts", """import { base } from './fKK';
import React from "react";
const tool = require('./tool');
export class Acct_KK extends Base { pay_KK(x: number) { return help_KK(`a ${x ? `} class No { ${x}` : "}"} b`); } }
const help_KK = async (x: string): Promise<string> => {
  const at = /[{(]/.test(x) // function never() {
  return x
}
app.post('/poly/KK', help_KK)
"""),
    ("java", '''import com.acme.Base;
import java.util.*;
public class Acct_KK extends Base {
  String text = """
    } class No { void never() { "
    """;
  @GetMapping("/poly/KK")
  public List<Map<String, Integer>> pay_KK(int x) throws Exception { char c = '}'; return help_KK(x); }
  int help_KK(int x) { return x; }
}
'''),
    ("go", """package main
import (
  "fmt"
  p "acme/pay"
)
type Acct_KK struct{ a int }
func (s *Acct_KK) pay_KK(a int) (int, error) { fmt.Println(`func no() { "`); return help_KK(a), nil }
func help_KK(a int) int { return a }
"""),
    ("cs", """using Acme.Base;
using static System.Math;
class Acct_KK : Base, IPay {
  [HttpPost("/poly/KK")]
  public int pay_KK(int x) { var s = $"a {x + "}".Length} b"; var v = @"c:\\\\"; return this.help_KK(x); }
  int help_KK(int x) => x;
}
"""),
    ("cpp", """#include "base.h"
#include <vector>
#define OPEN {
class Acct_KK : public Base { public: int pay_KK(int x) { const char* s = R"x( } " )x"; return help_KK(x + 1'000); } };
int help_KK(int x) { return x; }
"""),
]


def millis(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds of a timestamp with or without a zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return F.unix_millis(name)


def ident(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def choice(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


class Model:
    """The tables of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    def settled(self, *names: str) -> Model:
        """This model with some of its tables written, for what reads them again and again."""
        for name in names:
            self.__dict__[name] = written(getattr(self, name), name)
        return self

    @cached_property
    def raw_events(self) -> DataFrame:
        df = self.raw("events")
        return df.withColumn("ms", millis(df, "ts")).withColumn("agent", ident("A", F.col("user_id") % 10)).drop("ts")

    @cached_property
    def now(self) -> int:
        """The fixed present: the last event's time."""
        return self.raw_events.agg(F.max("ms")).first()[0]

    @cached_property
    def n_orders(self) -> int:
        return self.raw("orders").count()

    @cached_property
    def n_customers(self) -> int:
        return self.raw("customer").count()

    @cached_property
    def nations(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_regionkey", "n_name", F.concat_ws("/", "r_name", "n_name").alias("path"))

    @cached_property
    def orders(self) -> DataFrame:
        df = self.raw("orders")
        return df.select("o_orderkey", "o_custkey", "o_orderstatus", millis(df, "o_orderdate").alias("ms"), "o_orderpriority")

    @cached_property
    def order_chain(self) -> DataFrame:
        """Each order with its customer's previous one (null for the first) and whether it is the last."""
        w = W.partitionBy("o_custkey").orderBy("ms", "o_orderkey")
        return self.orders.select("*", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"), F.first("o_orderkey").over(w).alias("first_order"))

    @cached_property
    def symbols(self) -> DataFrame:
        def rows(df, id_, path, kind, name, fqn, parent, at, role=None, meta=None):
            return df.select(id_.alias("id"), path.alias("path"), F.lit(kind).alias("kind"), name.alias("name"), fqn.alias("fqn"), (parent if parent is not None else F.lit(None)).cast("string").alias("parent_id"), at.cast("long").alias("start_byte"), (role if role is not None else F.lit(None)).cast("string").alias("role"), F.lit("R1").alias("repo_id"), (meta if meta is not None else F.lit(None)).cast("string").alias("meta"))

        c = F.col
        customers = self.raw("customer").join(F.broadcast(self.nations), c("c_nationkey") == c("n_nationkey"))
        methods = self.orders.join(customers, c("o_custkey") == c("c_custkey"))
        role = F.when(c("o_orderpriority") == "1-URGENT", "api").when(c("o_orderpriority") == "5-LOW", "test")
        route = F.when(c("o_orderpriority") == "1-URGENT", F.concat(F.lit('{"method":"'), F.when(c("o_orderkey") % 2 == 0, "GET").otherwise("POST"), F.lit('","path":"/orders/'), c("o_orderkey").cast("string"), F.lit('"}')))
        return (
            rows(self.raw("region"), ident("R", "r_regionkey"), c("r_name"), "service", c("r_name"), c("r_name"), None, c("r_regionkey"))
            .unionAll(rows(self.nations, ident("N", "n_nationkey"), c("path"), "file", c("n_name"), c("path"), ident("R", "n_regionkey"), F.lit(0)))
            .unionAll(rows(customers, ident("C", "c_custkey"), c("path"), "class", c("c_name"), c("c_name"), ident("N", "c_nationkey"), c("c_custkey")))
            .unionAll(rows(methods, ident("O", "o_orderkey"), c("path"), "method", ident("O", "o_orderkey"), F.concat_ws(".", "c_name", ident("O", "o_orderkey")), ident("C", "o_custkey"), c("o_orderkey"), role, route))
            .unionAll(rows(self.raw("part"), ident("P", "p_partkey"), F.concat_ws("/", F.lit("db"), "p_brand"), "table", c("p_name"), c("p_name"), None, c("p_partkey")))
        )

    @cached_property
    def repos(self) -> DataFrame:
        """The root and a repository for each region."""
        root = self.spark.createDataFrame([("R1", "root", ".")], "id string, name string, root_path string")
        return root.unionAll(self.raw("region").select(ident("R", F.col("r_regionkey") + 2), F.lower("r_name"), F.col("r_name")))

    @cached_property
    def files(self) -> DataFrame:
        return self.nations.select(F.lit("R1").alias("repo_id"), "path", F.substring(F.sha2("n_name", 256), 1, 16).alias("content_hash"), F.length("n_name").cast("long").alias("size"))

    @cached_property
    def sources(self) -> DataFrame:
        """(path, text): a Python module for each customer, which calls into the one of the customer before."""
        k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
        before = (F.col("c_custkey") - 1).cast("string")
        first = F.col("c_custkey") == 0
        call = F.when(first, F.lit("len(x)")).otherwise(F.concat(F.lit("run_"), before, F.lit("(x)")))
        pieces = [
            F.lit("import os\n"), F.when(first, F.lit("")).otherwise(F.concat(F.lit("from src.m"), before, F.lit(" import run_"), before, F.lit("\n"))),
            F.lit("\n\nclass Holder_"), k, F.lit(":\n    def place(self, x):\n        return "), call,
            F.lit("\n\n\ndef run_"), k, F.lit("(x):\n    q = 'SELECT * FROM \"shop\".brand"), n, F.lit(" JOIN nowhere'\n    return Holder_"), k, F.lit("().place(q)\n"),
            F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("\n\ndef test_run_"), k, F.lit("():\n    assert run_"), k, F.lit("(1)\n"))).otherwise(F.lit("")),
            F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("\n\n@app.post('/run/"), k, F.lit("')\ndef serve_"), k, F.lit("(x):\n    return run_"), k, F.lit("(x)\n"))).otherwise(F.lit("")),
        ]
        return self.raw("customer").select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), F.concat(*pieces).alias("text"))

    @cached_property
    def polyglot(self) -> DataFrame:
        """(path, text): a source file for each customer in one of six languages, with the constructs that are hard to tell apart: lifetimes, raw strings, nested templates, text blocks, interpolated strings, macros' lines. Each holds Acct_k with a method pay_k that calls help_k, which is a function of its own or of a type."""
        k = F.col("c_custkey").cast("string")
        made = F.element_at(F.array(*[F.lit(text) for _, text in POLYGLOT]), (F.col("c_custkey") % len(POLYGLOT) + 1).cast("int"))
        ext = choice([ext for ext, _ in POLYGLOT], F.col("c_custkey") % len(POLYGLOT))
        path = F.concat(F.lit("poly/f"), k, F.lit("."), ext)
        return self.raw("customer").select(path.alias("path"), F.replace(made, F.lit("KK"), k).alias("text"))

    @cached_property
    def edges(self) -> DataFrame:
        c = F.col
        line, cust, supp = self.raw("lineitem"), self.raw("customer"), self.raw("supplier")
        calls = self.order_chain.filter("prev is not null").select(ident("O", "o_orderkey").alias("src"), ident("O", "prev").alias("dst"), F.when(c("o_orderpriority") == "5-LOW", "tests").otherwise("calls").alias("kind"))
        queries = line.select(ident("O", "l_orderkey").alias("src"), ident("P", "l_partkey").alias("dst"), F.lit("queries").alias("kind")).distinct()
        n, m = c("c_nationkey"), c("s_nationkey")
        pairs = line.select("l_orderkey", "l_suppkey").join(self.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).join(cust.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey")).join(supp.select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
        imports = pairs.filter(((m == (7 * n + 3) % 25) | (m == (5 * n + 1) % 25)) & (m != n)).select("c_nationkey", "s_nationkey").distinct().select(ident("N", "c_nationkey").alias("src"), ident("N", "s_nationkey").alias("dst"), F.lit("imports").alias("kind"))
        contains = self.symbols.filter(c("kind").isin("class", "method")).select(c("parent_id").alias("src"), c("id").alias("dst"), F.lit("contains").alias("kind"))
        return calls.unionAll(queries).unionAll(imports).unionAll(contains)

    @cached_property
    def tasks(self) -> DataFrame:
        c = F.col
        state = F.when(c("o_orderstatus") == "F", "done").when(c("o_orderstatus") == "O", "pending").otherwise(choice(["running", "review", "blocked", "failed"], c("o_orderkey") % 4))
        return self.orders.select(
            ident("T", "o_orderkey").alias("id"), F.concat(F.lit("Order "), c("o_orderkey").cast("string")).alias("title"), state.alias("state"),
            (6 - F.substring("o_orderpriority", 1, 1).cast("long")).alias("priority"), F.when(state != "pending", ident("A", c("o_custkey") % 10)).alias("assignee"),
            F.when(state != "pending", c("ms")).alias("claimed_at"), c("ms").alias("created_at"), (c("ms") + (c("o_orderkey") % 1000) * 1000).alias("updated_at"),
            F.when(c("o_orderpriority") == "5-LOW", "testing").alias("required_capability"),
        )

    @cached_property
    def task_deps(self) -> DataFrame:
        chain = self.order_chain
        on_previous = chain.filter("prev is not null").select(ident("T", "o_orderkey").alias("task_id"), ident("T", "prev").alias("depends_on"))
        closing = chain.filter("next is null and o_custkey % 50 = 0 and first_order <> o_orderkey").select(ident("T", "first_order").alias("task_id"), ident("T", "o_orderkey").alias("depends_on"))
        return on_previous.unionAll(closing)

    @cached_property
    def task_symbols(self) -> DataFrame:
        return self.orders.select(ident("T", "o_orderkey").alias("task_id"), ident("O", "o_orderkey").alias("symbol_id"))

    @cached_property
    def goals(self) -> DataFrame:
        c = F.col
        return self.raw("customer").select(ident("G", "c_custkey").alias("id"), c("c_name").alias("title"), choice(["open", "done", "abandoned"], c("c_custkey") % 3).alias("state"), (c("c_custkey") % 5).alias("priority"), c("c_custkey").alias("created_at"))

    @cached_property
    def task_goals(self) -> DataFrame:
        return self.orders.select(ident("T", "o_orderkey").alias("task_id"), ident("G", "o_custkey").alias("goal_id"))

    @cached_property
    def agents(self) -> DataFrame:
        per = self.raw_events.groupBy("agent").agg(F.max("ms").alias("heartbeat_at"), F.min("ms").alias("joined_at"), (F.min("user_id") % 5).alias("k"))
        return per.select(F.col("agent").alias("name"), choice(["human", "ai", "service", "person", "bot"], F.col("k")).alias("kind"), "joined_at", "heartbeat_at", (F.col("k") == 3).alias("paused"), F.when(F.col("k") == 1, "testing").alias("capability"))

    @cached_property
    def events(self) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])[F.col("event_type")]
        return self.raw_events.select(F.col("event_id").alias("id"), F.col("ms").alias("ts"), kind.alias("kind"), "agent", ident("O", F.col("event_id") % self.n_orders).alias("symbol_handle"), ident("T", F.col("event_id") % self.n_orders).alias("task"), F.col("props").alias("detail"))

    def _of(self, event_type: str) -> DataFrame:
        return self.raw_events.filter(F.col("event_type") == event_type)

    @cached_property
    def leases(self) -> DataFrame:
        c, e = F.col, F.col("event_id")
        symbol = F.when(e % 101 == 0, ident("N", e % 25)).when(e % 7 == 0, ident("C", e % self.n_customers)).otherwise(ident("O", e % self.n_orders))
        ttl = (3600 * (1 + F.floor("value"))).cast("long")
        df = self._of("click").select(ident("L", "event_id").alias("id"), symbol.alias("symbol_id"), "agent", (e % 5).alias("priority"), ttl.alias("ttl_secs"), c("ms").alias("acquired_at"), (c("ms") + ttl * 1000).alias("expires_at"), F.when(e % 3 == 0, ident("T", e % self.n_orders)).alias("task"))
        return df.withColumn("state", F.when(c("expires_at") > self.now - DAY, "active").otherwise("expired"))

    @cached_property
    def lease_queue(self) -> DataFrame:
        e = F.col("event_id")
        return self._of("signup").select(ident("Q", "event_id").alias("id"), e.alias("seq"), ident("C", e % (self.n_customers // 10 + 1)).alias("symbol_id"), "agent", (e % 5).alias("priority"), F.col("ms").alias("requested_at"), (F.col("ms") + (F.col("user_id") % 5) * 5000).alias("polled_at"), F.when(e % 4 == 0, "granted").otherwise("waiting").alias("state"))

    @cached_property
    def requests(self) -> DataFrame:
        e, ms = F.col("event_id"), F.col("ms")
        return self._of("error").select(
            ident("RQ", "event_id").alias("id"), e.alias("seq"), choice(REQUEST_KINDS, e % 6).alias("kind"), F.col("agent").alias("from_agent"), F.when(e % 4 != 0, ident("A", (F.col("user_id") + 3) % 10)).alias("to_agent"),
            (e % 5).alias("priority"), choice(REQUEST_STATES, e % 7 % 6).alias("state"), ms.alias("created_at"), F.when(e % 3 != 0, ms + DAY * (1 + e % 20)).alias("deadline_at"), ident("O", e % (self.n_orders + 50)).alias("resource_symbol"), F.col("props").alias("body"),
            F.concat(F.lit("Request "), e.cast("string")).alias("subject"), F.when(e % 6 == 2, ident("T", e % self.n_orders)).alias("resource_task"),
        )

    @cached_property
    def progress(self) -> DataFrame:
        e = F.col("event_id")
        return self._of("view").select(e.alias("id"), "agent", ident("T", e % self.n_orders).alias("task"), ident("O", e % (self.n_orders + 50)).alias("symbol_id"), (e % 101).alias("percent"), F.col("ms").alias("ts"))

    @cached_property
    def sessions(self) -> DataFrame:
        e, ms = F.col("event_id"), F.col("ms")
        return self._of("view").filter(e % 5 == 0).select(ident("S", "event_id").alias("id"), "agent", choice(["editor", "copilot", "jenkins", "shell"], F.col("user_id") % 4).alias("tool"), choice(["mcp", "hook", "ide", "cli"], e % 4).alias("transport"), ms.alias("started_at"), (ms + e % 7 * 20000).alias("heartbeat_at"), F.when(e % 2 != 0, ms + 60000).alias("ended_at"))

    @cached_property
    def touches(self) -> DataFrame:
        """Raw edit events: one for each click."""
        paths = self.nations.select("n_nationkey", "path")
        return self._of("click").join(F.broadcast(paths), F.col("event_id") % 25 == F.col("n_nationkey")).select("event_id", "agent", F.lit("R1").alias("repo_id"), "path", F.col("ms").alias("ts"))

    @cached_property
    def activity(self) -> DataFrame:
        """The last edit window of each (agent, repo_id, path): a gap of more than a day opens a new one."""
        w = W.partitionBy("agent", "repo_id", "path").orderBy("ts", "event_id")
        gaps = self.touches.withColumn("fresh", F.when(F.col("ts") - F.lag("ts").over(w) <= DAY, 0).otherwise(1))
        windows = gaps.withColumn("at", F.sum("fresh").over(w)).groupBy("agent", "repo_id", "path", "at").agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"))
        return windows.groupBy("agent", "repo_id", "path").agg(F.max_by(F.struct("started_at", "updated_at"), "at").alias("w")).select("agent", "repo_id", "path", "w.started_at", "w.updated_at")

    @cached_property
    def memory(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"), F.col("source").alias("author"), F.concat_ws(",", "lang", "source").alias("tags"), F.col("doc_id").alias("updated_at"))

    @cached_property
    def messages(self) -> DataFrame:
        t = self.raw("conversations")
        return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), ident("A", F.col("conv_id") % 10).alias("to_agent"), F.col("role").alias("from_agent"), F.col("text").alias("body"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("read_at"))
