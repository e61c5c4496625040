import os
import random

import pandas as pd
from loomgraph.operators import state
from loomgraph.streaming import jobs, leases
from pyspark.sql import functions as F


def test_activity_windows_by_gap(spark, tmp_path):
    rows = [("a", "p", 0), ("a", "p", 60_000), ("a", "p", 120_001), ("b", "p", 5)]
    spark.createDataFrame(rows, "agent string, path string, ts long").write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), "agent string, path string, ts long")
    got = sorted(tuple(r) for r in jobs.run_to_table(jobs.activity_windows(stream), "complete", "t").collect())
    assert got == [("a", "p", 0, 60_000, 2), ("a", "p", 120_001, 120_001, 1), ("b", "p", 5, 5, 1)]


def test_lease_expiry_follows_heartbeats(spark, tmp_path):
    schema = "lease string, ms long, expires_at long"
    for i, part in enumerate([[("x", 500, 1_000), ("y", 500, 500_000)], [("x", 900, 300_000)], [("z", 2_000_000, 9_000_000)], [("z", 2_100_000, 9_000_000)], [("z", 2_200_000, 9_000_000)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        for f in (tmp_path / "in" / f"b{i}").iterdir():
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    beats = stream.select("lease", F.timestamp_millis("ms").alias("at"), "expires_at")
    got = dict(map(tuple, jobs.run_to_table(jobs.lease_expiry(beats), "append", "t").collect()))
    assert got == {"x": 300_000, "y": 500_000}


def lease_log(n, seed):
    rng = random.Random(seed)
    ops = ["acquire"] * 6 + ["release", "transfer", "heartbeat", "settle", "dequeue", "release_all", "sweep"]
    above = {"f": [], "c": ["f"], "d": ["f"], "m": ["c", "f"], "n": ["c", "f"], "o": ["d", "f"]}
    out, ts = [], 0
    for i in range(n):
        ts += rng.choice([0, 100, 900, 4000, 16_000])
        op, symbol = rng.choice(ops), rng.choice(list(above))
        more = rng.choice(list(above))
        out.append({"root": rng.choice(["r1", "r2"]), "id": i, "ts": ts, "op": op, "symbol": None if op == "heartbeat" and i % 2 else symbol, "ancestors": above[symbol], "agent": rng.choice("abc"), "priority": rng.randint(0, 3), "ttl_secs": rng.choice([0, 1, 5, 30]), "preempt": rng.random() < 0.5, "queue": rng.random() < 0.7, "to": rng.choice("abc"), "scope": [(symbol, above[symbol]), (more, above[more])] if op == "settle" else []})
    return out


class PlainLeases:
    """The rules without any index: lists that every command walks."""

    def __init__(self):
        self.live, self.line, self.seq = [], [], 0

    def sweep(self, ts):
        self.live = [v for v in self.live if v["until"] > ts]

    def against(self, symbol, above, agent):
        return [v for v in self.live if v["agent"] != agent and (v["symbol"] == symbol or v["symbol"] in above or symbol in v["above"])]

    def acquire(self, x, symbol, above):
        self.sweep(x["ts"])
        self.line = [w for w in self.line if w["polled"] >= x["ts"] - 15_000]
        mine = min((v for v in self.live if v["symbol"] == symbol and v["agent"] == x["agent"]), key=lambda v: v["lease"], default=None)
        if mine:
            mine.update(until=x["ts"] + x["ttl_secs"] * 1000, ttl=x["ttl_secs"], priority=x["priority"])
            return "extended"
        met = self.against(symbol, above, x["agent"])

        def wait():
            w = next((w for w in self.line if w["symbol"] == symbol and w["agent"] == x["agent"]), None)
            if w is None and x["queue"]:
                self.seq += 1
                self.line.append({"symbol": symbol, "agent": x["agent"], "priority": x["priority"], "polled": x["ts"], "seq": self.seq})
            elif x["queue"]:
                w.update(polled=x["ts"], priority=x["priority"])
            return "denied"

        if met and not (x["preempt"] and all(v["priority"] < x["priority"] for v in met)):
            return wait()
        self.live = [v for v in self.live if v not in met]
        here = [w for w in self.line if w["symbol"] == symbol]
        head = min((w for w in here if w["agent"] != x["agent"]), key=lambda w: (-w["priority"], w["seq"]), default=None)
        own = next(((-w["priority"], w["seq"]) for w in here if w["agent"] == x["agent"]), (-x["priority"], 1 << 62))
        if head and head["polled"] >= x["ts"] - 15_000 and (-head["priority"], head["seq"]) < own:
            return wait()
        self.live.append({"lease": f"L{x['id']}" + (f":{symbol}" if symbol != x["symbol"] else ""), "symbol": symbol, "above": above, "agent": x["agent"], "priority": x["priority"], "until": x["ts"] + x["ttl_secs"] * 1000, "ttl": x["ttl_secs"]})
        self.line = [w for w in self.line if (w["symbol"], w["agent"]) != (symbol, x["agent"])]
        return "preempted" if met else "acquired"

    def run(self, x):
        op, me = x["op"], x["agent"]
        if op == "acquire":
            return self.acquire(x, x["symbol"], x["ancestors"])
        if op == "settle":
            for symbol, above in x["scope"]:
                met = self.against(symbol, above, me)
                if met and not (x["preempt"] and all(v["priority"] < x["priority"] for v in met)):
                    return "denied"
            for symbol, above in x["scope"]:
                self.acquire(x, symbol, above)
            return "settled"
        if op in ("heartbeat", "release_all"):
            if op == "heartbeat":
                self.sweep(x["ts"])
            held = [v for v in self.live if v["agent"] == me and (op == "release_all" or x["symbol"] in (None, v["symbol"]))]
            if op == "release_all":
                self.live = [v for v in self.live if v not in held]
            for v in held:
                v["until"] = x["ts"] + v["ttl"] * 1000
            return ("refreshed" if op == "heartbeat" else "released") if held else "ignored"
        if op == "sweep":
            self.sweep(x["ts"])
            return "swept"
        if op == "dequeue":
            n = len(self.line)
            self.line = [w for w in self.line if (w["symbol"], w["agent"]) != (x["symbol"], me)]
            return "cancelled" if len(self.line) < n else "ignored"
        mine = min((v for v in self.live if v["symbol"] == x["symbol"] and v["agent"] == me), key=lambda v: v["lease"], default=None)
        if not mine or (op == "transfer" and x["to"] == me):
            return "ignored"
        if op == "release":
            self.live.remove(mine)
            return "released"
        mine.update(agent=x["to"], until=x["ts"] + mine["ttl"] * 1000)
        self.line = [w for w in self.line if (w["symbol"], w["agent"]) != (x["symbol"], x["to"])]
        return "transferred"


def plain_outcomes(log):
    roots = {}
    return {x["id"]: roots.setdefault(x["root"], PlainLeases()).run(x) for x in log}


def test_indexed_leases_follow_the_plain_rules():
    for seed in range(60):
        log = [x | {"root": "r"} for x in lease_log(150, seed)]
        got = state.replay(pd.DataFrame(log))
        assert dict(zip(got.id.tolist(), got.outcome.tolist(), strict=True)) == plain_outcomes(log)


def test_leases_as_a_stream_and_as_a_batch(spark, tmp_path):
    log = lease_log(120, 100)
    schema = "root string, id long, ts long, op string, symbol string, ancestors array<string>, agent string, priority long, ttl_secs long, preempt boolean, queue boolean, to string, scope array<struct<symbol: string, ancestors: array<string>>>"
    df = spark.createDataFrame(log, schema)
    want = plain_outcomes(log)
    batch = state.lease_fold(df)
    assert {r.id: r.outcome for r in batch.collect()} == want
    for i in range(4):
        at = tmp_path / "log" / f"{i}.parquet"
        spark.createDataFrame(log[30 * i : 30 * i + 30], schema).coalesce(1).write.parquet(str(tmp_path / "parts" / str(i)))
        (tmp_path / "log").mkdir(exist_ok=True)
        part = next((tmp_path / "parts" / str(i)).glob("part-*.parquet"))
        part.rename(at)
        os.utime(at, (1_000_000_000 + i, 1_000_000_000 + i))
    stream = leases.lease_stream(jobs.event_stream(spark, str(tmp_path / "log"), df.schema, files_per_batch=1))
    rows = lambda out: sorted(map(tuple, out.select("id", "outcome", "lease", "holder").collect()))
    assert rows(jobs.run_to_table(stream, "append", "leases")) == rows(batch)


def test_a_burst_ends_with_quiet(spark, tmp_path):
    rows = [("r", "b", 0), ("r", "a", 200), ("r", "b", 450), ("r", "c", 701), ("s", "a", 300)]
    spark.createDataFrame(rows, "root string, path string, ms long").write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), "root string, path string, ms long").select("root", "path", F.timestamp_millis("ms").alias("at"))
    got = sorted(tuple(r) for r in jobs.run_to_table(jobs.bursts(stream), "complete", "t").collect())
    assert got == [("r", 0, 450, ["a", "b"], 3), ("r", 701, 701, ["c"], 1), ("s", 300, 300, ["a"], 1)]


def test_frames_are_coalesced_and_have_a_floor(spark, tmp_path):
    assert jobs.frame_due(True, 10, 9) and not jobs.frame_due(False, 3008, 9) and jobs.frame_due(False, 3009, 9)
    spark.range(500).repartition(1).write.parquet(str(tmp_path / "in"))
    status = lambda: spark.createDataFrame([("tasks", "count", "3")], "section string, key string, value string")
    frames = jobs.pump(jobs.event_stream(spark, str(tmp_path / "in"), "id long"), status, "pump", for_ms=15_000, floor_ms=2_000).orderBy("at").collect()
    # One frame for all 500 events, then one each two seconds at most though nothing comes any more.
    assert sum(r.events for r in frames) == 500 and [r.events for r in frames if r.events] == [500]
    assert len(frames) >= 2 and all(r.last_id == 499 for r in frames if r.at >= next(x.at for x in frames if x.events))
    assert all(b.at - a.at >= 2_000 for a, b in zip(frames, frames[1:], strict=False) if not b.events)


def test_a_sign_behind_its_time_starts_anew(spark, tmp_path):
    rows = [("x", 500, 1_000, False), ("x", 5_000, 6_000, False), ("v", 500, 400, False), ("z", 5_000_000, 9_000_000, False)]
    spark.createDataFrame(rows, "key string, ms long, until long, ended boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ms long, until long, ended boolean").parquet(str(tmp_path / "in")).select("key", F.timestamp_millis("ms").alias("at"), "until", "ended")
    assert sorted(map(tuple, jobs.run_to_table(jobs.timer_expiry(stream), "append", "t").collect())) == [("v", 400), ("x", 1_000), ("x", 6_000)]
