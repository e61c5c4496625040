"""Queries against their DuckDB statements on the smallest input, where it is there."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SAMPLE = ["sym_list", "lease_handle", "throughput_counts", "goal_progress", "impact", "plan_waves", "dep_cycles", "activity_windows", "guard", "svc_edge_rollup", "edges_build", "arch_graph", "workers", "schedule_summary", "notice_union", "task_context", "kw_match", "st_session_expire"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no input tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    df = entry.queries()[name](spark, DIR)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    at = [want.columns.index(x) for x in columns]
    theirs = sorted((tuple(plain(t[i]) for i in at) for t in want.fetchall()), key=key)
    assert sorted((tuple(plain(t[x]) for x in columns) for t in df.collect()), key=key) == theirs


def test_entry_has_a_stable_schema(spark):
    if os.path.isdir(DIR):
        assert entry.entry(spark).columns == ["seed", "symbol_id", "distance", "path", "start_byte", "lease_agent"]
