"""Plans of chains that are longer than 64 tasks, against the DuckDB statements."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    """The smallest input, with a customer more, whose 70 orders are pending, each behind the one before."""
    import duckdb

    at = tmp_path_factory.mktemp("deep")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
        if f not in ("orders.parquet", "customer.parquet"):
            os.symlink(f"{DIR}/{f}", at / f)
    # Not of a key that closes its chain to a cycle, as every fiftieth does.
    more = "SELECT * REPLACE (c_custkey + 2 AS c_custkey) FROM customer QUALIFY c_custkey = max(c_custkey) OVER ()"
    orders = f"SELECT o.* REPLACE (o_orderkey + n AS o_orderkey, c.c_custkey AS o_custkey, 'O' AS o_orderstatus, o_orderdate + to_days(CAST(n AS INT)) AS o_orderdate) FROM (SELECT * FROM orders QUALIFY o_orderkey = max(o_orderkey) OVER ()) o, range(1, 71) t(n), ({more}) c"
    con.sql(f"COPY (SELECT * FROM orders UNION ALL {orders}) TO '{at}/orders.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT * FROM customer UNION ALL {more}) TO '{at}/customer.parquet' (FORMAT parquet)")
    for name in ("orders", "customer"):
        con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}.parquet')")
    return str(at), con


def both(spark, deep, name, only=lambda row: True):
    """The rows of a query and of its statement, as texts."""
    want = deep[1].sql(entry.oracle_sql()[name])
    theirs = [dict(zip(want.columns, map(str, t), strict=True)) for t in want.fetchall()]
    ours = [{x: str(y) for x, y in t.asDict().items()} for t in entry.queries()[name](spark, deep[0]).collect()]
    return tuple(sorted(filter(only, rows), key=lambda row: sorted(row.items())) for rows in (ours, theirs))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no input tables here")
def test_a_summary_has_all_waves(spark, deep):
    got, want = both(spark, deep, "schedule_summary")
    assert got == want and int(want[0]["waves"]) >= 70


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no input tables here")
def test_status_has_all_waves(spark, deep):
    got, want = both(spark, deep, "status", lambda row: row["section"] == "schedule")
    assert got == want and ("waves", "70") in [(row["key"], row["value"]) for row in got]
