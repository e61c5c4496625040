"""The register of queries over the model and of the DuckDB statements they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.model_sql import oracle
from loomgraph.sources.adapter import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *more: str):
    """Register a function of the model as a query, and its statement."""

    def add(f: Callable[[Model], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            ORACLE[name] = oracle(sql, *more)
        return f

    return add


#: Handle of a symbol, and as leases, requests and reports show it.
HANDLE = "CASE WHEN kind = 'file' THEN path WHEN kind = 'service' THEN 'service:' || name ELSE path || ':' || fqn END"
STORED = "CASE WHEN s.kind = 'file' THEN s.path ELSE s.path || ':' || s.fqn END"
SYM = ("id", "path", "kind", "name", "fqn", "start_byte", "role")
SYMS = ", ".join(SYM)


def handle_of(alias: str) -> str:
    """The statement of a handle over a table of another name."""
    return f"CASE WHEN {alias}.kind = 'file' THEN {alias}.path WHEN {alias}.kind = 'service' THEN 'service:' || {alias}.name ELSE {alias}.path || ':' || {alias}.fqn END"
