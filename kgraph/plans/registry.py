"""Queries over the property graph and the tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph import model
from kgraph.plans import tgraph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql may use the common tables ``nodes`` and ``edges``."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def over_graph(sql: str, more: str = "") -> str:
    return f"WITH {tgraph.SQL}{', ' + more if more else ''} {sql}"


def graph(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tgraph.nodes(spark, sf_dir), tgraph.edges(spark, sf_dir))


def nodes_alone(f: Callable[[DataFrame], DataFrame]) -> Query:
    """For results of nodes alone: edges, which they don't depend on, aren't built."""
    return lambda spark, sf_dir: f(tgraph.nodes(spark, sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def all_queries() -> dict[str, Query]:
    from kgraph.plans import graph_queries, ingest_queries, layout_queries, scalar_queries  # noqa: F401  they register themselves

    return QUERIES


def all_sql() -> dict[str, str]:
    all_queries()
    return SQL


__all__ = ["QUERIES", "SQL", "F", "all_queries", "all_sql", "empty", "graph", "model", "nodes_alone", "over_graph", "query", "table"]
