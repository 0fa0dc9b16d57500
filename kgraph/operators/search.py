"""Search, lookups and filters over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph import model

SHOWN = 60


def _has(c: Column, q: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))


def relevance(query: str, others: int) -> Column:
    """0: the name is the query; 1: it starts with it; 2: it contains it; ``others`` otherwise."""
    name, q = F.lower("name"), F.lit(query)
    return F.when(name == q, 0).when(F.startswith(name, q), 1).when(F.contains(name, q), 2).otherwise(others)


def find_node(nodes: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Nodes whose name, path or id contains the query, letter case aside, with rank and their place in
    the answer's order. The query is taken as it is, spaces included; an empty one matches all."""
    q = query.lower()
    hit = _has(F.col("name"), q) | _has(F.col("path"), q) | _has(F.col("id"), q)
    rows = (nodes if kind is None else nodes.filter(F.col("kind") == kind)).filter(hit)
    return rows.withColumn("rank", relevance(q, 3))


def search_matches(meta: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """The viewer's search: the query is trimmed, ids aren't searched, and an empty query with no kind
    finds nothing. Rank is 0, 1 or 2."""
    q = query.strip().lower()
    rows = meta if kind is None else meta.filter(F.col("kind") == kind)
    if not q:
        return rows.filter(F.lit(kind is not None)).withColumn("rank", F.when(F.col("name") == "", 0).otherwise(1))
    found = rows.filter(_has(F.col("name"), q) | _has(F.col("path"), q))
    name = F.lower("name")
    return found.withColumn("rank", F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1).otherwise(2))


def in_order(found: DataFrame) -> DataFrame:
    """By relevance, then by input order; a sort by range, not in one task."""
    return found.orderBy("rank", "idx")


def with_position(found: DataFrame) -> DataFrame:
    return model.dense_index(found, ["rank", "idx"], "pos")


def first_shown(found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` in order, by a top-k, and how many more there are."""
    more = found.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    return in_order(found).limit(shown).crossJoin(F.broadcast(more))


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def out_edges(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter(F.col("src") == node_id)


def in_edges(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter(F.col("dst") == node_id)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))


def inspect(meta: DataFrame, index: int) -> DataFrame:
    """One node for the inspector; a symbol's own kind goes before the kind of node."""
    return meta.filter(F.col("idx") == index).withColumn("shown_kind", F.coalesce("symbol_kind", "kind"))


def visible(kind: Column, hidden: list[str]) -> Column:
    """0 or 1; kinds outside the five are always shown."""
    return F.when(kind.isin([k for k in hidden if k in model.NODE_TAGS]) if hidden else F.lit(False), F.lit(0)).otherwise(F.lit(1))


def visibility(nodes: DataFrame, hidden: list[str]) -> DataFrame:
    return nodes.select("id", "idx", "kind", visible(F.col("kind"), hidden).alias("mask"))


def edge_visibility(edges: DataFrame, masks: DataFrame) -> DataFrame:
    """An edge is hidden if either end is."""
    a, b = masks.select(F.col("id").alias("src"), F.col("mask").alias("_a")), masks.select(F.col("id").alias("dst"), F.col("mask").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select(*edges.columns, F.least("_a", "_b").alias("mask"))
