"""Graphs for Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame


def register(nodes: DataFrame, edges: DataFrame, prefix: str = "") -> None:
    """Temporary views ``nodes`` and ``edges`` of the session, each name after ``prefix``; views of these names
    are replaced."""
    nodes.createOrReplaceTempView(f"{prefix}nodes")
    edges.createOrReplaceTempView(f"{prefix}edges")
