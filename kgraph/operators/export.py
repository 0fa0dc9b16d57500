"""Projections of a graph for other tools: dense edges, sidecar rows, layout tables, adjacency offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgraph import model
from kgraph.functions import text

SIDECAR = ("index", "id", "name", "kind", "path", "span", "signature", "symbol_kind", "container", "doc", "locals", "calls", "role", "returns", "description")


def dense_edges(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(eidx, from_idx, to_idx): ends by their nodes' numbers, which aren't numbered anew when kinds are
    left out. Dangling edges are dropped."""
    ix = nodes.select("id", "idx")
    rows = model.of_kinds(edges, kinds)
    a, b = ix.select(F.col("id").alias("src"), F.col("idx").alias("from_idx")), ix.select(F.col("id").alias("dst"), F.col("idx").alias("to_idx"))
    return rows.join(a, "src").join(b, "dst").select("eidx", "from_idx", "to_idx")


def edge_lines(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(eidx, line) of the edge list."""
    return dense_edges(nodes, edges, kinds).select("eidx", F.concat_ws(" ", F.col("from_idx").cast("string"), F.col("to_idx").cast("string")).alias("line"))


def sidecar(nodes: DataFrame) -> DataFrame:
    """The 15 columns of a node's line, as text; a cell has no tabs or line ends."""

    def cell(c: Column) -> Column:
        return text.sanitize_cell(F.coalesce(c, F.lit("")))

    return nodes.select(
        F.col("idx").alias("index"), cell(F.col("id")).alias("id"), cell(F.col("name")).alias("name"), F.col("kind"), cell(F.col("path")).alias("path"), text.span_text(F.col("span")).alias("span"),
        cell(F.col("signature")).alias("signature"), cell(F.col("symbol_kind")).alias("symbol_kind"), cell(F.col("container")).alias("container"), cell(F.col("summary")).alias("doc"),
        cell(F.array_join("locals", " ")).alias("locals"), cell(F.array_join("calls", " ")).alias("calls"), cell(F.col("role")).alias("role"), cell(text.returns_text(F.col("returns"))).alias("returns"),
        cell(F.col("description")).alias("description"),
    )


def sidecar_lines(nodes: DataFrame) -> DataFrame:
    rows = sidecar(nodes)
    return rows.select("index", F.concat_ws("\t", *(F.col(c).cast("string") for c in SIDECAR)).alias("line"))


def layout_graph(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Layout tables: nodes at the origin with their ids as labels, and dense edges."""
    zeros = [F.lit(0.0).alias(c) for c in ("x", "y", "z", "dx", "dy", "dz")]
    return nodes.select("idx", *zeros, F.lit(0.0).cast("float").alias("size"), F.col("id").alias("label"), "kind"), dense_edges(nodes, edges, kinds).select("eidx", F.col("from_idx").alias("src"), F.col("to_idx").alias("dst"))


# Undirected adjacency in compressed rows


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends; a self loop gives two rows."""
    return edges.select("eidx", F.lit(0).alias("side"), F.col("src").alias("node"), F.col("dst").alias("neighbor")).union(edges.select("eidx", F.lit(1).alias("side"), F.col("dst").alias("node"), F.col("src").alias("neighbor")))


def degrees(n: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected degree of every node of n (column idx); a self loop counts 2."""
    d = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))
    return n.select("idx").join(d, F.col("idx") == F.col("node"), "left").select("idx", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def offsets(degree: DataFrame, per_block: int = 1 << 20) -> DataFrame:
    """(idx, offset): the sum of the degrees before each node. Summed by block of numbers first, so that
    no task holds all nodes; one row after the last node has the total."""
    blocked = degree.withColumn("_b", F.floor(F.col("idx") / per_block))
    sums = blocked.groupBy("_b").agg(F.sum("degree").alias("_s"))
    before = sums.withColumn("_first", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("degree").over(Window.partitionBy("_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocked.withColumn("_in", inside).join(F.broadcast(before.select("_b", "_first")), "_b").select("idx", (F.col("_first") + F.col("_in")).cast("long").alias("offset"))
    return rows.union(degree.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("idx"), F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("offset")))


def neighbor_slots(edges: DataFrame) -> DataFrame:
    """(node, slot, neighbor): neighbours in edge order, each edge's source side first."""
    slot = F.row_number().over(Window.partitionBy("node").orderBy("eidx", "side")) - 1
    return both_ways(edges).select("node", slot.cast("long").alias("slot"), "neighbor")


def csr(n: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, neighbor): the flat neighbour array."""
    first = offsets(degrees(n, edges))
    return neighbor_slots(edges).join(first, F.col("node") == F.col("idx")).select((F.col("offset") + F.col("slot")).alias("position"), "neighbor")


def byte_size(n_nodes: Column, n_edges: Column) -> Column:
    """Bytes on a device: 48 a node, 8 an edge, and the adjacency."""
    return 48 * n_nodes + 8 * n_edges + 4 * (n_nodes + 1) + 8 * n_edges
