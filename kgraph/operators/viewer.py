"""Analytic operators behind a viewer: projected labels, picking, focus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.functions import numeric

MAX_LABELS = 800
EDGE_REACH = 6.0
LEAST_RADIUS = 7.0
LABEL_OFFSET = 12.0
STANDOFF = 700.0


def on_screen(nodes: DataFrame, matrix: list[list[float]], width: float, height: float) -> DataFrame:
    """nodes with w and, where in front of the camera, ndc_x, ndc_y, ndc_z, px, py."""
    x, y, z, w = numeric.project(matrix, F.col("x"), F.col("y"), F.col("z"))
    out = nodes.withColumns({"_cx": x, "_cy": y, "_cz": z, "w": w})
    out = out.withColumns({f"ndc_{c}": F.when(F.col("w") > 0, F.col(f"_c{c}") / F.col("w")) for c in "xyz"}).drop("_cx", "_cy", "_cz")
    return out.withColumns({"px": (F.col("ndc_x") * 0.5 + 0.5) * width, "py": (1.0 - (F.col("ndc_y") * 0.5 + 0.5)) * height})


def labels(nodes: DataFrame, matrix: list[list[float]], width: float, height: float, pixels_per_point: float = 1.0, shown: DataFrame | None = None, most: int = MAX_LABELS) -> DataFrame:
    """Names of visible nodes in view, in node order, ``most`` of them: (idx, name, px, py). nodes has name
    and mask (0: hidden kind); ``shown`` (idx, inside) leaves out what a selection dims. Nodes after the
    first one without a name column's value (null) have no labels."""
    seen = on_screen(nodes, matrix, width, height)
    gap = nodes.filter(F.col("name").isNull()).agg(F.min("idx").alias("_gap"))
    seen = seen.crossJoin(F.broadcast(gap)).filter(F.col("_gap").isNull() | (F.col("idx") < F.col("_gap")))
    if shown is not None:
        seen = seen.join(shown.filter("inside").select("idx"), "idx", "left_semi")
    inside = (F.col("w") > 0) & F.col("ndc_z").between(0, 1) & (F.abs("ndc_x") <= 1) & (F.abs("ndc_y") <= 1)
    kept = seen.filter((F.col("name") != "") & (F.col("mask") == 1) & inside).orderBy("idx").limit(most)
    return kept.select("idx", "name", (F.col("px") / pixels_per_point).alias("px"), (F.col("py") / pixels_per_point - LABEL_OFFSET).alias("py"))


def pick_node(nodes: DataFrame, matrix: list[list[float]], view_z: list[float], cx: float, cy: float, width: float, height: float) -> DataFrame:
    """The front-most visible node whose disc covers the cursor; the lower number on ties. view_z is the
    row of the view matrix that gives depth before projection."""
    depth = F.col("x") * view_z[0] + F.col("y") * view_z[1] + F.col("z") * view_z[2] + view_z[3]
    seen = on_screen(nodes.withColumn("vz", depth), matrix, width, height).filter((F.col("mask") == 1) & (F.col("vz") < 0) & (F.col("w") > 0))
    radius = F.greatest(numeric.point_diameter(F.col("size"), F.col("vz")) * 0.5, F.lit(LEAST_RADIUS))
    away = F.sqrt((F.col("px") - cx) * (F.col("px") - cx) + (F.col("py") - cy) * (F.col("py") - cy))
    return seen.filter(away <= radius).agg(F.min(F.struct("ndc_z", "idx"))["idx"].alias("idx"))


def pick_edge(nodes: DataFrame, edges: DataFrame, matrix: list[list[float]], cx: float, cy: float, width: float, height: float) -> DataFrame:
    """The nearest edge within reach of the cursor, both ends visible and in front; the lower number on
    ties. Edges are (eidx, src, dst)."""
    seen = on_screen(nodes, matrix, width, height).filter((F.col("mask") == 1) & (F.col("w") > 0))
    a = seen.select(F.col("idx").alias("src"), F.col("px").alias("ax"), F.col("py").alias("ay"))
    b = seen.select(F.col("idx").alias("dst"), F.col("px").alias("bx"), F.col("py").alias("by"))
    away = numeric.point_segment_distance(F.lit(cx), F.lit(cy), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return edges.join(a, "src").join(b, "dst").withColumn("away", away).filter(F.col("away") <= EDGE_REACH).agg(F.min(F.struct("away", "eidx"))["eidx"].alias("eidx"))


def edge_hop(edge: int, last: tuple[int, int] | None) -> tuple[int, int]:
    """(edge, end) after a click on an edge: its start, or the other end if it was clicked last."""
    return (edge, 1 - last[1]) if last is not None and last[0] == edge else (edge, 0)


def focus(nodes: DataFrame, index: int, standoff: float = STANDOFF) -> DataFrame:
    """Where the camera goes to look at a node."""
    return nodes.filter(F.col("idx") == index).select("idx", (-F.col("x")).alias("cam_x"), (-F.col("y")).alias("cam_y"), (F.lit(-standoff) - F.col("z")).alias("cam_z"))


def edge_vertices(edges: DataFrame) -> DataFrame:
    """Two vertices for each edge: vertex i is end i % 2 of edge i / 2."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("src").alias("node")), F.struct(F.lit(1).alias("end"), F.col("dst").alias("node"))))
    return edges.select("eidx", ends.alias("v")).select((F.col("eidx") * 2 + F.col("v.end")).alias("vertex"), F.col("v.node").alias("node"))
