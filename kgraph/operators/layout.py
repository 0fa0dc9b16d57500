"""Force-directed layout: exact and tree-approximated steps of the Fruchterman-Reingold simulation.

Nodes are (idx, x, y, z, ...), edges (src, dst). A step reads one set of positions and writes the next.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph import storage
from kgraph.functions import numeric

AREA_MULTIPLIER = 500.0
SPEED_DIVISOR = 400.0
BLOCK = 2048
BROADCAST_CELLS = 4096
BROADCAST_PLACES = 100_000
MOST_BLOCKS = 32
LEVELS = numeric.MORTON_BITS
# Colours of kinds.
COLORS = {"dir": (0.55, 0.55, 0.60), "file": (0.30, 0.65, 1.00), "doc": (0.35, 0.80, 0.45), "sec": (0.55, 0.85, 0.55), "sym": (1.00, 0.70, 0.25), "?": (0.80, 0.80, 0.80)}
CHOICES = {"gpu": "F-R gpu", "gpu-barnes-hut": "F-R gpu barnes-hut", "cpu": "F-R cpu", "barnes-hut": "F-R cpu barnes-hut", "random": "Random"}


@dataclass(frozen=True)
class Params:
    speed: float = 100.0
    area: float = 1000.0
    gravity: float = 1.0
    three_d: bool = False

    def k(self, n: int) -> float:
        return AREA_MULTIPLIER * self.area / (1.0 + n)

    def max_displace(self) -> float:
        return (AREA_MULTIPLIER * self.area) ** 0.5 / 10.0

    def speed_scale(self) -> float:
        return self.speed / SPEED_DIVISOR

    def clamped(self) -> Params:
        """Speed 0.1 to 1000, area 0.1 at least, gravity as it is."""
        return replace(self, speed=min(1000.0, max(0.1, self.speed)), area=max(0.1, self.area))


def parse_choice(name: str) -> str:
    """A layout by name, letter case aside."""
    found = name.strip().lower()
    if found not in CHOICES:
        raise ValueError(f"unknown layout {name!r}; valid: {', '.join(CHOICES)}")
    return found


def scatter(n: DataFrame, extent: float = 1000.0, sizes: tuple[float, float] = (10.0, 30.0), three_d: bool = True, seed: int = 0) -> DataFrame:
    """Uniform places, colours and sizes from a hash of (idx, seed, axis): the same whatever the
    partitioning. n has the column idx."""

    def unit(axis: int) -> Column:
        return F.pmod(F.xxhash64("idx", F.lit(seed), F.lit(axis)), F.lit(1 << 53)) / float(1 << 53)

    def place(axis: int) -> Column:
        return unit(axis) * (2 * extent) - extent

    return n.withColumns(
        {"x": place(0), "y": place(1), "z": place(2) if three_d else F.lit(0.0), "r": 0.1 + 0.9 * unit(3), "g": 0.1 + 0.9 * unit(4), "b": 0.1 + 0.9 * unit(5), "a": F.lit(1.0), "size": sizes[0] + (sizes[1] - sizes[0]) * unit(6)}
        | {c: F.lit(0.0) for c in ("dx", "dy", "dz")}
    )


def kind_color(kind: Column, channel: int) -> Column:
    out = F
    for k, rgb in COLORS.items():
        out = out.when(kind == k, F.lit(rgb[channel]))
    return out.otherwise(F.lit(COLORS["?"][channel]))


def colorize(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """Colours by kind; nodes stay as they are unless there is one meta row for each."""
    if nodes.count() != meta.count():
        return nodes
    kinds = meta.select("idx", F.col("kind").alias("_kind"))
    return nodes.join(kinds, "idx", "left").withColumns({c: kind_color(F.col("_kind"), i) for i, c in enumerate("rgb")} | {"a": F.lit(1.0)}).drop("_kind")


def exact_repulsion(nodes: DataFrame, k: float, three_d: bool, block: int = BLOCK) -> DataFrame:
    """(idx, fx, fy, fz): k*k/d away from every other node. Nodes of one place get one force and add up to one
    weight, so a place stands for all its nodes, exactly: at distance 0 there is no force. Places are packed into
    blocks, every unordered pair of blocks is one row that gives the forces both ways, and a pair's forces are
    summed in arrays; no pair of nodes is ever a row, and no task needs more than a few pairs of blocks. Blocks
    hold ``block`` places, or more where there would be over ``MOST_BLOCKS``, which bounds tasks and copies."""
    place = ("_x", "_y", "_z")
    axes = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) if three_d or c != "z" else F.lit(0.0) for c in "xyz"]
    keyed = nodes.select("idx", *(v.alias(c) for c, v in zip(place, axes)))
    spots = storage.save(keyed.groupBy(*place).agg(F.count("*").alias("n")), "places")
    count = spots.count()
    blocks = max(1, -(-count // max(block, -(-count // MOST_BLOCKS))))

    def pack(table: pa.Table) -> pa.Table:
        rows = np.stack([table[c].to_numpy() for c in (*place, "n")], 1)
        return pa.table({"b": [table["b"][0].as_py()], "rows": [rows.astype(np.float64).tobytes()]})

    packed = storage.save(spots.withColumn("b", F.pmod(F.xxhash64(*place), F.lit(blocks)).cast("long")).groupBy("b").applyInArrow(pack, "b long, rows binary"), "blocks")
    own = packed.select(F.col("b").alias("_own"), F.col("rows").alias("own"), F.explode(F.sequence("b", F.lit(blocks - 1).cast("long"))).alias("b"))
    pairs = own.join(packed, "b").select((F.col("_own") == F.col("b")).alias("same"), "own", "rows").repartition(blocks * (blocks + 1) // 2)

    def force(batches):
        for batch in batches:
            for same, own, others in zip(*batch.columns):
                a, b = (np.frombuffer(v.as_buffer(), np.float64).reshape(-1, 4) for v in (own, others))
                for rows, total in zip((a,) if same.as_py() else (a, b), _repel(a, b)):
                    yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(3)), pa.array(rows[:, 3].astype(np.int64)), *(pa.array(v * (k * k)) for v in total)], names=[*place, "n", "fx", "fy", "fz"])

    parts = pairs.mapInArrow(force, "_x double, _y double, _z double, n long, fx double, fy double, fz double")
    forces = storage.save(parts.groupBy(*place).agg(F.first("n").alias("n"), *(F.sum(c).alias(c) for c in ("fx", "fy", "fz"))), "forces")
    out = ("idx", "fx", "fy", "fz")
    if count <= BROADCAST_PLACES:
        return keyed.join(F.broadcast(forces), [*place]).select(*out)
    crowded = forces.filter(F.col("n") > F.lit(nodes.count() / 1000))  # under a thousand places
    found = keyed.join(F.broadcast(crowded), [*place], "left")
    return found.filter("n is not null").select(*out).union(found.filter("n is null").select("idx", *place).join(forces, [*place]).select(*out))


def _repel(a: np.ndarray, b: np.ndarray, rows: int = 64, width: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Sums of difference over square distance, times weight, for places of a away from those of b and the other way; (3, n) each.
    Places are (x, y, z, weight). Tiles are small enough for a core's cache."""
    (ax, ay, az, aw), (bx, by, bz, bw) = (np.ascontiguousarray(v.T) for v in (a, b))
    of_a, of_b = np.zeros((3, len(a))), np.zeros((3, len(b)))
    for i in range(0, len(a), rows):
        for j in range(0, len(b), width):
            u, v = slice(i, i + rows), slice(j, j + width)
            away = [p[u, None] - q[None, v] for p, q in ((ax, bx), (ay, by), (az, bz))]
            square = away[0] * away[0]
            for d in away[1:]:
                square += d * d
            square[square == 0] = np.inf
            np.divide(1.0, square, out=square)
            for axis, d in enumerate(away):
                d *= square
                of_a[axis, u] += d @ bw[v]
                of_b[axis, v] -= aw[u] @ d
    return of_a, of_b


def attraction(nodes: DataFrame, edges: DataFrame, k: float, three_d: bool) -> DataFrame:
    """(idx, fx, fy, fz): d*d/k towards every neighbour, once for each edge; self loops don't count."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst")
    a = nodes.select(F.col("idx").alias("src"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = nodes.select(F.col("idx").alias("dst"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    dx, dy, dz, d = numeric.separation(tuple(F.col(f"a{c}") for c in "xyz"), tuple(F.col(f"b{c}") for c in "xyz"), three_d)
    pull = both.join(a, "src").join(b, "dst").select(F.col("src").alias("idx"), *((-v * d / k).alias(f) for v, f in ((dx, "fx"), (dy, "fy"), (dz, "fz"))))
    return pull.groupBy("idx").agg(*(F.sum(c).alias(c) for c in ("fx", "fy", "fz")))


def integrate(nodes: DataFrame, forces: DataFrame, params: Params, k: float) -> DataFrame:
    """Gravity towards the origin, the speed scale, a ceiling on the step, and z at 0 in two dimensions.
    The stored displacement is scaled but not cut."""
    scale, ceiling = params.speed_scale(), params.max_displace() * params.speed_scale()
    joined = nodes.join(forces, "idx", "left")
    force = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("fx", "fy", "fz")]
    z = F.col("z") if params.three_d else F.lit(0.0)
    radius = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + z * z)
    pull = F.when(radius > 0, F.lit(0.01 * k * params.gravity)).otherwise(F.lit(0.0))  # times radius, over radius
    moved = joined.withColumns({f"n{c}": (f - pull * F.col(c)) * scale for c, f in zip("xyz", force)})
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    moved = moved.withColumn("_step", F.when(length > 0, F.least(F.lit(ceiling), length) / length).otherwise(F.lit(0.0)))
    places = {c: F.col(c) + F.col(f"n{c}") * F.col("_step") for c in "xyz"}
    if not params.three_d:
        places["z"] = F.lit(0.0)
    moved = moved.withColumns({f"_{c}": v for c, v in places.items()})
    kept = [c for c in nodes.columns if c not in ("x", "y", "z", "dx", "dy", "dz")]
    return moved.select(*kept, *(F.col(f"_{c}").alias(c) for c in "xyz"), *(F.col(f"n{c}").alias(f"d{c}") for c in "xyz"))


def exact_step(nodes: DataFrame, edges: DataFrame, params: Params) -> DataFrame:
    k = params.k(nodes.count())
    forces = exact_repulsion(nodes, k, params.three_d).unionByName(attraction(nodes, edges, k, params.three_d))
    return integrate(nodes, forces.groupBy("idx").agg(*(F.sum(c).alias(c) for c in ("fx", "fy", "fz"))), params, k)


def bounding_cube(nodes: DataFrame) -> DataFrame:
    """One row: the centre, and half the longest side with a little slack, 1 if there is no extent."""
    b = nodes.agg(*(F.min(c).alias(f"lo{c}") for c in "xyz"), *(F.max(c).alias(f"hi{c}") for c in "xyz"))
    side = F.greatest(*(F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"))
    return b.select(*(((F.col(f"lo{c}") + F.col(f"hi{c}")) * 0.5).alias(f"c{c}") for c in "xyz"), F.when(side > 0, side * 0.5 * 1.001).otherwise(F.lit(1.0)).alias("half"))


def coded(nodes: DataFrame) -> DataFrame:
    """Nodes with their Morton codes in the cube around them, and the cube."""
    cube = bounding_cube(nodes)
    return nodes.crossJoin(F.broadcast(cube)).withColumn("code", numeric.morton(*(F.col(c) for c in "xyz"), *(F.col(f"c{c}") for c in "xyz"), F.col("half")))


def cells(code: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The octree as rows: (level, prefix, count, centre of mass, lowest and highest code, body, width).
    A cell is a leaf if it holds one body or bodies of one code; below a leaf there are no cells."""
    out = None
    todo = code.select("idx", "x", "y", "z", "code", "half")
    rows = todo.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("prefix", F.expr(f"shiftright(code, 3 * ({levels} - level))"))
    sums = rows.groupBy("level", "prefix").agg(F.count("*").alias("mass"), *(F.avg(c).alias(f"m{c}") for c in "xyz"), F.min("code").alias("low"), F.max("code").alias("high"), F.min("idx").alias("first_body"), F.first("half").alias("half"))
    out = sums.withColumns({"leaf": F.col("low") == F.col("high"), "body": F.when(F.col("mass") == 1, F.col("first_body")), "width": 2 * F.col("half") / F.pow(F.lit(2.0), F.col("level"))})
    above = out.filter("leaf").select((F.col("level") + 1).alias("level"), F.col("low").alias("_code"))
    covered = above.withColumn("prefix", F.expr(f"shiftright(_code, 3 * ({levels} - level))")).select("level", "prefix")
    deeper = out.join(covered.withColumn("_below", F.lit(True)), ["level", "prefix"], "left")
    return deeper.filter("_below is null").drop("_below", "first_body", "half")


def compressed_cells(tree: DataFrame) -> DataFrame:
    """Cells that don't hold the same bodies as the cell above: at most 2n - 1."""
    upper = tree.select((F.col("level") + 1).alias("level"), F.col("prefix").alias("_up"), F.col("mass").alias("_mass"))
    joined = tree.withColumn("_up", F.shiftright("prefix", 3)).join(upper, ["level", "_up"], "left")
    return joined.filter(F.col("_mass").isNull() | (F.col("_mass") != F.col("mass"))).drop("_up", "_mass")


def tree_walk(nodes: DataFrame, theta: float = 0.5) -> DataFrame:
    """(idx, level, prefix, mass, body, ex, ey, ez, d2, taken) for every cell that a body meets: a cell is taken
    if it is a leaf or its width is below theta times its distance, else opened, and its children are met.
    Level by level, (body, cell) rows meet the cells they name; a level's rows are written before the next.
    A level of few cells is broadcast, since all bodies meet them; deeper ones are joined by cell, where no
    cell is met by more than a share of the bodies."""
    code = storage.save(coded(nodes), "coded")
    tree = storage.save(cells(code), "cells")
    sizes = {r["level"]: r["count"] for r in tree.groupBy("level").count().collect()}  # a row for each level
    front = code.select("idx", "x", "y", "z", F.lit(0).cast("long").alias("prefix"))
    levels = []
    for level in range(LEVELS + 1):
        here = tree.filter(F.col("level") == level)
        if sizes.get(level, 0) <= BROADCAST_CELLS:
            here = F.broadcast(here)
        met = front.join(here, "prefix").withColumns({"ex": F.col("x") - F.col("mx"), "ey": F.col("y") - F.col("my"), "ez": F.col("z") - F.col("mz")})
        met = met.withColumn("d2", F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez"))
        taken = F.col("leaf") | ((F.col("d2") > 0) & (F.col("width") * F.col("width") < theta * theta * F.col("d2")))
        met = storage.save(met.withColumn("taken", taken), f"met-{level}")
        levels.append(met.select("idx", "level", "prefix", "mass", "body", "ex", "ey", "ez", "d2", "taken"))
        opened = met.filter("not taken")
        if opened.isEmpty():
            break
        below = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda o: F.shiftleft("prefix", 3) + o))
        front = opened.select("idx", "x", "y", "z", below.alias("prefix"))
    out = levels[0]
    for met in levels[1:]:
        out = out.unionByName(met)
    return out


def tree_repulsion(nodes: DataFrame, k: float, theta: float = 0.5) -> DataFrame:
    """(idx, fx, fy, fz) with far cells taken whole; see ``tree_walk``."""
    met = tree_walk(nodes, theta).filter("taken and d2 > 0 and (body is null or body <> idx)")
    force = [F.sum(F.col(e) * F.col("mass") * (k * k) / F.col("d2")).alias(f) for e, f in (("ex", "fx"), ("ey", "fy"), ("ez", "fz"))]
    return met.groupBy("idx").agg(*force)


def tree_step(nodes: DataFrame, edges: DataFrame, params: Params, theta: float = 0.5) -> DataFrame:
    k = params.k(nodes.count())
    flat = nodes if params.three_d else nodes.withColumn("z", F.lit(0.0))
    forces = tree_repulsion(flat, k, theta).unionByName(attraction(nodes, edges, k, params.three_d))
    return integrate(nodes, forces.groupBy("idx").agg(*(F.sum(c).alias(c) for c in ("fx", "fy", "fz"))), params, k)


STEPS = {"gpu": exact_step, "cpu": exact_step, "random": exact_step, "gpu-barnes-hut": tree_step, "barnes-hut": tree_step}


def bounds(nodes: DataFrame) -> DataFrame:
    """Least and greatest of each axis and the extents; null without nodes."""
    b = nodes.agg(*(F.min(c).alias(f"min_{c}") for c in "xyz"), *(F.max(c).alias(f"max_{c}") for c in "xyz"))
    return b.select("*", *((F.col(f"max_{c}") - F.col(f"min_{c}")).alias(f"extent_{c}") for c in "xyz"))


def mean_edge_length(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.col("idx").alias("src"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = nodes.select(F.col("idx").alias("dst"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    length = numeric.separation(tuple(F.col(f"a{c}") for c in "xyz"), tuple(F.col(f"b{c}") for c in "xyz"), True)[3]
    return edges.join(a, "src").join(b, "dst").agg(F.avg(length).alias("mean_edge_length"))


def run(nodes: DataFrame, edges: DataFrame, params: Params, choice: str, steps: int) -> tuple[DataFrame, DataFrame]:
    """Run steps and report: (nodes, one row of layout, counts, steps, seconds, bounds, mean edge, k)."""
    name = parse_choice(choice)
    edges = storage.save(edges.select("src", "dst"), "links")  # every step and the report read them
    began = time.monotonic()
    for i in range(steps):
        nodes = storage.save(STEPS[name](nodes, edges, params), f"step-{i}")
    seconds = time.monotonic() - began
    n = nodes.count()
    report = bounds(nodes).crossJoin(mean_edge_length(nodes, edges)).select(
        F.lit(CHOICES[name]).alias("layout"), F.lit(n).cast("long").alias("node_count"), F.lit(edges.count()).cast("long").alias("edge_count"), F.lit(steps).alias("steps"), F.lit(seconds).alias("elapsed_s"),
        numeric.millis_per_step(F.lit(seconds), F.lit(steps)).alias("millis_per_step"), F.lit(params.k(n)).alias("k"), "mean_edge_length", *(f"{a}_{c}" for a in ("min", "max", "extent") for c in "xyz"),
    )
    return nodes, report
