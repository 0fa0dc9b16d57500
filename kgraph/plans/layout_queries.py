"""Layout and viewer queries over deterministic positions of the property graph's nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgraph.functions import numeric
from kgraph.operators import export, layout, viewer
from kgraph.plans import tgraph
from kgraph.plans.registry import graph, nodes_alone, over_graph, query

SEEDED = """pos AS MATERIALIZED (SELECT idx, kind, name, ((idx * 37) % 2001 - 1000)::DOUBLE AS x, ((idx * 911) % 2001 - 1000)::DOUBLE AS y, ((idx * 577) % 2001 - 1000)::DOUBLE AS z FROM nodes),
d AS MATERIALIZED (SELECT eidx, a.idx AS src, b.idx AS dst FROM edges JOIN nodes a ON a.id = edges.src JOIN nodes b ON b.id = edges.dst)"""


def placed(n):
    i = F.col("idx")
    return n.select("idx", "kind", "name", *(((i * k % 2001) - 1000).cast("double").alias(c) for k, c in ((37, "x"), (911, "y"), (577, "z"))))


def add(name, f, sql, more="", over=graph):
    query(name, over_graph(sql, SEEDED + more) if sql else None)(over(f))


def links(n, e):
    return export.layout_graph(n, e)[1]


add("agg_bounds", lambda n, e: layout.bounds(placed(n)), "SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, max(x) - min(x) AS extent_x, max(y) - min(y) AS extent_y, max(z) - min(z) AS extent_z FROM pos")
add("agg_mean_edge_len", lambda n, e: layout.mean_edge_length(placed(n), links(n, e)).select(F.round("mean_edge_length", 6).alias("mean_edge_length")), "SELECT round(avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS mean_edge_length FROM d JOIN pos a ON a.idx = src JOIN pos b ON b.idx = dst")
CUBE = ", cube AS (SELECT (min(x) + max(x)) * 0.5::DOUBLE AS cx, (min(y) + max(y)) * 0.5::DOUBLE AS cy, (min(z) + max(z)) * 0.5::DOUBLE AS cz, CASE WHEN greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) > 0 THEN greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) * 0.5::DOUBLE * 1.001::DOUBLE ELSE 1.0::DOUBLE END AS half FROM pos)"
add("agg_bounding_cube", lambda n, e: layout.bounding_cube(placed(n)).select("cx", "cy", "cz", F.round("half", 6).alias("half")), "SELECT cx, cy, cz, round(half, 6) AS half FROM cube", CUBE)
OCT = CUBE + ", oct AS (SELECT idx, x, y, z, greatest(least(floor((x - (cx - half)) / (half * 2) * 8), 7), 0)::BIGINT AS gx, greatest(least(floor((y - (cy - half)) / (half * 2) * 8), 7), 0)::BIGINT AS gy, greatest(least(floor((z - (cz - half)) / (half * 2) * 8), 7), 0)::BIGINT AS gz FROM pos, cube)"
MIX = " | ".join(f"(((g{c} >> {b}) & 1) << {3 * b + k})" for b in range(3) for k, c in enumerate("xyz"))
add("agg_center_mass", lambda n, e: layout.cells(layout.coded(placed(n))).filter("level = 3").select("prefix", "mass", *(F.round(f"m{c}", 4).alias(f"m{c}") for c in "xyz")), f"SELECT {MIX} AS prefix, count(*) AS mass, round(avg(x), 4) AS mx, round(avg(y), 4) AS my, round(avg(z), 4) AS mz FROM oct GROUP BY 1", OCT)
GRID = ", ".join(f"greatest(least(floor((p.{c} - (c{c} - half)) / (half * 2) * 2097152), 2097151), 0)::BIGINT AS g{c}" for c in "xyz")
MIX21 = " | ".join(f"(((g{c} >> {b}) & 1) << {3 * b + k})" for b in range(21) for k, c in enumerate("xyz"))
#: All cells of the octree: a cell below a leaf, which holds one body or bodies of one code, isn't there.
TREE = (
    CUBE + f", codes AS MATERIALIZED (SELECT idx, x, y, z, half, {MIX21} AS code FROM (SELECT p.idx, p.x, p.y, p.z, half, {GRID} FROM pos p, cube)), "
    "every_cell AS MATERIALIZED (SELECT v::INTEGER AS level, code >> (63 - 3 * v)::INTEGER AS prefix, count(*) AS mass, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, "
    "min(code) = max(code) AS leaf, CASE WHEN count(*) = 1 THEN min(idx) END AS body, 2 * any_value(half) / pow(2, v) AS width FROM codes, (SELECT unnest(range(22)) AS v) GROUP BY v, 2), "
    "tree AS MATERIALIZED (SELECT c.* FROM every_cell c LEFT JOIN every_cell up ON up.level = c.level - 1 AND up.prefix = c.prefix >> 3 WHERE up.leaf IS NULL OR NOT up.leaf)"
)
add("l_octree_build", lambda n, e: layout.cells(layout.coded(placed(n))).groupBy("level").agg(F.sum("mass").alias("bodies"), F.count("*").alias("cells")), "SELECT level, sum(mass)::BIGINT AS bodies, count(*) AS cells FROM tree GROUP BY level", TREE)
add("l_octree_build_gpu", lambda n, e: layout.compressed_cells(layout.cells(layout.coded(placed(n)))).agg(F.max("mass").alias("root_mass"), (F.count("*") <= 2 * F.max("mass") - 1).alias("within")), "SELECT count(*) AS root_mass, true AS within FROM pos")
K = "(500.0::DOUBLE * 1000 / (1 + (SELECT count(*) FROM pos)))"

def rounded(df, digits=3):
    return df.select("idx", *(F.round(c, digits).alias(c) for c in ("fx", "fy", "fz")))


LEVELS = range(22)
MET = "SELECT b.idx, b.x, b.y, b.z, c.*, (b.x - mx) ** 2 + (b.y - my) ** 2 + (b.z - mz) ** 2 AS d2 FROM "
#: The walk level by level: each body meets the children of the cells that it opened one level above.
WALK = ", met0 AS MATERIALIZED (SELECT *, leaf OR (d2 > 0 AND width * width < 0.25 * d2) AS taken FROM (" + MET + "pos b, tree c WHERE c.level = 0)), " + ", ".join(
    f"met{v} AS MATERIALIZED (SELECT *, leaf OR (d2 > 0 AND width * width < 0.25 * d2) AS taken FROM ({MET}met{v - 1} b JOIN tree c ON c.level = {v} AND c.prefix >> 3 = b.prefix WHERE NOT b.taken))" for v in LEVELS[1:]
)
WALK = WALK.replace("c.*,", "c.level, c.prefix, c.mass, c.leaf, c.body, c.width, c.mx, c.my, c.mz,").replace("(b.x - mx)", "(b.x - c.mx)").replace("(b.y - my)", "(b.y - c.my)").replace("(b.z - mz)", "(b.z - c.mz)")
WALK += ", met AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM met{v}" for v in LEVELS) + "), tree_rep AS MATERIALIZED (SELECT idx, " + ", ".join(f"sum(({c} - m{c}) * mass * {K} * {K} / d2) AS f{c}" for c in "xyz") + " FROM met WHERE taken AND d2 > 0 AND (body IS NULL OR body <> idx) GROUP BY idx)"
WALKED = "SELECT level, count(*) AS met, count(*) FILTER (taken) AS taken FROM met GROUP BY level"
P3 = layout.Params(three_d=True)
REPEL = f"SELECT a.idx AS idx, sum((a.x - b.x) * {K} * {K} / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS fx, sum((a.y - b.y) * {K} * {K} / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS fy, sum((a.z - b.z) * {K} * {K} / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS fz FROM pos a JOIN pos b ON a.idx <> b.idx AND ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) > 0 GROUP BY 1"
ROUND3 = "idx, round(fx, 3) AS fx, round(fy, 3) AS fy, round(fz, 3) AS fz"


def count_k(df):
    return P3.k(df.count())


add("l_repulsion_exact", lambda n: (lambda f: rounded(layout.exact_repulsion(f, count_k(f), True), 2))(placed(n)), f"SELECT {ROUND3.replace(', 3)', ', 2)')} FROM ({REPEL})", over=nodes_alone)
add("join_all_pairs", lambda n: (lambda f: rounded(layout.exact_repulsion(f, count_k(f), True, 512), 2))(placed(n)), f"SELECT {ROUND3.replace(', 3)', ', 2)')} FROM ({REPEL})", over=nodes_alone)
PULL = f"SELECT a.idx AS idx, sum(-(a.x - b.x) * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / kk) AS fx, sum(-(a.y - b.y) * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / kk) AS fy, sum(-(a.z - b.z) * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / kk) AS fz FROM (SELECT src, dst FROM d UNION ALL SELECT dst, src FROM d) JOIN pos a ON a.idx = src JOIN pos b ON b.idx = dst, (SELECT 500.0::DOUBLE * 1000 / (1 + count(*)) AS kk FROM pos) WHERE src <> dst GROUP BY 1"
add("l_attraction", lambda n, e: (lambda p: rounded(layout.attraction(p, links(n, e), count_k(p), True)))(placed(n)), f"SELECT {ROUND3} FROM ({PULL})")
add("join_attraction", lambda n, e: (lambda p: layout.attraction(p, links(n, e), count_k(p), True).agg(F.count("*").alias("moved")))(placed(n)), "SELECT count(*) AS moved FROM (SELECT DISTINCT src FROM (SELECT src, dst FROM d UNION ALL SELECT dst, src FROM d) WHERE src <> dst)")


def _integrated(n, e):
    p = placed(n)
    moved = layout.integrate(p, layout.attraction(p, links(n, e), count_k(p), True), P3, count_k(p))
    return moved.select("idx", *(F.round(c, 4).alias(c) for c in "xyz"))


STEP = f""", force AS (SELECT pos.idx AS idx, x, y, z, coalesce(fx, 0) AS fx, coalesce(fy, 0) AS fy, coalesce(fz, 0) AS fz FROM pos LEFT JOIN ({PULL}) p ON p.idx = pos.idx), kk AS (SELECT 0.01::DOUBLE * 500 * 1000 / (1 + count(*)) AS g FROM pos),
m AS (SELECT idx, x, y, z, (fx - g * x) * 0.25::DOUBLE AS nx, (fy - g * y) * 0.25::DOUBLE AS ny, (fz - g * z) * 0.25::DOUBLE AS nz FROM force, kk), s AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM m)"""
CEILING = "(sqrt(500000.0::DOUBLE) / 10 * 0.25::DOUBLE)"
add("l_integrate", _integrated, f"SELECT idx, round(x + CASE WHEN len > 0 THEN nx * least({CEILING}, len) / len ELSE 0 END, 4) AS x, round(y + CASE WHEN len > 0 THEN ny * least({CEILING}, len) / len ELSE 0 END, 4) AS y, round(z + CASE WHEN len > 0 THEN nz * least({CEILING}, len) / len ELSE 0 END, 4) AS z FROM s", STEP)


STEPPED = f""", rep AS ({REPEL}), att AS ({PULL}),
force AS (SELECT pos.idx AS idx, x, y, z, coalesce(rep.fx, 0) + coalesce(att.fx, 0) AS fx, coalesce(rep.fy, 0) + coalesce(att.fy, 0) AS fy, coalesce(rep.fz, 0) + coalesce(att.fz, 0) AS fz FROM pos LEFT JOIN rep ON rep.idx = pos.idx LEFT JOIN att ON att.idx = pos.idx), kk AS (SELECT 0.01::DOUBLE * 500 * 1000 / (1 + count(*)) AS g FROM pos),
m AS (SELECT idx, x, y, z, (fx - g * x) * 0.25::DOUBLE AS nx, (fy - g * y) * 0.25::DOUBLE AS ny, (fz - g * z) * 0.25::DOUBLE AS nz FROM force, kk), s AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM m)"""
STEP_SQL = f"SELECT idx, round(x + CASE WHEN len > 0 THEN nx * least({CEILING}, len) / len ELSE 0 END, 4) AS x, round(y + CASE WHEN len > 0 THEN ny * least({CEILING}, len) / len ELSE 0 END, 4) AS y, round(z + CASE WHEN len > 0 THEN nz * least({CEILING}, len) / len ELSE 0 END, 4) AS z FROM s"
add("l_fr_step", lambda n, e: layout.exact_step(placed(n), links(n, e), P3).select("idx", *(F.round(c, 4).alias(c) for c in "xyz")), STEP_SQL, STEPPED)
add("l_repulsion_bh", lambda n, e: (lambda p: rounded(layout.tree_repulsion(p, count_k(p), 0.5), 2))(placed(n)), f"SELECT {ROUND3.replace(', 3)', ', 2)')} FROM tree_rep", TREE + WALK)
add("join_bh_walk", lambda n, e: layout.tree_walk(placed(n), 0.5).groupBy("level").agg(F.count("*").alias("met"), F.count_if("taken").alias("taken")), WALKED, TREE + WALK)
TREE_STEPPED = TREE + WALK + STEPPED.replace(f"rep AS ({REPEL})", "rep AS (SELECT * FROM tree_rep)")
add("l_bh_step", lambda n, e: layout.tree_step(placed(n), links(n, e), P3, 0.5).select("idx", *(F.round(c, 4).alias(c) for c in "xyz")), STEP_SQL, TREE_STEPPED)
query("l_params", "SELECT 500.0::DOUBLE * 1000 / (1 + count(*)) AS k, sqrt(500000.0::DOUBLE) / 10 AS max_displace, 0.25::DOUBLE AS speed_scale FROM part")(lambda spark, sf_dir: spark.createDataFrame([(P3.k(spark.read.parquet(f"{sf_dir}/part.parquet").count()), P3.max_displace(), P3.speed_scale())], "k double, max_displace double, speed_scale double"))
query("l_separation", "SELECT p_partkey, round(sqrt((p_size - 20.0::DOUBLE) ** 2 + (p_retailprice - 100) ** 2), 6) AS flat, round(sqrt((p_size - 20.0::DOUBLE) ** 2 + (p_retailprice - 100) ** 2 + 9), 6) AS deep FROM part")(
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *(F.round(numeric.separation((F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(5.0)), (F.lit(20.0), F.lit(100.0), F.lit(2.0)), deep)[3], 6).alias(name) for deep, name in ((False, "flat"), (True, "deep"))))
)
COLOR = " ".join(f"WHEN '{k}' THEN {rgb[0]}::DOUBLE" for k, rgb in layout.COLORS.items())
add("l_colorize", lambda n, e: layout.colorize(layout.scatter(n.select("idx")), n).select("idx", "r", "a"), f"SELECT idx, CASE kind {COLOR} END AS r, 1.0::DOUBLE AS a FROM nodes")
add("l_scatter", lambda n, e: layout.scatter(n.select("idx"), seed=3).select("idx", "x", "y", "z", "size"), None)
add("v_reseed", lambda n, e: layout.scatter(n.select("idx"), seed=3).join(layout.scatter(n.select("idx").repartition(3), seed=3).select("idx", F.col("x").alias("again")), "idx").agg(F.sum((F.col("x") != F.col("again")).cast("int")).alias("moved")), "SELECT 0::BIGINT AS moved")
add("l_headless_run", lambda n, e: layout.run(placed(n), links(n, e), P3, "cpu", 1)[1].select("layout", "node_count", "edge_count", "steps", F.round("k", 6).alias("k")), "SELECT 'F-R cpu' AS layout, count(*) AS node_count, (SELECT count(*) FROM d WHERE src IN (SELECT idx FROM pos) AND dst IN (SELECT idx FROM pos)) AS edge_count, 1 AS steps, round(500000.0::DOUBLE / (1 + count(*)), 6) AS k FROM pos")

# Viewer

MATRIX = numeric.view_projection(0.0, 0.0, (0.0, 0.0, -1700.0), 1.0, 1.5, 1.0, 10_000.0)
SCREEN = (1200.0, 800.0)


def shown(n):
    return placed(n).withColumns({"mask": F.when(F.col("kind") == "doc", 0).otherwise(1), "size": F.lit(20.0)})


def _m(r, c):
    return repr(float(MATRIX[r][c])) + "::DOUBLE"


CLIP = ", clip AS MATERIALIZED (SELECT idx, name, CASE WHEN kind = 'doc' THEN 0 ELSE 1 END AS mask, z - 1700 AS vz, " + ", ".join(f"{_m(r, 0)} * x + {_m(r, 1)} * y + {_m(r, 2)} * z + {_m(r, 3)} AS c{c}" for r, c in enumerate("xyzw")) + " FROM pos), scr AS MATERIALIZED (SELECT *, (cx / cw * 0.5 + 0.5) * 1200 AS px, (1 - (cy / cw * 0.5 + 0.5)) * 800 AS py FROM clip WHERE cw > 0 AND mask = 1)"
add("v_project_labels", lambda n, e: viewer.labels(shown(n), MATRIX, *SCREEN).select("idx", "name", F.round("px", 3).alias("px"), F.round("py", 3).alias("py")), "SELECT idx, name, round(px, 3) AS px, round(py - 12, 3) AS py FROM scr WHERE cz / cw BETWEEN 0 AND 1 AND abs(cx / cw) <= 1 AND abs(cy / cw) <= 1 ORDER BY idx LIMIT 800", CLIP)
add("limit_labels", lambda n, e: viewer.labels(shown(n), MATRIX, *SCREEN, most=25).select("idx"), "SELECT idx FROM scr WHERE cz / cw BETWEEN 0 AND 1 AND abs(cx / cw) <= 1 AND abs(cy / cw) <= 1 ORDER BY idx LIMIT 25", CLIP)
add("v_pick_node", lambda n, e: viewer.pick_node(shown(n), MATRIX, [0.0, 0.0, 1.0, -1700.0], 600.0, 400.0, *SCREEN), "SELECT arg_min(idx, (cz / cw, idx)) AS idx FROM scr WHERE vz < 0 AND sqrt((px - 600) ** 2 + (py - 400) ** 2) <= greatest(20 * 500 / -vz * 0.5, 7)", CLIP)
add("v_pick_edge", lambda n, e: viewer.pick_edge(shown(n), links(n, e), MATRIX, 600.0, 400.0, *SCREEN), """SELECT arg_min(eidx, (dist, eidx)) AS eidx FROM (SELECT eidx, sqrt((600 - ax - t * (bx - ax)) ** 2 + (400 - ay - t * (by_ - ay)) ** 2) AS dist FROM (SELECT eidx, ax, ay, bx, by_, CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 > 0 THEN least(greatest(((600 - ax) * (bx - ax) + (400 - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0), 1) ELSE 0 END AS t
  FROM (SELECT eidx, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM d JOIN scr a ON a.idx = src JOIN scr b ON b.idx = dst))) WHERE dist <= 6""", CLIP)
add("v_focus", lambda n, e: viewer.focus(placed(n), 12), "SELECT idx, -x AS cam_x, -y AS cam_y, -700 - z AS cam_z FROM pos WHERE idx = 12")
add("v_edge_vertices", lambda n, e: viewer.edge_vertices(links(n, e)), "SELECT eidx * 2 AS vertex, src AS node FROM d UNION ALL SELECT eidx * 2 + 1, dst FROM d")
_ = tgraph
