"""Graph operators on a graph with ties, self loops and repeated edges, against plain searches."""

import heapq
import json
import random
from collections import Counter, deque

import duckdb
import pytest
from pyspark.sql import functions as F

from kgraph import model, sql
from kgraph.functions import numeric
from kgraph.operators import export, layout, search, traversal
from kgraph.plans import registry, tgraph
from kgraph.sources import graph_json, settings, text_graphs

NODES = [
    ("dir:lib", "dir"), ("file:lib/Alpha.py", "file"), ("file:lib/beta.py", "file"), ("file:lib/gamma.py", "file"), ("doc:notes/alpha.md", "doc"), ("sec:notes/alpha.md#use", "sec"),
    ("sym:lib/Alpha.py::alpha", "sym"), ("sym:lib/beta.py::run", "sym"), ("file:lonely.py", "file"), ("sym:lib/gamma.py::alphabet", "sym"),
]
EDGES = [
    (0, 1, "contains"), (0, 2, "contains"), (0, 3, "contains"), (1, 2, "imports"), (2, 3, "imports"), (3, 1, "imports"), (1, 6, "defines"), (2, 7, "defines"), (3, 9, "defines"),
    (6, 7, "calls"), (7, 6, "calls"), (7, 7, "references"), (4, 1, "links"), (4, 1, "links"), (4, 5, "contains"), (9, 6, "references"), (6, 7, "references"),
]


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(i, x, kind, x.split(":", 1)[1], x.split("/")[-1].split(":")[-1].split(".")[0]) for i, (x, kind) in enumerate(NODES)]
    nodes = model.as_nodes(spark.createDataFrame(rows, "idx long, id string, kind string, path string, name string"))
    edges = [(i, NODES[a][0], NODES[b][0], kind, 1.0) for i, (a, b, kind) in enumerate(EDGES)]
    return nodes, spark.createDataFrame(edges, "eidx long, src string, dst string, kind string, weight float")


def hops(start, kinds=None, direction="both"):
    """Hop count of everything reachable."""
    seen, todo = {start: 0}, deque([start])
    while todo:
        at = todo.popleft()
        for a, b, kind in EDGES:
            if kinds is None or kind in kinds:
                for x, y in ((a, b),) * (direction != "in") + ((b, a),) * (direction != "out"):
                    if x == at and y not in seen:
                        seen[y] = seen[at] + 1
                        todo.append(y)
    return seen


@pytest.mark.parametrize(("seed", "depth", "kinds", "direction"), [(4, 1, None, "both"), (4, 3, None, "both"), (6, 2, ["calls", "references"], "out"), (1, 2, ["imports"], "in"), (8, 5, None, "both"), (0, 0, None, "both")])
def test_neighbors_by_hops(graph, seed, depth, kinds, direction):
    got = {r["id"]: r["depth"] for r in traversal.neighbors(*graph, NODES[seed][0], depth, kinds, direction).collect()}
    assert got == {NODES[i][0]: d for i, d in hops(seed, kinds, direction).items() if 0 < d <= depth}


def test_paths_are_shortest(graph):
    joined = {frozenset((a, b)) for a, b, _ in EDGES}
    at = {x: i for i, (x, _) in enumerate(NODES)}
    for a, b in ((4, 9), (5, 7), (8, 8), (2, 2)):
        path = [at[x] for x in traversal.path_between(*graph, NODES[a][0], NODES[b][0])]
        assert path[0] == a and path[-1] == b and len(path) == hops(a)[b] + 1 and all(frozenset(p) in joined for p in zip(path, path[1:]))
    assert traversal.path_between(*graph, NODES[0][0], NODES[8][0]) is None
    assert traversal.path_between(*graph, "file:none", NODES[0][0]) is None and traversal.path_between(*graph, NODES[0][0], "file:none") is None


def least_costs(seed):
    dear = {k: c for k, c in model.EDGE_COSTS.items()}
    done, heap = {}, [(0, 0, NODES[seed][0], seed)]
    while heap:
        cost, hop, _, at = heapq.heappop(heap)
        if at in done:
            continue
        done[at] = (cost, hop)
        for a, b, kind in EDGES:
            for x, y in ((a, b), (b, a)):
                if x == at and y not in done:
                    heapq.heappush(heap, (cost + dear.get(kind, 1), hop + 1, NODES[y][0], y))
    return done


def test_costs_and_pack(graph):
    nodes, edges = graph
    costs = least_costs(4)
    assert {r["id"]: r["cost"] for r in traversal.distances(nodes, edges, NODES[4][0]).collect()} == {NODES[i][0]: c for i, (c, _) in costs.items()}
    size = {r["id"]: r["n"] for r in nodes.select("id", model.estimate_tokens().alias("n")).collect()}
    for budget in (1, sum(size.values()) // 3, sum(size.values()) // 2, 10**6):
        got = traversal.context_pack(nodes, edges, NODES[4][0], budget).orderBy("pos").collect()
        total, want = 0, []
        order = {r["id"]: (r["cost"], r["hop"], r["id"]) for r in traversal.distances(nodes, edges, NODES[4][0]).collect()}
        for x in sorted(order, key=order.get):
            if x == NODES[4][0] or total + size[x] <= budget:
                want.append(x)
                total += size[x]
        assert [r["id"] for r in got] == want and got[0]["reason"] == "seed" and all(r["reason"].startswith(f"{r['distance']} hop(s) away via ") for r in got[1:])
    assert traversal.context_pack(nodes, edges, "file:none", 10) is None


def test_search_prefers_exact_then_prefix(graph):
    nodes, _ = graph
    got = [r["id"] for r in search.find_node(nodes, "ALPHA").orderBy("rank", "idx").collect()]
    assert set(got) == {x for x, _ in NODES if "alpha" in x.lower()} and got.index("sym:lib/Alpha.py::alpha") < got.index("sym:lib/gamma.py::alphabet")
    assert search.find_node(nodes, "").count() == len(NODES) and search.search_matches(nodes, "  ").count() == 0


def test_first_edge_wins_and_ends_must_exist(graph, spark):
    nodes, edges = graph
    assert sorted(r["eidx"] for r in model.dedup_edges(edges).collect()) == [i for i, e in enumerate(EDGES) if e not in EDGES[:i]]
    odd = edges.unionByName(spark.createDataFrame([(90, "file:none", NODES[0][0], "links", 1.0), (91, "x", "y", "links", 1.0)], edges.schema))
    assert model.known_ends(odd, nodes).count() == len(EDGES)
    assert {r["eidx"]: (r["src_unknown"], r["dst_unknown"]) for r in model.dangling(odd, nodes).collect()} == {90: (True, False), 91: (True, True)}


def test_text_round_trip(graph, spark, tmp_path):
    nodes, edges = graph
    assert text_graphs.write_edges(nodes, edges, str(tmp_path / "edges")) == len(EDGES) and text_graphs.write_sidecar(nodes, str(tmp_path / "side")) == len(NODES)
    back, links = text_graphs.parse_exported(text_graphs.read_lines(spark, str(tmp_path / "edges")), text_graphs.read_lines(spark, str(tmp_path / "side")))
    assert [r["id"] for r in back.orderBy("idx").collect()] == [x for x, _ in NODES]
    assert sorted((r["src"], r["dst"]) for r in links.collect()) == sorted((a, b) for a, b, _ in EDGES)
    assert [r["line"] for r in export.edge_lines(nodes, edges, ["links"]).collect()] == ["4 1", "4 1"]


def test_json_round_trip(graph, spark, tmp_path):
    nodes, edges = graph
    graph_json.write(nodes, edges, str(tmp_path / "deep" / "graph.json"))
    again = graph_json.read(spark, str(tmp_path / "deep" / "graph.json"))
    for got, want, key in zip(again, graph, ("idx", "eidx")):
        assert got.orderBy(key).collect() == want.orderBy(key).collect()


def test_odd_text(spark):
    with pytest.raises(Exception, match="line 3"):
        text_graphs.parse_edge_list(text_graphs.lines_of(spark, "# top\nx y\nalone\n"))[1].collect()
    with pytest.raises(Exception, match="out of range"):
        text_graphs.parse_indexed_edges(text_graphs.lines_of(spark, "2 4\n"), 4).collect()
    gaps = text_graphs.parse_sidecar(text_graphs.lines_of(spark, "4\tfile:q\tq\tfile\tq\n")).orderBy("idx").collect()
    assert [r["kind"] for r in gaps] == ["?"] * 4 + ["file"]


def test_tree_walk_is_the_plain_one(spark):
    """The opening rule at 0.5, against a walk over a tree built body by body."""
    points = [(i, float(i * 37 % 101), float(i * 59 % 97), float(i * 83 % 89)) for i in range(60)] + [(60, 5.0, 5.0, 5.0), (61, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(points, "idx long, x double, y double, z double")
    code = {r["idx"]: r["code"] for r in layout.coded(df).collect()}
    half = layout.bounding_cube(df).first()["half"]

    def force(i, level, members):
        own = points[i]
        centre = [sum(points[m][a] for m in members) / len(members) for a in (1, 2, 3)]
        d = [own[a] - c for a, c in zip((1, 2, 3), centre)]
        square = sum(v * v for v in d)
        leaf = len({code[m] for m in members}) == 1
        if leaf or square > 0 and (2 * half / 2**level) ** 2 < 0.25 * square:
            return [0.0] * 3 if square == 0 or members == [i] else [v * len(members) * 49.0 / square for v in d]
        children = {}
        for m in members:
            children.setdefault(code[m] >> 3 * (numeric.MORTON_BITS - level - 1), []).append(m)
        return [sum(v) for v in zip(*(force(i, level + 1, c) for c in children.values()))]

    got = {r["idx"]: (r["fx"], r["fy"], r["fz"]) for r in layout.tree_repulsion(df, 7.0, 0.5).collect()}
    for i in range(len(points)):
        assert got.get(i, (0.0, 0.0, 0.0)) == pytest.approx(force(i, 0, list(range(len(points)))), abs=1e-9)


def most_tasks(spark, name, f):
    """f() and the most tasks that a stage of its jobs has."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out, tracker = f(), spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
        return out, max(s.numTasks for s in stages if s is not None)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def crowd(n):
    """n nodes at 12 places, in turn."""
    return [(i, float(i % 12 * 7 % 12), float(i % 12 * i % 12 % 5), float(i % 12 // 6)) for i in range(n)]


def plain_forces(points, k, three_d=True):
    out = {}
    for i, *p in points:
        total = [0.0, 0.0, 0.0]
        for j, *q in points:
            d = [a - b if axis < 2 or three_d else 0.0 for axis, (a, b) in enumerate(zip(p, q))]
            square = sum(v * v for v in d)
            if i != j and square > 0:
                total = [t + v * k * k / square for t, v in zip(total, d)]
        out[i] = tuple(total)
    return out


def test_exact_step_of_a_crowd(spark):
    points, edges, params = crowd(2 * layout.BLOCK * 4 + 5), [(0, 0, 1), (1, 1, 30), (2, 5, 5)], layout.Params(three_d=True)
    df, links = spark.createDataFrame(points, "idx long, x double, y double, z double"), spark.createDataFrame(edges, "eidx long, src long, dst long")
    got, tasks = most_tasks(spark, "exact step", lambda: {r["idx"]: (r["x"], r["y"], r["z"]) for r in layout.exact_step(df, links, params).collect()})
    assert tasks < 64  # nine blocks of nodes, in all pairs, were 81 tasks; twelve places are one block
    k, at, times = params.k(len(points)), {i: p for i, *p in points}, Counter(tuple(p) for _, *p in points)
    for i in (0, 1, 5, 30, 77, len(points) - 1):
        force = [0.0, 0.0, 0.0]
        for q, n in times.items():
            d = [a - b for a, b in zip(at[i], q)]
            if any(d):
                force = [f + n * v * k * k / sum(w * w for w in d) for f, v in zip(force, d)]
        for _, a, b in edges:
            for u, v in ((a, b), (b, a)):
                if u == i and u != v:
                    d = [p - q for p, q in zip(at[u], at[v])]
                    force = [f - w * sum(x * x for x in d) ** 0.5 / k for f, w in zip(force, d)]
        move = [(f - 0.01 * k * p) * params.speed_scale() for f, p in zip(force, at[i])]
        length = sum(v * v for v in move) ** 0.5
        cut = min(params.max_displace() * params.speed_scale(), length) / length if length else 0.0
        assert got[i] == pytest.approx(tuple(p + v * cut for p, v in zip(at[i], move)), abs=1e-9)
    assert len(got) == len(points)


def test_headless_run_of_a_crowd(spark):
    points = crowd(2 * layout.BLOCK * 4 + 5)
    df, links = spark.createDataFrame(points, "idx long, x double, y double, z double"), spark.createDataFrame([(0, 1, 30)], "eidx long, src long, dst long")
    (moved, report), tasks = most_tasks(spark, "headless run", lambda: layout.run(df, links, layout.Params(three_d=True), "cpu", 1))
    assert tasks < 64 and moved.count() == len(points) and report.first()["node_count"] == len(points)


def test_headless_run_takes_edges_once(spark):
    """A step and its report read the edges in several places; a plan that makes them must not be run for each."""
    nodes, read = spark.createDataFrame(crowd(40), "idx long, x double, y double, z double"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    links = spark.createDataFrame([(i, i, i + 1) for i in range(39)], "eidx long, src long, dst long").mapInPandas(counted, "eidx long, src long, dst long")
    report = layout.run(nodes, links, layout.Params(three_d=True), "cpu", 2)[1].first()
    assert (report["edge_count"], report["steps"]) == (39, 2) and read.value == 39  # were 234


def test_graph_tables_make_node_rows_once(spark, monkeypatch):
    """Edges are derived from the stored nodes, not from the tables' unions and joins again."""
    made, rows = [], tgraph._node_rows
    monkeypatch.setattr(tgraph, "_BUILT", {})
    monkeypatch.setattr(tgraph, "_node_rows", lambda *a: made.append(a) or rows(*a))
    nodes, edges = (f(spark, "/root/testdata/sf0.001") for f in (tgraph.nodes, tgraph.edges))
    assert len(made) == 1  # were two
    assert model.dangling(edges, nodes).isEmpty() and edges.agg(F.max("eidx") + 1).first()[0] == edges.count() > 0


@pytest.mark.parametrize("name", ["l_repulsion_exact", "join_all_pairs"])
def test_repulsion_queries_build_no_edges(spark, monkeypatch, name):
    monkeypatch.setattr(tgraph, "_edges", lambda *a: pytest.fail("edges are built, on which no row depends"))
    monkeypatch.setattr(tgraph, "_BUILT", {})
    got = registry.all_queries()[name](spark, "/root/testdata/sf0.001")
    assert got.count() == tgraph.nodes(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("three_d", [True, False])
@pytest.mark.parametrize("broadcast", [layout.BROADCAST_PLACES, 0])
def test_exact_repulsion_of_a_crowd(spark, monkeypatch, three_d, broadcast):
    monkeypatch.setattr(layout, "BROADCAST_PLACES", broadcast)  # 0: the way of many places, with all of these crowded or, at a crowd of one, not
    points = [*crowd(150), (150, -0.0, 0.0, 0.0), (151, 3.25, -7.5, 1e-3), (152, 3.25, -7.5, 2.0)]
    df = spark.createDataFrame(points, "idx long, x double, y double, z double")
    got, tasks = most_tasks(spark, f"repulsion {three_d} {broadcast}", lambda: {r["idx"]: (r["fx"], r["fy"], r["fz"]) for r in layout.exact_repulsion(df, 7.0, three_d, 4).collect()})
    want = plain_forces(points, 7.0, three_d)
    assert tasks < 64 and set(got) == set(want)  # 39 blocks of four nodes were 1521 tasks
    for i, force in want.items():
        assert got[i] == pytest.approx(force, abs=1e-9)


def test_all_pairs_in_bounded_blocks(spark, monkeypatch):
    """Places apart, in blocks of one node: pairs of blocks don't grow with the square of their count. No place here is crowded."""
    monkeypatch.setattr(layout, "BROADCAST_PLACES", 0)
    draw = random.Random(4)
    points = [(i, *(draw.uniform(-9, 9) for _ in range(3))) for i in range(1100)]
    df = spark.createDataFrame(points, "idx long, x double, y double, z double")
    got, tasks = most_tasks(spark, "all pairs", lambda: {r["idx"]: (r["fx"], r["fy"], r["fz"]) for r in layout.exact_repulsion(df, 7.0, True, 1).collect()})
    assert tasks <= layout.MOST_BLOCKS * (layout.MOST_BLOCKS + 1) // 2 and len(got) == len(points)  # were 4096
    want = plain_forces(points, 7.0)
    for i, force in want.items():
        assert got[i] == pytest.approx(force, rel=1e-9, abs=1e-7)


def test_segment_distance_rounds_as_sql(spark):
    """Segments through the cursor are at distances of a rounding error or none, which decide between them: equal to the last bit."""
    draw = random.Random(5)
    rows = []
    for i in range(200):
        dx, dy, far, near = draw.uniform(-500, 500), draw.uniform(-500, 500), draw.uniform(0.1, 1), draw.uniform(0.1, 1)
        rows.append((i, 600 - far * dx, 400 - far * dy, 600 + near * dx, 400 + near * dy))
    df = spark.createDataFrame(rows, "i long, ax double, ay double, bx double, by double")
    away = numeric.point_segment_distance(F.lit(600.0), F.lit(400.0), *(F.col(c) for c in ("ax", "ay", "bx", "by")))
    got = {r["i"]: r["away"] for r in df.select("i", away.alias("away")).collect()}
    table = ", ".join(f"({i}, {', '.join(f'{v!r}::DOUBLE' for v in r)})" for i, *r in rows)
    want = duckdb.connect().execute(f"""SELECT i, sqrt((600 - ax - t * (bx - ax)) ** 2 + (400 - ay - t * (by_ - ay)) ** 2) FROM (SELECT *, least(greatest(((600 - ax) * (bx - ax) + (400 - ay) * (by_ - ay))
      / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0), 1) AS t FROM (VALUES {table}) AS s(i, ax, ay, bx, by_))""").fetchall()
    assert got == dict(want)


def test_settings(tmp_path):
    path = tmp_path / "settings.json"
    path.write_text('{"speed": 7, "threeD": false, "background": [1, 2, 3], "mine": {"a": 1}}')
    got = settings.load(str(path))
    assert got == settings.Settings(speed=7.0, three_d=False, background=(1, 2, 3))
    settings.save(str(path), settings.Settings(speed=9.0, layout="cpu"))
    raw = json.loads(path.read_text())
    assert raw["mine"] == {"a": 1} and raw["background"] == [1, 2, 3] and raw["speed"] == 9.0 and "layout" not in raw
    assert settings.load(None, str(tmp_path / "none.json")) == settings.Settings()
    with pytest.raises(FileNotFoundError):
        settings.load(str(tmp_path / "none.json"))
    for bad in ("[]", '{"speed": "fast"}'):
        with pytest.raises(ValueError):
            settings.parse(bad)


def test_kinds_filter_reaches_nothing_for_an_empty_list(graph):
    _, edges = graph
    assert model.of_kinds(edges, []).count() == 0 and model.of_kinds(edges, None).count() == len(EDGES)
    assert model.of_kinds(edges, ["links"]).agg(F.count("*")).first()[0] == 2


def test_spark_sql_sees_the_graph(graph, spark):
    sql.register(*graph, prefix="t_")
    got = spark.sql("SELECT n.kind, count(*) AS c FROM t_edges e JOIN t_nodes n ON n.id = e.dst WHERE e.kind = 'links' GROUP BY 1").collect()
    assert [tuple(r) for r in got] == [("file", 2)]
