"""Queries on nodes and edges: search, joins, aggregates, windows, traversal, export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgraph import model
from kgraph.functions import text
from kgraph.operators import export, search, traversal
from kgraph.plans.registry import graph, over_graph, query
from kgraph.plans import tgraph

SEED = "sym:part::7"
TARGET = "dir:ASIA"
DEPTH = 2
BUDGET = 2000
NEEDLE = "EN"


def add(name: str, f, sql: str | None, more: str = "") -> None:
    query(name, over_graph(sql, more) if sql else None)(graph(f))


# Search and lookups

RANK = "CASE WHEN lower(name) = '{q}' THEN 0 WHEN starts_with(lower(name), '{q}') THEN 1 WHEN contains(lower(name), '{q}') THEN 2 ELSE {other} END"
add("find_node", lambda n, e: search.find_node(n, NEEDLE).select("idx", "id", "rank"), f"SELECT idx, id, {RANK.format(q='en', other=3)} AS rank FROM nodes WHERE contains(lower(name), 'en') OR contains(lower(path), 'en') OR contains(lower(id), 'en')")
add("find_node_kind", lambda n, e: search.find_node(n, "7", "sym").select("idx", "id", "rank"), f"SELECT idx, id, {RANK.format(q='7', other=3)} AS rank FROM nodes WHERE kind = 'sym' AND (contains(lower(name), '7') OR contains(lower(path), '7') OR contains(lower(id), '7'))")
add("sort_relevance", lambda n, e: search.with_position(search.find_node(n, "c1")).select("pos", "idx", "rank"), f"SELECT row_number() OVER (ORDER BY rank, idx) - 1 AS pos, idx, rank FROM (SELECT idx, {RANK.format(q='c1', other=3)} AS rank FROM nodes WHERE contains(lower(name), 'c1') OR contains(lower(path), 'c1') OR contains(lower(id), 'c1'))")
add("search_matches", lambda n, e: search.search_matches(n, "  Brand#1 ").select("idx", "rank"), f"SELECT idx, {RANK.format(q='brand#1', other=2)} AS rank FROM nodes WHERE contains(lower(name), 'brand#1') OR contains(lower(path), 'brand#1')")
add("limit_search", lambda n, e: search.first_shown(search.search_matches(n, "c")).select("idx", "rank", "more"), f"SELECT idx, rank, greatest((SELECT count(*) FROM hit) - 60, 0) AS more FROM hit ORDER BY rank, idx LIMIT 60", f"hit AS (SELECT idx, {RANK.format(q='c', other=2)} AS rank FROM nodes WHERE contains(lower(name), 'c') OR contains(lower(path), 'c'))")
add("edge_kind_filter", lambda n, e: model.of_kinds(e, ["imports", "links"]).select("eidx", "src", "dst", "kind"), "SELECT eidx, src, dst, kind FROM edges WHERE kind IN ('imports', 'links')")
add("kind_visibility", lambda n, e: search.visibility(n, ["doc", "sec"]).select("idx", "mask"), "SELECT idx, CASE WHEN kind IN ('doc', 'sec') THEN 0 ELSE 1 END AS mask FROM nodes")
EDGE_MASK = "SELECT eidx, least(a.mask, b.mask) AS mask FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst"
MASKS = "m AS (SELECT id, CASE WHEN kind IN ('doc', 'sec') THEN 0 ELSE 1 END AS mask FROM nodes)"
add("edge_visibility", lambda n, e: search.edge_visibility(e, search.visibility(n, ["doc", "sec"])).select("eidx", "mask"), EDGE_MASK, MASKS)
add("meta_inspect", lambda n, e: search.inspect(n, 40).select("idx", "id", "name", "shown_kind"), "SELECT idx, id, name, coalesce(symbol_kind, kind) AS shown_kind FROM nodes WHERE idx = 40")
add("node_lookup", lambda n, e: search.node(n, SEED).select("idx", "id", "kind", "path", "name", "symbol_kind", "loc"), f"SELECT idx, id, kind, path, name, symbol_kind, loc FROM nodes WHERE id = '{SEED}'")
add("out_edges", lambda n, e: search.out_edges(e, SEED).select("eidx", "dst", "kind"), f"SELECT eidx, dst, kind FROM edges WHERE src = '{SEED}'")
add("in_edges", lambda n, e: search.in_edges(e, SEED).select("eidx", "src", "kind"), f"SELECT eidx, src, kind FROM edges WHERE dst = '{SEED}'")
add("node_edge_count", search.counts, "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")

# Joins

DENSE = "SELECT eidx, a.idx AS from_idx, b.idx AS to_idx FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst"
add("join_dense_index", lambda n, e: export.dense_edges(n, e), DENSE)
add("join_induced", lambda n, e: model.known_ends(e, n.filter("kind in ('file', 'dir')")).select("eidx"), "SELECT eidx FROM edges WHERE src IN (SELECT id FROM nodes WHERE kind IN ('file', 'dir')) AND dst IN (SELECT id FROM nodes WHERE kind IN ('file', 'dir'))")
add("join_dangling", lambda n, e: model.dangling(e, n.filter("kind <> 'sec'")).select("eidx", "src_unknown", "dst_unknown"), "SELECT eidx, src NOT IN (SELECT id FROM known) AS src_unknown, dst NOT IN (SELECT id FROM known) AS dst_unknown FROM edges WHERE src NOT IN (SELECT id FROM known) OR dst NOT IN (SELECT id FROM known)", "known AS (SELECT id FROM nodes WHERE kind <> 'sec')")
add("join_rollup_imports", lambda n, e: e.filter("kind = 'imports'").join(n.select(F.col("id").alias("dst"), "name"), "dst").select("eidx", "src", "name"), "SELECT eidx, src, name FROM edges JOIN nodes ON id = dst WHERE edges.kind = 'imports'")
add("join_mask", lambda n, e: search.edge_visibility(e, search.visibility(n, ["sym"])).groupBy("kind").agg(F.sum("mask").alias("shown")), "SELECT edges.kind AS kind, sum(least(a.mask, b.mask))::BIGINT AS shown FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst GROUP BY 1", "m AS (SELECT id, CASE WHEN kind = 'sym' THEN 0 ELSE 1 END AS mask FROM nodes)")


def _first_of_name(n):
    return n.filter("kind = 'sym'").groupBy("symbol_kind", "name").agg(F.min_by("id", "idx").alias("dst"))


def _mentions(n, e, kind):
    """Symbols stand for files by their kind of symbol: a mention goes to the first symbol of that name."""
    named = n.filter("kind = 'sym'").select("id", "symbol_kind", "name")
    rows = e.filter(F.col("kind") == kind).join(named.select(F.col("id").alias("dst"), "name"), "dst").select("src", "name", "eidx")
    own = named.select(F.col("id").alias("src"), "symbol_kind") if kind == "calls" else None
    rows = rows.join(own, "src") if own is not None else rows.crossJoin(F.broadcast(named.agg(F.min("symbol_kind").alias("symbol_kind"))))
    return rows.join(_first_of_name(n), ["symbol_kind", "name"]).filter("src <> dst").select("eidx", "src", "dst")


FIRST = "f AS (SELECT symbol_kind, name, min_by(id, idx) AS dst FROM nodes WHERE kind = 'sym' GROUP BY 1, 2)"
add("join_symbol_calls", lambda n, e: _mentions(n, e, "calls"), "SELECT eidx, src, f.dst AS dst FROM edges JOIN nodes t ON t.id = edges.dst JOIN nodes s ON s.id = src JOIN f ON f.symbol_kind = s.symbol_kind AND f.name = t.name WHERE edges.kind = 'calls' AND src <> f.dst", FIRST)
add("join_symbol_refs", lambda n, e: _mentions(n, e, "references"), "SELECT eidx, src, f.dst AS dst FROM edges JOIN nodes t ON t.id = edges.dst JOIN f ON f.symbol_kind = (SELECT min(symbol_kind) FROM nodes WHERE kind = 'sym') AND f.name = t.name WHERE edges.kind = 'references' AND src <> f.dst", FIRST)
add("agg_first_wins", lambda n, e: _first_of_name(n), "SELECT * FROM f", FIRST)

# Sets and constraints

add("set_dedup_nodes", lambda n, e: model.dedup_nodes(n.unionByName(n.withColumn("idx", F.col("idx") + 100_000)).withColumn("id", F.replace("id", F.lit("s1"), F.lit("s")))).select("idx", "id"), "SELECT min(idx) AS idx, id FROM (SELECT idx, replace(id, 's1', 's') AS id FROM nodes UNION ALL SELECT idx + 100000, replace(id, 's1', 's') FROM nodes) GROUP BY id")
add("set_dedup_edges", lambda n, e: model.dedup_edges(e.unionByName(e.withColumn("eidx", F.col("eidx") + 1_000_000)).withColumn("kind", F.when(F.col("kind") == "links", "references").otherwise(F.col("kind")))).select("eidx", "src", "dst", "kind"), "SELECT min(eidx) AS eidx, src, dst, kind FROM (SELECT eidx, src, dst, CASE WHEN kind = 'links' THEN 'references' ELSE kind END AS kind FROM edges) GROUP BY src, dst, kind")
add("set_union_labels", lambda n, e: e.select(F.col("src").alias("label")).union(e.select("dst")).distinct(), "SELECT src AS label FROM edges UNION SELECT dst FROM edges")
add("set_union_directions", lambda n, e: traversal.adjacency(e, ["imports"], "both").select("at", "to", "dir", "eidx"), 'SELECT src AS "at", dst AS "to", 0 AS dir, eidx FROM edges WHERE kind = \'imports\' UNION ALL SELECT dst, src, 1, eidx FROM edges WHERE kind = \'imports\'')
add("set_undirected", lambda n, e: export.both_ways(export.layout_graph(n, e)[1]).groupBy("node").agg(F.count("*").alias("n"), F.sum("neighbor").alias("s")), "SELECT node, count(*) AS n, sum(nb)::BIGINT AS s FROM (SELECT from_idx AS node, to_idx AS nb FROM d UNION ALL SELECT to_idx, from_idx FROM d) GROUP BY 1", f"d AS ({DENSE})")
add("set_membership", lambda n, e: n.join(e.filter("kind = 'imports'").select(F.col("src").alias("id")), "id", "left_semi").select("idx", "id"), "SELECT idx, id FROM nodes WHERE id IN (SELECT src FROM edges WHERE kind = 'imports')")
add("g_add_node", lambda n, e: model.add_nodes(n.filter("idx < 500"), n.filter("idx >= 400")).select("idx", "id"), "SELECT min(i) AS idx, id FROM (SELECT idx AS i, id FROM nodes WHERE idx < 500 UNION ALL SELECT idx + (SELECT max(idx) FROM nodes WHERE idx < 500) + 1, id FROM nodes WHERE idx >= 400) GROUP BY id")
add("g_add_edge", lambda n, e: model.add_edges(e.filter("eidx < 300"), e, n.filter("kind <> 'doc'")).select("eidx", "src", "dst", "kind"), "SELECT min(i) AS eidx, src, dst, kind FROM (SELECT eidx AS i, src, dst, kind FROM edges WHERE eidx < 300 UNION ALL SELECT eidx + (SELECT max(eidx) FROM edges WHERE eidx < 300) + 1, src, dst, kind FROM edges WHERE src IN (SELECT id FROM nodes WHERE kind <> 'doc') AND dst IN (SELECT id FROM nodes WHERE kind <> 'doc')) GROUP BY src, dst, kind")
add("g_node_update", lambda n, e: model.update_summary(n, n.filter("kind = 'dir'").select("id", F.concat(F.lit("folder "), F.col("name")).alias("summary"))).select("id", "summary"), "SELECT id, CASE WHEN kind = 'dir' THEN 'folder ' || name ELSE summary END AS summary FROM nodes")

# Aggregates and windows

add("agg_degree", lambda n, e: export.degrees(n, export.layout_graph(n, e)[1]), "SELECT idx, count(node) AS degree FROM nodes LEFT JOIN (SELECT from_idx AS node FROM d UNION ALL SELECT to_idx FROM d) ON node = idx GROUP BY idx", f"d AS ({DENSE})")
DEGREES = f"d AS ({DENSE}), deg AS (SELECT idx, count(node) AS degree FROM nodes LEFT JOIN (SELECT from_idx AS node FROM d UNION ALL SELECT to_idx FROM d) ON node = idx GROUP BY idx)"
OFFSETS = 'SELECT idx, coalesce(sum(degree) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM deg UNION ALL SELECT max(idx) + 1, sum(degree)::BIGINT FROM deg'
add("win_csr_offsets", lambda n, e: export.offsets(export.degrees(n, export.layout_graph(n, e)[1]), 512), OFFSETS, DEGREES)
SLOTS = "SELECT node, row_number() OVER (PARTITION BY node ORDER BY eidx, side) - 1 AS slot, neighbor FROM (SELECT eidx, 0 AS side, from_idx AS node, to_idx AS neighbor FROM d UNION ALL SELECT eidx, 1, to_idx, from_idx FROM d)"
add("win_csr_fill", lambda n, e: export.neighbor_slots(export.layout_graph(n, e)[1]), SLOTS, f"d AS ({DENSE})")
add("g_csr_build", lambda n, e: export.csr(n, export.layout_graph(n, e)[1]), f'SELECT "offset" + slot AS position, neighbor FROM ({SLOTS}) s JOIN ({OFFSETS}) o ON node = idx', DEGREES)
add("g_csr_neighbors", lambda n, e: export.neighbor_slots(export.layout_graph(n, e)[1]).filter("node = 40").select("slot", "neighbor"), f"SELECT slot, neighbor FROM ({SLOTS}) WHERE node = 40", f"d AS ({DENSE})")
add("agg_kind_counts", lambda n, e: n.filter("kind = 'sym'").groupBy("symbol_kind").agg(F.count("*").alias("n")).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_kind", "n"))), lambda k: F.concat_ws(" ", k["n"].cast("string"), k["symbol_kind"])), ", ").alias("counts")), "SELECT string_agg(n || ' ' || symbol_kind, ', ' ORDER BY symbol_kind) AS counts FROM (SELECT symbol_kind, count(*) AS n FROM nodes WHERE kind = 'sym' GROUP BY 1)")
add("win_dense_index", lambda n, e: model.dense_index(n.select("name", "id"), ["name", "id"], "k", 1000).select("id", "k"), "SELECT id, row_number() OVER (ORDER BY name, id) - 1 AS k FROM nodes")
add("win_consecutive_dedup", lambda n, e: n.select("idx", "symbol_kind", F.lag("symbol_kind").over(Window.partitionBy("kind").orderBy("idx")).alias("last")).filter("symbol_kind is distinct from last").select("idx", "symbol_kind"), "SELECT idx, symbol_kind FROM (SELECT idx, symbol_kind, lag(symbol_kind) OVER (PARTITION BY kind ORDER BY idx) AS last FROM nodes) WHERE symbol_kind IS DISTINCT FROM last")
add("agg_byte_size", lambda n, e: search.counts(n, e).select(export.byte_size(F.col("node_count"), F.col("edge_count")).alias("bytes")), "SELECT 48 * n + 8 * m + 4 * (n + 1) + 8 * m AS bytes FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)")
add("agg_max_index", lambda n, e: n.agg(F.max("idx").alias("max_index")), "SELECT max(idx) AS max_index FROM nodes")
add("topk_names", lambda n, e: n.filter("kind = 'sym'").groupBy("symbol_kind").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 10), " ").alias("names")), "SELECT symbol_kind, string_agg(name, ' ' ORDER BY name) AS names FROM (SELECT symbol_kind, name, row_number() OVER (PARTITION BY symbol_kind ORDER BY name) AS k FROM (SELECT DISTINCT symbol_kind, name FROM nodes WHERE kind = 'sym')) WHERE k <= 10 GROUP BY 1")
add("agg_distinct_names", lambda n, e: n.filter("kind = 'sym'").groupBy("symbol_kind").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("names")), "SELECT symbol_kind, string_agg(name, ' ' ORDER BY name) AS names FROM (SELECT DISTINCT symbol_kind, name FROM nodes WHERE kind = 'sym') GROUP BY 1")
add("agg_unanimous", lambda n, e: e.join(n.select(F.col("id").alias("dst"), "loc"), "dst").groupBy("src").agg(F.when(F.count_distinct("loc") == 1, F.first("loc", True)).alias("agreed")), "SELECT src, CASE WHEN count(DISTINCT loc) = 1 THEN min(loc) END AS agreed FROM edges JOIN nodes ON id = dst GROUP BY src")

# Tokens, steps, traversal

TOKENS = "greatest(1, ((strlen(id) + strlen(name) + strlen(path) + coalesce(strlen(summary), 0)) // 4)::INTEGER)"
add("g_estimate_tokens", lambda n, e: n.select("id", model.estimate_tokens().alias("est_tokens")), f"SELECT id, {TOKENS} AS est_tokens FROM nodes")
add("agg_token_sum", lambda n, e: n.groupBy("kind").agg(F.sum(model.estimate_tokens()).alias("tokens")), f"SELECT kind, sum({TOKENS})::BIGINT AS tokens FROM nodes GROUP BY kind")
add("g_edge_cost", lambda n, e: e.groupBy("kind").agg(F.sum(model.edge_cost(F.col("kind"))).alias("cost")), "SELECT kind, sum(CASE WHEN kind = 'contains' THEN 6 ELSE 1 END)::BIGINT AS cost FROM edges GROUP BY kind")
add("g_step", lambda n, e: traversal.step(e, SEED).select("to", "dir", "eidx", "kind"), f"SELECT dst AS \"to\", 0 AS dir, eidx, kind FROM edges WHERE src = '{SEED}' UNION ALL SELECT src, 1, eidx, kind FROM edges WHERE dst = '{SEED}'")

ADJ = 'adj AS MATERIALIZED (SELECT src AS a, dst AS b, 0 AS dir, eidx, kind FROM edges UNION ALL SELECT dst, src, 1, eidx, kind FROM edges)'


def bfs_sql(start: str, hops: int, adj: str = ADJ) -> str:
    """Levels f0, f1, ... of a search in order of discovery, as common tables."""
    out = [adj, f"f0 AS MATERIALIZED (SELECT id, 0::BIGINT AS rank, 0 AS depth, NULL::VARCHAR AS parent FROM nodes WHERE id = '{start}')"]
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM f{i}" for i in range(k))
        out.append(f"f{k} AS MATERIALIZED (SELECT b AS id, row_number() OVER (ORDER BY rank, dir, eidx) - 1 AS rank, {k} AS depth, a AS parent FROM (SELECT b, a, rank, dir, eidx, row_number() OVER (PARTITION BY b ORDER BY rank, dir, eidx) AS q FROM f{k - 1} JOIN adj ON a = id WHERE b NOT IN ({seen})) WHERE q = 1)")
    return ", ".join(out)


add("g_neighbors", lambda n, e: traversal.neighbors(n, e, SEED, DEPTH), "SELECT id, depth, rank FROM f1 UNION ALL SELECT id, depth, rank FROM f2", bfs_sql(SEED, 2))
OUT = "adj AS MATERIALIZED (SELECT src AS a, dst AS b, 0 AS dir, eidx FROM edges WHERE kind IN ('calls', 'contains'))"
add("g_neighbors_out", lambda n, e: traversal.neighbors(n, e, "sym:part::3", 4, ["calls", "contains"], "out"), " UNION ALL ".join(f"SELECT id, depth, rank FROM f{k}" for k in range(1, 5)), bfs_sql("sym:part::3", 4, OUT))


def _path(n, e):
    found = traversal.path_between(n, e, SEED, TARGET) or []
    return n.sparkSession.createDataFrame(list(enumerate(found)), "pos long, id string")


HOPS = 6
PATH = ", every AS (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(HOPS + 1)) + f"), walk AS (SELECT id, parent, depth FROM every WHERE id = '{TARGET}' UNION ALL SELECT every.id, every.parent, every.depth FROM walk JOIN every ON every.id = walk.parent)"
query("g_path", f"WITH RECURSIVE {tgraph.SQL}, {bfs_sql(SEED, HOPS)}{PATH} SELECT depth::BIGINT AS pos, id FROM walk")(graph(_path))


def _sub(n, e):
    ids = e.filter(F.col("src") == SEED).select(F.col("dst").alias("id"), F.col("eidx").alias("pos")).union(n.sparkSession.createDataFrame([(SEED, -1)], "id string, pos long"))
    return traversal.subgraph(n, e, ids)


WANTED = f"w AS (SELECT id, min(pos) AS pos FROM (SELECT dst AS id, eidx AS pos FROM edges WHERE src = '{SEED}' UNION ALL SELECT '{SEED}', -1) GROUP BY id)"
add("g_subgraph_nodes", lambda n, e: _sub(n, e)[0].select("id", "pos"), "SELECT w.id AS id, pos FROM w JOIN nodes ON nodes.id = w.id", WANTED)
add("g_subgraph_edges", lambda n, e: _sub(n, e)[1].select("eidx", "src", "dst"), "SELECT eidx, src, dst FROM edges WHERE src IN (SELECT id FROM w) AND dst IN (SELECT id FROM w)", WANTED)

LEVELS = 48


def dijkstra_sql(seed: str, levels: int) -> str:
    """Nodes settled at each cost, as common tables s0, s1, ..."""
    out = [ADJ, f"s0 AS MATERIALIZED (SELECT id, 0::BIGINT AS cost, 0::BIGINT AS hop, NULL::VARCHAR AS via FROM nodes WHERE id = '{seed}')"]
    for c in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM s{i}" for i in range(c))
        near = f"SELECT s.id, s.cost, s.hop, b, dir, eidx, kind FROM s{c - 1} s JOIN adj ON a = s.id WHERE kind <> 'contains'"
        far = f" UNION ALL SELECT s.id, s.cost, s.hop, b, dir, eidx, kind FROM s{c - 6} s JOIN adj ON a = s.id WHERE kind = 'contains'" if c >= 6 else ""
        out.append(f"s{c} AS MATERIALIZED (SELECT b AS id, {c}::BIGINT AS cost, hop + 1 AS hop, kind AS via FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY cost, hop, id, dir, eidx) AS q FROM ({near}{far}) WHERE b NOT IN ({seen})) WHERE q = 1)")
    return ", ".join(out)


SETTLED = "settled AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(LEVELS + 1)) + ")"
add("g_dijkstra", lambda n, e: traversal.distances(n, e, SEED), "SELECT id, cost, hop, via FROM settled", f"{dijkstra_sql(SEED, LEVELS)}, {SETTLED}")
add("order_cost", lambda n, e: model.dense_index(traversal.distances(n, e, "dir:ASIA"), ["cost", "hop", "id"], "pos").select("pos", "id"), "SELECT row_number() OVER (ORDER BY cost, hop, id) - 1 AS pos, id FROM settled", f"{dijkstra_sql('dir:ASIA', LEVELS)}, {SETTLED}")
PACK = f"""ranked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cost, hop, settled.id) AS k, settled.id AS id, cost, hop, via, {TOKENS.replace('(id)', '(nodes.id)')} AS est FROM settled JOIN nodes ON nodes.id = settled.id),
fold AS (SELECT 1::BIGINT AS k, (SELECT est FROM ranked WHERE k = 1) AS total, true AS taken UNION ALL SELECT r.k, CASE WHEN f.total + r.est <= {BUDGET} THEN f.total + r.est ELSE f.total END, f.total + r.est <= {BUDGET} FROM fold f JOIN ranked r ON r.k = f.k + 1)"""
query("g_context_pack", f"WITH RECURSIVE {tgraph.SQL}, {dijkstra_sql(SEED, LEVELS)}, {SETTLED}, {PACK} SELECT row_number() OVER (ORDER BY r.k) - 1 AS pos, id, hop AS distance, CASE WHEN hop = 0 THEN 'seed' ELSE hop || ' hop(s) away via ' || via END AS reason, est AS est_tokens FROM fold JOIN ranked r ON r.k = fold.k WHERE taken")(graph(lambda n, e: traversal.context_pack(n, e, SEED, BUDGET).select("pos", "id", "distance", "reason", "est_tokens")))
query("win_greedy_budget", f"WITH RECURSIVE {tgraph.SQL}, {dijkstra_sql(SEED, LEVELS)}, {SETTLED}, {PACK.replace(str(BUDGET), '300')} SELECT count(*) AS n, sum(est)::BIGINT AS tokens FROM fold JOIN ranked r ON r.k = fold.k WHERE taken")(graph(lambda n, e: traversal.context_pack(n, e, SEED, 300).agg(F.count("*").alias("n"), F.sum("est_tokens").alias("tokens"))))
add("context_entry_project", lambda n, e: traversal.context_pack(n, e, "doc:catalog.md", 400).select("id", "kind", "path", "name", "lang", "symbol_kind", "summary", "distance"), None)
REACH = "adj AS MATERIALIZED (SELECT src AS a, dst AS b, 0 AS dir, eidx FROM edges UNION ALL SELECT dst, src, 1, eidx FROM edges)"


def _around(n, e):
    layout_nodes, layout_edges = export.layout_graph(n, e)
    return traversal.selected_neighborhood(layout_nodes, layout_edges, 40, 2)


def around_sql(column: str) -> str:
    return f"WITH {tgraph.SQL}, pick AS (SELECT id FROM nodes WHERE idx = 40), {REACH}, h1 AS MATERIALIZED (SELECT id FROM pick UNION SELECT b FROM adj JOIN pick ON a = id), h2 AS MATERIALIZED (SELECT id FROM h1 UNION SELECT b FROM adj JOIN h1 ON a = id) SELECT idx, {column} FROM nodes"


query("g_select_neighborhood", around_sql("id IN (SELECT id FROM h2) AS inside"))(graph(_around))
query("g_dim_mask", around_sql("CASE WHEN id IN (SELECT id FROM h2) THEN 1.0::DOUBLE ELSE 0.18::DOUBLE END AS dim"))(graph(lambda n, e: traversal.dim_mask(_around(n, e))))
query("set_minus_seen", over_graph("SELECT id FROM f2", bfs_sql(SEED, 2)))(graph(lambda n, e: traversal.neighbors(n, e, SEED, 2).filter("depth = 2").select("id")))
query("join_visited", over_graph("SELECT depth, count(*) AS n FROM (SELECT depth FROM f1 UNION ALL SELECT depth FROM f2 UNION ALL SELECT depth FROM f3) GROUP BY depth", bfs_sql(TARGET, 3)))(graph(lambda n, e: traversal.neighbors(n, e, TARGET, 3).groupBy("depth").agg(F.count("*").alias("n"))))

# Export

add("snk_edges", lambda n, e: export.edge_lines(n, e, ["imports", "calls"]), "SELECT eidx, a.idx || ' ' || b.idx AS line FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE edges.kind IN ('imports', 'calls')")
add("snk_nodes_tsv", lambda n, e: export.sidecar_lines(n), "SELECT idx AS index, idx || chr(9) || id || chr(9) || name || chr(9) || kind || chr(9) || path || chr(9) || chr(9) || chr(9) || coalesce(symbol_kind, '') || chr(9) || chr(9) || coalesce(summary, '') || chr(9) || chr(9) || chr(9) || chr(9) || chr(9) AS line FROM nodes")
add("snk_graphdata", lambda n, e: export.layout_graph(n, e)[0].select("idx", "label", "x", "dx"), "SELECT idx, id AS label, 0.0::DOUBLE AS x, 0.0::DOUBLE AS dx FROM nodes")
add("g_reindex", lambda n, e: model.known_ends(e, n).groupBy("src").agg(F.count("*").alias("out_degree")), "SELECT src, count(*) AS out_degree FROM edges GROUP BY src")
add("sanitize_cell", lambda n, e: n.select("id", text.sanitize_cell(F.concat(F.lit("a\tb\n"), F.col("name"))).alias("cell")), "SELECT id, 'a b ' || name AS cell FROM nodes")
