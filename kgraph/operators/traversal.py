"""Traversal: hops, neighbourhoods, subgraphs, shortest paths, weighted distance and context packs.

Every search is a loop over a frontier, written to the shared folder at each round, so plans stay short and
a lost executor costs one round at most. Order is the order of discovery of a queue: by the rank of the node
that found it, out edges before in edges, then by edge number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph import model, storage

MERGE_EVERY = 8
DIRECTIONS = ("out", "in", "both")
REACHED = "id string, rank long, depth int, parent string"


def adjacency(edges: DataFrame, kinds: list[str] | None = None, direction: str = "both", src: str = "src", dst: str = "dst") -> DataFrame:
    """(at, to, dir, eidx, kind): out edges with dir 0, in edges with dir 1."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    rows = model.of_kinds(edges, kinds)
    out = rows.select(F.col(src).alias("at"), F.col(dst).alias("to"), F.lit(0).alias("dir"), "eidx", *(["kind"] if "kind" in edges.columns else []))
    back = rows.select(F.col(dst).alias("at"), F.col(src).alias("to"), F.lit(1).alias("dir"), "eidx", *(["kind"] if "kind" in edges.columns else []))
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def step(edges: DataFrame, node_id: str, kinds: list[str] | None = None, direction: str = "both") -> DataFrame:
    """One hop. Out edges come first, each side in edge order; a neighbour may come twice."""
    return adjacency(edges, kinds, direction).filter(F.col("at") == node_id).select("to", "dir", "eidx", "kind")


def _hop(frontier: DataFrame, adj: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    key = F.min(F.struct("rank", "dir", "eidx", F.col("at").alias("parent"))).alias("k")
    found = frontier.select(F.col("id").alias("at"), "rank").join(adj, "at").select(F.col("to").alias("id"), "rank", "dir", "eidx", "at")
    new = found.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(key)
    flat = new.select("id", F.col("k.rank").alias("_r"), F.col("k.dir").alias("_d"), F.col("k.eidx").alias("_e"), F.col("k.parent").alias("parent"))
    ranked = model.dense_index(storage.save(flat, f"found-{depth}"), ["_r", "_d", "_e"], "rank")
    return storage.save(ranked.select("id", "rank", F.lit(depth).alias("depth"), "parent"), f"frontier-{depth}")


def search(nodes: DataFrame, adj: DataFrame, start, depth: int | None, until=None, key: str = "id") -> list[DataFrame]:
    """Breadth first from start: one written table for each depth. Ends at ``depth``, when ``until`` is
    found, or when nothing new is. An unknown start gives no tables."""
    first = storage.save(nodes.filter(F.col(key) == start).limit(1).select(F.col(key).alias("id"), F.lit(0).cast("long").alias("rank"), F.lit(0).alias("depth"), F.lit(None).cast(nodes.schema[key].dataType).alias("parent")), "frontier-0")
    if first.isEmpty():
        return []
    levels, adj = [first], storage.save(adj, "adjacency")
    while depth is None or len(levels) <= depth:
        if until is not None and not levels[-1].filter(F.col("id") == until).isEmpty():
            break
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.unionByName(level)
        new = _hop(levels[-1], adj, seen, len(levels))
        if new.isEmpty():
            break
        levels.append(new)
    return levels


def _all(levels: list[DataFrame], like: DataFrame) -> DataFrame:
    if not levels:
        return like.sparkSession.createDataFrame([], REACHED)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def neighbors(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, kinds: list[str] | None = None, direction: str = "both") -> DataFrame:
    """(id, depth, rank) of nodes within ``depth`` hops, the start left out, in order of (depth, rank). An
    unknown start or depth 0 gives none."""
    levels = search(nodes, adjacency(edges, kinds, direction), start, depth)
    return _all(levels[1:], nodes).select("id", "depth", "rank")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given ids in their order (missing and repeated ids are ignored; column pos), and the
    edges with both ends among them."""
    wanted = ids if isinstance(ids, DataFrame) else nodes.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id string")
    wanted = wanted.groupBy("id").agg(F.min("pos").alias("pos"))
    kept = nodes.join(wanted, "id").select(*nodes.columns, "pos")
    return kept, model.known_ends(edges, kept)


def path_between(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> list[str] | None:
    """A shortest path over all edges in either direction, both ends included; None without one. Ties go
    to what is discovered first. Only the path itself reaches the driver, one row for each hop."""
    if nodes.filter(F.col("id") == b).isEmpty():
        return None
    levels = search(nodes, adjacency(edges), a, None, until=b)
    if not levels or levels[-1].filter(F.col("id") == b).isEmpty():
        return None
    path = [b]
    for level in reversed(levels[1:]):
        path.append(level.filter(F.col("id") == path[-1]).first()["parent"])
    return path[::-1]


def settle(nodes: DataFrame, edges: DataFrame, seed: str) -> Iterator[DataFrame]:
    """(id, cost, hop, via) of what is reachable from seed, cost by cost, edges taken either way: least cost,
    and the hops and last edge kind of the path that wins. Costs are whole numbers, so all nodes of one cost
    settle together; of equal costs the winner comes from the predecessor first in (cost, hop, id), then
    out edges before in edges, then the edge number. Nothing comes of an unknown seed. Whoever has enough
    stops taking; settled ids are kept in few tables, merged every MERGE_EVERY costs."""
    start = nodes.filter(F.col("id") == seed).limit(1)
    if start.isEmpty():
        return
    adj = storage.save(adjacency(edges).withColumn("step", model.edge_cost(F.col("kind"))), "adjacency")
    order = ["cost", "pred_cost", "pred_hop", "pred_id", "dir", "eidx", "kind"]
    zeros = [F.lit(0).cast("long").alias(c) for c in ("cost", "pred_cost")]
    none = F.lit(None).cast("string").alias("kind")
    open_ = start.select("id", *zeros, F.lit(-1).cast("long").alias("pred_hop"), F.lit("").alias("pred_id"), F.lit(0).alias("dir"), F.lit(0).cast("long").alias("eidx"), none)
    open_ = storage.save(open_, "open")
    done: list[DataFrame] = []
    k = 0
    while (least := open_.agg(F.min("cost")).first()[0]) is not None:
        k += 1
        now = open_.filter(F.col("cost") == least).select("id", "cost", (F.col("pred_hop") + 1).alias("hop"), F.col("kind").alias("via"))
        now = storage.save(now, f"settled-{k}")
        yield now
        done.append(now.select("id"))
        if len(done) > MERGE_EVERY:
            done = [storage.save(reduce(DataFrame.union, done), f"done-{k}")]
        found = now.select(F.col("id").alias("at"), F.col("cost").alias("pred_cost"), F.col("hop").alias("pred_hop")).join(adj, "at")
        found = found.select(F.col("to").alias("id"), (F.col("pred_cost") + F.col("step")).alias("cost"), "pred_cost", "pred_hop", F.col("at").alias("pred_id"), "dir", "eidx", "kind")
        rest = open_.filter(F.col("cost") > least).unionByName(found).join(reduce(DataFrame.union, done), "id", "left_anti")
        best = rest.groupBy("id").agg(F.min(F.struct(*order)).alias("b")).select("id", *(F.col(f"b.{c}").alias(c) for c in order))
        open_ = storage.save(best, f"open-{k}")


def distances(nodes: DataFrame, edges: DataFrame, seed: str) -> DataFrame | None:
    """Everything that ``settle`` gives, as one table. None if the seed is unknown."""
    levels = list(settle(nodes, edges, seed))
    return reduce(DataFrame.unionByName, levels) if levels else None


PACKED = ("id", "kind", "path", "name", "lang", "symbol_kind", "container", "span", "signature", "summary", "calls", "role", "returns", "description")


def context_pack(nodes: DataFrame, edges: DataFrame, seed: str, budget: int = 2000) -> DataFrame | None:
    """The seed and what is near it, in order of (cost, hop, id), as far as the token budget goes: a node
    that would exceed it is skipped and the scan goes on. The seed is always in.

    Nodes settle cost by cost into the pack, and no further once nothing fits any more: a node takes a
    token at least, or as much as the smallest there is. The rows of a cost stream to the driver in order;
    those that can't fit stay behind, and at most ``budget`` are kept."""
    tokens = nodes.select("id", model.estimate_tokens().alias("est_tokens"))
    least = tokens.agg(F.min("est_tokens")).first()[0]
    total, kept = 0, []
    for level in settle(nodes, edges, seed):
        sized = level.join(tokens, "id")
        fits = sized.filter((F.col("hop") == 0) | (F.col("est_tokens") <= budget - total)).orderBy("hop", "id")
        for r in fits.select("id", "cost", "hop", "via", "est_tokens").toLocalIterator():
            if r["hop"] == 0 or total + r["est_tokens"] <= budget:
                total += r["est_tokens"]
                kept.append((len(kept), r["id"], r["cost"], r["hop"], r["via"], r["est_tokens"]))
            if total + least > budget:
                break
        if total + least > budget:
            break
    if not kept:
        return None
    chosen = nodes.sparkSession.createDataFrame(kept, "pos long, id string, cost long, hop long, via string, est_tokens int")
    reason = F.when(F.col("hop") == 0, F.lit("seed")).otherwise(F.concat(F.col("hop").cast("string"), F.lit(" hop(s) away via "), F.col("via")))
    entries = nodes.join(F.broadcast(chosen) if budget <= 100_000 else chosen, "id")
    return entries.select("pos", *PACKED, F.col("hop").alias("distance"), reason.alias("reason"), "est_tokens", "cost")


def selected_neighborhood(layout_nodes: DataFrame, layout_edges: DataFrame, selected: int, depth: int) -> DataFrame:
    """(idx, inside) for every node: within ``depth`` hops of the selected one, itself included. An index
    out of range leaves all outside."""
    numbered = layout_edges if "eidx" in layout_edges.columns else layout_edges.withColumn("eidx", F.lit(0).cast("long"))
    levels = search(layout_nodes, adjacency(numbered), selected, depth, key="idx")
    if not levels:
        return layout_nodes.select("idx", F.lit(False).alias("inside"))
    ids = levels[0].select("id")
    for level in levels[1:]:
        ids = ids.union(level.select("id"))
    return layout_nodes.select("idx").join(ids.select(F.col("id").alias("idx"), F.lit(True).alias("_in")), "idx", "left").select("idx", F.coalesce("_in", F.lit(False)).alias("inside"))


DIMMED = 0.18


def dim_mask(inside: DataFrame) -> DataFrame:
    return inside.select("idx", F.when(F.col("inside"), F.lit(1.0)).otherwise(F.lit(DIMMED)).alias("dim"))
