"""The command line: build a graph, ask it, export it."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from kgraph import arguments
from kgraph.ingest import build
from kgraph.operators import search, traversal
from kgraph.sources import graph_json, text_graphs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kgraph")
    verbs = top.add_subparsers(dest="verb", required=True)
    b = verbs.add_parser("build")
    b.add_argument("path", nargs="?", default=".")
    b.add_argument("--output", default=".kgraph/graph.json")
    q = verbs.add_parser("query").add_subparsers(dest="ask", required=True)
    for name, more in {"find": ["text"], "neighbors": ["id"], "context": ["id"], "subgraph": ["ids"], "path": ["start", "end"]}.items():
        p = q.add_parser(name)
        for m in more:
            p.add_argument(m, **({"nargs": "+"} if m == "ids" else {}))
        p.add_argument("--graph", default=".kgraph/graph.json")
        p.add_argument("--json", action="store_true")
        if name == "find":
            p.add_argument("--kind")
        if name == "neighbors":
            p.add_argument("--depth", type=int, default=1)
            p.add_argument("--direction")
            p.add_argument("--edge-kind", action="append")
        if name == "context":
            p.add_argument("--budget", type=int, default=2000)
    e = verbs.add_parser("export")
    e.add_argument("--graph", default=".kgraph/graph.json")
    e.add_argument("--edges")
    e.add_argument("--nodes")
    e.add_argument("--edge-kind", action="append")
    return top


def ask(nodes, edges, a: argparse.Namespace) -> tuple[list[dict], str]:
    """Rows of an answer and what to say if there are none."""
    if a.ask == "find":
        found = search.find_node(nodes, a.text, arguments.node_kind(a.kind)).orderBy("rank", "idx")
        return [r.asDict() for r in found.select("id", "kind", "name", "path").collect()], "no matches"
    if a.ask == "neighbors":
        found = traversal.neighbors(nodes, edges, a.id, a.depth, arguments.edge_kinds(a.edge_kind), arguments.direction(a.direction)).orderBy("depth", "rank")
        return [{"id": r["id"]} for r in found.collect()], "no neighbors"
    if a.ask == "context":
        found = traversal.context_pack(nodes, edges, a.id, a.budget)
        rows = [] if found is None else found.orderBy("pos").select("id", "kind", "name", "reason", "distance", "est_tokens", "signature", "summary").collect()
        return [r.asDict() for r in rows], f"unknown node: {a.id}"
    if a.ask == "subgraph":
        kept, inside = traversal.subgraph(nodes, edges, a.ids)
        rows = [{"id": r["id"]} for r in kept.orderBy("pos").collect()]
        return rows + [{"from": r["src"], "to": r["dst"], "kind": r["kind"]} for r in inside.orderBy("eidx").collect()], "no matches"
    found = traversal.path_between(nodes, edges, a.start, a.end)
    return [{"id": x} for x in found or []], "no path"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kgraph").getOrCreate()
    try:
        if a.verb == "build":
            nodes, edges = build.build_repo(spark, a.path)
            graph_json.write(nodes, edges, a.output)
            print(f"{nodes.count()} nodes, {edges.count()} edges -> {a.output}")
            return 0
        nodes, edges = graph_json.read(spark, a.graph)
        if a.verb == "export":
            kinds = arguments.edge_kinds(a.edge_kind)
            if a.edges:
                print(f"{text_graphs.write_edges(nodes, edges, a.edges, kinds)} edges -> {a.edges}")
            if a.nodes:
                print(f"{text_graphs.write_sidecar(nodes, a.nodes)} nodes -> {a.nodes}")
            return 0
        rows, nothing = ask(nodes, edges, a)
        if a.json:
            print(json.dumps(rows, ensure_ascii=False, indent=2))
        else:
            print("\n".join("  ".join(str(v) for v in r.values() if v is not None) for r in rows) or nothing)
        return 0
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
