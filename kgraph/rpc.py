"""A JSON-RPC server over lines: tools to build and ask a graph."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from kgraph import arguments
from kgraph.ingest import build
from kgraph.operators import search, traversal
from kgraph.sources import graph_json

NO_METHOD, MALFORMED, BAD_PARAMS = -32601, -32700, -32602
TOOLS = {
    "build": {"path": "string"}, "find_node": {"query": "string", "kind": "string"}, "neighbors": {"id": "string", "depth": "integer", "edge_kinds": "array", "direction": "string"},
    "context_pack": {"id": "string", "budget": "integer"}, "subgraph": {"ids": "array"}, "path_between": {"from": "string", "to": "string"},
}


class Server:
    def __init__(self, spark: SparkSession, nodes=None, edges=None, store: str | None = None) -> None:
        self.spark, self.nodes, self.edges, self.store = spark, nodes, edges, store

    def line(self, text: str) -> str | None:
        """The answer to one line; None to a message without an id."""
        try:
            message = json.loads(text)
        except ValueError as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": MALFORMED, "message": str(e)}})
        answer = self.handle(message if isinstance(message, dict) else {})
        return None if answer is None else json.dumps(answer, ensure_ascii=False)

    def handle(self, message: dict) -> dict | None:
        if "id" not in message:
            return None
        head = {"jsonrpc": "2.0", "id": message["id"]}
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return head | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "kgraph", "version": "0.1"}}}
        if method == "ping":
            return head | {"result": {}}
        if method == "tools/list":
            return head | {"result": {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, p in TOOLS.items()]}}
        if method == "tools/call":
            try:
                told, failed = json.dumps(self.call(params.get("name"), params.get("arguments") or {}), ensure_ascii=False), False
            except (ValueError, KeyError, OSError) as e:
                told, failed = str(e), True
            return head | {"result": {"content": [{"type": "text", "text": told}], "isError": failed}}
        return head | {"error": {"code": NO_METHOD, "message": f"unknown method: {method}"}}

    def call(self, tool: str | None, a: dict):
        def text(key: str) -> str:
            if not isinstance(a.get(key), str):
                raise ValueError(f"missing argument: {key}")
            return a[key]

        def texts(key: str) -> list[str] | None:
            return [x for x in a[key] if isinstance(x, str)] if isinstance(a.get(key), list) else None

        if tool == "build":
            self.nodes, self.edges = build.build_repo(self.spark, text("path"))
            if self.store:
                graph_json.write(self.nodes, self.edges, self.store)
            return {"nodes": self.nodes.count(), "edges": self.edges.count()}
        if tool not in TOOLS:
            raise ValueError(f"unknown tool: {tool}")
        if self.nodes is None:
            raise ValueError("no graph; build one first")
        if tool == "find_node":
            return [r.asDict() for r in search.find_node(self.nodes, text("query"), arguments.node_kind(a.get("kind"))).orderBy("rank", "idx").select("id", "kind", "name", "path").collect()]
        if tool == "neighbors":
            kinds = texts("edge_kinds")  # an empty list matches nothing
            arguments.edge_kinds(kinds)
            found = traversal.neighbors(self.nodes, self.edges, text("id"), int(a.get("depth", 1)), kinds, arguments.direction(a.get("direction")))
            return [r["id"] for r in found.orderBy("depth", "rank").collect()]
        if tool == "context_pack":
            found = traversal.context_pack(self.nodes, self.edges, text("id"), int(a.get("budget", 2000)))
            if found is None:
                raise ValueError(f"unknown node: {a['id']}")
            rows = [r.asDict(recursive=True) for r in found.orderBy("pos").drop("pos", "cost").collect()]
            return {"seed": a["id"], "entries": rows, "est_tokens": sum(r["est_tokens"] for r in rows)}
        if tool == "subgraph":
            kept, inside = traversal.subgraph(self.nodes, self.edges, texts("ids") or [])
            return {"nodes": [r["id"] for r in kept.orderBy("pos").collect()], "edges": [{"from": r["src"], "to": r["dst"], "kind": r["kind"]} for r in inside.orderBy("eidx").collect()]}
        return traversal.path_between(self.nodes, self.edges, text("from"), text("to"))


def main() -> None:
    import sys

    server = Server(SparkSession.builder.appName("kgraph-rpc").getOrCreate(), store=".kgraph/graph.json")
    for line in sys.stdin:
        if line.strip() and (answer := server.line(line)) is not None:
            print(answer, flush=True)


if __name__ == "__main__":
    main()
