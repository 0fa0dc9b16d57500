import json

from kgraph import cli, rpc
from kgraph.ingest import build


def test_rpc_and_build(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "README.md").write_text("# Hi\n[x](src/lib.rs)\n")
    (tmp_path / "src" / "lib.rs").write_text("pub mod loader;\npub fn build() {}\n")
    (tmp_path / "src" / "loader.rs").write_text("use crate::build;\n")
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "x.log").write_text("no")
    nodes, edges = build.build_repo(spark, str(tmp_path))
    found = {(r["src"], r["dst"], r["kind"]) for r in edges.collect()}
    assert {("dir:.", "dir:src", "contains"), ("file:src/lib.rs", "file:src/loader.rs", "imports"), ("file:src/loader.rs", "file:src/lib.rs", "imports"), ("doc:README.md", "file:src/lib.rs", "links"), ("file:src/lib.rs", "sym:src/lib.rs::build", "defines"), ("doc:README.md", "sec:README.md#hi", "contains")} <= found
    assert not any("x.log" in r["id"] for r in nodes.collect())
    server = rpc.Server(spark, nodes, edges)
    assert server.line("{") and json.loads(server.line("{"))["error"]["code"] == rpc.MALFORMED
    assert server.handle({"method": "ping"}) is None
    assert server.handle({"id": 1, "method": "what"})["error"]["code"] == rpc.NO_METHOD
    call = {"id": 2, "method": "tools/call", "params": {"name": "path_between", "arguments": {"from": "doc:README.md", "to": "file:src/loader.rs"}}}
    assert json.loads(server.handle(call)["result"]["content"][0]["text"]) == ["doc:README.md", "file:src/lib.rs", "file:src/loader.rs"]
    assert server.handle({"id": 3, "method": "tools/call", "params": {"name": "find_node"}})["result"]["isError"]


def test_arguments():
    a = cli.parser().parse_args(["query", "neighbors", "x", "--edge-kind", "imports"])
    assert a.depth == 1 and a.edge_kind == ["imports"]
