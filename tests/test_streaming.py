from kgraph.streaming import edges


def test_degrees(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# x\na b\nb c extra\nlone\nc c\n")
    counts = edges.degrees(edges.read_edges(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("deg").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["label"], r["degree"]) for r in spark.table("deg").collect()} == {("a", 1), ("b", 2), ("c", 3)}
