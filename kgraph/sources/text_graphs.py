"""Graphs as text: edge lists, indexed edges and node sidecars, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph import model, storage
from kgraph.functions import text
from kgraph.operators import export

HEADER = "# from to"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one or more text files, numbered in the order of files and lines. Numbers may
    have gaps between files' parts; only their order counts."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return rows


def lines_of(spark: SparkSession, content: str) -> DataFrame:
    rows = [(i, x) for i, x in enumerate(content.splitlines())]
    return spark.createDataFrame(rows, "line_no long, line string")


def _pairs(lines: DataFrame) -> DataFrame:
    bare = text.trim(F.col("line"))
    kept = lines.withColumn("_t", bare).filter((F.col("_t") != "") & ~F.rlike("_t", F.lit("^[#%]")))
    parts = kept.withColumn("_p", F.split("_t", r"(?U)\s+"))
    wrong = F.raise_error(F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string"), F.lit(": two fields expected: "), F.col("_t")))
    return parts.select("line_no", F.when(F.size("_p") >= 2, F.col("_p")[0]).otherwise(wrong.cast("string")).alias("a"), F.when(F.size("_p") >= 2, F.col("_p")[1]).alias("b"))


def parse_edge_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, edges) from whitespace-separated pairs: labels (idx, label) are distinct and sorted, so 10
    comes before 9; edges (eidx, src, dst) keep file order and repeats. Blank lines and those that start
    with # or % are skipped, further fields ignored, and a lone field is an error that names its line."""
    pairs = _pairs(lines)
    names = pairs.select(F.col("a").alias("label")).union(pairs.select("b")).distinct()
    labels = model.dense_index(names, ["label"], "idx").select("idx", "label")
    a, b = labels.select(F.col("label").alias("a"), F.col("idx").alias("src")), labels.select(F.col("label").alias("b"), F.col("idx").alias("dst"))
    return labels, pairs.join(a, "a").join(b, "b").select(F.col("line_no").alias("eidx"), "src", "dst")


def parse_indexed_edges(lines: DataFrame, n: int | Column) -> DataFrame:
    """(eidx, src, dst) of whole numbers as they stand; one outside 0 to n - 1 is an error."""
    p = _pairs(lines).select(F.col("line_no").alias("eidx"), F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"))
    limit = n if isinstance(n, Column) else F.lit(n)

    def checked(c: str) -> Column:
        return F.when((F.col(c) >= 0) & (F.col(c) < limit), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("edge end out of range: "), F.col(c).cast("string"))).cast("long"))

    return p.select("eidx", checked("src").alias("src"), checked("dst").alias("dst"))


def parse_sidecar(lines: DataFrame) -> DataFrame:
    """Node rows, one for every number from 0 to the largest: the last line of a number wins, and numbers
    without a line are unknown nodes. The first five columns must be there, others may be missing. Even an
    empty sidecar has one unknown node."""
    kept = lines.filter((text.trim(F.col("line")) != "") & ~F.startswith(F.col("line"), F.lit("#")) & ~F.startswith(F.col("line"), F.lit("index\t")))
    cut = kept.withColumn("_p", F.split("line", "\t"))
    short = F.raise_error(F.concat(F.lit("five columns expected: "), F.col("line"))).cast("string")

    def cell(i: int) -> Column:
        value = F.get("_p", F.lit(i))
        return F.when(F.size("_p") < 5, short).otherwise(value) if i == 0 else value

    def optional(i: int) -> Column:
        return F.nullif(F.coalesce(cell(i), F.lit("")), F.lit(""))

    def words(i: int) -> Column:
        return F.filter(F.split(F.coalesce(cell(i), F.lit("")), r"(?U)\s+"), lambda w: w != "")

    kind = F.when(cell(3).isin(*model.NODE_TAGS), cell(3)).otherwise(F.lit(model.UNKNOWN))
    rows = cut.select(
        text.trim(cell(0)).cast("long").alias("idx"), "line_no", cell(1).alias("id"), cell(2).alias("name"), kind.alias("kind"), cell(4).alias("path"), text.parse_span(cell(5)).alias("span"),
        optional(6).alias("signature"), optional(7).alias("symbol_kind"), optional(8).alias("container"), optional(9).alias("summary"), words(10).alias("locals"), words(11).alias("calls"),
        optional(12).alias("role"), text.parse_returns(cell(13)).alias("returns"), optional(14).alias("description"),
    )
    last = rows.groupBy("idx").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("idx", "line_no"))), "line_no").alias("r")).select("idx", "r.*")
    top = rows.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0]
    full = lines.sparkSession.range(top + 1).withColumnRenamed("id", "idx").join(last, "idx", "left")
    empty = F.array().cast("array<string>")
    fill = {"id": F.lit(""), "name": F.lit(""), "path": F.lit(""), "kind": F.lit(model.UNKNOWN), "locals": empty, "calls": empty}
    return full.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def parse_exported(edge_lines: DataFrame, sidecar_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an exported pair; a node's label is its name."""
    nodes = parse_sidecar(sidecar_lines).withColumn("label", F.col("name"))
    n = nodes.agg(F.max("idx") + 1).first()[0]
    return nodes, parse_indexed_edges(edge_lines, n)


def _write_one(lines: DataFrame, order: str, path: str) -> None:
    """Lines in order as a folder of text files; read in the order of their names they are one text."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def write_edges(nodes: DataFrame, edges: DataFrame, path: str, kinds: list[str] | None = None) -> int:
    """Write the dense edge list with one line of header; the number of edges."""
    rows = storage.save(export.edge_lines(nodes, edges, kinds), "edge-lines")
    head = nodes.sparkSession.createDataFrame([(-1, HEADER)], "eidx long, line string")
    _write_one(head.unionByName(rows), "eidx", path)
    return rows.count()


def write_sidecar(nodes: DataFrame, path: str) -> int:
    rows = storage.save(export.sidecar_lines(nodes), "sidecar-lines")
    _write_one(rows, "index", path)
    return rows.count()
