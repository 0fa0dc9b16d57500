"""Nodes and edges of a typed graph: schemas, kinds, identity and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph import storage

# Kinds with their tags, their names in graph JSON, and what crossing an edge costs.
NODE_TAGS = ("dir", "file", "doc", "sec", "sym")
NODE_JSON_NAMES = {"dir": "dir", "file": "file", "doc": "doc", "sec": "section", "sym": "symbol"}
EDGE_KINDS = ("contains", "imports", "links", "defines", "references", "calls")
EDGE_COSTS = {"contains": 6, "imports": 1, "links": 1, "defines": 1, "references": 1, "calls": 1}
UNKNOWN = "?"

TYPE = T.StructType([T.StructField("ty", T.StringType()), T.StructField("inferred", T.BooleanType())])
PARAM = T.StructType([T.StructField("name", T.StringType()), T.StructField("ty", TYPE)])
SPAN = T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
NODE_FIELDS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("symbol_kind", T.StringType()), T.StructField("container", T.StringType()), T.StructField("span", SPAN),
    T.StructField("signature", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("locals", T.ArrayType(T.StringType())),
    T.StructField("calls", T.ArrayType(T.StringType())), T.StructField("role", T.StringType()), T.StructField("params", T.ArrayType(PARAM)),
    T.StructField("returns", TYPE), T.StructField("description", T.StringType()), T.StructField("loc", T.IntegerType()),
])
NODES = T.StructType([T.StructField("idx", T.LongType()), *NODE_FIELDS])
EDGE_FIELDS = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.FloatType())])
EDGES = T.StructType([T.StructField("eidx", T.LongType()), *EDGE_FIELDS])


def as_nodes(df: DataFrame) -> DataFrame:
    """df with every column of a node, in order; what df lacks is null, or empty for lists, or 0 for loc."""
    have = set(df.columns)
    lists = {"locals", "calls", "params"}
    cols = []
    for f in NODES:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in lists:
            cols.append(F.array().cast(f.dataType).alias(f.name))
        elif f.name == "loc":
            cols.append(F.lit(0).alias("loc"))
        elif f.name != "idx":
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def dense_index(df: DataFrame, order: list[str], out: str, rows_per_part: int = 2_000_000) -> DataFrame:
    """Number rows from 0 in the order of columns, at any size: rows are range-sorted into parts, parts are
    written, and each part's rows are numbered from the sum of the parts before it. Rows equal in all of
    ``order`` are numbered in either order."""
    n = df.count()
    if n <= rows_per_part:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    parts = -(-n // rows_per_part)
    placed = storage.save(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_low"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_first")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_rank", rank).join(F.broadcast(first), "_part").withColumn(out, (F.col("_first") + F.col("_rank") - 1).cast("long")).drop("_part", "_rank", "_first")


def first_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key. A window, since whole rows are kept; partial aggregation
    over a struct would carry every column through the exchange as well."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes are unique by id; the first written wins."""
    return first_wins(nodes, ["id"], "idx")


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is unknown, with the ends that are."""
    ids = nodes.select("id")
    marked = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    bad = marked.filter(F.col("_s").isNull() | F.col("_d").isNull())
    return bad.select(*edges.columns, F.col("_s").isNull().alias("src_unknown"), F.col("_d").isNull().alias("dst_unknown"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Edges are unique by (src, dst, kind), whatever their weight; the first written wins."""
    return first_wins(edges, ["src", "dst", "kind"], "eidx")


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes with those of ``more`` whose ids are new, numbered after them."""
    top = nodes.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("_top"))
    shifted = more.crossJoin(F.broadcast(top)).withColumn("idx", F.col("idx") + F.col("_top") + 1).drop("_top")
    return dedup_nodes(nodes.unionByName(shifted.select(nodes.columns)))


def add_edges(edges: DataFrame, more: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with those of ``more`` that are new and have known ends, numbered after them."""
    top = edges.agg(F.coalesce(F.max("eidx"), F.lit(-1)).alias("_top"))
    shifted = more.crossJoin(F.broadcast(top)).withColumn("eidx", F.col("eidx") + F.col("_top") + 1).drop("_top")
    return dedup_edges(edges.unionByName(known_ends(shifted.select(edges.columns), nodes)))


def update_summary(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Nodes with the summaries of (id, summary) put in; others keep theirs."""
    new = summaries.select("id", F.col("summary").alias("_new"))
    return nodes.join(new, "id", "left").withColumn("summary", F.coalesce("_new", "summary")).select(nodes.columns)


def edge_cost(kind: Column) -> Column:
    dear = [k for k, c in EDGE_COSTS.items() if c != 1]
    return F.when(kind.isin(dear), F.lit(EDGE_COSTS[dear[0]])).otherwise(F.lit(1))


def of_kinds(df: DataFrame, kinds: list[str] | None) -> DataFrame:
    """None: all kinds. An empty list matches nothing. The filter reaches a Parquet scan."""
    return df if kinds is None else df.filter(F.col("kind").isin(kinds)) if kinds else df.filter(F.lit(False))


def estimate_tokens() -> Column:
    """A quarter of the UTF-8 bytes that a node's text takes, rounded down, 1 at least. Calls cost a byte
    more each, parameters two; locals, container and role don't count."""

    def size(c: Column) -> Column:
        return F.coalesce(F.octet_length(c), F.lit(0))

    flat = [size(F.col(c)) for c in ("id", "name", "path", "signature", "summary", "description")] + [size(F.col("returns.ty"))]
    calls = F.aggregate("calls", F.lit(0), lambda a, c: a + size(c) + 1)
    params = F.aggregate("params", F.lit(0), lambda a, p: a + size(p["name"]) + size(p["ty"]["ty"]) + 2)
    total = sum(flat[1:], flat[0]) + calls + params
    return F.greatest(F.lit(1), F.floor(total / 4).cast("int"))
