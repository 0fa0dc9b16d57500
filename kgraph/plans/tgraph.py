"""A property graph over the star-schema tables, for queries and tests: the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph import model, storage


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.concat_ws("/", "r_name", "n_name").alias("place"))
    geo = F.broadcast(geo)  # nations: 25 rows
    customer, supplier, part = (_read(spark, sf_dir, t) for t in ("customer", "supplier", "part"))

    def rows(df, kind, path, name, **more):
        cols = {"lang": F.lit(None).cast("string"), "symbol_kind": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "loc": F.lit(0)} | more
        return df.select(F.lit(kind).alias("kind"), path.alias("path"), name.alias("name"), *(v.alias(k) for k, v in cols.items()))

    one = spark.range(1)
    file_name, doc_name = F.concat(F.lit("c"), F.col("c_custkey"), F.lit(".py")), F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".md"))
    brands = part.select("p_brand").distinct()
    parts = [
        rows(one, "dir", F.lit("."), F.lit("root")),
        rows(region, "dir", F.col("r_name"), F.col("r_name")),
        rows(geo, "dir", F.col("place"), F.col("n_name")),
        rows(customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")), "file", F.concat_ws("/", "place", file_name), file_name, lang=F.lit("python"), summary=F.col("c_mktsegment")),
        rows(supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey")), "doc", F.concat_ws("/", "place", doc_name), doc_name),
        rows(one, "doc", F.lit("catalog.md"), F.lit("catalog.md")),
        rows(brands, "sec", F.concat(F.lit("catalog.md#"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))), F.col("p_brand")),
        rows(part, "sym", F.concat(F.lit("part::"), F.col("p_partkey")), F.translate("p_name", " ", "_"), symbol_kind=F.lower("p_type"), loc=F.col("p_size")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("id", F.concat_ws(":", "kind", "path"))


#: Graphs already built in this process: each is written once and then read while its tables' files stay as they are.
_BUILT: dict[tuple, DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, part: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, part, sf_dir, _stamps(spark, sf_dir))
    if key not in _BUILT:
        _BUILT[key] = storage.save(build(spark, sf_dir), f"tgraph-{part}")
    return _BUILT[key]


def _stamps(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files of all tables in a folder: they tell whether tables have changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for top in fs.globStatus(path) or []:
        for f in fs.listStatus(top.getPath()):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(found)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "nodes", _nodes)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "edges", _edges)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storage.save(_node_rows(spark, sf_dir), "tgraph-node-rows")  # numbering counts them first
    return model.as_nodes(model.dense_index(rows, ["kind", "path"], "idx"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored nodes, and numbered once written: plans over the tables' unions and joins, made anew for
    every reference and every count, are what fills the driver's memory, whatever the tables' size."""
    ids = nodes(spark, sf_dir).select("kind", "path", "id")
    customer, part = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "part")
    first = _read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")

    def keyed(kind, pattern):
        return ids.filter(F.col("kind") == kind).select(F.regexp_extract("path", pattern, 1).try_cast("long").alias("key"), "id").filter("key is not null")

    files, docs = keyed("file", r"/c(\d+)\.py$"), ids.filter("kind = 'doc' and path <> 'catalog.md'").select(F.regexp_extract("path", r"/s(\d+)\.md$", 1).try_cast("long").alias("key"), "id")

    def sym(key):
        return F.concat(F.lit("sym:part::"), key)

    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("."))
    inside = ids.filter("kind in ('dir', 'file', 'doc') and path <> '.'").select(F.concat(F.lit("dir:"), parent).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    sections = ids.filter("kind = 'sec'").select(F.lit("doc:catalog.md").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    nearest = customer.select("c_custkey", F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("nxt")).filter("nxt is not null")
    imports = nearest.join(files.select(F.col("key").alias("c_custkey"), F.col("id").alias("src")), "c_custkey").join(files.select(F.col("key").alias("nxt"), F.col("id").alias("dst")), "nxt").select("src", "dst", F.lit("imports").alias("kind"))
    size = customer.agg(F.count("*").alias("n"))
    defines = part.crossJoin(F.broadcast(size)).select((F.col("p_partkey") % F.col("n")).alias("key"), sym(F.col("p_partkey")).alias("dst")).join(files, "key").select(F.col("id").alias("src"), "dst", F.lit("defines").alias("kind"))
    refs = first.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("key"), "l_partkey").distinct().join(files, "key").select(F.col("id").alias("src"), sym(F.col("l_partkey")).alias("dst"), F.lit("references").alias("kind"))
    links = first.select(F.col("l_suppkey").alias("key"), "l_partkey").distinct().join(docs, "key").select(F.col("id").alias("src"), sym(F.col("l_partkey")).alias("dst"), F.lit("links").alias("kind"))
    n_part = part.agg(F.count("*").alias("n"))
    calls = part.crossJoin(F.broadcast(n_part)).select("p_partkey", ((7 * F.col("p_partkey") + 3) % F.col("n")).alias("q")).filter("p_partkey <> q").select(sym(F.col("p_partkey")).alias("src"), sym(F.col("q")).alias("dst"), F.lit("calls").alias("kind"))
    out = inside
    for e in (sections, imports, defines, refs, links, calls):
        out = out.unionByName(e)
    out = storage.save(model.known_ends(storage.save(out, "tgraph-edge-rows"), ids), "tgraph-known-ends").withColumn("weight", F.lit(1.0).cast("float"))
    return model.dense_index(out, ["kind", "src", "dst"], "eidx").select("eidx", "src", "dst", "kind", "weight")


#: The same graph as common table expressions ``nodes`` and ``edges``.
SQL = r"""
geo AS (SELECT n_nationkey, n_name, r_name, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
cfile AS (SELECT c_custkey AS key, place || '/c' || c_custkey || '.py' AS path, 'c' || c_custkey || '.py' AS name, c_mktsegment AS summary FROM customer JOIN geo ON c_nationkey = n_nationkey),
sdoc AS (SELECT s_suppkey AS key, place || '/s' || s_suppkey || '.md' AS path, 's' || s_suppkey || '.md' AS name FROM supplier JOIN geo ON s_nationkey = n_nationkey),
raw_nodes AS (
  SELECT 'dir' AS kind, '.' AS path, 'root' AS name, NULL::VARCHAR AS lang, NULL::VARCHAR AS symbol_kind, NULL::VARCHAR AS summary, 0 AS loc
  UNION ALL SELECT 'dir', r_name, r_name, NULL, NULL, NULL, 0 FROM region
  UNION ALL SELECT 'dir', place, n_name, NULL, NULL, NULL, 0 FROM geo
  UNION ALL SELECT 'file', path, name, 'python', NULL, summary, 0 FROM cfile
  UNION ALL SELECT 'doc', path, name, NULL, NULL, NULL, 0 FROM sdoc
  UNION ALL SELECT 'doc', 'catalog.md', 'catalog.md', NULL, NULL, NULL, 0
  UNION ALL SELECT DISTINCT 'sec', 'catalog.md#' || lower(replace(p_brand, '#', '')), p_brand, NULL, NULL, NULL, 0 FROM part
  UNION ALL SELECT 'sym', 'part::' || p_partkey, replace(p_name, ' ', '_'), NULL, lower(p_type), NULL, p_size FROM part),
nodes AS (SELECT row_number() OVER (ORDER BY kind, path) - 1 AS idx, kind || ':' || path AS id, kind, path, name, lang, symbol_kind, summary, loc FROM raw_nodes),
first_item AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1),
raw_edges AS (
  SELECT 'dir:' || CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS src, id AS dst, 'contains' AS kind FROM nodes WHERE kind IN ('dir', 'file', 'doc') AND path <> '.'
  UNION ALL SELECT 'doc:catalog.md', id, 'contains' FROM nodes WHERE kind = 'sec'
  UNION ALL SELECT 'file:' || a.path, 'file:' || b.path, 'imports' FROM (SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nxt FROM customer) JOIN cfile a ON a.key = c_custkey JOIN cfile b ON b.key = nxt
  UNION ALL SELECT 'file:' || path, 'sym:part::' || p_partkey, 'defines' FROM part JOIN cfile ON key = p_partkey % (SELECT count(*) FROM customer)
  UNION ALL SELECT DISTINCT 'file:' || path, 'sym:part::' || l_partkey, 'references' FROM first_item JOIN orders ON l_orderkey = o_orderkey JOIN cfile ON key = o_custkey
  UNION ALL SELECT DISTINCT 'doc:' || path, 'sym:part::' || l_partkey, 'links' FROM first_item JOIN sdoc ON key = l_suppkey
  UNION ALL SELECT 'sym:part::' || p_partkey, 'sym:part::' || ((7 * p_partkey + 3) % (SELECT count(*) FROM part)), 'calls' FROM part WHERE p_partkey <> (7 * p_partkey + 3) % (SELECT count(*) FROM part)),
edges AS (SELECT row_number() OVER (ORDER BY kind, src, dst) - 1 AS eidx, src, dst, kind, 1.0::FLOAT AS weight FROM raw_edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))
"""
