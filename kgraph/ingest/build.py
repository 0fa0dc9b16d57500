"""From files to a graph: skeleton, symbols, imports, sections, links and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph import model, storage
from kgraph.functions import text
from kgraph.ingest import imports, markdown, symbols
from kgraph.ingest.languages import DOC_EXTENSIONS, language
from kgraph.sources import repo

SHOWN_NAMES, SHOWN_IMPORTS = 8, 6


def skeleton(paths: DataFrame, root_name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of folders, files and documents: (kind, path, name, lang, id) and contains edges
    (src, dst). Folders above a file exist even if ``paths`` (path, is_dir) doesn't name them."""
    dirs = paths.filter("is_dir").select("path").union(paths.select(F.explode(text.path_prefixes(F.col("path"))).alias("path"))).distinct()
    ext = text.extension(F.col("path"))
    kind = F.when(ext.isin(*DOC_EXTENSIONS), "doc").otherwise("file")
    rows = paths.filter("not is_dir").select(kind.alias("kind"), "path", text.file_name(F.col("path")).alias("name"), language(ext).alias("lang"))
    rows = rows.unionByName(dirs.select(F.lit("dir").alias("kind"), "path", text.file_name(F.col("path")).alias("name"), F.lit(None).cast("string").alias("lang")))
    top = paths.sparkSession.createDataFrame([("dir", ".", root_name, None)], "kind string, path string, name string, lang string")
    nodes = rows.unionByName(top).withColumn("id", F.concat_ws(":", "kind", "path"))
    edges = nodes.filter("path <> '.'").select(F.concat(F.lit("dir:"), text.parent(F.col("path"))).alias("src"), F.col("id").alias("dst"))
    return nodes, edges


def name_symbols(found: DataFrame) -> DataFrame:
    """Symbols with their ids. The first of a name in a file has the plain id, later ones add their start
    line; of those the first wins, and what comes after joins it (survives = false)."""
    by_name = Window.partitionBy("path", "name").orderBy("ord")
    base = F.concat(F.lit("sym:"), F.col("path"), F.lit("::"), F.col("name"))
    named = found.withColumn("id", F.when(F.row_number().over(by_name) == 1, base).otherwise(F.concat(base, F.lit("@"), F.col("start_line").cast("string"))))
    return named.withColumn("survives", F.row_number().over(Window.partitionBy("id").orderBy("ord")) == 1)


def symbol_nodes(named: DataFrame) -> DataFrame:
    role = text.classify_role(F.col("name"), F.col("symbol_kind"), F.col("container"))
    rows = named.filter("survives").withColumn("role", role)
    told = text.describe(F.col("name"), F.col("role"), F.col("params"), F.col("returns"), F.col("calls"), F.col("symbol_kind"), F.col("doc"))
    return rows.select(
        "id", F.lit("sym").alias("kind"), F.concat_ws("::", "path", "name").alias("path"), "name", "lang", "symbol_kind", "container", F.struct("start_line", "end_line").alias("span"), "signature",
        F.col("doc").alias("summary"), "locals", "calls", "role", "params", "returns", told.alias("description"), (F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1).alias("loc"), F.col("path").alias("_file"), "ord",
    )


def symbol_edges(named: DataFrame) -> DataFrame:
    """(src, dst, kind, ord, item): defines, and references and calls between symbols of one file, each to
    the first of its name, not to itself."""
    first = named.groupBy("path", "name").agg(F.min_by("id", "ord").alias("dst")).withColumnRenamed("name", "target")

    def mentions(column: str, kind: str) -> DataFrame:
        rows = named.select("path", F.col("id").alias("src"), "ord", F.posexplode(column).alias("item", "target"))
        return rows.join(first, ["path", "target"]).filter("src <> dst").select("src", "dst", F.lit(kind).alias("kind"), "ord", "item")

    defines = named.select(F.concat(F.lit("file:"), F.col("path")).alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("kind"), "ord", F.lit(0).alias("item"))
    return defines.unionByName(mentions("refs", "references")).unionByName(mentions("calls", "calls"))


def consecutive_dedup(names: Column) -> Column:
    """Without items equal to the one before."""
    empty = F.array().cast("array<string>")
    return F.aggregate(names, empty, lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, F.greatest(F.size(a), F.lit(1))) == x), a).otherwise(F.concat(a, F.array(x))))


def rollup(named: DataFrame, imported: DataFrame) -> DataFrame:
    """(path, summary) of files with symbols or imports: kinds with counts, top-level names in order, and
    the names of imported files. named needs (path, name, symbol_kind, container, ord); imported (path,
    name, at)."""
    kinds = named.groupBy("path", "symbol_kind").agg(F.count("*").alias("n")).groupBy("path")
    kinds = kinds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_kind", "n"))), lambda k: F.concat_ws(" ", k["n"].cast("string"), k["symbol_kind"])), ", ").alias("kinds"))
    tops = named.filter("container is null").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda t: t["name"]).alias("all"))
    tops = tops.withColumn("tops", consecutive_dedup(F.col("all")))
    more = F.when(F.size("tops") > SHOWN_NAMES, F.concat(F.lit(", +"), (F.size("tops") - SHOWN_NAMES).cast("string"))).otherwise(F.lit(""))
    tops = tops.select("path", F.concat(F.lit("defines "), F.array_join(F.slice("tops", 1, SHOWN_NAMES), ", "), more).alias("tops"))
    brought = imported.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("i"))
    brought = brought.select("path", F.concat(F.lit("imports "), F.array_join(F.slice(F.transform("i", lambda x: x["name"]), 1, SHOWN_IMPORTS), ", ")).alias("brought"))
    joined = kinds.join(tops, "path", "full_outer").join(brought, "path", "full_outer")
    return joined.select("path", F.concat_ws("; ", "kinds", "tops", "brought").alias("summary"))


def build_graph(paths: DataFrame, contents: DataFrame, root_name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a repository from paths (path, is_dir) and contents (path, content). Nodes are
    numbered by kind of thing and path; edges in the order their files would emit them."""
    base, contains = skeleton(paths, root_name)
    base = storage.save(base, "skeleton")
    known = base.filter("kind in ('file', 'doc')").select("path", "id")
    files = storage.save(contents.join(base.filter("kind = 'file'").select("path", "lang"), "path"), "files")
    lines = markdown.open_lines(contents.join(base.filter("kind = 'doc'").select("path"), "path"))
    named = storage.save(name_symbols(symbols.symbol_rows(files)), "symbols")
    brought = storage.save(imports.import_edges(files, known), "imports")
    heads = markdown.sections(lines)
    named_files = base.select(F.col("id").alias("dst"), F.col("name"))
    summaries = rollup(named, brought.join(named_files, "dst").select("path", "name", F.struct("line_no", "item").alias("at"))).withColumn("id", F.concat(F.lit("file:"), F.col("path")))
    null = F.lit(None).cast("int")
    sec = heads.select(F.concat(F.lit("sec:"), F.col("path"), F.lit("#"), F.col("slug")).alias("id"), F.lit("sec").alias("kind"), F.concat_ws("#", "path", "slug").alias("path"), "name", F.col("path").alias("_file"), F.col("line_no").alias("ord"))
    first = base.withColumn("_file", F.when(F.col("path") == ".", F.lit("")).otherwise(F.col("path"))).withColumn("ord", null)
    parts = [first.withColumn("_stage", F.lit(0)), sec.withColumn("_stage", F.lit(1)), symbol_nodes(named).withColumn("_stage", F.lit(2))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = rows.withColumns({"_early": (F.col("_stage") > 0).cast("int"), "ord": F.coalesce("ord", F.lit(-1))})
    nodes = model.as_nodes(model.dense_index(rows, ["_early", "_file", "_stage", "ord", "id"], "idx"))
    nodes = model.update_summary(nodes, summaries)
    found = contains.select("src", "dst", F.lit("contains").alias("kind"), F.lit(0).alias("_s"), F.col("dst").alias("_f"), F.lit(0).alias("_a"), F.lit(0).alias("_b"))
    inside = heads.select(F.concat(F.lit("doc:"), F.col("path")).alias("src"), F.concat(F.lit("sec:"), F.col("path"), F.lit("#"), F.col("slug")).alias("dst"), F.lit("contains").alias("kind"), F.lit(1).alias("_s"), F.col("path").alias("_f"), F.col("line_no").alias("_a"), F.lit(0).alias("_b"))
    linked = markdown.links(lines, known).select("src", "dst", F.lit("links").alias("kind"), F.lit(1).alias("_s"), F.col("path").alias("_f"), F.col("line_no").alias("_a"), F.col("item").alias("_b"))
    imported = brought.select("src", "dst", "kind", F.lit(2).alias("_s"), F.col("path").alias("_f"), F.col("line_no").alias("_a"), F.col("item").alias("_b"))
    stage = F.when(F.col("kind") == "defines", F.lit(3)).otherwise(F.lit(4))
    between = symbol_edges(named).select("src", "dst", "kind", stage.alias("_s"), F.regexp_extract("src", r"^(?:file|sym):(.*?)(?:::.*)?$", 1).alias("_f"), F.col("ord").alias("_a"), F.col("item").alias("_b"))
    edges = found.unionByName(inside).unionByName(linked).unionByName(imported).unionByName(between)
    keyed = edges.withColumn("_e", (F.col("_s") > 0).cast("int"))
    once = keyed.groupBy("src", "dst", "kind").agg(F.min(F.struct("_e", "_f", "_s", "_a", "_b")).alias("o")).select("src", "dst", "kind", "o.*")
    once = model.known_ends(once, nodes)
    edges = model.dense_index(once, ["_e", "_f", "_s", "_a", "_b", "kind", "dst"], "eidx").select("eidx", "src", "dst", "kind", F.lit(1.0).cast("float").alias("weight"))
    return nodes, edges


def build_repo(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    from pathlib import Path

    paths, contents = repo.files(spark, root)
    return build_graph(paths, contents, Path(root).resolve().name)
