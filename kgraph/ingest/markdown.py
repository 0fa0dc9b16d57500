"""Sections and links of Markdown documents, by expressions over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgraph.functions import text


def open_lines(docs: DataFrame) -> DataFrame:
    """(path, line_no, line) outside of ``` fences; the fence lines themselves are out too."""
    lines = docs.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)\s+$", ""))
    fence = F.rlike("line", F.lit(r"(?U)^\s*```"))
    inside = F.sum(fence.cast("int")).over(Window.partitionBy("path").orderBy("line_no")) % 2
    return lines.withColumn("_in", inside).filter(~fence & (F.col("_in") == 0)).select("path", "line_no", "line")


def sections(lines: DataFrame) -> DataFrame:
    """(path, slug, name, line_no): of equal headings in a document the first counts; a heading without
    letters or digits is none."""
    found = lines.withColumn("name", text.heading(F.col("line"))).filter("name is not null").withColumn("slug", text.slugify(F.col("name"))).filter("slug <> ''")
    return found.groupBy("path", "slug").agg(F.min(F.struct("line_no", "name")).alias("f")).select("path", "slug", "f.name", "f.line_no")


def links(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst, path, line_no): distinct links to files that exist, not to the document itself; a line
    that is a heading without letters or digits gives none."""
    name = text.heading(F.col("line"))
    fine = lines.filter(name.isNull() | (text.slugify(name) != ""))
    target = fine.select("path", "line_no", F.posexplode(text.link_targets(F.col("line"))).alias("item", "target")).filter(~text.is_external(F.col("target")))
    clean = target.withColumn("target", F.substring_index("target", "#", 1)).filter("target <> ''")
    hit = clean.withColumn("candidate", text.join_normalize(text.parent(F.col("path")), F.col("target"))).join(paths.select(F.col("path").alias("candidate"), F.col("id").alias("dst")), "candidate")
    edges = hit.withColumn("src", F.concat(F.lit("doc:"), F.col("path"))).filter("src <> dst")
    return edges.groupBy("src", "dst").agg(F.min(F.struct("path", "line_no", "item")).alias("w")).select("src", "dst", "w.path", "w.line_no", "w.item")
