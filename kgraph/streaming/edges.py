"""Edge lists that arrive as files over time: an extension, as the model itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.functions import text


def read_edges(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (src, dst) from text files put into a folder; comments and lone fields are skipped."""
    lines = spark.readStream.text(folder).select(text.trim(F.col("value")).alias("t")).filter((F.col("t") != "") & ~F.rlike("t", F.lit("^[#%]")))
    parts = lines.select(F.split("t", r"(?U)\s+").alias("p")).filter(F.size("p") >= 2)
    return parts.select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """Running undirected degree of every label seen so far; a self loop counts 2."""
    return edges.select(F.explode(F.array("src", "dst")).alias("label")).groupBy("label").agg(F.count("*").alias("degree"))
