"""Graph JSON (``{nodes: [...], edges: [...]}``) and the Parquet store of a graph."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph import model

_NODE = T.StructType([f for f in model.NODE_FIELDS])
_EDGE = T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.FloatType())])
SCHEMA = T.StructType([T.StructField("nodes", T.ArrayType(_NODE)), T.StructField("edges", T.ArrayType(_EDGE))])


def _tag(kind: Column) -> Column:
    out = kind
    for tag, name in model.NODE_JSON_NAMES.items():
        out = F.when(kind == name, F.lit(tag)).otherwise(out) if tag != name else out
    return out


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), numbered as they stand. Dangling edges are kept, as the file has them; joins on
    their ends leave them out. Missing lists are empty, a missing weight is 1."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    n = doc.select(F.posexplode("nodes").alias("idx", "n")).select(F.col("idx").cast("long").alias("idx"), "n.*")
    fills = {c: F.coalesce(F.col(c), F.array().cast(model.NODES[c].dataType)) for c in ("locals", "calls", "params")}
    returns = F.when(F.col("returns").isNotNull(), F.struct(F.col("returns.ty").alias("ty"), F.coalesce("returns.inferred", F.lit(False)).alias("inferred")))
    n = n.withColumns(fills | {"kind": _tag(F.col("kind")), "loc": F.coalesce("loc", F.lit(0)), "returns": returns})
    e = doc.select(F.posexplode("edges").alias("eidx", "e")).select(F.col("eidx").cast("long").alias("eidx"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.kind").alias("kind"), F.coalesce("e.weight", F.lit(1.0)).cast("float").alias("weight"))
    return model.as_nodes(n), e


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON document on the driver's disk, for tools that want one: rows stream through, part by part,
    and absent optional fields are left out."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    optional = ("lang", "symbol_kind", "container", "span", "signature", "summary", "role", "returns", "description")

    def node(r) -> dict:
        d = r.asDict(recursive=True)
        d.pop("idx")
        d["kind"] = model.NODE_JSON_NAMES.get(d["kind"], d["kind"])
        for c in (*optional, "locals", "calls", "params"):
            if d[c] is None or d[c] == []:
                d.pop(c)
        if d["loc"] == 0:
            d.pop("loc")
        return d

    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "nodes": [')
        for i, r in enumerate(nodes.orderBy("idx").toLocalIterator()):
            f.write((",\n    " if i else "\n    ") + json.dumps(node(r), ensure_ascii=False))
        f.write('\n  ],\n  "edges": [')
        for i, r in enumerate(edges.orderBy("eidx").toLocalIterator()):
            f.write((",\n    " if i else "\n    ") + json.dumps({"from": r["src"], "to": r["dst"], "kind": r["kind"], "weight": r["weight"]}, ensure_ascii=False))
        f.write("\n  ]\n}\n")


def write_store(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The canonical store: nodes by number, edges in folders by kind so that kind filters read only theirs."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(model.NODES).parquet(f"{path}/nodes"), spark.read.schema(model.EDGES).parquet(f"{path}/edges")
