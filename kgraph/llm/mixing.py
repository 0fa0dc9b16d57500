"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / size copies of itself. The expected copies are summed up along
the source's documents in order of size, one random offset is added, and a document is emitted once for
each integer that its stretch of the sum crosses. Order of size makes the sample an even one of all sizes,
so the words taken come within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> dict[str | None, float]:
    """Targets by weight, sources by code point and null last, the weights repeating. A target stops at
    ``ceiling`` times its source's size, and what is over is shared by weight among the others until none
    is above."""
    named = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(named)}
    size = dict(named)
    left, open_, out = share * sum(size.values()), [s for s, _ in named], {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > ceiling * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = ceiling * size[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in set(over)]
    return out


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", place: bool = False) -> DataFrame:
    """How many copies of every row the mix takes.

    Returns id_col, source, size (words of the text; null text: 0), source_size, target and copies; with
    ``place`` also file and row, each row's place in the scan of docs. copies is at most the ceiling rounded up. Rerun,
    the mix is the same: the offset is a hash of seed and source, ties of size go by a hash of id and
    text, and repeated rows share their stretch in either order. Null sources are one source, weighed
    last. A source without words has target 0 and gives no copies. An empty table gives no rows.

    Only one row for each source reaches the driver; that table must fit there. A source that holds most
    rows is range-sorted into parts and ranked there, never in one task.
    """
    spark = docs.sparkSession
    columns = [
        F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        common.count_words(F.col(text_col)).alias("_size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_tie"),
    ]
    base = common.save(common.scan_rows(docs, columns) if place else docs.select(*columns), "mix-rows")
    found = base.groupBy("_none", "_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()
    wanted = targets([(None if r["_none"] else r["_source"], r["size"]) for r in found], weights, share, ceiling)
    rows = [(r["_none"], r["_source"], r["size"], wanted[None if r["_none"] else r["_source"]]) for r in found]
    plan = spark.createDataFrame(rows, "_none boolean, _source string, source_size long, target double")
    ranked = common.dense_rank_in(base, ["_none", "_source"], ["_size", "_tie", "_id"], sum(r["n"] for r in found), "_rank")
    if len(rows) <= common.BROADCAST_ROWS:
        plan = F.broadcast(plan)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), "_none", "_source"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    copies = F.floor((F.col("_rank") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset"))
    out = ranked.join(plan, ["_none", "_source"]).withColumns({"_rate": rate, "_offset": offset}).withColumn("copies", copies.cast("long"))
    source = F.when(~F.col("_none"), F.col("_source")).alias("source")
    return out.select(F.col("_id").alias(id_col), source, F.col("_size").alias("size"), "source_size", "target", "copies", *["file", "row"] * place)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as ``plan_mix`` says: 0, 1 or 2 times at a ceiling of 2. Texts
    aren't shuffled; docs is scanned again and looks its copies up."""
    docs = common.as_scan(docs)
    planned = plan_mix(docs, place=True, **options).filter("copies > 0").select("file", "row", "copies")
    counted = common.attach(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), planned, {"copies": T.LongType()}, "copies").filter("copies is not null")
    repeated = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
    return repeated.toDF(*docs.columns)
