"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.llm import common

MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node reachable. Self links and nulls
    are ignored; no links give no rows. Each round rewrites the links towards smaller neighbours and writes
    them to the shared folder; it ends when a round changes nothing. A hub's links are aggregated before
    they are shuffled, and joined to its smallest neighbour by a broadcast of the few hubs there can be (see
    ``join_hot``), so no task gets all of them. No links reach the driver."""
    e = common.save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links-0")
    seen = None
    for k in range(MOST_ROUNDS):
        up = F.col("v") > F.col("u")
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(up).alias("n"))
        low = common.save(low.filter("n > 0"), f"links-{k}-low")
        large = common.join_hot(both.filter(up), low, ["u"], "n", _total(low))
        large = common.save(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), f"links-{k}-large")
        low = common.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"links-{k}-least")
        pairs = common.join_hot(large, low, ["u"], "n", _total(low))
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = common.save(small, f"links-{k + 1}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError("components did not settle")


def _total(low: DataFrame) -> int:
    return low.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
