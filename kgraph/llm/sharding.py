"""Sharding by longest-processing-time scheduling.

Documents of equal text form a group that stays together. Groups are taken by falling size and each goes
to the shard with the least bytes so far, through a heap. Only the histogram of group sizes reaches the
driver: groups of one size are alike to the schedule, so a run of them is dealt out at once. D distinct
sizes add up to at least D*D/2 bytes, so the histogram has at most sqrt(2 * total bytes) rows (250
thousand at 30 GB, 14 million at 100 TB: 1.3 GB of Arrow columns for 8 shards, and some minutes of the one
sequential step that the method has).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm import common

LAW = "bytes"


def deal_run(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each shard gets when every group goes to the least loaded shard,
    the lower number on ties. Whole rounds below a water level are counted, the rest go through the heap."""
    taken = [0] * len(loads)
    if n > 4 * len(loads):
        lo, hi = min(loads), max(loads) + size * n

        def below(level: int) -> int:
            return sum((level - x) // size + 1 for x in loads if x <= level)

        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if below(mid) <= n else (lo, mid - 1)
        if below(lo) <= n:
            for s, x in enumerate(loads):
                taken[s] = max(0, (lo - x) // size + 1)
    heap = [(x + taken[s] * size, s) for s, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(n - sum(taken)):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        taken[s] += 1
    for s, k in enumerate(taken):
        loads[s] += k * size
    return taken


def schedule(sizes: np.ndarray, counts: np.ndarray, n_shards: int) -> tuple[np.ndarray, list[int]]:
    """For each size (any order in, falling inside): the number of its groups for each shard."""
    loads = [0] * n_shards
    out = np.zeros((len(sizes), n_shards), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = deal_run(loads, int(sizes[i]), int(counts[i]))
    return out, loads


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", place: bool = False) -> DataFrame:
    """Put every row of docs into a shard of near equal bytes.

    Returns id_col, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, shard (0 to
    n_shards - 1) and slot (gapless from 0 in each shard); with ``place`` also file and row, each row's
    place in the scan of docs.

    Equal texts share a shard; null texts are one such group, apart from the empty text. Repeated rows
    keep one output row each. Null ids are kept and come first in order. An empty table gives no rows.
    Columns of other names are left out. In a shard, slots follow id and then a hash of the text. A group larger than the mean load makes its
    shard that much larger, since groups are never split.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    text = F.col(text_col)
    columns = [
        F.col(id_col).alias("_id"),
        (common.byte_length(text) + 1).alias("_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("_crc"),
        common.text_key(text).alias("_key"),
    ]
    base = common.save(common.scan_rows(docs, columns) if place else docs.select(*columns), "shard-rows")
    groups = base.groupBy("_key").agg((F.count("*") * F.first("_size")).cast("long").alias("_bytes"), F.count("*").alias("_rows"))
    groups = common.save(groups, "shard-groups")
    hist = groups.groupBy("_bytes").agg(F.count("*").alias("groups"), F.sum("_rows").alias("rows")).toArrow()
    sizes, counts, rows_of = (hist[c].to_numpy().astype(np.int64) for c in ("_bytes", "groups", "rows"))
    dealt, _ = schedule(sizes, counts, n_shards)
    ends = pa.FixedSizeListArray.from_arrays(pa.array(np.cumsum(dealt, axis=1).ravel()), n_shards).cast(pa.list_(pa.int64()))
    plan = spark.createDataFrame(pa.table({"_plan_bytes": sizes, "_ends": ends}))
    ranked = common.dense_rank_in(groups, ["_bytes"], ["_key"], int(counts.sum()), "_rank")
    if len(sizes) <= common.BROADCAST_ROWS:
        plan = F.broadcast(plan)
    placed = ranked.join(plan, F.col("_bytes") == F.col("_plan_bytes"))
    shard_of = common.save(placed.select("_key", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("shard"), "_rows"), "shard-of-group")
    n_rows = int(rows_of.sum())
    rows = common.join_hot(base, shard_of, ["_key"], "_rows", n_rows)
    out = common.dense_rank_in(rows, ["shard"], ["_id", "_key"], n_rows, "slot")
    made = [F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot"]
    return out.select(F.col("_id").alias(id_col), *made, *["file", "row"] * place)


def shard_rows(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns and those of shard and slot; see ``assign_shards``. Texts aren't shuffled."""
    docs = common.as_scan(docs)
    placed = assign_shards(docs, n_shards, id_col, text_col, place=True)
    return common.attach(docs, placed, {"shard": T.IntegerType(), "slot": T.LongType()}, "shards")
