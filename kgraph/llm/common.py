"""Shared helpers: the scratch folder, word splitting and heavy-key safe ranking."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII white space that separates words; ``bytes.split()`` splits on exactly these six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 500_000
BROADCAST_ROWS = 100_000
MOST_TASKS = 20_000
BATCH_BYTES = 4 << 20
NULL_KEY = b""


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local temporary folder is
    used only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    return base.rstrip("/")


@lru_cache(1)
def _local_dir() -> str:
    """One temporary folder for this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="kgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/kgraph-llm/{uuid.uuid4().hex[:12]}-{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the scratch folder and read it back: lineage ends there, and a lost
    executor costs nothing that was already written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Gives what is free back to the system. Python workers are used again by later tasks, and the allocators
    of Arrow and C would keep the most that any task took so far."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most, without copies: long texts become Python objects a few
    at a time, whatever the session's batch size is. Memory is released before the first and after each one."""
    release_memory()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        release_memory()


def bound_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of about BATCH_BYTES: what a batch takes, several times over
    on both sides, then doesn't depend on how long texts are (a text above it is a batch alone). The limit stays
    set for the session, as batches are made when a result is read; one that the session has itself is kept.
    No result depends on it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cuts(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of each run of equal keys in a sorted array: only keys that are there, however
    many others there might be."""
    if len(keys):
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist()
        yield from zip(keys[starts].tolist(), starts, [*starts[1:], len(keys)])


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null texts share a key of their own, apart from empty ones."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(NULL_KEY))


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def count_words(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; null: 0. No list of words is built:
    a word starts where a non-space follows a space or the start."""
    squeezed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def bucket_count(rows: int, per: int = ROWS_PER_BUCKET) -> int:
    return max(8, min(1 << 20, -(-rows // per)))


def power_of_two(n: int, least: int = 1) -> int:
    return max(least, 1 << max(0, n - 1).bit_length())


def dealt(df: DataFrame, ranges: int) -> DataFrame:
    """df by its column ``range``, ready to be grouped by it: each range is one task, so that tasks stay of one
    size however much the input grows; very many ranges share tasks."""
    if ranges <= MOST_TASKS:
        return df.repartitionById(ranges, F.col("range"))
    return df.repartition(MOST_TASKS, "range")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of left with right, which has each key once and says in ``weight`` how many rows of left
    have it, of ``total``. Keys that hold over one in ``share`` of all rows, at most ``share`` keys, are
    broadcast, so that no task gets all rows of a hot key; the others are joined by a shuffle."""
    limit = max(share, total // share)
    hot = F.broadcast(right.filter(F.col(weight) > limit).withColumn("_hot", F.lit(True)))
    names = [c for c in right.columns if c not in keys]
    tried = left.join(hot, keys, "left")
    found = tried.filter("_hot").select(*left.columns, *names)
    rest = tried.filter("_hot is null").select(*left.columns)
    return found.unionAll(rest.join(right.filter(F.col(weight) <= limit), keys).select(*left.columns, *names))


def dense_rank_in(df: DataFrame, group: list[str], order: list[str], rows: int, out: str, per: int = ROWS_PER_BUCKET) -> DataFrame:
    """df with a column ``out``: gapless numbers from 0 within each group, in the order of columns ``order``.

    Rows are range-sorted by group and order into parts of about ``per``, so that a group of any size spreads
    over parts and cells of one value over as many as they need; each part numbers its own rows as it is
    written. What goes through one window is a row for each group of a part. Equal rows may be numbered
    in either order; else the numbers don't depend on how the parts fall. Group columns must not be null."""
    n = bucket_count(rows, per)
    parts = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    at = F.monotonically_increasing_id()
    parts = save(parts.withColumns({"_part": F.shiftright(at, 33).cast("int"), "_at": at.bitwiseAND((1 << 33) - 1)}), "ranked-parts")
    firsts = parts.groupBy("_part", *group).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = save(firsts.select("_part", *group, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_low")).alias("_add")), "ranked-firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    numbered = parts.join(firsts, ["_part", *group])
    return numbered.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_at") + F.col("_add")).cast("long").alias(out))


def scan_rows(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows with their place in a file: (file, row, *columns). A DataFrame that isn't a scan of Parquet
    files is written to the scratch folder first."""
    bound_batches(df.sparkSession)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return as_scan(df).select(*place, *columns)


def as_scan(df: DataFrame) -> DataFrame:
    """df itself if it is a scan of Parquet files, else a written copy."""
    try:
        df.select("_metadata.row_index")
        return df
    except AnalysisException:
        return save(df, "scan")


SIDE_CHUNK = 256


def attach(docs: DataFrame, answers: DataFrame, fields: dict[str, T.DataType], name: str, columns: list[Column] | None = None) -> DataFrame:
    """``columns`` of docs (all, if None) with the columns ``fields`` of answers (file, row, ...), null for rows
    without an answer. docs is scanned again and looks its answers up in side files, so its own columns are
    never shuffled. docs must be a scan of Parquet files; clashing names are kept apart by position."""
    docs = as_scan(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns] if columns is None else columns
    shape = docs.select(*columns).schema
    names = shape.names
    keyed = answers.select("file", "row", *fields).withColumn("chunk", F.floor(F.col("row") / SIDE_CHUNK).cast("long"))
    side = SideFiles(keyed, "file", ["chunk", "row"], name)
    inputs = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    kept = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(shape)]
    added = [T.StructField(f"a{i}", t) for i, t in enumerate(fields.values())]
    kinds = [to_arrow_type(t) for t in fields.values()]

    def run(batches):
        reader = side.reader()
        for batch in slices(batches):
            found = []
            at, rows = None, {}
            for file, row in zip(batch.column("file").to_pylist(), batch.column("row").to_pylist()):
                if at != (file, row // SIDE_CHUNK):
                    at = (file, row // SIDE_CHUNK)
                    rows = {r: x for r, *x in reader.rows(file, row // SIDE_CHUNK, ["row", *fields])}
                found.append(rows.get(row) or [None] * len(fields))
            values = list(zip(*found)) if found else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(v, k) for v, k in zip(values, kinds))], names=[*(f.name for f in kept), *(f.name for f in added)])

    out = scan_rows(docs, inputs).mapInArrow(run, T.StructType([*kept, *added]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *(F.col(f"a{i}").alias(c) for i, c in enumerate(fields)))


class SideFiles:
    """Answers for rows of a scan, kept in the shared folder so that a second scan can look them up
    without shuffling the rows themselves. df has one row for each answer; the answers of one source file
    are written together, sorted, and a reader takes those of one chunk through Parquet's statistics."""

    def __init__(self, df: DataFrame, file: str, order: list[str], name: str) -> None:
        spark = df.sparkSession
        self.path = scratch_path(spark, name)
        keyed = df.withColumn("side", F.sha1(F.col(file)))
        stretch = F.floor(F.col(order[0]) / 64)
        keyed.repartition("side", stretch).sortWithinPartitions("side", *order).write.option("compression", "zstd").partitionBy("side").parquet(self.path)

    def reader(self) -> "SideReader":
        return SideReader(self.path, 64)


class SideReader:
    def __init__(self, path: str, stretch: int) -> None:
        self.path, self.stretch, self.at, self.table = path, stretch, None, {}

    def rows(self, file: str, chunk: int, columns: list[str]):
        """Answers of a chunk; the stretch of chunks around it is kept."""
        import hashlib

        import pyarrow.dataset as ds
        from pyarrow import fs as pafs

        at = (file, chunk // self.stretch)
        if self.at != at:
            fs, root = pafs.FileSystem.from_uri(self.path)
            folder = f"{root}/side={hashlib.sha1(file.encode()).hexdigest()}"
            self.at, self.table = at, {}
            if fs.get_file_info(folder).type != pafs.FileType.NotFound:
                field = ds.field("chunk")
                low = at[1] * self.stretch
                found = ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["chunk", *columns], filter=(field >= low) & (field < low + self.stretch))
                for key, *row in zip(*(c.to_pylist() for c in found.columns)):
                    self.table.setdefault(key, []).append(row)
        return self.table.get(chunk, [])
