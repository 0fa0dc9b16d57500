"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm import common
from kgraph.llm.substring_dedup import WordHashes, window_hashes

REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_end_lines", "n_distinct", "n_capitals", "n_digits", "n_bangs", "n_pipes", "n_commas", "n_stops", "longest_line")


def _among(data: bytes, some: bytes) -> int:
    return len(data) - len(data.translate(None, some))


def repeated_words(hashes: np.ndarray, window: int) -> int:
    """Words under windows that occur twice or more among the hashes, the first occurrence included."""
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + window, np.int64)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def count_text(text: str | None, hash_of: WordHashes) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS; a null text counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    distinct = set(words)
    repeats = 0
    if len(words) > REPEAT_WINDOW and len(distinct) < len(words):
        values = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
        repeats = repeated_words(window_hashes(values, REPEAT_WINDOW)[0], REPEAT_WINDOW)
    return (
        len(words), len(text) - _among(data, SPACES), _among(data, SYMBOLS), len(lines) - len(set(lines)), repeats,
        len(lines), sum(x.rstrip(" \t\r")[-1:] in ".!?" for x in lines), len(distinct), _among(data, CAPITALS), _among(data, DIGITS), data.count(b"!"), data.count(b"|"), data.count(b","), data.count(b"."),
        max(map(len, lines), default=0),
    )


def with_stats(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of df named by ``keep`` (all, if None), then a struct ``stats`` of the counts. One scan,
    no shuffle. Names may clash with anything but ``stats``."""
    common.bound_batches(df.sparkSession)
    keep = tuple(df.columns) if keep is None else keep
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches):
        hash_of = WordHashes()
        for batch in common.slices(batches):
            counts = np.array([count_text(t, hash_of) for t in batch.column("t").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            kept = [batch.column(f"c{i}") for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], names=[f.name for f in schema])

    out = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.struct(*COUNTS).alias("stats"))


def _ratio(a: str, b: str) -> Column:
    top, below = F.col(f"stats.{a}"), F.col(f"stats.{b}")
    return F.when(below > 0, top / below).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What the learned operators see: statistics of the text alone, as columns over ``stats``."""
    ratios = {
        "symbols_per_char": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "end_lines": ("n_end_lines", "n_lines"),
        "distinct": ("n_distinct", "n_words"), "capitals": ("n_capitals", "word_chars"), "digits": ("n_digits", "word_chars"), "bangs": ("n_bangs", "n_words"), "pipes": ("n_pipes", "n_words"),
        "commas": ("n_commas", "n_words"), "stops": ("n_stops", "n_words"), "word_length": ("word_chars", "n_words"), "line_words": ("n_words", "n_lines"),
    }
    return {k: _ratio(*v) for k, v in ratios.items()} | {"words": F.col("stats.n_words").cast("double"), "longest_line": F.col("stats.longest_line").cast("double")}


def labelled(stats: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of about ``most`` labelled rows at most, picked by a hash of the id; the
    label of an id with several is their majority, ties to 1. Null labels are left out. This bounded
    sample is all that reaches the driver."""
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    n = one.count()
    share = 1 << 30 if n <= most else int((1 << 30) * most / n)
    one = one.filter(F.pmod(F.xxhash64("_label_id"), F.lit(1 << 30)) < share)
    found = stats.join(F.broadcast(one) if min(n, most) <= 100_000 else one, F.col(id_col) == F.col("_label_id"))
    table = found.select("_label", F.col(id_col).alias("_id"), *(v.cast("double").alias(k) for k, v in features().items())).orderBy("_id", *features()).toPandas()
    return table[list(features())].to_numpy(np.float64).reshape(-1, len(features())), table["_label"].to_numpy(np.int64)
