"""Benchmark decontamination by SimHash over item-sized windows.

A window as long as an item slides over a document, for every length that items have. Windows get a SimHash
of their word shingles, from running sums of bits, and a multi-index over the fingerprints of the items of
that length finds all items within 23 bits: eight blocks of eight bits hold every item at all values within
two bits of its own, and 23 errors leave some block with two at most. What the index finds is verified by
the exact similarity of shingles weighted by their counts.

Most windows can't be similar to anything: similarity s of n and m shingles takes s (n + m) / (1 + s) shared
ones, so a window with fewer shingles that occur anywhere in the benchmark gets no fingerprint. That bound
is exact; it says nothing on which item is meant, which the index alone finds.

At similarity 0.8 two fingerprints differ in 9.7 bits on average with a spread of 2.9, so 23 bits lie
four and a half spreads above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm import common
from kgraph.llm.substring_dedup import VOCABULARY, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
ITEMS_AT_ONCE = 20_000
BYTES_AT_ONCE = 16 << 20
FILTER_BITS = 24
NOT_PLAIN = re.compile(r"[\W_]+")

def plain(word: bytes) -> bytes:
    """A word in lower case without punctuation; a word of nothing else stays as it is."""
    lower = word.decode("utf-8", "replace").lower()
    return (lower if lower.isalnum() else NOT_PLAIN.sub("", lower)).encode() or word


class PlainHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(plain(word))
        return value


def word_values(text: str | None, hash_of: PlainHashes) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    return np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def prints_of(bits: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHashes of n shingles from each start: a bit is 1 if over half of the shingles have it."""
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return np.packbits((sums[starts + n] - sums[starts]) * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Shared weight over joint weight of shingles."""
    shared = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class MultiIndex:
    """Fingerprints by their blocks: in each of BLOCKS tables, a fingerprint stands at every value within
    RADIUS // BLOCKS bits of its own block. Whatever differs in RADIUS bits or fewer meets in some table."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS
        self.starts, self.sizes, self.places = [], [], []
        for k in range(BLOCKS):
            value, place = np.nonzero(near[:, self._block(prints, k)])
            self.starts.append(np.searchsorted(value, np.arange(256)))
            self.sizes.append(np.bincount(value, minlength=256))
            self.places.append(place.astype(np.int32))

    @staticmethod
    def _block(prints: np.ndarray, k: int) -> np.ndarray:
        return (prints >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, place in the index) of all pairs within RADIUS bits."""
        met = []
        for k in range(BLOCKS):
            value = self._block(prints, k)
            first, n = self.starts[k][value], self.sizes[k][value]
            query = np.repeat(np.arange(len(prints)), n)
            at = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            met.append(query * len(self.prints) + self.places[k][at])
        query, place = np.divmod(np.unique(np.concatenate(met)), len(self.prints))
        close = np.bitwise_count(prints[query] ^ self.prints[place]) <= RADIUS
        return query[close], place[close]


class Items:
    """Benchmark items and their index. Items are told apart by their place in the list; ids, null or
    repeated ones too, are only carried. An item of fewer words than a shingle is one shingle; one of no
    words matches nothing. Arrays only, so that a broadcast of it is about 50 bytes a word."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int = SHINGLE, least: float = SIMILARITY) -> None:
        self.size, self.least = size, least
        self.ids = [item_id for item_id, _ in items]
        self.shingles: dict[int, np.ndarray] = {}
        by_length: dict[int, list[int]] = {}
        hash_of = PlainHashes()
        for place, (_, text) in enumerate(items):
            values = word_values(text, hash_of)
            if len(values):
                self.shingles[place] = window_hashes(values, min(size, len(values)))[0]
                by_length.setdefault(len(values), []).append(place)
        #: width of a shingle: [(words, shingles, places, index)], by length
        self.groups: dict[int, list[tuple[int, int, np.ndarray, MultiIndex]]] = {}
        for length, places in sorted(by_length.items()):
            width = min(size, length)
            n = length - width + 1
            prints = np.concatenate([prints_of(bits_of(self.shingles[p]), np.zeros(1, np.int64), n) for p in places])
            self.groups.setdefault(width, []).append((length, n, np.array(places), MultiIndex(prints)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "filters"}

    @cached_property
    def filters(self) -> dict[int, np.ndarray]:
        """By width of a shingle, a table of its top bits: does any item have such a one?"""
        out = {}
        for width, groups in self.groups.items():
            out[width] = np.zeros(1 << FILTER_BITS, bool)
            for _, _, places, _ in groups:
                for p in places.tolist():
                    out[width][self.shingles[p] >> np.uint64(64 - FILTER_BITS)] = True
        return out


class Matcher:
    """Finds items in documents."""

    def __init__(self, items: Items) -> None:
        self.items, self.hash_of = items, PlainHashes()
        self.weights: dict[int, Counter] = {}

    def _weight(self, item: int) -> Counter:
        if item not in self.weights:
            if len(self.weights) >= 10_000:
                self.weights.clear()
            self.weights[item] = Counter(self.items.shingles[item].tolist())
        return self.weights[item]

    def leaks(self, text: str | None) -> list[tuple[int | None, int, int, int, float]]:
        """(item's id, first word, words, differing bits, similarity) of the best window for each item found."""
        least, best = self.items.least, {}
        values = word_values(text, self.hash_of)
        for width, groups in self.items.groups.items():
            hashes = window_hashes(values, width)[0]
            known = self.items.filters[width][hashes >> np.uint64(64 - FILTER_BITS)]
            total = int(known.sum())
            if not total:
                continue
            sums = np.concatenate(([0], np.cumsum(known)))
            for length, m, places, index in groups:
                n = min(m, len(hashes))
                need = math.ceil(least * (n + m) / (1 + least) - 1e-9)
                if need > total:
                    break
                starts = np.flatnonzero(sums[n:] - sums[:-n] >= need)
                for _, a, b in common.cuts(np.cumsum(np.diff(starts, prepend=starts[:1]) > n)):
                    self._search(hashes, starts[a:b], n, min(length, len(values)), places, index, best)
        return [(self.items.ids[item], *found) for item, found in sorted(best.items())]

    def _search(self, hashes: np.ndarray, starts: np.ndarray, n: int, span: int, places: np.ndarray, index: MultiIndex, best: dict[int, tuple]) -> None:
        """Puts in best, by item, the most similar of the windows of n shingles at starts, the first on ties."""
        low = int(starts[0])
        prints = prints_of(bits_of(hashes[low : int(starts[-1]) + n]), starts - low, n)
        for w, k in zip(*(x.tolist() for x in index.find(prints))):
            start, item = int(starts[w]), int(places[k])
            s = similarity(Counter(hashes[start : start + n].tolist()), self._weight(item))
            if s >= self.items.least and (item not in best or s > best[item][3]):
                best[item] = (start, span, (int(prints[w]) ^ int(index.prints[k])).bit_count(), s)


def _item_groups(benchmark: DataFrame, item_col: str, text_col: str, at_once: int):
    """Items in groups of a size that is safe to broadcast: at most ``at_once`` rows, and no more text than
    BYTES_AT_ONCE but for a single longer item."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    group: list[tuple[int | None, str | None]] = []
    held = 0
    for r in rows.toLocalIterator():
        n = len((r["t"] or "").encode("utf-8", "surrogatepass"))
        if group and (len(group) == at_once or held + n > BYTES_AT_ONCE):
            yield group
            group, held = [], 0
        group.append((r["i"], r["t"]))
        held += n
    if group:
        yield group


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """Items that documents hold: id_col, item_id, start and n_words of the most similar window,
    differing bits of the fingerprints, and similarity, ``least`` or more.

    Whole texts are scanned without a shuffle. Items are indexed once and broadcast, in groups of at most
    ``at_once`` rows and 16 MB of text; a larger benchmark takes one scan for each group. Null and empty texts
    and items match nothing; every other row of the benchmark is searched for, also where its id is null or
    repeated; a document shorter than an item is compared as a whole. Of windows that are equally similar
    the first counts. Repeated rows are each reported. An empty table gives no rows; other columns are
    left out.
    """
    kind = docs.schema[id_col].dataType
    fields = [("id", kind), ("item_id", T.LongType()), ("start", T.LongType()), ("n_words", T.LongType()), ("bits", T.IntegerType()), ("similarity", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def searched(items: list[tuple[int | None, str | None]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(Items(items, size, least))

        def run(batches):
            matcher = Matcher(sent.value)
            for batch in common.slices(batches):
                at, rows = [], []
                for i, text in enumerate(batch.column("t").to_pylist()):
                    for leak in matcher.leaks(text):
                        at.append(i)
                        rows.append(leak)
                if rows:
                    found = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *found], names=schema.names)

        return texts.mapInArrow(run, schema)

    common.bound_batches(docs.sparkSession)
    out = None
    for items in _item_groups(benchmark, item_col, item_text_col, at_once):
        part = searched(items)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def drop_leaking(
    docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """docs without the rows that hold a benchmark item, with all their columns, whatever their names; see
    ``find_leaks``. Rows without text stay. Several groups of items take one scan all the same."""
    names = docs.columns
    kept = docs.toDF(*(f"c{i}" for i in range(len(names))))
    column = f"c{names.index(text_col)}"
    schema = kept.schema
    common.bound_batches(docs.sparkSession)
    for items in _item_groups(benchmark, item_col, item_text_col, at_once):
        sent = docs.sparkSession.sparkContext.broadcast(Items(items, size, least))

        def run(batches, sent=sent):
            matcher = Matcher(sent.value)
            for batch in common.slices(batches):
                clean = pa.array([not matcher.leaks(t) for t in batch.column(column).to_pylist()], pa.bool_())
                yield batch.filter(clean)

        kept = kept.mapInArrow(run, schema)
    return kept.toDF(*names)
