"""Removing repeated passages: Rabin-Karp hashes of every fixed-length window of words.

A window is removed where the same words also start in a document with a smaller id. Documents are read
twice, in the same scan order, and their texts are never shuffled. The first pass hashes every window of a
chunk of rows (a rolling polynomial over 64-bit word hashes, and 16 more bits of a second polynomial),
keeps each distinct window once with the smallest id in the chunk, and sends the sorted hashes out by
range in compressed blobs. Spark groups the blobs by range; each range is merged and counted by one task, which answers with one bit for each hash:
whether a smaller id outside the chunk has the window. The second pass computes the windows again, applies
bits and the ids of its own chunk, merges covered words to maximal intervals, and cuts them out.

Two different windows share all 80 bits with a chance of n * n / 2^81: 4e-9 at 140 million windows, one in
a few thousand millions of windows at 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgraph.llm import common

WINDOW = 13
CHUNK_ROWS = 2048
CHUNK_WORDS = 1_000_000
SLICE = 256
WINDOWS_PER_RANGE = 1_000_000
LEAST_RANGES = 32
MERGED_AT_ONCE = 8_000_000
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
LAST = (1 << 63) - 1
VOCABULARY = 200_000


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all when too many are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def window_hashes(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of word values: 64 bits of one polynomial and 16 of another. The
    hash of a window is a difference of prefix sums, brought to a common power."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    out = []
    for base, mix in ((BASE_A, 0), (BASE_B, 29)):
        v = values if not mix else values ^ (values >> np.uint64(mix))
        inverse = pow(base, -1, 1 << 64)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * _powers(inverse, len(v) - 1), dtype=np.uint64)))
        h = (prefix[window:] - prefix[:-window]) * _powers(base, n + window - 2)[window - 1 :]
        h ^= h >> np.uint64(31)
        out.append(h * np.uint64(0xBF58476D1CE4E5B9))
    return out[0], (out[1] >> np.uint64(48)).astype(np.uint16)


class Chunk:
    """A run of rows of one scan, with their windows and, if asked for, their words."""

    def __init__(self, window: int, keep_words: bool) -> None:
        self.window, self.keep_words, self.hash_of = window, keep_words, WordHashes()
        self.clear(None)

    def clear(self, key) -> None:
        self.key, self.ids, self.words, self.highs, self.lows, self.n = key, [], [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        values = np.fromiter(map(self.hash_of.__getitem__, words), np.uint64, len(words))
        high, low = window_hashes(values, self.window)
        self.ids.append(LAST if doc_id is None else doc_id)
        if self.keep_words:
            self.words.append(words)
        self.highs.append(high)
        self.lows.append(low)
        self.n += len(words)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows by hash, with the smallest id here, and for each window its place among them."""
        high, low = np.concatenate(self.highs or [np.zeros(0, np.uint64)]), np.concatenate(self.lows or [np.zeros(0, np.uint16)])
        ids = np.repeat(np.array(self.ids, np.int64), [len(h) for h in self.highs])
        order = np.argsort(high, kind="stable")
        h, lo = high[order], low[order]
        if len(h) > 1 and ((h[1:] == h[:-1]) & (lo[1:] != lo[:-1])).any():
            order = np.lexsort((low, high))
            h, lo = high[order], low[order]
        new = _firsts(h, lo)
        starts = np.flatnonzero(new)
        smallest = np.minimum.reduceat(ids[order], starts) if len(starts) else np.zeros(0, np.int64)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        return h[starts], lo[starts], smallest, place


def _firsts(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return new


def _chunks(batches, window: int, rows: int, words: int, keep_words: bool) -> Iterator[Chunk]:
    """Chunks end at multiples of ``rows`` in a file, where the scan goes to another file, and where they
    hold ``words`` words."""
    chunk = Chunk(window, keep_words)
    for batch in common.slices(batches, SLICE):
        for file, row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            key = (file, row // rows)
            if chunk.key is None or chunk.key[:2] != key or chunk.n >= words:
                if chunk.key is not None:
                    yield chunk
                chunk.clear((*key, row))
            chunk.add(doc_id, text)
    if chunk.key is not None:
        yield chunk


def _pack(high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted hashes as differences, all in byte planes, then zstd: high bytes of differences are zero."""
    gaps = np.diff(high, prepend=high[:1])
    gaps[:1] = high[:1]
    own, place = np.unique(ids, return_inverse=True)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes() + low.tobytes() + np.ascontiguousarray(place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
    head = np.array([len(high), len(own)], np.int64).tobytes() + own.astype(np.int64).tobytes()
    return zstandard.ZstdCompressor(1).compress(head + planes)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, k = np.frombuffer(data, np.int64, 2)
    own, at = np.frombuffer(data, np.int64, k, 16), 16 + 8 * k
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel()
    low, at = np.frombuffer(data, np.uint16, n, at + 8 * n), at + 10 * n
    place = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(gaps, dtype=np.uint64), low, own[place]


def _smallest_ids(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the parts in order, each with its smallest id."""
    high, low, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, low, high))
    high, low, ids = high[order], low[order], ids[order]
    new = _firsts(high, low)
    return high[new], low[new], ids[new]


def earlier_elsewhere(blobs: list[bytes], at_once: int = MERGED_AT_ONCE) -> Iterator[np.ndarray]:
    """For each blob and hash of it: does another blob hold the hash with a smaller id? Blobs are unpacked
    twice and merged a few at a time into one table of distinct hashes, so that a window that all blobs
    have takes no more memory than one that a single blob has."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for blob in blobs:
        held.append(_unpack(blob))
        n += len(held[-1][0])
        if n > at_once:
            held = [_smallest_ids(held)]
            n = len(held[0][0]) // 2  # grows with the table, so that each hash is merged a few times at most
    high, low, first = _smallest_ids(held)
    for blob in blobs:
        h, lo, ids = _unpack(blob)
        place = np.searchsorted(high, h)
        while (other := low[place] != lo).any():  # equal in 64 bits and not in 80
            place[other] += 1
        yield ids > first[place]


def covered(flags: np.ndarray, n_words: int, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words under the flagged windows."""
    starts = np.flatnonzero(flags)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + window).tolist()))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, chunk_rows: int = CHUNK_ROWS, chunk_words: int = CHUNK_WORDS,
    windows_per_range: int = WINDOWS_PER_RANGE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Cut out every word under a window of ``window`` words that also starts in a document with a
    smaller id.

    Returns id_col, n_words, n_removed, spans (list of [start, end) in words), kept (the kept words
    joined by one space). Windows are judged on the input. Null and empty texts have no words and stay
    empty; texts shorter than a window lose nothing; a window repeated within one document only is kept,
    and so is one shared by rows of equal id. Null ids count as larger than all others. An empty table
    gives no rows; other columns are left out.

    docs is scanned twice, so it is read from files: a DataFrame that isn't a plain file scan is first
    written to the shared folder. A chunk takes about 100 bytes a word, a range about 60 bytes a distinct
    window, and a blob is a chunk's part of a range. The defaults fit tasks of a few hundred MB up to some
    TB of text; at 100 TB raise chunks to 20 million words and ranges to 250 million windows, with tasks of
    16 GB, so that blobs keep some hundred windows.
    """
    rows = common.scan_rows(docs, [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")])
    words = rows.select(F.sum(common.count_words(F.col("text")))).first()[0] or 0
    ranges = common.power_of_two(-(-int(words) // windows_per_range), LEAST_RANGES)
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def hash_windows(batches):
        for chunk in _chunks(batches, window, chunk_rows, chunk_words, False):
            high, low, ids, _ = chunk.distinct()
            cells = [(k, *chunk.key, len(high), _pack(high[a:b], low[a:b], ids[a:b])) for k, a, b in common.cuts(high >> shift)]
            if cells:
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), kinds)], names=["range", "file", "chunk", "first", "n", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        bits = [np.packbits(f).tobytes() for f in earlier_elsewhere(table["blob"].to_pylist())]
        return table.drop_columns(["blob"]).append_column("bits", pa.array(bits, pa.binary()))

    answer = "range int, file string, chunk long, first long, n long, bits binary"
    hashed = rows.mapInArrow(hash_windows, "range int, file string, chunk long, first long, n long, blob binary")
    flagged = common.dealt(hashed, ranges).groupBy("range").applyInArrow(merge, answer)
    side = common.SideFiles(flagged, "file", ["chunk", "range"], "repeats")

    def cut(batches):
        answers = side.reader()
        for chunk in _chunks(batches, window, chunk_rows, chunk_words, True):
            high, _, smallest, place = chunk.distinct()
            runs = {k: (a, b) for k, a, b in common.cuts(high >> shift)}
            elsewhere = np.zeros(len(high), bool)
            seen = 0
            for k, first, n, bits in answers.rows(chunk.key[0], chunk.key[1], ["range", "first", "n", "bits"]):
                if (first, n) != (chunk.key[2], len(high)):
                    continue
                a, b = runs[k]
                elsewhere[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                seen += b - a
            if seen != len(high):
                raise RuntimeError(f"rows of {chunk.key} were scanned in another order than before")
            out, at = [], 0
            for doc_id, own_words, hashes in zip(chunk.ids, chunk.words, chunk.highs):
                own = place[at : at + len(hashes)]
                at += len(hashes)
                spans = covered(elsewhere[own] | (smallest[own] < doc_id), len(own_words), window)
                kept, last = [], 0
                for a, b in spans:
                    kept += own_words[last:a]
                    last = b
                kept = kept + own_words[last:] if spans else own_words
                out.append((None if doc_id == LAST else doc_id, len(own_words), len(own_words) - len(kept), [list(s) for s in spans], b" ".join(kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["id", "n_words", "n_removed", "spans", "kept"])

    done = rows.mapInArrow(cut, "id long, n_words long, n_removed long, spans array<array<long>>, kept binary")
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept"))
