"""Near-duplicates by SimHash and fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded to 23). The perfect
(23, 12, 7) Golay code puts every 23-bit word within 3 bits of one codeword, and within 4 bits of at most
six. Two segments at most 2 bits apart have a word within 1 bit of
both; its codeword is within 4 bits of both, so they share one of their keys. Of fingerprints that differ in 4 bits or fewer, at most one segment can
differ in more than 2, so the other two agree on a pair of keys. Joining on pairs of keys thus finds every
link; candidates are then verified bit by bit.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm import common
from kgraph.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))
KEYS_PER_RANGE = 750_000
KEYS_AT_ONCE = 32_768
SMALL_GROUP = 48


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of word shingles, repeats included: a bit is 1 if over half of the hashes have it. Fewer
    words than a shingle count as one shingle; no words give 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())], np.uint64, len(words) - size + 1)
    counts = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in common.slices(batches):
            prints = np.fromiter((fingerprint(t, size) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints)], names=["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns that lead from a word to the codewords within 4 bits (six columns,
    unused ones -1), and by byte of a word its part of the syndrome."""

    def rest(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    single = [rest(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for i in bits:
                s ^= single[i]
            found[s].append(sum(1 << i for i in bits))
    if max(map(len, found)) != 6:
        raise AssertionError("not the Golay code")
    patterns = np.full((2048, 6), -1, np.int64)
    for s, x in enumerate(found):
        patterns[s, : len(x)] = x
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * k + i < 23:
                    by_byte[k, v] ^= single[8 * k + i]
    return patterns, by_byte


def segment_keys(words: np.ndarray) -> np.ndarray:
    """Indices (the 12 message bits) of all codewords within 4 bits of each 23-bit word: six columns, -1
    where there are fewer."""
    patterns, by_byte = golay_tables()
    s = by_byte[0, words & 255] ^ by_byte[1, words >> 8 & 255] ^ by_byte[2, words >> 16]
    errors = patterns[s]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of the fingerprint) for all pairs of segments and all pairs of their keys."""
    parts = [segment_keys((prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    keys, places = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        key = np.where((a < 0) | (b < 0), -1, (k << 24) | (a << 12) | b).reshape(len(prints), -1)
        at, column = np.nonzero(key >= 0)
        keys.append(key[at, column])
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def spread(key: np.ndarray) -> np.ndarray:
    """Mixes a key to 32 bits, so that ranges of equal width get like numbers of keys; one to one."""
    return (key.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def close_pairs(key: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints that share a key: all pairs in small groups. In a larger group a
    search takes what is near from the shrinking set of fingerprints not yet reached, which links
    everything that is linked without going through all pairs of a dense group."""
    order = np.lexsort((prints, key))
    key, prints = key[order], prints[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [], []
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    k, f = key[small], prints[small]
    for d in range(1, int(sizes[sizes <= SMALL_GROUP].max(initial=1))):
        near = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius) & (f[d:] != f[:-d]))
        left.append(f[near])
        right.append(f[near + d])
    joined = Forest()
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        own = np.unique(prints[start : start + size])
        if joined.parts(own.tolist()) > 1:  # a dense cluster shares many keys; once it is linked, that is enough
            a, b = reach(own, radius)
            left.append(own[a])
            right.append(own[b])
            joined.link(own[a].tolist(), own[b].tolist())
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right)), 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


class Forest:
    """Which numbers are linked already."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def parts(self, some: list[int]) -> int:
        return len({self.find(x) for x in some})

    def link(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """Links pairs; returns those that weren't linked before."""
        new = []
        for u, v in zip(a, b):
            p, q = self.find(u), self.find(v)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                new.append((u, v))
        return new


def reach(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints, as places."""
    left, right, todo, block = [], [], np.arange(len(prints)), 256
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            now, front = front[:block], front[block:]
            step = max(1, (1 << 21) // len(todo))
            for at in range(0, len(now), step):
                near = np.bitwise_count(prints[now[at : at + step], None] ^ prints[todo]) <= radius
                hit = near.any(axis=0)
                if hit.any():
                    left.append(now[at : at + step][near[:, hit].argmax(axis=0)])
                    right.append(todo[hit])
                    front = np.concatenate((front, todo[hit]))
                    todo = todo[~hit]
                    if not len(todo):
                        break
    return (np.concatenate(left), np.concatenate(right)) if left else (todo, todo)


def links(prints: DataFrame, count: int) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column fp) within 4 bits. Keys go out in
    compressed blobs by range of key; a range is joined and verified by one task."""
    ranges = common.power_of_two(-(-count * 84 // KEYS_PER_RANGE), LEAST_RANGES)
    shift = np.uint32(32 - (ranges.bit_length() - 1))

    def spread_keys(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(own), KEYS_AT_ONCE):
                part = own[at : at + KEYS_AT_ONCE]
                key, place = fuzzy_keys(part)
                key = spread(key)
                order = np.argsort(key, kind="stable")
                key, place = key[order], place[order].astype(np.uint16)
                rows = []
                for k, a, b in common.cuts(key >> shift):
                    used, local = np.unique(place[a:b], return_inverse=True)
                    data = np.array([b - a, len(used)], np.int64).tobytes() + part[used].tobytes() + key[a:b].tobytes() + local.astype(np.uint16).tobytes()
                    rows.append((k, zstandard.ZstdCompressor(1).compress(data)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["range", "blob"])

    def join(table: pa.Table) -> pa.Table:
        keys, own = [], []
        for blob in table["blob"].to_pylist():
            data = zstandard.ZstdDecompressor().decompress(blob)
            n, m = np.frombuffer(data, np.int64, 2)
            part = np.frombuffer(data, np.uint64, m, 16)
            keys.append(np.frombuffer(data, np.uint32, n, 16 + 8 * m))
            own.append(part[np.frombuffer(data, np.uint16, n, 16 + 8 * m + 4 * n)])
        a, b = close_pairs(np.concatenate(keys), np.concatenate(own))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    keyed = prints.select("fp").mapInArrow(spread_keys, "range int, blob binary")
    return common.dealt(keyed, ranges).groupBy("range").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The near-duplicate class of every row.

    Returns id_col, fingerprint (16 hex digits) and component_id (the smallest id in the class): classes
    connect texts whose fingerprints differ in 4 bits or fewer. Null and empty texts have fingerprint 0 and form one class with whatever lies within 4 bits of 0. Equal texts and repeated
    rows share a class. A null id is kept; component_id is null only where a class has no other ids. An
    empty table gives no rows; other columns are left out.
    """
    rows = common.save(fingerprints(docs, size, id_col, text_col), "prints")
    distinct = common.save(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "prints-distinct")
    found = common.save(links(distinct, distinct.count()), "print-links")
    roots = components(found)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = common.save(rooted, "print-roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"), F.sum("n").alias("docs"))
    n_prints, n_docs = smallest.agg(F.coalesce(F.sum("prints"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    classes = common.join_hot(rooted, smallest.drop("docs"), ["root"], "prints", n_prints).select("fp", "component_id", "n")
    classes = common.save(classes, "print-classes")
    out = common.join_hot(rows, classes, ["fp"], "n", n_docs)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Longer fingerprints, for similarities that 4 bits of 64 can't reach.

LANES = 10
LEAST = 0.8
PRINTS_PER_RANGE = 375_000
LEAST_RANGES = 32
MARGIN = 4.0
BLOCK = 2048
MIX = 0x9E3779B97F4A7C15


def differing_share(similarity: float) -> float:
    """The share of SimHash bits that differ, on average, at a Jaccard similarity of shingle sets."""
    cosine = 2 * similarity / (1 + similarity)
    return float(np.arccos(cosine) / np.pi)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted. Letters A to Z count as lower case. Texts of fewer
    words than a shingle are one shingle; no words have none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    n = max(1, len(words) - size + 1)
    last = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(joined[a:b], SEED) for a, b in zip((ends - lengths)[:n].tolist(), last)], np.uint64, n))


def lanes_of(text: str | None, size: int, lanes: int = LANES) -> bytes:
    """A SimHash of ``lanes`` times 64 bits over ``shingle_hashes``: each lane mixes them anew. No words
    give zeros."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return bytes(8 * lanes)
    mixed = hashes[:, None] ^ (np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(MIX))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(mixed), 255):  # sums of 255 bits fit a byte
        counts += np.unpackbits(mixed[at : at + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(mixed), bitorder="little").tobytes()


def key_range(codeword: np.ndarray, parts: int) -> np.ndarray:
    """The range, of ``parts`` in a lane, that a 12-bit key of the first segment belongs to; -1 stays."""
    return np.where(codeword < 0, -1, (codeword * 0x9E3 & 0xFFF) * parts >> 12)


def lane_keys(words: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the words of one lane: all pairs of the Golay keys of its two segments of 23 bits
    whose first key falls in range ``part``."""
    low = np.uint64((1 << 23) - 1)
    a = segment_keys((words & low).astype(np.int64))
    a = np.where(key_range(a, parts) == part, a, -1)[:, :, None]
    b = segment_keys((words >> np.uint64(23) & low).astype(np.int64))[:, None, :]
    key = np.where((a < 0) | (b < 0), -1, (a << 12) | b).reshape(len(words), -1)
    at, column = np.nonzero(key >= 0)
    return key[at, column], at


def within(x: np.ndarray, y: np.ndarray, most_bits: int) -> np.ndarray:
    """Places of the pairs of rows that differ in ``most_bits`` bits at most over all lanes. Pairs whose
    first half alone differs in more aren't compared further."""
    half = x.shape[1] // 2
    bits = np.bitwise_count(x[:, :half] ^ y[:, :half]).sum(axis=1, dtype=np.int64)
    at = np.flatnonzero(bits <= most_bits)
    return at[bits[at] + np.bitwise_count(x[at, half:] ^ y[at, half:]).sum(axis=1, dtype=np.int64) <= most_bits]


def reach_lanes(rows: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints of several lanes, as places."""
    left, right, todo = [], [], np.arange(len(rows))
    while len(todo):
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            step = max(1, (1 << 18) // len(todo))
            now, front = front[:step], front[step:]
            i, j = (x.ravel() for x in np.indices((len(now), len(todo))))
            near = within(rows[now[i]], rows[todo[j]], most_bits)
            hit, first = np.unique(j[near], return_index=True)
            left.append(now[i[near][first]])
            right.append(todo[hit])
            front = np.concatenate((front, todo[hit]))
            todo = np.delete(todo, hit)
    return (np.concatenate(left), np.concatenate(right)) if left else (todo, todo)


def verified_forest(key: np.ndarray, place: np.ndarray, rows: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect whatever is linked: fingerprints that share a key and differ in
    ``most_bits`` bits of all lanes at most. Pairs are verified first, with one radius in groups of every
    size, and only links are thinned, to a forest, which joins exactly what all links join."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    rest = np.repeat(sizes, sizes) - (np.arange(len(key)) - np.repeat(starts, sizes))
    rest[np.repeat(sizes > SMALL_GROUP, sizes)] = 0
    joined = Forest()
    kept: list[tuple[int, int]] = []
    for d in range(1, SMALL_GROUP):
        open_ = np.flatnonzero(rest > d)
        for at in range(0, len(open_), 1 << 18):
            x, y = place[open_[at : at + (1 << 18)]], place[open_[at : at + (1 << 18)] + d]
            near = within(rows[x], rows[y], most_bits)
            kept += joined.link(x[near].tolist(), y[near].tolist())
    for start, size in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
        own = place[start : start + size]
        if joined.parts(own.tolist()) > 1:
            a, b = reach_lanes(rows[own], most_bits)
            kept += joined.link(own[a].tolist(), own[b].tolist())
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def similar_links(prints: DataFrame, count: int, lanes: int, most_bits: int) -> DataFrame:
    """(a, b) for fingerprints (fp, lanes) that share a key and differ in ``most_bits`` bits at most: a
    forest of these links for each range of keys. A whole fingerprint goes to the ranges of its first
    segment's keys, six in a lane at most (5.3 on average), and its keys are made again there. Small inputs
    are cut to ranges as well, so that copies of a fingerprint don't grow with the input."""
    parts = min(4096, max(LEAST_RANGES, -(-count * 16 // (3 * PRINTS_PER_RANGE))))
    low = np.uint64((1 << 23) - 1)

    def spread_prints(batches):
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, lanes)
            for at in range(0, len(ids), 4096):
                own, part = ids[at : at + 4096], rows[at : at + 4096]
                out = []
                for k in range(lanes):
                    r = key_range(segment_keys((part[:, k] & low).astype(np.int64)), parts)
                    place, column = np.nonzero(r >= 0)
                    r, place = np.divmod(np.unique(r[place, column] * len(own) + place), len(own))
                    edges = np.flatnonzero(np.diff(r)) + 1
                    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(r)]):
                        used = place[a:b]
                        out.append((k * parts + int(r[a]), packer.compress(own[used].tobytes() + part[used].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary()))], names=["range", "blob"])

    def join(table: pa.Table) -> pa.Table:
        own, rows = [], []
        for blob in table["blob"].to_pylist():
            data = zstandard.ZstdDecompressor().decompress(blob)
            n = len(data) // (8 + 8 * lanes)
            own.append(np.frombuffer(data, np.int64, n))
            rows.append(np.frombuffer(data, np.uint64, n * lanes, 8 * n).reshape(-1, lanes))
        own, rows = np.concatenate(own), np.concatenate(rows)
        k, part = divmod(table["range"][0].as_py(), parts)
        a, b = verified_forest(*lane_keys(rows[:, k], part, parts), rows, most_bits)
        found = pa.table({"a": own[a], "b": own[b]})
        del own, rows
        common.release_memory()
        return found

    keyed = prints.select("fp", "lanes").mapInArrow(spread_prints, "range int, blob binary")
    met = common.dealt(keyed, lanes * parts).groupBy("range").applyInArrow(join, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def exact_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of places that connect all sets (none empty) with a Jaccard similarity of ``least`` or more
    to another: a search takes what is similar from the shrinking rest."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, todo, out = np.zeros(len(known), bool), np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        front = [seed] if todo[seed] else []
        todo[seed] = False
        while front and todo.any():
            x = front.pop()
            own = flat[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            hit = np.flatnonzero(todo & (shared / (sizes[x] + sizes - shared) >= least))
            todo[hit] = False
            front += hit.tolist()
            out += [(x, y) for y in hit.tolist()]
    return out


def exact_links(docs: DataFrame, members: DataFrame, size: int, least: float, text_col: str) -> DataFrame:
    """(a, b) of the members (file, row, root, fp, n: how many have that root) that connect all members of
    a root whose shingle sets have a Jaccard similarity of ``least`` or more. Texts are scanned again, and
    only the members' sets of hashes go to tasks: many roots to one task, and where a root has more than
    BLOCK members, each pair of its blocks to one."""
    most = BLOCK
    buckets = max(8, -(-members.count() // (2 * most)))
    keyed = members.select("file", "row", "root", "fp", "n").withColumn("chunk", F.floor(F.col("row") / common.SIDE_CHUNK).cast("long"))
    side = common.SideFiles(keyed, "file", ["chunk", "row"], "lane-members")

    def read_sets(batches):
        reader = side.reader()
        for batch in common.slices(batches):
            out, at, found = [], None, {}
            for file, row, text in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "text"))):
                if at != (file, row // common.SIDE_CHUNK):
                    at = (file, row // common.SIDE_CHUNK)
                    found = {r: x for r, *x in reader.rows(file, row // common.SIDE_CHUNK, ["row", "root", "fp", "n"])}
                if row in found:
                    root, fp, n = found[row]
                    data = shingle_hashes(text, size).tobytes()
                    blocks = -(-n // most)
                    if blocks == 1:
                        out.append((root % buckets, -1, -1, root, fp, data))
                    else:
                        own = xxhash.xxh64_intdigest(fp.to_bytes(8, "little", signed=True)) % blocks
                        out += [(root, min(own, k), max(own, k), root, fp, data) for k in range(blocks) if k != own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["task", "i", "j", "root", "fp", "shingles"])

    def join(table: pa.Table) -> pa.Table:
        roots: dict[int, list[tuple[int, np.ndarray]]] = {}
        for root, fp, data in zip(*(table[c].to_pylist() for c in ("root", "fp", "shingles"))):
            if data:
                roots.setdefault(root, []).append((fp, np.frombuffer(data, np.uint64)))
        pairs = [(own[x][0], own[y][0]) for own in roots.values() for x, y in exact_forest([h for _, h in own], least)]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = common.scan_rows(docs, [F.col(f"`{text_col}`").cast("string").alias("text")]).mapInArrow(read_sets, "task long, i int, j int, root long, fp long, shingles binary")
    return sets.groupBy("task", "i", "j").applyInArrow(join, "a long, b long")


def similar_classes(docs: DataFrame, size: int, least: float = LEAST, lanes: int = LANES, text_col: str = "text") -> DataFrame:
    """(file, row, class) for every row of a scan: classes connect texts whose word shingles have a Jaccard
    similarity of ``least`` or more.

    Candidates come from SimHashes of 64 bits for each lane: pairs that share a Golay key pair in some
    lane and differ in no more bits than ``least`` gives on average, plus 4 standard deviations (133 of
    640 bits for 0.8). One text of each fingerprint stands for it, and within the components of the
    candidates the sets of shingles are compared exactly. At similarity 0.8 keys miss one link in 80, at
    0.85 one in 800; by the binomial the radius misses one in 18,000 at 0.8.
    """
    docs = common.as_scan(docs)
    rows = common.scan_rows(docs, [F.col(f"`{text_col}`").cast("string").alias("text")])

    def run(batches):
        for batch in common.slices(batches):
            prints = pa.array([lanes_of(t, size, lanes) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), prints], names=["file", "row", "lanes"])

    prints = common.save(rows.mapInArrow(run, "file string, row long, lanes binary").withColumn("fp", F.xxhash64("lanes")), "lanes")
    distinct = common.save(prints.groupBy("fp").agg(F.first("lanes").alias("lanes"), F.min(F.struct("file", "row")).alias("at"), F.count("*").alias("copies")), "lanes-distinct")
    share = differing_share(least)
    bits = 64 * lanes
    most_bits = int(bits * share + MARGIN * (bits * share * (1 - share)) ** 0.5)
    near = common.save(similar_links(distinct, distinct.count(), lanes, most_bits), "lane-links")
    joined = components(near)
    joined = common.save(joined, "lane-roots")
    met = distinct.join(joined, F.col("fp") == F.col("node")).select("at.file", "at.row", "root", "fp")
    members = common.join_hot(met, joined.groupBy("root").agg(F.count("*").alias("n")), ["root"], "n", joined.count())
    members = common.save(members, "lane-members")
    found = common.save(exact_links(docs, members, size, least, text_col), "exact-links")
    roots = components(found)
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "copies", F.coalesce("root", "fp").alias("class"))
    classes = common.save(classes, "lane-classes")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return common.join_hot(prints, classes, ["fp"], "copies", total).select("file", "row", "class")


def drop_near_duplicates(docs: DataFrame, size: int, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of similar texts (see ``similar_classes``): that of the smallest
    id, the first in the scan where ids repeat or are null. All columns are kept. Null and empty texts are
    one class; equal texts share a class. docs must be a scan of Parquet files, else it is written first;
    its texts aren't shuffled."""
    docs = common.as_scan(docs)
    classes = similar_classes(docs, size, least, text_col=text_col)
    ids = common.scan_rows(docs, [F.col(f"`{id_col}`").alias("id")])
    best = classes.join(ids, ["file", "row"]).groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "file", "row")).alias("best"))
    stays = best.select("best.file", "best.row", F.lit(True).alias("stays"))
    marked = common.attach(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), stays, {"stays": T.BooleanType()}, "stays")
    return marked.filter("stays").drop("stays").toDF(*docs.columns)
