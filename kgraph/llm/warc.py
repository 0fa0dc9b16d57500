"""WARC archives with a two-level capture index.

``write_archive`` writes one gzip member for each page into WARC files in the shared folder and returns
the captures. ``build_index`` sorts captures by (reversed-host URL key, capture stamp) into compressed
blocks of CDX lines and keeps a sparse directory: one line for each block beside each index part, and one
entry for each part on top. ``lookup`` finds captures by binary search in top, directory and block, and
``read_records`` fetches them by range reads. Only the top level, one entry for each index part, is sent
to tasks; a directory or a block is read by the task that needs it.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm import common

CAPTURED = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_LINES = 512
FILE_BYTES = 1 << 30
READ_AHEAD = 1 << 20
KEEP = "!#$%&'()*+,/:;=?@[]~"

CAPTURE = "urlkey string, stamp string, page_id long, file string, start long, length long, digest string"
RECORD = "page_id long, urlkey string, stamp string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """``http://a.example.com/x?y#z`` gives ``com,example,a)/x?y``; host in lower case, no scheme, port,
    user or fragment. What can't be parsed is quoted as it stands; null gives ``-``."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
        tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        key = ",".join(reversed(host.split("."))) + ")" + tail if host else url
    except ValueError:
        key = url
    return quote(key.encode("utf-8", "replace"), safe=KEEP)


def stamp(page_id: int | None) -> str:
    """Sorts like the id, null first."""
    return "-" if page_id is None else f"{page_id + (1 << 63):020d}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 4) -> tuple[bytes, str]:
    """One gzip member: a response with its payload, or a revisit that names the response's record."""
    digest = sha1_base32(payload)
    uri = quote((url or "").encode("utf-8", "replace"), safe=KEEP)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "null" if page_id is None else str(page_id)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", CAPTURED.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{'null' if refers_to is None else refers_to}>")]
    return _member(headers, http if revisit else http + payload, level), digest


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member; a payload that doesn't match its digest is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and f"sha1:{sha1_base32(payload)}" != headers["WARC-Payload-Digest"]:
        raise ValueError(f"digest of {headers['WARC-Record-ID']} does not match its payload")
    return headers, payload


def _page_of(name: str) -> int | None:
    name = name.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def write_archive(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = common.BROADCAST_ROWS) -> DataFrame:
    """Write every page as a WARC record and return its capture (urlkey, stamp, page_id, file, start,
    length, digest).

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the smallest id is
    written in full and the others as revisits of it; repeated rows that share that id are all written
    in full. Null html is an empty payload. Null ids sort after others and null urls get the key ``-``.
    No html is shuffled: the table of repeated digests is broadcast up to ``most_broadcast`` rows of 40 bytes,
    and above that digests alone are joined and the rows look their answers up in side files.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    columns = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")]
    digest = F.unhex(F.sha1(payload)).alias("dg")
    rows = pages.select(*columns, digest)
    long_enough = rows.filter(F.octet_length("payload") >= min_revisit_bytes)
    again = common.save(long_enough.groupBy("dg").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("dg", "first", F.lit(True).alias("again"), "n"), "warc-repeats")
    found, copies = again.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if found <= most_broadcast:
        todo = rows.join(F.broadcast(again), "dg", "left")
    else:
        pages = common.as_scan(pages)
        placed = common.join_hot(common.scan_rows(pages, [digest]), again, ["dg"], "n", copies)
        todo = common.attach(pages, placed, {"first": T.LongType(), "again": T.BooleanType()}, "warc-repeats", columns)
    todo = todo.select("id", "url", "payload", "first", (F.coalesce("again", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))
    base = common.scratch_path(spark, "warc")

    def write(batches):
        fs, root = open_fs(base)
        fs.create_dir(root, recursive=True)
        out = name = None
        at = 0
        for batch in common.slices(batches):
            found = []
            for page_id, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data, digest = record_bytes(page_id, url, payload, first, revisit)
                out.write(data)
                found.append((url_key(url), stamp(page_id), page_id, f"{base}/{name}", at, len(data), digest))
                at += len(data)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), [pa.string()] * 2 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()])], names=["urlkey", "stamp", "page_id", "file", "start", "length", "digest"])
        if out is not None:
            out.close()

    return common.save(todo.mapInArrow(write, CAPTURE), "captures")


@dataclass(frozen=True)
class Index:
    """Top level: for each part its first key, block file and directory file, in key order."""

    parts: tuple[tuple[str, str, str], ...]


def _line_key(line: bytes) -> bytes:
    return b" ".join(line.split(b" ", 2)[:2])


def build_index(captures: DataFrame, lines: int = BLOCK_LINES, parts: int | None = None) -> Index:
    """Sorted CDX lines in gzip blocks of ``lines`` lines, with a sparse directory. An empty table gives
    an index of no parts. A host or URL with very many captures spreads over blocks and parts, since the
    sort key ends with the capture stamp."""
    spark = captures.sparkSession
    base = common.scratch_path(spark, "cdx")
    n = parts or common.bucket_count(captures.count(), 250_000)

    def write(batches):
        fs, root = open_fs(base)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        held: list[bytes] = []
        directory: list[bytes] = []
        out, at, first = None, 0, None

        def flush() -> None:
            nonlocal at, held
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = z.compress(b"\n".join(held)) + z.flush()
            out.write(data)
            directory.append(b"%s\t%d\t%d" % (_line_key(held[0]), at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for key, st, page_id, file, start, length, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, first = fs.open_output_stream(f"{root}/{name}.cdx.gz", compression=None), f"{key} {st}"
                held.append(f"{key} {st} ".encode() + json.dumps({"page": page_id, "digest": digest, "offset": start, "length": length, "filename": file}).encode())
                if len(held) == lines:
                    flush()
        if out is None:
            return
        if held:
            flush()
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
            f.write(b"\n".join(directory))
        yield pa.RecordBatch.from_pydict({"first": [first], "blocks": [f"{base}/{name}.cdx.gz"], "directory": [f"{base}/{name}.idx"]})

    ordered = captures.repartitionByRange(n, "urlkey", "stamp").sortWithinPartitions("urlkey", "stamp")
    top = common.save(ordered.mapInArrow(write, "first string, blocks string, directory string"), "cdx-top")
    return Index(tuple(sorted((r["first"], r["blocks"], r["directory"]) for r in top.collect())))


class Searcher:
    """Binary search in an index; keeps the last directory and block it read."""

    def __init__(self, index: Index) -> None:
        self.parts = index.parts
        self.firsts = [p[0].encode() for p in index.parts]
        self.directory: tuple[str, list[bytes], list[tuple[int, int]]] = ("", [], [])
        self.block: tuple[str, int, list[bytes], list[bytes]] = ("", -1, [], [])

    def _directory(self, part: int) -> tuple[list[bytes], list[tuple[int, int]]]:
        path = self.parts[part][2]
        if self.directory[0] != path:
            fs, root = open_fs(path)
            rows = [x.rsplit(b"\t", 2) for x in fs.open_input_stream(root, compression=None).read().split(b"\n")]
            self.directory = (path, [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows])
        return self.directory[1:]

    def _block(self, part: int, k: int) -> tuple[list[bytes], list[bytes]]:
        path = self.parts[part][1]
        if self.block[:2] != (path, k):
            fs, root = open_fs(path)
            start, length = self._directory(part)[1][k]
            with fs.open_input_file(root) as f:
                lines = zlib.decompress(f.read_at(length, start), 31).split(b"\n")
            self.block = (path, k, lines, [_line_key(x) for x in lines])
        return self.block[2:]

    def find(self, key: bytes):
        """Every capture line whose ``urlkey stamp`` is key."""
        part = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while part < len(self.parts) and self.firsts[part] <= key:
            firsts, _ = self._directory(part)
            k = max(0, bisect.bisect_left(firsts, key) - 1)
            while k < len(firsts) and firsts[k] <= key:
                lines, keys = self._block(part, k)
                i = bisect.bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    yield json.loads(lines[i].split(b" ", 2)[2])
                    i += 1
                k += 1
            part += 1


def capture_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The distinct (urlkey, stamp) to look up for pages."""

    def keys(batches):
        for batch in batches:
            ids, urls = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in urls], pa.string()), pa.array([stamp(i) for i in ids], pa.string())], names=["urlkey", "stamp"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")).mapInArrow(keys, "urlkey string, stamp string").distinct()


def lookup(index: Index, keys: DataFrame) -> DataFrame:
    """Captures of keys (urlkey, stamp): sorted keys go by range to tasks, so that neighbours share a
    block. Keys that the index lacks give no row."""
    n = max(1, len(index.parts))

    def find(batches):
        searcher = Searcher(index)
        for batch in batches:
            found = [(k, s, x["page"], x["filename"], x["offset"], x["length"], x["digest"]) for k, s in zip(*(c.to_pylist() for c in batch.columns)) for x in searcher.find(f"{k} {s}".encode())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), [pa.string()] * 2 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()])], names=["urlkey", "stamp", "page_id", "file", "start", "length", "digest"])

    return keys.select("urlkey", "stamp").repartitionByRange(n, "urlkey", "stamp").sortWithinPartitions("urlkey", "stamp").mapInArrow(find, CAPTURE)


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """Fetch captured records by range reads, in file order: rows go to tasks by (file, 32 MB stretch),
    so that one task reads a stretch from front to back. Payload sizes and digests of responses are
    taken from the payload itself; a revisit has only headers to tell them."""
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def read(batches):
        path, f, base, held = None, None, 0, b""
        for batch in batches:
            rows = []
            for key, st, file, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != path:
                    if f is not None:
                        f.close()
                    fs, root = open_fs(file)
                    path, f, base, held = file, fs.open_input_file(root), 0, b""
                if not base <= start <= start + length <= base + len(held):
                    base, held = start, f.read_at(max(length, READ_AHEAD), start)
                headers, payload = parse_record(held[start - base : start - base + length])
                kind = headers["WARC-Type"]
                size = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                refers = _page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
                rows.append((_page_of(headers["WARC-Record-ID"]), key, st, size, headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, refers, *[payload] * with_payload))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
        if f is not None:
            f.close()

    stretch = F.floor(F.col("start") / (32 << 20))
    dealt = captures.select("urlkey", "stamp", "file", "start", "length").repartition("file", stretch).sortWithinPartitions("file", "start")
    return dealt.mapInArrow(read, schema)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages to WARC, index them, look every page up by URL and read its record back."""
    index = build_index(write_archive(pages, min_revisit_bytes))
    found = common.save(lookup(index, capture_keys(pages)), "warc-found")
    return read_records(found)
