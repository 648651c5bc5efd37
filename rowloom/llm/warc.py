"""WARC archives with a two-level capture index.

Pages are written as gzip records to archive files in shared storage. Their captures,
keyed by reversed-host URL, are range-sorted into shards of compressed blocks; each
shard has a sparse directory of the first capture of each block. A look-up finds the
shard, then the block, by binary search, reads that block's byte range, and with the
capture's offset and length the record's byte range.

Each attempt of a task writes files of new names, and what is read later are the files
that the finished attempts named, so lost executors and repeated tasks leave no gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Scratch, bound_batches, new_path

BLOCK_LINES = 1000
ARCHIVE_BYTES = 256 << 20
#: Archive bytes that one task reads back.
READ_BYTES = 32 << 20
#: Sorts before any page id: the place of a null id.
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "url_key string, page_id long, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: the host reversed, in lower case, without scheme, port and fragment."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").split(".")
    except ValueError:
        return ")" + (url or "")
    return ",".join(reversed(host)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record; a revisit keeps the HTTP headers and drops the payload."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127)))) if url else "about:blank"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", f"application/http; msgtype={'revisit' if revisit else 'response'}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """The row of RECORDS. The payload's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError("payload does not match its digest")
    page, to = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
    return (int(page) if page else None, size, digest, kind, int(to) if to else None, fields["WARC-Target-URI"])


class Store:
    """A folder by URI, with a few files kept open for range reads."""

    def __init__(self, uri: str, most_open: int = 32):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.most_open = most_open

    def create(self, name: str) -> pa.NativeFile:
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.most_open:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        self.open.move_to_end(name)
        return self.open[name].read_at(length, offset)

    def read_all(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return f.read()


def _write_archives(uri: str, date: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, name, at = Store(uri), None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.create(name)
                member = gzip.compress(make_record(page_id, url, (html or "").encode(), refers_to, revisit, date), 6, mtime=0)
                out.write(member)
                rows.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["url_key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return work


def _write_index(uri: str, block_lines: int):
    """Sorted captures of a partition to one shard; yields the shard with its first and last capture."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, out, at, total, size = Store(uri), uuid.uuid4().hex, None, 0, 0, 0
        directory: list[list] = []
        lines: list[str] = []
        first = last = None

        def flush() -> None:
            nonlocal out, at
            out = out or store.create(f"{name}.blocks")
            packed = zlib.compress("\n".join(lines).encode())
            directory.append([*json.loads(lines[0])[:2], at, len(packed)])
            out.write(packed)
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = [row[0], NO_ID if row[1] is None else row[1]]
                first, last, total, size = first or place, place, total + 1, size + row[4]
                lines.append(json.dumps([*place, *row[2:]]))
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with store.create(f"{name}.directory") as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_pydict({"shard": [name], "first_key": [first[0]], "first_id": [first[1]], "last_key": [last[0]], "last_id": [last[1]], "captures": [total], "bytes": [size]})

    return work


@dataclass
class CaptureIndex:
    """Shards in order: name, first and last (key, id). As many as the index had partitions."""

    uri: str
    archives: str
    shards: list[tuple[str, tuple[str, int], tuple[str, int]]]
    #: Bytes of all captured records.
    captured: int = 0


class Reader:
    """Look-ups in an index, on one machine."""

    def __init__(self, index: CaptureIndex, most_kept: int = 4):
        self.index, self.blocks, self.archives = index, Store(index.uri), Store(index.archives)
        self.last = [s[2] for s in index.shards]
        self.directories: OrderedDict[str, list] = OrderedDict()
        self.kept: OrderedDict[tuple, list] = OrderedDict()
        self.most_kept = most_kept

    def _directory(self, shard: str) -> list:
        if shard not in self.directories:
            if len(self.directories) >= self.most_kept:
                self.directories.popitem(last=False)
            rows = json.loads(zlib.decompress(self.blocks.read_all(f"{shard}.directory")))
            self.directories[shard] = [((k, i), at, size) for k, i, at, size in rows]
        self.directories.move_to_end(shard)
        return self.directories[shard]

    def _block(self, shard: str, at: int, size: int) -> list:
        if (shard, at) not in self.kept:
            if len(self.kept) >= self.most_kept:
                self.kept.popitem(last=False)
            rows = [json.loads(x) for x in zlib.decompress(self.blocks.read(f"{shard}.blocks", at, size)).decode().split("\n")]
            self.kept[shard, at] = [((r[0], r[1]), *r[2:]) for r in rows]
        self.kept.move_to_end((shard, at))
        return self.kept[shard, at]

    def captures(self, key: str, page_id: int | None = None, any_id: bool = False) -> Iterator[tuple]:
        """((key, id), file, offset, length) of captures of a key, or of one page of it."""
        low = (key, NO_ID if any_id or page_id is None else page_id)
        high = (key, (1 << 63) - 1 if any_id else low[1])
        for shard, first, _ in self.index.shards[bisect_left(self.last, low) :]:
            if first > high:
                break
            directory = self._directory(shard)
            firsts = [d[0] for d in directory]
            for _, at, size in directory[max(0, bisect_left(firsts, low) - 1) : bisect_right(firsts, high)]:
                block = self._block(shard, at, size)
                places = [b[0] for b in block]
                yield from block[bisect_left(places, low) : bisect_right(places, high)]

    def record(self, capture: tuple) -> tuple:
        return parse_record(gzip.decompress(self.archives.read(*capture[1:4])))


def write_archives(pages: DataFrame, uri: str, scratch: Scratch, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns the captures.

    Of rows with equal payloads of ``least_bytes`` or more the largest page_id is the
    response (all rows of that id are), the others revisit it. Rows with only null ids
    stay responses; a null id beside others revisits.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    keyed = read.withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.octet_length("html"))
    # Written first, so that the join knows its size: small, it is broadcast and no page is shuffled.
    chosen = scratch.keep(keyed.where(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1 AND chosen IS NOT NULL").drop("n"))
    revisit = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen"))
    rows = keyed.join(chosen, ["digest", "n_bytes"], "left").select("page_id", "url", "html", F.when(revisit, F.col("chosen")).alias("refers_to"), revisit.alias("revisit"))
    return scratch.keep(rows.mapInArrow(_write_archives(uri, date), CAPTURES))


def build_index(captures: DataFrame, uri: str, archives: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorts captures by (key, id) into shards; ids part the captures of a key that many pages have."""
    order = F.col("url_key"), F.col("page_id").asc_nulls_first()
    ranged = captures.repartitionByRange(*order, F.col("file"), F.col("offset")).sortWithinPartitions(*order)
    # One row per shard: as many as shuffle partitions.
    rows = ranged.mapInArrow(_write_index(uri, block_lines), "shard string, first_key string, first_id long, last_key string, last_id long, captures long, bytes long").collect()
    shards = sorted(((r.shard, (r.first_key, r.first_id), (r.last_key, r.last_id)) for r in rows), key=lambda s: s[1:])
    return CaptureIndex(uri, archives, shards, sum(r.bytes for r in rows))


def read_back(queries: DataFrame, index: CaptureIndex) -> DataFrame:
    """Records of the captures of distinct ``queries`` (url, page_id), found by the index."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["url_key", "page_id"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            rows = [reader.record(c) for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in reader.captures(key, page)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    asked = queries.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(keys, "url_key string, page_id long").distinct()
    order = F.col("url_key"), F.col("page_id").asc_nulls_first()
    # By the records' bytes, not those of the keys, and at least one task a core.
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-index.captured // READ_BYTES))
    return asked.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(look_up, RECORDS)


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, uri: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives with an index under ``uri`` (by default in the shared folder) and reads every page back through it.

    One row per row of ``pages``; null html is an empty payload, null urls and ids have a
    key of their own. Other columns are not read. No pages: no archives and no rows.
    """
    bound_batches(spark)
    scratch = Scratch(spark, "warc")
    root = uri or new_path(spark, "archive")
    captures = write_archives(pages, f"{root}/archives", scratch, least_bytes)
    index = build_index(captures, f"{root}/index", f"{root}/archives")
    return read_back(pages, index)
