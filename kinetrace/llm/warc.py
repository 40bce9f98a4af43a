"""WARC archives: a writer with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, new_path, small_batches, stash, table

VERSION, GZIP, BLOCK = b"WARC/1.1", b"\x1f\x8b\x08", 1 << 16
#: A file is closed once it holds so many bytes.
FILE_BYTES = 8 << 20
#: No cell of a table holds more: a member that unpacks to more is quarantined before it fills the memory.
MOST_BYTES = (1 << 31) - 1
FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r?\n")


@dataclass
class Found:
    """A record (reason is empty) or a quarantined gap of bytes, and where it lies in its file."""

    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    reason: str = ""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """One uncompressed record; its length and block digest are filled in."""
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: sha1:{sha1_base32(payload)}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(Exception):
    pass


def parse(data: bytes, whole: bool) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and length of the record at the start of data; whole: data is no more than it. Checks all that can be checked."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        raise Damaged("no version line or no end of headers")
    line, _, rest = data[: end + 2].partition(b"\r\n")
    headers, at = {}, 0
    for m in FIELD.finditer(rest):
        if m.start() != at:
            break
        headers[m[1].decode("latin-1")] = m[2].decode("utf-8", "replace")
        at = m.end()
    if at != len(rest) or not re.fullmatch(rb"WARC/1\.[01]", line):
        raise Damaged("malformed headers")
    try:
        n = int(headers["Content-Length"])
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    stop = end + 4 + n
    if n < 0 or data[stop : stop + 4] != b"\r\n\r\n" or whole and len(data) != stop + 4:
        raise Damaged("content length doesn't fit")
    payload = data[end + 4 : stop]
    if (want := headers.get("WARC-Block-Digest", "")).startswith("sha1:") and want[5:] != sha1_base32(payload):
        raise Damaged("block digest differs")
    return headers, payload, stop + 4


def inflate(read: Callable[[int, int], bytes], offset: int) -> tuple[bytes, int]:
    """The data of the gzip member at offset and the member's length; its checksum is checked."""
    unpack, parts, at, size = zlib.decompressobj(31), [], offset, 0
    while not unpack.eof:
        block = read(at, BLOCK)
        if not block:
            raise Damaged("member is cut off")
        rest = block
        while rest and not unpack.eof:
            try:
                parts.append(unpack.decompress(rest, 16 * BLOCK))
            except zlib.error as e:
                raise Damaged(f"bad member: {e}") from None
            rest = unpack.unconsumed_tail
            size += len(parts[-1])
            if size > MOST_BYTES:
                raise Damaged("member unpacks to more than a cell can hold")
        at += len(block)
    return b"".join(parts), at - len(unpack.unused_data) - offset


def plain(read: Callable[[int, int], bytes], offset: int, size: int) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at offset: reads its headers, then as much as they state."""
    head = b""
    while (end := head.find(b"\r\n\r\n")) < 0 and len(head) < 1 << 20:
        block = read(offset + len(head), BLOCK)
        if not block:
            break
        head += block
    m = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", head[: max(end, 0) + 2], re.I)
    if not m:
        raise Damaged("no version line or no end of headers")
    need = end + 8 + int(m[1])
    if offset + need > size:
        raise Damaged("content length doesn't fit")
    return parse(head[:need] if len(head) >= need else head + read(offset + len(head), need - len(head)), False)


def next_sign(read: Callable[[int, int], bytes], offset: int, size: int) -> int:
    """The next place at or after offset where a member or a version line may start; size if there is none."""
    at = offset
    while at < size:
        block = read(at, BLOCK + 8)
        found = [i for i in (block.find(GZIP), block.find(b"WARC/1.")) if i >= 0]
        if found:
            return at + min(found)
        at += BLOCK
    return size


def salvage(read: Callable[[int, int], bytes], size: int) -> Iterator[Found]:
    """All records of a file, and a gap for every run of bytes that belongs to no valid record.

    After a failed check the search goes on one byte later for the next member or version
    line that holds a valid record.  Only one record and one block are held at a time.
    """
    offset, gap, why = 0, None, ""
    while offset < size:
        try:
            start = read(offset, 8)
            if start.startswith(GZIP):
                data, length = inflate(read, offset)
                headers, payload, _ = parse(data, True)
            elif start.startswith(b"WARC/1."):
                headers, payload, length = plain(read, offset, size)
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged as e:
            if gap is None:
                gap, why = offset, str(e)
            offset = next_sign(read, offset + 1, size)
            continue
        if gap is not None:
            yield Found(gap, offset - gap, reason=why)
            gap = None
        yield Found(offset, length, headers, payload)
        offset += length
    if gap is not None:
        yield Found(gap, size - gap, reason=why)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write a gzip member per page into files under folder; returns (path, bytes, records) of the files that count.

    Of equal payloads, the page with the largest page_id is a response, the others revisit it.
    A null html is an empty payload.  Rows that repeat the largest page_id are all responses;
    a page without an id is a response only if none of its payload has one.  Columns other than
    page_id, url and html are left out; an empty table writes no files.  A file's name
    has its attempt in it and the caller reads the files named here only, so that what a
    lost or repeated task has left does no harm.
    """
    small_batches(pages.sparkSession, 200)
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("key", F.sha1("payload"))
    last = p.groupBy("key").agg(F.max("page_id").alias("last_id"))
    p = p.join(fresh(last), "key").select("page_id", "url", "payload", "last_id")

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, out, size, records = "", None, 0, 0
        for b in batches:
            for page_id, url, payload, last_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                revisit = page_id != last_id
                headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": re.sub(r"\s+", "%20", url or "about:blank"), "Content-Type": "text/html; charset=utf-8", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Payload-Length": str(len(payload))}
                if revisit:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{last_id}>"}
                data = member(record(headers, b"" if revisit else payload))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [records]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [records]})

    return stash(p.mapInArrow(run, "path string, bytes long, records long").withColumn("folder", F.lit(folder)), "manifest")


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and gaps of the files (path, folder): path, offset, length, kind, reason, headers, payload_bytes, payload_digest, payload.

    kind is record or gap.  Digest and length are those of the payload as read; a file that
    can't be opened fails the task.  Without payloads, that column is null.
    """
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "path string, offset long, length long, kind string, reason string, headers map<string,string>, payload_bytes long, payload_digest string, payload binary"
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def batch(path: str, found: list[Found]) -> pa.RecordBatch:
        rows = [(path, f.offset, f.length, "gap" if f.reason else "record", f.reason or None, list(f.headers.items()), None if f.reason else len(f.payload), None if f.reason else sha1_base32(f.payload), f.payload if payloads else None) for f in found]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for path, folder in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with filesystem(folder)[0].open_input_file(path) as f:
                    held, size = [], 0
                    for x in salvage(lambda at, n: f.read_at(n, at), f.size()):  # noqa: B023
                        held.append(x)
                        size += len(x.payload) * payloads + 500
                        if size > 1 << 20:
                            yield batch(path, held)
                            held, size = [], 0
                    if held:
                        yield batch(path, held)

    return files.select("path", "folder").repartition(parts).mapInArrow(run, schema)


def recover(files: DataFrame, name: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the files of a manifest, each read once: gaps are the quarantine log, a stored table of
    path, offset, length and reason of all bytes that no valid record holds."""
    found = stash(read_archives(files, payloads=False), name, "zstd")
    return found.where("kind = 'record'"), found.where("kind = 'gap'").select("path", "offset", "length", "reason")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages as WARC, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row for each page; see write_pages for odd rows.  If any record that was written isn't read
    back the query fails and names the damage, so that no page goes missing unseen.
    """
    files = write_pages(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    r, gaps = recover(files)
    written, read, lost = files.agg(F.sum("records")).first()[0] or 0, r.count(), gaps.count()
    if written != read or lost:
        raise RuntimeError(f"{written} records were written and {read} read; {lost} gaps, such as {gaps.head(3)}")
    h = lambda name: F.col("headers")[name]
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")
    revisit = h("WARC-Type") == "revisit"
    return r.select(
        page(h("WARC-Record-ID")).alias("page_id"),
        F.when(revisit, h("WARC-Payload-Length").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring(h("WARC-Payload-Digest"), 6, 32)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        h("WARC-Type").alias("record_type"),
        F.when(revisit, page(h("WARC-Refers-To"))).alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM d
"""
