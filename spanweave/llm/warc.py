"""WARC archives: deduplicating writer and salvage reader (operator 5).

The writer turns pages into response records, or, where an equal payload of at least ``min_revisit``
bytes has a smaller page_id, into revisit records that carry headers alone. Every record is a gzip
member of its own; archives roll over at ``ROLL_BYTES`` and lie in the shared folder. Each task names
its files afresh and only the files that successful tasks report are read, so retried or doubled
tasks do no harm.

The reader checks each member and record (gzip trailer, framing, length, block digest). After a failed
check it searches for the next valid member or version line, goes on from there, and logs the bytes
between as a quarantined gap. Inside a member it goes on at the next version line too and logs the gap by
offset within the member's content. Of a damaged member, what can be inflated is read; there only records
whose digest is right count, as the trailer vouches for nothing. Compressed and plain archives and mixtures
of both are read. An archive is one task's work and is read in blocks, so a task holds a block and the
member or record at hand; the list of archives stays a table.

Payloads are equal if their SHA-1 digests are, as revisit records say it. Of equal ones the smallest page_id is
an aggregate joined back on unique digests, so adaptive execution can split the rows of a common payload, the
empty one for instance. A record that is not compressed and whose header exceeds ``BLOCK`` bytes is quarantined.

Defined results: a null page is an empty payload; a null page_id is larger than all others and never
referred to while another has the payload; repeated rows each have their record, of one smallest
page_id all are responses; an empty table gives no archives and an empty result; control characters of
a url are percent-encoded; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpoint, checkpoint_dir, drop_at_exit, slices

ROLL_BYTES = 16 << 20
LAST = (1 << 63) - 1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, BLOCK = 1 << 16, 1 << 20
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"(?im)^Content-Length[ \t]*:[ \t]*([0-9]{1,18})[ \t]*\r$")
HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")
RECORDS = "file string, start long, stop long, problem string, record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit, without the payload, if it refers to another page."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}"}
    if refers_to is None:
        block += payload
    else:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    fields |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(data: bytes, at: int, digest: bool = False) -> tuple[int, dict | None, str]:
    """The record at ``at``: its end, its parts, or what is wrong with it; with ``digest``, having none is wrong."""
    head = HEAD.match(data, at)
    if head is None:
        return at, None, "no header"
    lines = [x.partition(":") for x in head[1].decode("utf-8", "replace").split("\r\n") if x]
    fields = {k.strip().lower(): v.strip() for k, _, v in lines}
    # a header that breaks off and runs into the next has a line that is no field, or fields twice
    if not all(colon for _, colon, _ in lines) or len({k.strip().lower() for k, _, _ in lines} - {"warc-concurrent-to"}) < sum(k.strip().lower() != "warc-concurrent-to" for k, _, _ in lines):
        return at, None, "broken header"
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        return at, None, "no length"
    stop = head.end() + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return at, None, "wrong length"
    block = data[head.end() : stop]
    if (said := fields.get("warc-block-digest", "")).lower().startswith("sha1:"):
        if said[5:] != base32_sha1(block):
            return at, None, "wrong block digest"
        digest = False
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    found = {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri")}
    said = fields.get("warc-payload-digest", "")
    if found["record_type"] == "revisit":
        length = re.search(rb"(?im)^Content-Length:[ \t]*([0-9]{1,18})", http)
        found |= {"payload": None, "payload_bytes": int(length[1]) if length else None, "payload_digest": said[5:] or None}
    else:
        found |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": base32_sha1(payload)}
        if said.lower().startswith("sha1:"):
            if said[5:] != found["payload_digest"]:
                return at, None, "wrong payload digest"
            digest = False
    if digest:
        return at, None, "no digest in a damaged member"
    return stop + 4, found, ""


class Archive:
    """The bytes of an open file by offset, read in blocks as they are asked for; of a bytes object, itself."""

    def __init__(self, file: pa.NativeFile | bytes):
        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        self.size, self.base, self.held = self.file.size(), 0, b""

    def part(self, at: int, stop: int) -> bytes:
        stop = min(stop, self.size)
        if at < self.base or stop > self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(BLOCK, stop - at))
        return self.held[at - self.base : stop - self.base]

    def startswith(self, prefix: bytes, at: int) -> bool:
        return self.part(at, at + len(prefix)) == prefix

    def next_start(self, at: int) -> int:
        """Where the next member or version line may begin, or the end."""
        while at < self.size:
            if m := START.search(self.part(at, at + BLOCK)):
                return at + m.start()
            at += BLOCK - 16  # a version line may lie across blocks
        return self.size

    def record(self, at: int) -> tuple[int, dict | None, str]:
        """The plain record at ``at``, as ``parse_record`` has it; only what its length says is read."""
        window = self.part(at, at + BLOCK)
        head = HEAD.match(window)
        length = LENGTH.search(window, 0, head.end()) if head else None
        stop = at + head.end() + int(length[1]) + 4 if length else at + len(window)
        if length and not self.startswith(b"\r\n\r\n", stop - 4):
            return at, None, "wrong length"
        end, parts, problem = parse_record(self.part(at, stop), 0)
        return at + end, parts, problem


def inflate(data: Archive, start: int) -> tuple[int, bytes, bool]:
    """The gzip member at ``start``: its end, its content and whether it is sound; of a damaged one where inflating ends and what comes before."""
    z, out, at = zlib.decompressobj(31), [], start
    try:
        while not z.eof and at < data.size:
            out.append(z.decompress(data.part(at, at + CHUNK)))
            at = min(at + CHUNK, data.size)
    except zlib.error:
        # the chunk's content before the error is lost with it, so it is read again by single bytes
        z = zlib.decompressobj(31)
        for k in range(start, at, CHUNK):
            z.decompress(data.part(k, k + CHUNK))
        try:
            while True:
                out.append(z.decompress(data.part(at, at + 1)))
                at += 1
        except zlib.error:
            return at, b"".join(out), False
    return (at - len(z.unused_data) if z.eof else at), b"".join(out), z.eof


def inflated_from(data: Archive, start: int, length: int) -> int:
    """The end of the bytes that the first ``length`` bytes of a member's content are inflated from."""
    z, at, n, step = zlib.decompressobj(31), start, 0, CHUNK
    while n < length:
        before = z.copy() if step > 1 else z
        try:
            got = len(z.decompress(data.part(at, at + step)))
        except zlib.error:  # what is wrong comes after these bytes
            got = length
        if step > 1 and n + got >= length:
            z, step = before, 1
        else:
            n, at = n + got, at + step
    return at


def member_records(content: bytes, sound: bool = True) -> tuple[list[dict], int]:
    """The records of a member's content and its gaps, ``problem`` set, and the end of the last record."""
    found, at, last, why = [], 0, 0, ""

    def lost(stop: int) -> list[dict]:
        return [{"problem": f"{why}, bytes {last} to {stop} of the member's content"}] if stop > last else []

    while at < len(content):
        stop, parts, problem = parse_record(content, at, not sound)
        if parts is None:
            why = why or problem
            following = VERSION.search(content, at + 1)
            at = following.start() if following else len(content)
            continue
        found += [*lost(at), {"problem": None} | parts]
        at, last, why = stop, stop, ""
    return (found + lost(at) if sound else found), last


def salvage(archive: pa.NativeFile | bytes) -> Iterator[dict]:
    """Every valid record of an archive with its byte range, and a gap (``problem`` set) for every range given up or read in part."""
    data, at, gap, why = Archive(archive), 0, None, ""
    held: list[dict] = []  # what a damaged member at ``gap`` still gives; its range ends where the next sound part begins

    def close(stop: int) -> Iterator[dict]:
        yield from ({"start": gap, "stop": stop} | r for r in [*held, {"problem": why}])

    while at < data.size:
        rows: list[dict] = []
        stop, problem, onward = at, "no record", at + 1
        if data.startswith(MAGIC, at):
            end, content, sound = inflate(data, at)
            rows, last = member_records(content, sound)
            if sound:
                stop = end
            else:
                problem = "damaged member"
                if rows:
                    if gap is not None:
                        yield from close(at)
                    # bytes that right records are inflated from hold no other member
                    gap, held, why = at, rows, f"{problem}, lost from byte {last} of its content"
                    onward = max(onward, inflated_from(data, at, last))
        elif data.startswith(b"WARC/", at):
            end, parts, problem = data.record(at)
            if parts is not None:
                rows, stop = [{"problem": None} | parts], end
        if stop == at:
            gap, why = (at, problem) if gap is None else (gap, why)
            at = data.next_start(onward)
            continue
        if gap is not None:
            yield from close(at)
            gap, held = None, []
        for r in rows:
            yield {"start": at, "stop": stop} | r
        at = stop
    if gap is not None:
        yield from close(data.size)


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.fullmatch("(?:file:)?(?://)?(/.*)", uri)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` into new files of ``folder``; the files: path, bytes, records."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    each = bounded(pages).select(doc.alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    shared = each.where(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when((F.length("payload") >= min_revisit) & (F.col("first") < F.col("page")), F.col("first"))
    rows = each.join(checkpoint(shared), "digest", "left").select("page", "url", "payload", refers.alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int, int]] = []
        out = None
        try:
            for batch in slices(batches):
                for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    raw = member(record(None if page == LAST else page, url, html, first))
                    out.write(raw)
                    size, n = size + len(raw), n + 1
                    if size >= ROLL_BYTES:
                        out.close()
                        files.append((f"{folder}/{name}", size, n))
                        out = None
        finally:
            if out is not None:
                out.close()
                files.append((f"{folder}/{name}", size, n))
        paths, sizes, counts = zip(*files, strict=True) if files else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "bytes", "records"])

    return checkpoint(rows.mapInArrow(write, "path string, bytes long, records long"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives in column path; a gap has ``problem`` set and only file, start and stop besides."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = _file_system(name)
                rows: list[dict] = []
                with store.open_input_file(path) as file:
                    for r in salvage(file):
                        rows.append(r | {"file": name} | ({} if payloads else {"payload": None}))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = archives.sparkSession.createDataFrame([], RECORDS).toArrow().schema
    return archives.select("path").mapInArrow(read, RECORDS)


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: file, start, stop and problem of the byte ranges given up."""
    return found.where("problem is not null").select("file", "start", "stop", "problem")


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to as read back from archives of ``pages``."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(pages, folder, min_revisit)  # checkpointed: the list of what successful tasks wrote, as a commit would have it
    if not files.isEmpty():
        drop_at_exit(spark, folder)
    found = read_archives(files, payloads=False).where("problem is null")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
