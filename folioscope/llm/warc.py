"""Operator 3: WARC records in ZIP-packaged archives.

Writing: records go to gzip members of a WARC file, which lies stored (uncompressed) in a ZIP archive beside a CDX
index of their places; each task writes archives of its own of about `archive_bytes` in the shared folder, through
PyArrow's file systems. Names are new in each attempt, and only finished attempts enter the manifest, so a lost
executor leaves nothing behind that counts.

Reading: of an archive only its end is read first, for the end record, the ZIP64 locator and record, and the
central directory. Stored members are located by their local headers, the index is read by range, and each record is
read by range and parsed. Nothing is extracted.

A record whose payload was stored with a larger page_id becomes a revisit: it has the HTTP headers, no payload. Digests are
grouped with pre-aggregation; pages whose payload over one in `common.HOT` pages has get its largest page_id by a broadcast of these few
digests, the others by a join in which no key has more rows, so a payload that a third of all pages share makes no hot task.

What `round_trip` returns about a payload comes from payloads that were read: a response's digest and size are computed anew, a
revisit's are those of the response it refers to. A record that doesn't hold what its headers say, or a revisit without its response, raises ValueError.
Rows that share the largest page_id of a payload (repeated rows) are all responses. Null html is an empty payload, a null url an
empty one; a null page_id counts as the least. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES = 64 << 20
WARC_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdx"
#: An end record has a comment of at most 65,535 bytes.
TAIL = 22 + 65_535 + 20
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not yet compressed."""
    target = urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {_DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse_record(data: bytes) -> Record:
    """A record's headers, its HTTP headers and its payload; ValueError if it's cut or has another form."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, headers = _headers(head)
    if not sep or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("a WARC record is cut")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return Record(headers, _headers(http)[1], payload)


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored: int
    header: int


def zip_members(file) -> list[Member]:
    """The central directory of a seekable file, with its ZIP64 parts. Only the directory and the end are read."""
    file.seek(0, 2)
    size = file.tell()
    start = max(0, size - TAIL)
    file.seek(start)
    tail = file.read(size - start)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end record of a ZIP archive")
    count, length, offset = struct.unpack("<HLL", tail[at + 10 : at + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
        if tail[at - 20 : at - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        file.seek(int.from_bytes(tail[at - 12 : at - 4], "little"))
        end = file.read(56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack("<QQQ", end[32:56])
    file.seek(offset)
    directory, out, at = file.read(length), [], 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        stored, full, n, extra, comment = struct.unpack("<LLHHH", directory[at + 20 : at + 34])
        header = int.from_bytes(directory[at + 42 : at + 46], "little")
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        fields, p = directory[at + 46 + n : at + 46 + n + extra], 0
        while p + 4 <= len(fields):
            kind, m = struct.unpack("<HH", fields[p : p + 4])
            if kind == 1:  # the 64-bit values, of those that don't fit, in this order
                wide = iter(struct.unpack(f"<{m // 8}Q", fields[p + 4 : p + 4 + m // 8 * 8]))
                full, stored, header = (next(wide) if x == 0xFFFFFFFF else x for x in (full, stored, header))
            p += 4 + m
        out.append(Member(name, method, full, stored, header))
        at += 46 + n + extra + comment
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; records can't be read by range")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^(file:)?/*", "file:///", path))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (page_id, url, html, sha1, response_id) as archives; the result lists (archive, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple] = []
        current: list = []

        def close() -> None:
            name, out, archive, member, index, _ = current.pop()
            member.close()
            with archive.open(INDEX_NAME, "w") as f:
                f.write("".join(index).encode())
            archive.close()
            size = out.tell()
            out.close()
            done.append((f"{folder}/{name}", len(index), size))

        for batch in batches:
            for part in common.slices(batch, 2):
                ids, urls, sha1s, firsts = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
                for page, url, payload, sha1, first in zip(ids, urls, common.texts_of(part.column(2)), sha1s, firsts, strict=True):
                    if not current:
                        name = f"{uuid.uuid4().hex}.wacz"
                        out = fs.open_output_stream(f"{root}/{name}")
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                        current.append([name, out, archive, archive.open(WARC_NAME, "w", force_zip64=True), [], 0])
                    it = current[0]
                    revisit = page != first
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = squeeze.compress(record(page, url, payload, sha1, first if revisit else None, revisit)) + squeeze.flush()
                    it[3].write(data)
                    it[4].append(f"{it[5]} {len(data)} {sha1}\n")
                    it[5] += len(data)
                    if it[5] >= archive_bytes:
                        close()
        if current:
            close()
        columns = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "bytes"])

    return rows.select("page_id", "url", "html", "sha1", "response_id").mapInArrow(run, "archive string, records long, bytes long")


def read_archives(archives: DataFrame) -> DataFrame:
    """RECORDS of all archives named in `archives` (archive), each record by its own range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as file:
                    members = {m.name: m for m in zip_members(file)}
                    index, data = members[INDEX_NAME], data_start(file, members[WARC_NAME])
                    file.seek(data_start(file, index))
                    places = [x.split() for x in file.read(index.size).decode().splitlines()]
                    for k in range(0, len(places), 1000):
                        rows = []
                        for offset, length, _ in places[k : k + 1000]:
                            file.seek(data + int(offset))
                            r = parse_record(zlib.decompress(file.read(int(length)), 31))
                            kind, sha1 = r.headers["warc-type"], r.headers["warc-payload-digest"].removeprefix("sha1:")
                            size = int(r.http["content-length"])
                            refers = number(r.headers["warc-refers-to"]) if kind == "revisit" else None
                            if kind != "revisit" and (len(r.payload) != size or digest(r.payload) != sha1):
                                raise ValueError(f"{path}: the payload at byte {data + int(offset)} isn't what its record says")
                            rows.append((number(r.headers["warc-record-id"]), r.headers["warc-target-uri"], size, sha1, kind, refers, path, data + int(offset), int(length)))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select("archive").mapInArrow(run, RECORDS)


def _digest_column(html: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 5 bits a character."""
    sha1 = F.sha1(html)
    parts = (F.lpad(F.conv(F.substring(sha1, i, 10), 16, 32), 8, "0") for i in range(1, 41, 10))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_responses(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """rows (page_id, url, html) with sha1 and response_id: the largest page_id of those with the same payload."""
    rows = rows.withColumns({"sha1": _digest_column(F.col("html")), "size": F.octet_length("html")})
    seen = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1")
    seen = common.materialize(seen, "warc-digests")
    hot = F.col("n") > rows.count() / common.HOT
    few = seen.where(hot).select("sha1", "size", F.struct("response_id").alias("few"))
    # rows that have met theirs are dealt out evenly: nothing equals their key
    met = rows.join(F.broadcast(few), ["sha1", "size"], "left").withColumn("key", F.when(F.col("few").isNotNull(), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("sha1")))
    rest = seen.where(~hot).select(F.col("sha1").alias("key"), F.col("size").alias("size_"), F.struct("response_id").alias("rest"))
    found = met.join(rest, [met["key"] == rest["key"], met["size"] == rest["size_"]], "left")
    return found.select("page_id", "url", "html", "sha1", F.coalesce("few.response_id", "rest.response_id", "page_id").alias("response_id"))


def resolved(records: DataFrame) -> DataFrame:
    """RECORDS with each revisit's payload_bytes and payload_digest taken from the response it refers to; ValueError if one has none."""
    records = common.materialize(records, "warc-records")
    revisits = records.where("record_type = 'revisit'")
    pairs = revisits.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("read_bytes")).distinct()
    table = common.materialize(pairs.join(responses, ["refers_to", "payload_digest"]), "warc-responses")
    total, followed = revisits.count(), table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total != followed:
        raise ValueError(f"{total - followed} revisits refer to no response with their payload")
    followed = common.lookup(revisits, table, ["refers_to", "payload_digest"], max(total, 1)).withColumn("payload_bytes", F.col("read_bytes"))
    return records.where("record_type <> 'revisit'").unionByName(followed.select(*records.columns))


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives and read them back: RECORDS. Payloads under `least_bytes` never become revisits."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    made = common.materialize(write_archives(with_responses(rows, least_bytes), common.new_path(spark, "warc")), "warc-manifest")
    return resolved(read_archives(made.repartition(max(1, spark.sparkContext.defaultParallelism))))


def oracle() -> str:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of round_trip() over pages, for DuckDB."""
    nibble = lambda j: f"(instr('0123456789abcdef', substring(h, {j} + 1, 1)) - 1)"
    letter = f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({nibble('i * 5 // 4')} * 16 + {nibble('(i * 5 // 4 + 1)')}) >> (3 - i * 5 % 4)) & 31)::int + 1, 1)"
    other = "page_id is distinct from top"
    return (
        "with d as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages), m as (select h, max(page_id) as top from d group by h)"
        f" select page_id, strlen(t)::bigint as payload_bytes, array_to_string(list_transform(range(32), lambda i: {letter}), '') as payload_digest,"
        f" case when {other} then 'revisit' else 'response' end as record_type, case when {other} then top end as refers_to from d join m using (h)"
    )
