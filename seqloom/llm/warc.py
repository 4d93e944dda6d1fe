"""WARC records in ZIP archives (operator 3).

An archive is a ZIP file with two stored members: archive/data.warc.gz, each record a gzip member of its own, and
indexes/index.cdxj, a line for each record with its place. The reader finds the end record, the ZIP64 one if there is
one, and the central directory, then a member's data behind its local header; from there on each record is one range
read: nothing is extracted.

Of records with equal payloads of at least `least` bytes, that with the smallest id is a response and the others are
revisits that name it: they hold the HTTP header with the payload's length, and its digest, but no payload.

Archives go to a shared folder through pyarrow's file systems (file, hdfs, s3, gs). Each attempt of a task writes files
of its own; only those that a finished task reports are read.

Defined results: a null html is an empty payload, always a response; rows that repeat the smallest id are all responses;
a null id is a revisit where its payload is another's, else a response; an empty table gives no archive and no row.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized, new_path, partitions, salts_of

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
Read = Callable[[int, int], bytes]


def warc_record(page_id: str | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (b"" if refers_to is not None else payload)
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """type, id, refers_to, digest and length as the record says, and its payload (None of a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    urn = lambda x: x[len("<urn:page:") : -1] or None
    return {"type": fields["WARC-Type"], "id": urn(fields["WARC-Record-ID"]), "refers_to": urn(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "length": length, "url": fields.get("WARC-Target-URI", ""), "payload": payload if fields["WARC-Type"] == "response" else None}


def build_archive(records: Iterable[tuple[str | None, bytes]]) -> bytes:
    data, index = io.BytesIO(), []
    for key, raw in records:
        start = data.tell()
        data.write(gzip.compress(raw, 1, mtime=0))
        index.append(json.dumps({"id": key, "offset": start, "length": data.tell() - start}))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(DATA, data.getvalue())
        z.writestr(INDEX, "\n".join(index))
    return out.getvalue()


def members(read: Read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Name to method, CRC, start of the data and its length, from the central directory. read(offset, length)."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        place = tail_at + at - 20
        locator = read(place, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        crc, packed, full, names, extras, comments = struct.unpack("<IIIHHH", directory[at + 16 : at + 34])
        local = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[k : k + 4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + n
        head = read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n, m = struct.unpack("<HH", head[26:30])
        found[name] = method, crc, local + 30 + n + m, packed
        at += 46 + names + extras + comments
    return found


def read_records(read: Read, size: int) -> Iterator[dict]:
    """The archive's records, each by a range read at the place that the index gives."""
    found = members(read, size)
    for name in (DATA, INDEX):
        if name not in found or found[name][0] != zipfile.ZIP_STORED:
            raise ValueError(f"{name} isn't there as a stored member")
    _, crc, start, length = found[INDEX]
    lines = read(start, length)
    if zlib.crc32(lines) != crc:
        raise ValueError("the index is damaged")
    _, _, base, limit = found[DATA]
    for line in lines.decode().splitlines():
        place = json.loads(line)
        if place["offset"] + place["length"] > limit:
            raise ValueError("the index points outside of the data")
        yield parse_record(gzip.decompress(read(base + place["offset"], place["length"])))


def with_first(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = 100) -> DataFrame:
    """_id, _url, _payload, _digest and _first: the smallest id with that payload, null where only one row has it or it
    is short. A payload's rows are dealt over as many salts as a shuffle has tasks; its first id is found from one row
    a salt."""
    salts = salts_of(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("_payload"))
    rows = rows.withColumn("_digest", F.sha2("_payload", 256)).withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(salts)))
    seen = rows.where(F.octet_length("_payload") >= least).groupBy("_digest", "_salt").agg(F.min("_id").alias("first"), F.count("*").alias("n"))
    firsts = seen.groupBy("_digest").agg(F.min("first").alias("_first"), F.sum("n").alias("n"), F.collect_list("_salt").alias("s")).where("n > 1")
    return rows.join(firsts.select("_digest", "_first", F.explode("s").alias("_salt")), ["_digest", "_salt"], "left").drop("_salt")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows(_id, _url, _payload, _digest, _first) as archives; a row (path, size) for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = fs.FileSystem.from_uri(folder)
        to.create_dir(base, recursive=True)
        pending: list[tuple[str | None, bytes]] = []
        held = 0

        def close() -> pa.RecordBatch:
            path, data = f"{base}/{uuid.uuid4().hex}.wacz", build_archive(pending)
            with to.open_output_stream(path) as f:
                f.write(data)
            pending.clear()
            return pa.RecordBatch.from_pydict({"path": [path], "size": [len(data)]}, pa.schema([("path", pa.string()), ("size", pa.int64())]))

        for batch in batches:
            for row in range(batch.num_rows):
                key, url, payload, digest, first = (batch.column(k)[row].as_py() for k in range(5))
                refers = first if first is not None and key != first else None
                raw = warc_record(key, url, payload, digest, len(payload), refers)
                pending.append((key, raw))
                held += len(raw)
                if held >= archive_bytes:
                    yield close()
                    held = 0
        if pending:
            yield close()

    rows = rows.select(F.col("_id").cast("string"), "_url", "_payload", "_digest", F.col("_first").cast("string"))
    return rows.mapInArrow(write, "path string, size long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of archives(path, size): page_id and refers_to as strings, length and digest of the full payload. A
    response's are computed from what was read and held against what its header says."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns: list[list] = [[], [], [], [], []]
                with where.open_input_file(path) as f:
                    for r in read_records(lambda at, n, f=f: f.read_at(n, at), size):
                        length, digest = r["length"], r["digest"]
                        if r["payload"] is not None:
                            length, digest = len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()
                            if (length, digest) != (r["length"], r["digest"]):
                                raise ValueError(f"the payload of {r['id']} in {path} isn't what its header says")
                        for column, x in zip(columns, (r["id"], length, digest, r["type"], r["refers_to"]), strict=True):
                            column.append(x)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Writes all pages and reads the archives back. Payloads are shuffled once, on their way to the archives."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = materialized(write_archives(with_first(pages, id_col, url_col, html_col, least), folder), "archives")
    kind = pages.schema[id_col].dataType
    out = read_archives(archives.repartition(partitions(spark)), folder)
    return out.withColumn(id_col, F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)).select(id_col, "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""
