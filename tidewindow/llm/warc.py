"""Operator 9: WARC records in ZIP packages, written by Spark tasks and read back by range.

A package is a ZIP archive with two stored members, ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdx`` (a JSON line for each record with its place). The reader parses the central
directory, its ZIP64 form too, finds the members where they lie and reads single records by range; nothing is
extracted. Files are opened through Arrow's file systems, so that any store with a URI works.
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
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.shared import new_path, saved, small_batches

#: Compressed bytes of records after which a task starts another package.
PACKAGE_BYTES = 32_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- records ---------------------------------------------------------------------------------------------------------


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    value = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that has the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id)}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}"]),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of one record; the digest of a payload that is there is worked out and held against the head."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": None if url is None else unquote(url),
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
    }


# -- packages --------------------------------------------------------------------------------------------------------


def make_package(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP archive with gzipped records and their index, both stored."""
    data, index = io.BytesIO(), []
    for page_id, packed in records:
        index.append(json.dumps({"page_id": page_id, "offset": data.tell(), "length": len(packed)}))
        data.write(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), data.getbuffer())
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
    return out.getvalue()


def read_directory(file, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset, length) of the stored members of a ZIP archive; ``file.read_at(n, offset)`` reads a range."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    locator = tail[at - 20 : at] if at >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", locator[8:16])
        record = file.read_at(56, end64)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is damaged")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, out, at = file.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (header,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # values stand here in this order, each only where the 32 bits are all ones
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        if method == 0:
            local = file.read_at(30, header)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"the local header of {name} is damaged")
            out[name] = header + 30 + sum(struct.unpack("<HH", local[26:30])), plain
        at += 46 + n_name + n_extra + n_note
    return out


def read_package(file, size: int) -> Iterator[dict]:
    """The records of a package, each read by its own range."""
    members = read_directory(file, size)
    data_at, data_size = members[DATA]
    index_at, index_size = members[INDEX]
    for line in file.read_at(index_size, index_at).decode().split("\n"):
        if line:
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > data_size:
                raise ValueError("the index points beyond the archive")
            yield parse_record(zlib.decompress(file.read_at(entry["length"], data_at + entry["offset"]), wbits=31))


# -- Spark -----------------------------------------------------------------------------------------------------------


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes packages under names that no other attempt uses, and returns what it has written."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    waiting: list[tuple[int | None, bytes]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        name, package = f"{uuid.uuid4().hex}.wacz", make_package(waiting)
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(package)
        row = [pa.array([f"{folder}/{name}"]), pa.array([len(package)], pa.int64()), pa.array([len(waiting)], pa.int64())]
        waiting.clear()
        return pa.RecordBatch.from_arrays(row, names=["path", "bytes", "records"])

    for batch in batches:
        for page_id, url, html, refers_to, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
            page_id, payload = page_id.as_py(), html.as_py().encode("utf-8", "replace")
            packed = gzip.compress(make_record(page_id, url.as_py(), payload, refers_to.as_py(), revisit.as_py()), 6, mtime=0)
            waiting.append((page_id, packed))
            held += len(packed)
            if held >= PACKAGE_BYTES:
                held = 0
                yield flush()
    if waiting:
        yield flush()


_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path, size in zip(batch.column(0), batch.column(1), strict=True):
            store, name = fs.FileSystem.from_uri(path.as_py())
            rows: list[dict] = []
            with store.open_input_file(name) as file:
                for record in read_package(file, size.as_py()):
                    rows.append(record if payloads else record | {"payload": None})
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


#: Revisits, some hundred bytes each, up to which they are broadcast; above, the pages are shuffled by id and digest to tell them.
BROADCAST_ROWS = 200_000


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``pages(page_id, url, html)`` with ``refers_to`` and ``revisit``.

    Of equal payloads of at least ``min_bytes`` the one with the largest page id is the response; rows that repeat
    that id are responses too, the others revisit it. Only ids and digests are grouped and joined by payload.
    """
    keyed = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    narrow = keyed.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    # tables of their own: a join with an aggregate of the same key would keep the rows of a payload of very many pages in one task
    winners = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    winners = saved(winners, "winners")
    revisits = narrow.join(winners, "digest").where("page_id < refers_to or (page_id is null and refers_to is not null)")
    decided = saved(revisits.repartition("digest", "page_id").distinct(), "revisits")
    if decided.count() <= BROADCAST_ROWS:
        decided = F.broadcast(decided)
    joined = keyed.alias("k").join(decided.alias("d"), F.col("k.page_id").eqNullSafe(F.col("d.page_id")) & (F.col("k.digest") == F.col("d.digest")), "left")
    return joined.select("k.page_id", "k.url", "k.html", "d.refers_to", F.col("d.refers_to").isNotNull().alias("revisit"))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Writes a record for each row of ``pages``; returns ``(path, bytes, records)`` of the packages of tasks that succeeded.

    A null html is an empty payload; null urls and ids stay null. Files left by lost or repeated attempts aren't listed
    and so aren't read. An empty table writes nothing.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    small_batches(pages.sparkSession)
    plan = plan_records(rows, min_bytes)
    return saved(plan.mapInArrow(partial(_write, folder=folder), "path string, bytes long, records long"), "manifest")


def read_packages(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages that a table of ``(path, bytes)`` lists, a package a task at most."""
    n = manifest.count()
    files = manifest.select("path", "bytes").repartition(max(1, min(n, 100_000)))
    return files.mapInArrow(partial(_read, payloads=payloads), _RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 1000, payloads: bool = False) -> DataFrame:
    """The records of ``pages``, written to packages in the shared folder and read back."""
    folder = new_path(pages.sparkSession, "packages")
    return read_packages(write_packages(pages, folder, min_bytes=min_bytes), payloads)
