"""Web archives: WARC files, a two-level capture index, reads by range.

``write`` stores pages as WARC records, each a gzip member of its own. A page
whose payload equals that of a page with a larger id becomes a revisit record
that names the stored one. ``index`` sorts captures by reversed-host URL key
into compressed blocks and keeps one row per block (the sparse directory).
``lookup`` finds captures: binary search in the directory, one range read for
the block, one range read for the record.

Defined cases. Null payload: empty. Null URL: the record has no target URI and
the empty key. Null id: never the stored one of equal payloads unless all ids
are null. Repeated rows: each is a record; rows that share the largest id are
all responses. Empty table: no files, no rows. Other input columns are ignored.

Files are named by task attempt, so an attempt that is run again never changes
bytes that an index row already points to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Workspace

#: Payloads below this are stored in every record.
REVISIT_BYTES = 1000
#: Captures in a block; blocks grow so that the directory keeps to DIRECTORY_ROWS.
BLOCK_LINES = 500
DIRECTORY_ROWS = 100_000

RECORDS = "page_id long, key string, digest string, n long, type string, refers_to long, file string, offset long, length long"
DIRECTORY = "key string, page_id long, last_key string, file string, offset long, length long, lines long"
CAPTURES = "page_id long, key string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then what follows the host."""
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$"
    host = F.lower(F.regexp_extract(url, parts, 1))
    return F.when(url.isNull(), "").when(~url.rlike(parts), url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, parts, 2)))


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n: int, refers_to: int | None, date: str) -> bytes:
    of = lambda x, d: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{x}/{d}')}>"
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", of(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(n))]
    if payload is None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", of(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload or b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, work: Workspace, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every page to WARC files below the workspace; one row per record."""
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    base = base.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    same = base.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count("*").alias("copies")).where("copies > 1")
    # small payloads, many of them empty, have no partner: a key of their own each, not one hot digest
    own = F.when(F.col("n") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = base.withColumn("at", own).join(same.select(F.col("digest").alias("at"), "stored"), "at", "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    rows = rows.select("page_id", "url", url_key(F.col("url")).alias("key"), "digest", "n", F.when(revisit, F.col("stored")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))
    folder = work.path("warc")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows, placed = batch.to_pylist(), []
            for r in rows:
                if out is None:
                    out = files.open_output_stream(f"{top}/{name}", compression=None)
                data = _member(_record(r["page_id"], r["url"], None if r["payload"] is None else r["payload"].encode(), r["digest"], r["n"], r["refers_to"], date))
                out.write(data)
                placed.append((at, len(data)))
                at += len(data)
            keep = batch.select(["page_id", "key", "digest", "n"]).columns
            types = pa.array(["response" if r["payload"] is not None else "revisit" for r in rows])
            yield pa.RecordBatch.from_arrays([*keep, types, batch.column("refers_to"), pa.array([f"{folder}/{name}"] * len(rows), pa.string()), pa.array([x for x, _ in placed], pa.int64()), pa.array([x for _, x in placed], pa.int64())], names=["page_id", "key", "digest", "n", "type", "refers_to", "file", "offset", "length"])
        if out is not None:
            out.close()

    return work.keep(rows.mapInArrow(store, RECORDS), "records")


def index(records: DataFrame, work: Workspace) -> DataFrame:
    """Sorted, compressed capture blocks; returns the directory, one row per block."""
    spark = records.sparkSession
    lines = max(BLOCK_LINES, -(-records.count() // DIRECTORY_ROWS))
    folder = work.path("index")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
    ranged = records.select("key", "page_id", "file", "offset", "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top)
        name, out, at, block = f"{uuid.uuid4().hex}.cdx.gz", None, 0, []

        def close() -> pa.RecordBatch:
            nonlocal out, at
            if out is None:
                out = files.open_output_stream(f"{top}/{name}", compression=None)
            data = _member("".join(json.dumps(x) + "\n" for x in block).encode())
            out.write(data)
            row = {"key": block[0][0], "page_id": block[0][1], "last_key": block[-1][0], "file": f"{folder}/{name}", "offset": at, "length": len(data), "lines": len(block)}
            at += len(data)
            block.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())]))

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append(x)
                if len(block) >= lines:
                    yield close()
        if block:
            yield close()
        if out is not None:
            out.close()

    return work.keep(ranged.mapInArrow(blocks, DIRECTORY), "directory")


def _place(key: str, page_id: int | None) -> tuple[str, bool, int]:
    return (key, page_id is not None, page_id or 0)


def lookup(directory: DataFrame, requests: DataFrame, with_payload: bool = True) -> DataFrame:
    """Captures of the requested (key, page_id) rows, read from the archives.

    The directory goes to every task: its rows are bounded by DIRECTORY_ROWS
    and one short block for each index file. Every response's payload is
    hashed again and must agree with its header.
    """
    spark = requests.sparkSession
    rows = sorted(((_place(r["key"], r["page_id"]), r["file"], r["offset"], r["length"]) for r in directory.toArrow().to_pylist()), key=lambda x: x[0])
    shared = spark.sparkContext.broadcast(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = requests.select("key", "page_id").distinct().repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", F.col("page_id").asc_nulls_first())

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        firsts, handles, block_at, block = [x[0] for x in table], {}, -1, []
        schema = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])

        def read(file: str, offset: int, length: int) -> bytes:
            if file not in handles:
                if len(handles) >= 64:
                    handles.pop(next(iter(handles))).close()
                files, path = fs.FileSystem.from_uri(file)
                handles[file] = files.open_input_file(path)
            return zlib.decompress(handles[file].read_at(length, offset), 31)

        def capture(key: str, page_id: int | None, file: str, offset: int, length: int) -> dict:
            fields, payload = parse(read(file, offset, length))
            stored = fields["WARC-Type"] == "response"
            digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if stored and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {file} at {offset} does not match its digest")
            return {"page_id": page_id, "key": key, "payload_bytes": len(payload) if stored else int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if stored else int(fields["X-Refers-To-Page"]), "payload": payload.decode() if stored and with_payload else None}

        for batch in batches:
            found, size = [], 0
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                want = _place(key, page_id)
                at = max(0, bisect.bisect_left(firsts, want) - 1)
                while at < len(table) and firsts[at] <= want:
                    if at != block_at:
                        block = [json.loads(x) for x in read(*table[at][1:]).decode().splitlines()]
                        places, block_at = [_place(x[0], x[1]) for x in block], at
                    for i in range(bisect.bisect_left(places, want), bisect.bisect_right(places, want)):
                        found.append(capture(*block[i]))
                        size += found[-1]["payload_bytes"] if with_payload else 0
                    at += 1
                if size > 8 << 20 or len(found) > 5000:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)
        for h in handles.values():
            h.close()

    return asked.mapInArrow(fetch, CAPTURES)


def archive(pages: DataFrame, **names: str) -> DataFrame:
    """Write pages, index them, and read every page back through the index."""
    work = Workspace(pages.sparkSession, "warc")
    records = write(pages, work, **names)
    return lookup(index(records, work), records, with_payload=False)
