"""WARC archives: one gzip member a record, revisit records for repeated payloads, a sequential reader.

Archives are rows (name, content) of up to about ``ARCHIVE_BYTES``, so they go to and from any store that
Spark reaches. ``read_archives`` takes the same two columns, for example from Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import materialize, maybe_broadcast

ARCHIVE_BYTES = 1 << 20
#: Pages that become Python values at once.
ROWS = 64
#: Compressed bytes given to the decompressor at once.
FEED = 1 << 16
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, gzipped as a member of its own. With refers_to the payload is left out, as a revisit."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return pack.compress(raw) + pack.flush()


def members(content: bytes) -> Iterator[bytes]:
    """The decompressed gzip members of an archive, one after the other."""
    at, view = 0, memoryview(content)
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a gzip member")
            piece = view[at : at + FEED]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(parts)


def _fields(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def read_record(raw: bytes) -> dict:
    """Parse one record; ValueError if its framing is broken, false flags if a digest does not match."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    warc = _fields(head)
    size = int(warc.get("content-length", -1))
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record is not as long as its Content-Length says")
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = warc.get("warc-type") == "revisit"
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(warc.get("warc-record-id", "").strip("<>").removeprefix(RECORD)),
        "url": warc.get("warc-target-uri"),
        "record_type": warc.get("warc-type"),
        "payload_bytes": int(_fields(http).get("content-length", 0)) if revisit else len(payload),
        "payload_digest": stated if revisit else sha1_base32(payload),
        "refers_to": number(warc.get("warc-refers-to", "").strip("<>").removeprefix(RECORD)),
        "block_ok": warc.get("warc-block-digest") == f"sha1:{sha1_base32(block)}",
        "payload_ok": revisit or stated == sha1_base32(payload),
        "payload": None if revisit else payload,
    }


def plan_revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """pages with ``_refers``: the largest id among the rows of an equal payload, null for that row itself."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = pages.withColumn("_payload", payload).withColumn("_sha", F.unhex(F.sha1("_payload")))
    groups = pages.where(F.octet_length("_payload") >= min_bytes).groupBy("_sha").agg(F.count("*").alias("n"), F.max(id_col).alias("_last"))
    # payloads that stand alone need no answer: only digests move to find the others, and few of those are broadcast
    groups = materialize(groups.where("n > 1").select("_sha", "_last"), "repeated-payloads", keep=True)
    pages = pages.join(maybe_broadcast(groups), "_sha", "left")
    return pages.withColumn("_refers", F.when(F.col(id_col).eqNullSafe(F.col("_last")), F.lit(None)).otherwise(F.col("_last")))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(name, content): the pages as WARC archives.

    Of rows with equal payloads of at least min_bytes, those with the largest id are responses (all of
    them if that id is repeated), the others revisit it. Null html is an empty payload. Rows without id
    revisit a row with one; where none has an id, all are responses. An empty table gives no archives.
    """
    planned = plan_revisits(pages.select(id_col, url_col, html_col), id_col, html_col, min_bytes)
    planned = planned.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col("_payload").alias("payload"), F.col("_refers").cast("long").alias("refers"), F.spark_partition_id().alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, number, part = [], 0, 0, 0
        made = lambda: pa.RecordBatch.from_pydict({"name": [f"{part:06d}-{number:06d}.warc.gz"], "content": pa.array([b"".join(parts)], pa.binary())})
        for batch in batches:
            for row in (r for k in range(0, batch.num_rows, ROWS) for r in batch.slice(k, ROWS).to_pylist()):
                part = row["part"]
                parts.append(build_record(row["id"], row["url"], row["payload"], row["refers"], date))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield made()
                    parts, size, number = [], 0, number + 1
        if parts:
            yield made()

    return planned.mapInArrow(pack, "name string, content binary")


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block_ok boolean, payload_ok boolean"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives (column content), read sequentially, digests verified.

    A broken frame raises ValueError; a digest that does not match gives block_ok or payload_ok false.
    payload_bytes and payload_digest are those of the full payload, for revisits as their headers state.
    ``payloads`` adds the payload itself (null for revisits).
    """
    schema = READ + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in members(content.as_buffer()):
                    row = read_record(raw)
                    rows.append({n: row[n] for n in names})
                    size += len(raw)
                    if size >= 16 * ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archives.select("content").where("content is not null").mapInArrow(read, schema)
