"""Operator 6: WARC archives, one gzip member per record, read back sequentially."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescope.session import fresh_path, materialize

#: Payloads below this many bytes are never stored as a revisit.
MIN_SHARED = 100
#: An archive is closed after this many uncompressed bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
#: A reading task takes one archive, or of very many archives so many.
MANY_TASKS, ARCHIVES_A_TASK = 10_000, 8
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed capture time, so that equal tables give equal archives.
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. ``refers_to`` makes it a revisit without payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "") if c.isprintable())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{revisit}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, inflated one at a time; holds one member and one chunk."""
    unpacker, got, used = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            got.append(unpacker.decompress(chunk))
            used, chunk = True, b""
            if unpacker.eof:
                yield b"".join(got)
                chunk, unpacker, got, used = unpacker.unused_data, zlib.decompressobj(31), [], False
    if used:
        raise WarcError("the archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and HTTP payload of one record, framed by its content length; checks the digests."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    top, *fields = head.decode("utf-8").split("\r\n")
    if not found or not top.startswith("WARC/"):
        raise WarcError("not a WARC record")
    header = {k.lower(): v for k, _, v in (f.partition(": ") for f in fields)}
    n = int(header["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError("content length does not frame the record")
    if header["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2]
    if header["warc-type"] == "response" and header["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise WarcError("payload digest differs")
    return header, payload


def _chunks(path: str) -> Iterator[bytes]:
    store, inner = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as stream:
        while chunk := stream.read(READ_BYTES):
            yield chunk


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        stream, name, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                if stream is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html or "").encode()
                stream.write(record(page_id, url, payload, digest, refers_to))
                size, n = size + len(payload), n + 1
                if size >= archive_bytes:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row; return the list of finished archives (path, records).

    Equal payloads of at least ``MIN_SHARED`` bytes are stored once, by the smallest page id; the others
    become revisits of it. Null html is an empty payload, a null url an empty one. Rows with a null id
    are responses of their own unless another row has their payload. Rows that share the smallest id and
    the payload are all responses. Each attempt of a task writes files under new names, and only those
    that the returned list names count, so a lost executor leaves no half archive behind in it.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn(
        "digest", F.sha2(F.col("html").cast("binary"), 256)
    )
    shared = rows.filter(F.octet_length("html") >= MIN_SHARED).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written, so that the join reads both sides from a shuffle of its own and can split a hot payload's rows.
    first = materialize(shared.select("digest", "first_id"), "shared-payloads")
    out = rows.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(None)).otherwise(F.col("first_id")))
    return materialize(out.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(folder, archive_bytes), "path string, records long"), "warc-list")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "url", "record_type", "payload_digest", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=list(names))

    for batch in batches:
        for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
            rows, size, n = [], 0, 0
            for raw in members(_chunks(path)):
                header, payload = parse(raw)
                revisit = header["warc-type"] == "revisit"
                number = lambda key: int(header[key]) if header.get(key) else None
                rows.append((number("x-page-id"), header["warc-target-uri"], header["warc-type"], header["warc-payload-digest"].removeprefix("sha256:"), number("x-refers-to-page-id"), None if revisit else payload))
                size, n = size + len(payload), n + 1
                if size >= READ_BYTES * 16 or len(rows) >= 1_000:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)
            if n != expected:
                raise WarcError(f"{path} has {n} records, {expected} were written")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the listed archives: page_id, url, record_type, payload_digest, refers_to, payload.

    Each task streams whole archives, one gzip member at a time. Framing, block digest and (of responses)
    payload digest are checked; a fault raises ``WarcError``. A revisit has no payload. An empty list
    gives no rows.
    """
    n = archives.count()
    # A given number of partitions is kept: the paths are few bytes, what they name is not.
    spread = archives.repartition(max(1, min(n, max(MANY_TASKS, n // ARCHIVES_A_TASK))))
    return spread.mapInArrow(_read, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Per record the size and digest of the full payload, that of a revisit taken from its response."""
    base = records.select("page_id", "payload_digest", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("own_bytes"))
    base = materialize(base, "warc-records")
    revisits = base.filter("record_type = 'revisit'").drop("own_bytes")
    sources = base.filter("record_type = 'response'").groupBy(F.col("page_id").alias("source_id"), F.col("payload_digest").alias("source_digest")).agg(F.max("own_bytes").alias("payload_bytes"))
    joined = revisits.join(sources, (F.col("refers_to") == F.col("source_id")) & (F.col("payload_digest") == F.col("source_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return base.filter("record_type = 'response'").withColumnRenamed("own_bytes", "payload_bytes").select(columns).unionByName(joined.select(columns))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
