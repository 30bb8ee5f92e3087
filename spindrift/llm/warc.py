"""WARC writing, and reading by transaction assembly.

``write_archives`` turns captures into WARC 1.1 files in a folder that all executors share: for
each capture a request, a response (or revisit) and a metadata record, each a gzip member of its
own, tied together by WARC-Concurrent-To. ``read_records`` parses archives record by record.
``assemble`` joins the records of each transaction through their concurrent-to identifiers and
gives one nested row per capture.

Record ids are UUIDs that spell page_id, occurrence and kind of record, so ids need no lookup table.
A capture whose payload equals an earlier one's (smallest page_id first) is written as a revisit.
Payloads are equal if their SHA-256 is (for SHA-1, which the archive states, different ones of equal digest are public);
the decision uses (page_id, SHA-256) rows only; a group of any size is reduced to its smallest page_id
by partial aggregation, and narrow rows of a payload that is very frequent are split by the skew join of AQE. Files are listed by a stored manifest, so those that a lost or repeated
task left behind are never read; a page sits in exactly one listed file.

Cases: null html is an empty payload and null url an empty URI; very long payloads are decided and written whole;
``min_bytes`` exempts smaller ones from revisits. A null page_id is larger than any other, and pages without one are
told apart by their place. Rows that repeat page_id and
payload: the first is the response, the others revisit it. Empty input: an empty manifest and no captures.
Line feeds in a URL are percent-encoded. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import partitions, scratch, stored, table, text_or_empty

#: Bytes of records after which a writer starts another archive.
ARCHIVE_BYTES = 256_000_000
#: Bytes of an archive that are decompressed at a time.
SLICE = 1 << 13
#: Kinds of records in the last byte of a record id.
KINDS = {"response": 1, "revisit": 2, "request": 3, "metadata": 4}
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NULL_ID = 2**63 - 1
STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None, occurrence: int, kind: str) -> str:
    n = ((NULL_ID if page_id is None else page_id) & (2**64 - 1)) << 64 | occurrence << 8 | KINDS[kind]
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def page_of(rid: str) -> int | None:
    n = uuid.UUID(rid[10:-1]).int >> 64
    n = n - 2**64 if n >= 2**63 else n
    return None if n == NULL_ID else n


def record(kind: str, rid: str, uri: str, content_type: str, block: bytes, *extra: tuple[str, str]) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *extra, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def transaction(page_id: int | None, occurrence: int, url: str, payload: bytes, refers_to: str | None) -> Iterator[bytes]:
    uri = url.replace("\r", "%0D").replace("\n", "%0A")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "revisit" if refers_to else "response"
    rid = record_id(page_id, occurrence, kind)
    shared = (("WARC-Concurrent-To", rid),)
    host, _, path = uri.partition("://")[2].partition("/")
    yield record("request", record_id(page_id, occurrence, "request"), uri, "application/http;msgtype=request", f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), *shared)
    if refers_to:
        yield record("revisit", rid, uri, "application/http;msgtype=response", STATUS, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE))
    else:
        yield record("response", rid, uri, "application/http;msgtype=response", STATUS + payload, ("WARC-Payload-Digest", f"sha1:{digest}"))
    yield record("metadata", record_id(page_id, occurrence, "metadata"), uri, "application/warc-fields", f"payloadLength: {len(payload)}\r\n".encode(), *shared)


def packed(data: bytes) -> bytes:
    """Compressed for the way between tasks; the length comes first."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


@F.pandas_udf(BinaryType())
def pack_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: packed(t.encode("utf-8", "surrogatepass")))


@F.pandas_udf(BinaryType())
def unpack_block(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: None if b is None else unpacked(b))


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def _writer(folder: str, archive_bytes: int, min_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_fs(folder)
        out = path = None
        n = size = 0
        last, occurrence, written, earlier = object(), -1, {}, {}
        nameless = (TaskContext.get().partitionId() << 32) - 1  # pages without an id are numbered by partition

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        for b in batches:
            for page_id, spread, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "spread", "url", "html", "refers_to")), strict=True):
                if (page_id, spread) != last:
                    last, occurrence, written, earlier = (page_id, spread), -1, {}, {}
                if refers is not None:  # such rows come first: digests of this page that another one has
                    earlier[html.decode()] = record_id(refers["page_id"], 0, "response")
                    continue
                payload = unpacked(html)
                if page_id is None:
                    occurrence = nameless = nameless + 1
                else:
                    occurrence += 1
                digest = hashlib.sha256(payload).hexdigest()
                seen = written.setdefault(digest, occurrence)  # rows that repeat the page id
                target = earlier.get(digest)
                if target is None and seen != occurrence and len(payload) >= min_bytes:
                    target = record_id(page_id, seen, "response")  # of rows that repeat page and payload
                if out is None:
                    store.create_dir(base, recursive=True)
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                for r in transaction(page_id, occurrence, url, payload, target):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = z.compress(r) + z.flush()
                    out.write(member)
                    n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all captures below ``folder``; the stored manifest: path, n_records, n_bytes."""
    rows = pages.select(F.col("page_id").cast("long"), text_or_empty("url").alias("url"), text_or_empty("html").alias("html"))
    nameless = F.col("page_id").isNull()  # any number of rows: dealt by payload
    narrow = stored(rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")), "payload-digests").where(F.col("n") >= min_bytes)
    order = F.struct(F.coalesce("page_id", F.lit(NULL_ID)).alias("k"), F.col("page_id"))
    first = narrow.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first_id"))
    again = narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    refers = again.select("page_id", F.lit("").alias("url"), F.encode("digest", "utf-8").alias("html"), F.struct(F.col("first_id").alias("page_id")).alias("refers_to"), F.when(nameless, F.col("digest")).alias("spread")).distinct()
    # pages and what is known of their digests travel in one shuffle, so the payloads move once
    dealt = rows.withColumn("spread", F.when(nameless, F.sha2("html", 256)))
    both = dealt.withColumn("html", pack_text("html")).withColumn("refers_to", F.lit(None).cast("struct<page_id:bigint>")).unionByName(refers)
    ready = both.repartition("page_id", "spread").sortWithinPartitions("page_id", "spread", F.col("refers_to").isNull(), "url", "html")
    write = _writer(folder, archive_bytes, min_bytes)
    return stored(ready.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


RECORDS = "path string, offset long, record_id string, type string, concurrent_to string, uri string, refers_to string, digest string, block binary"


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, read in blocks."""
    offset, block, at = 0, memoryview(b""), 0
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if at == len(block):
                block, at = memoryview(stream.read(1 << 20)), 0
                if not len(block):
                    if used:
                        raise ValueError("the archive ends inside a record")
                    return
            data = block[at : at + SLICE]  # what zlib leaves unused is copied, so slices are short
            parts.append(z.decompress(data))
            taken = len(data) - len(z.unused_data)
            at, used = at + taken, used + taken
        yield offset, b"".join(parts)
        offset += used


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("path", "offset", "record_id", "type", "concurrent_to", "uri", "refers_to", "digest", "block")
    kinds = (pa.string(), pa.int64(), *[pa.string()] * 6, pa.binary())
    for b in batches:
        for path in b.column("path").to_pylist():
            store, at = _open_fs(path)
            held, size = [], 0
            with store.open_input_stream(at, compression=None) as stream:
                for offset, data in _members(stream):
                    f, block = parse_record(data)
                    held.append((path, offset, f["warc-record-id"], f["warc-type"], f.get("warc-concurrent-to"), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest"), packed(block)))
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives whose path the manifest lists; blocks are packed until ``assemble``."""
    paths = manifest.select("path").repartition(partitions(manifest.sparkSession))
    return paths.mapInArrow(_read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, uri, type, refers_to, digest, request, response, metadata.

    A record without concurrent-to id opens a transaction, all others join the one that they name. Requests or
    metadata whose capture is missing are captures without a response.
    """
    part = F.struct("record_id", "uri", "type", "refers_to", "digest", "block")
    of = lambda *kinds: F.expr(f"type IN {kinds + kinds[:1]}")
    one = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        *(F.min(F.when(of(*kinds), part)).alias(kinds[0]) for kinds in (("response", "revisit"), ("request",), ("metadata",)))
    )
    return one.select("capture_id", *(F.col(f"response.{c}").alias(c) for c in ("uri", "type", "refers_to", "digest")), *(_with_block(c) for c in ("response", "request", "metadata")))


def _with_block(record: str):
    return F.when(F.col(record).isNotNull(), F.struct(F.col(f"{record}.record_id").alias("record_id"), unpack_block(F.col(f"{record}.block")).alias("block"))).alias(record)


def captures_of(records: DataFrame) -> DataFrame:
    """The columns of the contract, from the assembled captures."""
    one = assemble(records)
    end = F.locate("\r\n\r\n", F.decode(F.substring(F.col("response.block"), 1, 4096), "iso-8859-1")) + 3
    stated = F.regexp_extract(F.decode("metadata.block", "utf-8"), r"payloadLength: (\d+)", 1).cast("long")
    return one.select(
        _page("capture_id").alias("page_id"),
        F.when(F.col("type") == "revisit", stated).otherwise((F.octet_length("response.block") - end).cast("long")).alias("payload_bytes"),
        F.substring_index("digest", ":", -1).alias("payload_digest"),
        F.col("type").alias("record_type"),
        _page("refers_to").alias("refers_to"),
        "uri",
        F.decode("request.block", "utf-8").alias("request"),
    )


def _page(column: str):
    """The page id that a record id spells, as in ``page_of``."""
    digits = F.translate(F.substring(column, 11, 36), "-", "")
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    n = F.shiftleft(high, 32).bitwiseOR(low)
    return F.when(n != NULL_ID, n)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return captures_of(read_records(manifest)).drop("uri", "request")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
d AS (SELECT *, [('0x' || substr(x, 5 * i + 1, 5))::BIGINT FOR i IN range(0, 8)] AS parts FROM g)
SELECT page_id, payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> s) % 32 + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR n IN parts], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
