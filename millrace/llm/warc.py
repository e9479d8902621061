"""WARC archives whose repeated payloads are revisit records.

Payload digests are shuffled, the first record of each repeated payload is found, and every other one becomes a
revisit of it. Archives are written by tasks with fresh headers, one gzip member for a record. ``resolve`` reads
archives back: headers only of revisits, which it joins to the responses they refer to by payload digest.

A hot payload is one row for each task after pre-aggregation; the join back to it is salted.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schema import ref, require
from ..session import cut_lineage, scratch_path
from .common import arrow_map
from .storage import new_file, store_of

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16
BYTES_AT_ONCE = 1 << 20

HEADERS = "page_id long, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string"


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}')}>"


def _field(value: str) -> str:
    """A value that is safe in a header line: control characters and white space percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda found: "".join(f"%{byte:02X}" for byte in found[0].encode()), value)


def record(page_id, url, payload: bytes, digest: str, first, first_url, date: str) -> bytes:
    """One record; a revisit of page ``first`` if that is given as a pair (page_id,), else a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_name(first[0])}", f"WARC-Refers-To-Date: {date}"]
        if first_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_field(first_url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, count = None, None, 0
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("page_id", "url", "payload", "digest", "revisits", "first_id", "first_url")]
            for page_id, url, payload, digest, revisits, first_id, first_url in zip(*columns):
                if file is None:
                    path, store, inside = new_file(folder, ".warc.gz")
                    file = store.open_output_stream(inside, compression=None)
                    file.write(gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 17\r\n\r\nformat: WARC/1.1\n\r\n\r\n" % (str(uuid5(NAMESPACE_URL, path)).encode(), date.encode()), 6, mtime=0))
                file.write(gzip.compress(record(page_id, url, payload, digest, (first_id,) if revisits else None, first_url, date), 6, mtime=0))
                count += 1
        if file is not None:
            file.close()
            yield pa.record_batch([pa.array([path]), pa.array([count], pa.int64())], names=["path", "n_records"])

    return run


def write_archives(
    pages: DataFrame, folder: str | None = None, least_bytes: int = 100, date: str = "2025-01-01T00:00:00Z",
    id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
) -> DataFrame:
    """Write a record for each row and return the files' paths (path, n_records).

    Of rows with equal payloads (UTF-8, null is empty) of at least ``least_bytes`` bytes the one with the smallest id
    is a response and the others revisit it; all other rows are responses. Rows that repeat that smallest id are all
    responses; a null id is larger than any other, and payloads whose ids are all null are all responses. A null url
    gives no target header; control characters in one are percent-encoded. An empty table gives no file. Other
    columns are not read. ``folder`` defaults to a new one under ``spark.checkpoint.dir``.
    """
    require(pages, id_column, url_column, html_column)
    payload = F.coalesce(ref(html_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(ref(id_column).cast("long").alias("page_id"), ref(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_ = rows.where(F.octet_length("payload") >= least_bytes)
    firsts = long_.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    firsts = cut_lineage(firsts.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("same"), "first"))
    spread = firsts.withColumn("pepper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("salt", salt).join(spread, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("pepper")), "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    ready = joined.select(
        "page_id", "url", F.when(revisits, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), F.octet_length("payload").alias("n"),
        "digest", revisits.alias("revisits"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"),
    )
    folder = folder or scratch_path(pages.sparkSession, "warc")
    written = arrow_map(ready.drop("n"), _write(f"{folder}/archives", date), "path string, n_records long")
    written.write.parquet(f"{folder}/files")
    return pages.sparkSession.read.parquet(f"{folder}/files")


def members(file) -> Iterator[bytes]:
    """The gzip members of an open file, decompressed one after the other."""
    rest, unpacker, parts = b"", zlib.decompressobj(31), []
    while data := rest or file.read(BYTES_AT_ONCE):
        parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the file ends inside a record")


def parse(record_bytes: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields (names in lower case) and its block."""
    head, _, rest = record_bytes.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {name.lower(): value for name, value in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    names = ["page_id", "record_type", "record_id", "refers_to_id", "payload_bytes", "payload_digest"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()])))
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inside = store_of(path)
            rows = []
            with store.open_input_stream(inside, compression=None) as file:
                for member in members(file):
                    fields, block = parse(member)
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    told = fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and sha256(payload).hexdigest() != told:
                        raise ValueError(f"{path}: damaged payload of {fields['warc-record-id']}")
                    page = int(fields["x-page-id"]) if "x-page-id" in fields else None
                    whole = len(payload) if kind == "response" else None
                    rows.append((page, kind, fields["warc-record-id"], fields.get("warc-refers-to"), whole, told))
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema)


def resolve(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives.

    The payload of a revisit is that of the response with its digest, whose page ``refers_to`` names. A revisit whose
    response is in none of the archives has null ``payload_bytes`` and ``refers_to``.
    """
    paths = files.select("path").repartition(max(1, files.count()), "path")
    records = cut_lineage(arrow_map(paths, _read, HEADERS))
    told = records.where("record_type = 'revisit'").select(F.col("payload_digest").alias("same"), F.col("refers_to_id").alias("name")).distinct()
    originals = records.where("record_type = 'response'").join(
        told, (F.col("payload_digest") == F.col("same")) & (F.col("record_id") == F.col("name")), "left_semi"
    )
    originals = originals.groupBy(F.col("payload_digest").alias("same"), F.col("record_id").alias("name")).agg(
        F.first("page_id").alias("origin"), F.first("payload_bytes").alias("whole")
    )
    spread = originals.withColumn("pepper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(
        spread, (F.col("payload_digest") == F.col("same")) & (F.col("refers_to_id") == F.col("name")) & (F.col("salt") == F.col("pepper")), "left"
    )
    return joined.select("page_id", F.coalesce("payload_bytes", "whole").alias("payload_bytes"), "payload_digest", "record_type", F.col("origin").alias("refers_to"))
