"""WARC archives as a chunked record table.

An archive is a table of rows (archive, record_id, chunk, data, running_sha1): chunk 0 of a record is its
WARC and HTTP header, chunks 1.. are payload pieces of at most CHUNK bytes, the last row closes the record
with CRLF CRLF. The data of an archive's rows in (record_id, copy, chunk) order is a WARC/1.1 file. A
payload is written and read piece by piece under an incremental SHA-1; each row carries the digest of the
payload so far, so a reader verifies every chunk as it comes and never builds a whole record.

Records with equal payloads of at least `revisit_from` bytes: the one with the smallest page_id is a
response, the others are revisits that refer to it and hold no payload. Digests of payloads that occur
more than once are found by a pre-aggregated group, so one payload may have a third of all rows.

Defined cases: a null payload is empty; rows repeated under the smallest page_id are all responses; a
null url or page_id is written as an empty header value (page_id null reads back as null); an empty
table gives an empty archive; other columns are ignored. A record that lacks its head, a chunk or its end, has
rows after its end, or does not match a digest raises an error. `copy` is made once, as the archive is written."""

from __future__ import annotations

from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, new_path, written

CHUNK = 64 << 10
CRLF = b"\r\n"
#: Fixed so that equal inputs give equal archives.
DATE = "1970-01-01T00:00:00Z"
TABLE = "archive int, page_id long, copy long, chunk long, data binary, running_sha1 binary"
READ = "page_id long, copy long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def b32(digest: bytes) -> str:
    return b32encode(digest).decode()


def header(kind: str, page: int | None, url: str | None, digest: str, refers_to: int | None, size: int) -> bytes:
    """WARC header block, and the HTTP status line and headers that open the content block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"X-Payload-Length: {size}", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + http


def records(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    size = F.octet_length("html")
    first = p.where(size >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = broadcast_if_small(written(first, "digests"))  # else the payloads would be shuffled for it
    refers = F.when((size >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return p.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def chunk_table(recs: DataFrame, archives: int = 64, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of `records`. A record's rows follow each other, and `copy` tells repeated rows apart."""
    bounded_batches(recs.sparkSession)
    rows = recs.select("page_id", "url", "html", "digest", "refers_to", F.monotonically_increasing_id().alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "page_id", "copy", "chunk", "data", "running_sha1"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        out: list[list] = [[] for _ in names]
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            b = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
            for x in out:
                x.clear()
            held = 0
            return b

        for b in batches:
            for page, url, html, digest, refers, copy in zip(*b.columns, strict=True):
                page, refers = page.as_py(), refers.as_py()
                body = html.as_buffer()  # UTF-8 bytes, not copied
                kind = "response" if refers is None else "revisit"
                state, archive = sha1(), (page or 0) % archives
                pieces = [(0, header(kind, page, url.as_py(), b32(bytes.fromhex(digest.as_py())), refers, body.size))]
                stop = body.size if kind == "response" else 0
                for at in range(0, stop, chunk):
                    pieces.append((at // chunk + 1, body[at : min(at + chunk, stop)]))
                pieces.append((len(pieces), CRLF + CRLF))
                for k, data in pieces:
                    if 0 < k < len(pieces) - 1:
                        state.update(data)
                    for x, v in zip(out, (archive, page, copy.as_py(), k, data.to_pybytes() if isinstance(data, pa.Buffer) else data, state.digest()), strict=True):
                        x.append(v)
                    held += chunk if 0 < k < len(pieces) - 1 else 512
                    if held >= 8 << 20:
                        yield flush()
        if out[0]:
            yield flush()

    return rows.mapInArrow(run, TABLE)


def write(pages: DataFrame, path: str | None = None, revisit_from: int = 0) -> DataFrame:
    """Write the archives under `path` (default: the shared folder) and return them as a table."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    chunk_table(records(pages, revisit_from)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(TABLE).parquet(path)


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """WARC header fields, and the payload length that the content block announces."""
    top, http = data.split(CRLF + CRLF, 1)
    lines = top.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, int(fields["Content-Length"]) - len(http)


def record_number(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read(archives: DataFrame) -> DataFrame:
    """(page_id, copy, payload_bytes, payload_digest, record_type, refers_to) parsed from the archived bytes.

    Chunks arrive in order, whatever files they came from; one record's state is all that is held."""
    spark = archives.sparkSession
    bounded_batches(spark)
    ordered = archives.select("page_id", "copy", "chunk", "data", "running_sha1").repartition("page_id", "copy").sortWithinPartitions("page_id", "copy", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "copy", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        fields, left, got, state = {}, 0, 0, sha1()
        due = 0  # the next chunk of the open record; 0 if none is open
        for b in batches:
            out: list[list] = [[] for _ in names]
            for copy, chunk, data, running in zip(b.column(1), b.column(2), b.column(3), b.column(4), strict=True):
                body = data.as_buffer()
                if chunk.as_py() != due:
                    raise ValueError(f"{fields['WARC-Record-ID']} is cut off before chunk {due}" if due else f"chunk {chunk} has no record")
                due += 1
                if due == 1:
                    fields, left = parse_header(body.to_pybytes())
                    got, state = 0, sha1()
                elif left:
                    state.update(body)
                    got, left = got + body.size, left - body.size
                    if state.digest() != running.as_py():
                        raise ValueError(f"chunk {chunk} of {fields['WARC-Record-ID']} does not match its digest")
                else:
                    if body.to_pybytes() != CRLF + CRLF:
                        raise ValueError(f"{fields['WARC-Record-ID']} is not closed")
                    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (b32(state.digest()) != named or got != int(fields["X-Payload-Length"])):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    refers = record_number(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    for x, v in zip(out, (record_number(fields["WARC-Record-ID"]), copy.as_py(), int(fields["X-Payload-Length"]), named, kind, refers), strict=True):
                        x.append(v)
                    due = 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
        if due:
            raise ValueError(f"{fields['WARC-Record-ID']} is cut off before chunk {due}")

    return ordered.mapInArrow(run, READ)
