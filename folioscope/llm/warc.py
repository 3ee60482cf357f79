"""WARC archives: writing, and a normaliser for monolithic gzip.

``normalise`` inflates a whole-file gzip stream once, record by record, rewrites every record as a gzip member of
its own and writes a sidecar index (offset, length and record id of each member), so any record can be read alone.
Files that already have several members go through it as well. Memory is bounded by the longest record.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is a response; the
others are revisits that refer to it and hold the HTTP header only. Duplicates are found by a partial minimum per
digest and a join that Spark may split where a payload is frequent; payloads are not gathered by digest.

Defined results: a null payload is empty; a null URL leaves the header out; a null id is written as ``null``, never
chosen as the response where there is another, and read back as null; repeated rows with the smallest id are all
responses; extra columns are ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import filesystem, only, shared_dir, text_or_empty

EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = struct.Struct("<QQI")
READ = 1 << 18


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if text == "null" else int(text)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = EPOCH) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if line for k, _, v in [line.partition(":")]}


def inflated(stream) -> Iterator[bytes]:
    """The contents of a gzip file with one member or many, piece by piece."""
    tool = zlib.decompressobj(31)
    while piece := stream.read(READ):
        while piece:
            out = tool.decompress(piece)
            if out:
                yield out
            piece = tool.unused_data
            if tool.eof:
                tool = zlib.decompressobj(31)
                if not piece:
                    break
            else:
                piece = b""


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, the whole record) of each record of an inflated archive."""
    held = bytearray()
    wanted = None
    for piece in pieces:
        held += piece
        while True:
            if wanted is None:
                if (end := held.find(b"\r\n\r\n")) < 0:
                    break
                head = headers(bytes(held[:end]))
                wanted = end + 4 + int(head["content-length"]) + 4
            if len(held) < wanted:
                break
            yield head, bytes(held[:wanted])
            del held[:wanted]
            wanted = None
    if held:
        raise ValueError("the archive ends inside a record")


def normalise(source, target, sidecar, level: int = 4) -> int:
    """Reads a gzip archive once; writes a member for each record, and the index; returns the number of records."""
    at = n = 0
    for head, raw in records(inflated(source)):
        tool = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = tool.compress(raw) + tool.flush()
        target.write(member)
        name = head.get("warc-record-id", "").encode()
        sidecar.write(INDEX.pack(at, len(member), len(name)) + name)
        at += len(member)
        n += 1
    return n


def read_index(raw: bytes) -> list[tuple[int, int, str]]:
    out, at = [], 0
    while at < len(raw):
        offset, length, size = INDEX.unpack_from(raw, at)
        at += INDEX.size
        out.append((offset, length, raw[at : at + size].decode()))
        at += size
    return out


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one member."""
    file.seek(offset)
    raw = zlib.decompress(file.read(length), 31)
    end = raw.index(b"\r\n\r\n")
    head = headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n")
    return head, headers(block[:cut]), block[cut + 4 :]


def with_responses(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, sha1, revisit and refers_to."""
    known = pages.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    first = known.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).select("sha1", "first")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return known.join(first, "sha1", "left").select("page_id", "url", "html", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, to: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = EPOCH) -> list[dict]:
    """Writes the archives and their indices below the URI to; returns the manifest, a dict for each archive.

    Each task streams its records into one monolithic gzip member and normalises that; the monolith then goes.
    """
    own = only(pages, page_id=page_id, url=url, html=html).select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html"))

    def run(batches):
        fs, folder = filesystem(to)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}"
        stream = tool = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for row in batch.slice(at, 500).to_pylist():
                    if stream is None:
                        stream, tool = fs.open_output_stream(f"{name}.mono.gz", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    stream.write(tool.compress(record(row["page_id"], row["url"], row["html"].encode(), digest, row["refers_to"], row["revisit"], date)))
        if stream is None:
            return
        stream.write(tool.flush())
        stream.close()
        with fs.open_input_stream(f"{name}.mono.gz", compression=None) as source, fs.open_output_stream(f"{name}.warc.gz", compression=None) as target, fs.open_output_stream(f"{name}.idx", compression=None) as sidecar:
            n = normalise(source, target, sidecar)
        fs.delete_file(f"{name}.mono.gz")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "records"])

    return [r.asDict() for r in with_responses(own, min_bytes).mapInArrow(run, "name string, records long").collect()]


COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark, manifest: list[dict], to: str) -> DataFrame:
    """A row for each record, found through the indices and read from the archives."""
    if not manifest:
        return spark.createDataFrame([], COLUMNS)
    names = spark.createDataFrame([(m["name"],) for m in manifest], "name string").repartition(len(manifest))

    def run(batches):
        fs, _ = filesystem(to)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{name}.idx", compression=None) as side:
                    index = read_index(side.read())
                with fs.open_input_file(f"{name}.warc.gz") as file:
                    for at in range(0, len(index), 2000):
                        yield as_batch([row_of(*read_record(file, offset, length)) for offset, length, _ in index[at : at + 2000]])

    def row_of(head, http, payload):
        revisit = head["warc-type"] == "revisit"
        digest = head["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
        return page_of(head["warc-record-id"]), int(http["content-length"]) if revisit else len(payload), digest, head["warc-type"], page_of(head["warc-refers-to"]) if revisit else None

    def as_batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return names.mapInArrow(run, COLUMNS)


def write_and_read(pages: DataFrame, **names) -> DataFrame:
    to = shared_dir(pages.sparkSession)
    return read(pages.sparkSession, write(pages, to, **names), to)
