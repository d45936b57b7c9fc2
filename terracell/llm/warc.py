"""Operator 5: WARC archives, from monolithic gzip to a member per record with an offset index.

``write_archives`` writes each task's records as one gzip stream over the whole file, the form in
which records cannot be reached singly.  ``normalise`` inflates such a stream once, front to back in
bounded memory, and rewrites every record as a gzip member of its own beside a sidecar index of
offsets and lengths.  ``read_archives`` goes by the index and opens one member at a time.

Records with equal payloads of at least ``min_bytes``: the one with the largest page id is written as a
response, the others as revisits that name it.  Only digests meet in a shuffle to find them.

Cases: null html is an empty payload, which counts like any other; a null page id is written as such
and is the response only where no record of its payload has an id; rows that repeat the largest page
id and its payload are all responses; null or odd urls are percent-encoded; an empty table gives no
archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, slices

#: Bytes of a stream that are inflated at a time.
STEP = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def typed_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, keeper): keeper is the page id that a revisit refers to, null for a response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1").select("sha1", "keeper")
    keeper = F.when(F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(None).cast("long")).otherwise(F.col("keeper"))
    return rows.join(shared, "sha1", "left").select("page_id", "url", "payload", keeper.alias("keeper"))


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None) -> bytes:
    """One uncompressed WARC record with its two closing line ends."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if keeper is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~%-._')}")
    if keeper is not None:
        head += [f"WARC-Refers-To: <urn:page:{keeper}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """Header fields (lower-case names), block and size of the record that raw begins with; None if raw holds it only in part."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = bytes(raw[:end]).decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    start, n = end + 4, int(fields["content-length"])
    if len(raw) < start + n + 4:
        return None
    return fields, bytes(raw[start : start + n]), start + n + 4


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> list[str]:
    """Monolithic archives, one a task; their names come to the driver."""

    def write(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, packer, name = None, None, f"part-{uuid.uuid4().hex}.warc.gz"
        for batch in slices(batches, "payload"):
            if out is None:
                out, packer = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "keeper"))):
                out.write(packer.compress(record(*row)))
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return sorted(r["file"] for r in typed_pages(pages, min_bytes).mapInArrow(write, "file string").collect())


def inflated(stream) -> "iterator of bytes":  # noqa: F722
    """The bytes of a gzip file of one member or several, some at a time."""
    unpack = zlib.decompressobj(31)
    while True:
        data = stream.read(STEP)
        if not data:
            return
        while data:
            yield unpack.decompress(data, STEP)
            while unpack.unconsumed_tail:
                yield unpack.decompress(unpack.unconsumed_tail, STEP)
            data = b""
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)


def normalise(spark: SparkSession, folder: str, files: list[str], to: str) -> list[tuple[str, int]]:
    """Rewrites archives with a member per record and a sidecar ``.idx`` of JSON lines; returns (file, records) of each. One task a file."""

    def rewrite(batches):
        fs, base = filesystem(folder)
        ft, target = filesystem(to)
        ft.create_dir(target, recursive=True)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                name, offset, n, held = f"norm-{uuid.uuid4().hex}.warc.gz", 0, 0, bytearray()
                with fs.open_input_stream(f"{base}/{files[k]}", compression=None) as stream, ft.open_output_stream(f"{target}/{name}", compression=None) as out, ft.open_output_stream(f"{target}/{name}.idx", compression=None) as idx:
                    for data in inflated(stream):
                        held += data
                        at = 0
                        while at < len(held) and (got := parse(memoryview(held)[at:].tobytes() if at else bytes(held))):
                            fields, _, size = got
                            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = packer.compress(bytes(held[at : at + size])) + packer.flush()
                            out.write(member)
                            idx.write((json.dumps({"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "uri": fields.get("warc-target-uri")}) + "\n").encode())
                            offset, n, at = offset + len(member), n + 1, at + size
                        del held[:at]
                    if held:
                        raise ValueError(f"{files[k]} ends within a record")
                yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]}, pa.schema([("file", pa.string()), ("n", pa.int64())]))

    n = len(files)
    if not n:
        return []
    return sorted((r["file"], r["n"]) for r in spark.range(0, n, 1, n).mapInArrow(rewrite, "file string, n long").collect())


def read_archives(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload), a row a record, read member by member by the index.

    Of a response, bytes and digest are those of the payload read; of a revisit, those it states.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def page(urn: str | None) -> int | None:
        number = (urn or "").strip("<>").removeprefix("urn:page:")
        return int(number) if number else None

    def read(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with fs.open_input_stream(f"{base}/{files[k]}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                with fs.open_input_file(f"{base}/{files[k]}") as f:
                    for at in range(0, len(index), 256):
                        rows = []
                        for x in index[at : at + 256]:
                            fields, block, _ = parse(zlib.decompress(f.read_at(x["length"], x["offset"]), 31))
                            head, _, payload = block.partition(b"\r\n\r\n")
                            size = int(next(v for v in head.decode().split("\r\n") if v.lower().startswith("content-length:")).split(":")[1])
                            response = fields["warc-type"] == "response"
                            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else fields["warc-payload-digest"].removeprefix("sha1:")
                            url = fields.get("warc-target-uri")
                            rows.append((page(fields["warc-record-id"]), None if url is None else unquote(url), fields["warc-type"], len(payload) if response else size, digest, page(fields.get("warc-refers-to")), payload if response else None))
                        names = [c.split()[0] for c in schema.split(", ")]
                        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = len(files)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, schema)
