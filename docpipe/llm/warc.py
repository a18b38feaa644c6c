"""Seekable Zstandard bundles of WARC records.

Pages become WARC records. Records are spread over bundles by a hash of the whole record, so that the same pages give the
same bundles wherever they are read; inside a bundle they are packed in hash order into independent Zstandard frames, a
frame being closed when it reaches `frame` bytes. A bundle ends with a seek table in a skippable frame, as the public
seekable format has it: 4-byte compressed and uncompressed sizes for each frame, then the number of frames, a descriptor
and the magic number. Concatenating the `bytes` of a bundle's rows by frame_no gives a file that any Zstandard tool reads.

`pack` returns one row for each frame, the seek table being the last: bundle_id, frame_no, kind (data, seek), offset and
size of the frame in the bundle, raw_size, n_records, records (record_id, page_id, offset relative to the decompressed
frame, length) and bytes. `index`, `unpack`, `fetch` and `bundle` read them.

Defined results: a null url, page_id or html comes back as null, an empty html as empty. Line breaks in a url are kept by a
base64 header. Repeated pages are records of their own, told apart by a number after the same identifier. A page larger
than `frame` is a frame by itself. No pages give no bundles. Extra columns aren't stored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

SCHEMA = (
    "bundle_id int, frame_no int, kind string, offset bigint, size bigint, raw_size bigint, n_records int,"
    " records array<struct<record_id:string,page_id:bigint,offset:bigint,length:bigint>>, bytes binary"
)
ARROW = pa.schema(
    [("bundle_id", pa.int32()), ("frame_no", pa.int32()), ("kind", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("raw_size", pa.int64()), ("n_records", pa.int32())]
    + [("records", pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))), ("bytes", pa.binary())]
)
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record(page_id: int | None, url: str | None, html: str | None, date: str, again: int = 0) -> tuple[str, bytes]:
    """The identifier and the bytes of a page's record."""
    body = (html or "").encode("utf-8", "surrogatepass")
    digest = hashlib.md5(repr((page_id, url)).encode() + body).hexdigest()
    name = f"{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:]}" + (f"-{again}" if again else "")
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        plain = url == url.strip() and not any(c in url for c in "\r\n")
        head.append(f"WARC-Target-URI: {url}" if plain else "X-Target-Base64: " + base64.b64encode(url.encode()).decode())
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if html is None:
        head.append("X-Null-Payload: 1")
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[int | None, str | None, str | None]:
    """page_id, url and html of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    url = fields.get("WARC-Target-URI")
    if "X-Target-Base64" in fields:
        url = base64.b64decode(fields["X-Target-Base64"]).decode()
    html = None if "X-Null-Payload" in fields else rest[: int(fields["Content-Length"])].decode("utf-8", "surrogatepass")
    return int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, url, html


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and uncompressed size of each frame, from the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for size, raw in struct.iter_unpack("<II", data[len(data) - 9 - 8 * n : -9]):
        out.append((at, size, raw))
        at += size
    return out


def pack(pages: DataFrame, frame: int = 256 << 10, bundle: int = 32 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row for each frame; see the module. bundle: mean bytes of html in a bundle, from which their number follows."""
    own = pages.select(F.col("page_id").cast("bigint").alias("i"), F.col("url").cast("string").alias("u"), F.col("html").cast("string").alias("h"))
    n = 1 + int((own.agg(F.sum(F.octet_length("h"))).first()[0] or 0) // bundle)
    own = own.withColumn("k", F.xxhash64("i", "u", "h")).withColumn("b", F.pmod("k", F.lit(n)).cast("int"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        now, number, at, sizes, held, raw, again = None, 0, 0, [], [], 0, {}

        def closed() -> pa.RecordBatch:
            nonlocal number, at, held, raw
            data = compressor.compress(b"".join(x for _, _, x in held))
            where, entries = 0, []
            for name, page, x in held:
                entries.append({"record_id": name, "page_id": page, "offset": where, "length": len(x)})
                where += len(x)
            row = {"bundle_id": now, "frame_no": number, "kind": "data", "offset": at, "size": len(data), "raw_size": raw, "n_records": len(held), "records": entries, "bytes": data}
            sizes.append((len(data), raw))
            number, at, held, raw = number + 1, at + len(data), [], 0
            return pa.RecordBatch.from_pylist([row], ARROW)

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal number, at, sizes, again
            if held:
                yield closed()
            if sizes:
                data = seek_table(sizes)
                yield pa.RecordBatch.from_pylist([{"bundle_id": now, "frame_no": number, "kind": "seek", "offset": at, "size": len(data), "raw_size": 0, "n_records": 0, "records": [], "bytes": data}], ARROW)
            number, at, sizes, again = 0, 0, [], {}

        for batch in batches:
            for i, u, h, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != now:
                    yield from ended()
                    now = b
                name, data = record(i, u, h, date)
                seen = again.get(name, 0)
                again[name] = seen + 1
                if seen:
                    name, data = record(i, u, h, date, seen)
                held.append((name, i, data))
                raw += len(data)
                if raw >= frame:
                    yield closed()
        yield from ended()

    return own.repartitionById(n, "b").sortWithinPartitions("b", "k", "i", "u", "h").select("i", "u", "h", "b").mapInArrow(X.lean(packed), SCHEMA)


def index(frames: DataFrame) -> DataFrame:
    """record_id, page_id, bundle_id, frame_no, frame_offset, frame_size, record_offset, record_length: one row for each record."""
    return frames.where("kind = 'data'").select("bundle_id", "frame_no", F.col("offset").alias("frame_offset"), F.col("size").alias("frame_size"), F.explode("records").alias("r")).select(
        "r.record_id", "r.page_id", "bundle_id", "frame_no", "frame_offset", "frame_size", F.col("r.offset").alias("record_offset"), F.col("r.length").alias("record_length")
    )


def unpack(frames: DataFrame) -> DataFrame:
    """record_id, page_id, url, html of all records."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for records, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(data)
                out += [(r["record_id"], *parsed(raw[r["offset"] : r["offset"] + r["length"]])) for r in records]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["record_id", "page_id", "url", "html"])

    return frames.where("kind = 'data'").select("records", "bytes").mapInArrow(X.lean(read), "record_id string, page_id bigint, url string, html string")


def fetch(frames: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records named in record_ids.record_id: only frames that hold one of them are decompressed."""
    ids = record_ids.select("record_id").distinct()
    hit = index(frames).join(ids, "record_id", "left_semi").select("bundle_id", "frame_no").distinct()
    return unpack(frames.join(hit, ["bundle_id", "frame_no"], "left_semi")).join(ids, "record_id", "left_semi")


def bundle(frames: DataFrame, bundle_id: int) -> bytes:
    """A bundle as the bytes of a file."""
    return b"".join(r["bytes"] for r in frames.where(F.col("bundle_id") == bundle_id).orderBy("frame_no").select("bytes").collect())
