"""Operator 10, WARC: seekable Zstandard bundles.

Each task writes its rows as WARC/1.1 records into bundle files. Records are grouped into frames
that are compressed independently; a skippable frame at the end holds the table of frame sizes
(the public seekable format). An index maps each record's identifier to its bundle, frame and
offset inside the frame, so one record costs one read of one frame.

Records of equal payload (by SHA-1, of at least ``least`` bytes): that with the largest id is the
response, others are revisits that refer to it and carry no payload. Only digests are shuffled.

Files go to ``folder``, a URI that executors and driver share. A task attempt writes under a name
of its own and only its result names the file: a repeated attempt leaves an orphan, never a
mixture.

Defined results. html NULL or empty: an empty payload, always a response. A NULL url is left out
of the record. Rows that share the largest id of a payload are all responses; a NULL id is below
all others, and if all are NULL all are responses. Repeated rows make a record each. Payloads of
any length stand whole in one record and frame. An empty table gives no bundle and no rows.
Columns other than id, url and html play no part.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import parts_for, scratch_dir, stored, text_slices
from panelyard.llm.registry import query

LEAST = 1000                    # bytes from which equal payloads are revisits
FRAME_BYTES = 512 * 1024        # raw bytes after which a frame is closed
BUNDLE_BYTES = 128 * 1024**2    # raw bytes after which a bundle is closed
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"   # of a capture whose time is not given
# The public seekable format (fixed values).
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

INDEX = (
    "record_id string, page_id long, bundle string, frame int, frame_start long, frame_size long, "
    "record_start long, record_size long"
)
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    tail = name.rpartition(":")[2].rstrip(">")
    return None if tail == "none" else int(tail)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit if it refers to another. Both hold the HTTP header with
    the full payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        # A line break in a URL would end the header.
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_name(refers_to)}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Fields of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    size = int(head["Content-Length"])
    block = data[end + 4:end + 4 + size]
    split = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(b": ", 1) for line in block[:split - 4].split(b"\r\n")[1:])
    payload = block[split:]
    revisit = head["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    url = head.get("WARC-Target-URI")
    return {
        "page_id": page_of(head["WARC-Record-ID"]), "payload_bytes": int(http[b"Content-Length"]), "payload_digest": digest,
        "record_type": head["WARC-Type"], "refers_to": page_of(head["WARC-Refers-To"]) if revisit else None,
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload": None if revisit else payload,
    }, end + 4 + size + 4


class BundleWriter:
    """One bundle file: frames, then the seek table."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.files, self.path = pafs.FileSystem.from_uri(self.name)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.raw, self.at, self.total = [], 0, 0, 0
        self.waiting, self.index = [], []

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.buffer and self.raw + len(record) > FRAME_BYTES:
            self.close_frame()
        self.waiting.append((record_name(page_id), page_id, self.raw, len(record)))
        self.buffer.append(record)
        self.raw += len(record)
        self.total += len(record)

    def close_frame(self) -> None:
        if not self.buffer:
            return
        data = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.buffer))
        self.out.write(data)
        for name, page_id, start, size in self.waiting:
            self.index.append((name, page_id, self.name, len(self.frames), self.at, len(data), start, size))
        self.frames.append((len(data), self.raw))
        self.at += len(data)
        self.buffer, self.waiting, self.raw = [], [], 0

    def close(self) -> list[tuple]:
        self.close_frame()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.index


def read_at(bundle: str, start: int, size: int) -> bytes:
    files, path = pafs.FileSystem.from_uri(bundle)
    with files.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def seek_table(bundle: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the end of the file."""
    files, path = pafs.FileSystem.from_uri(bundle)
    with files.open_input_file(path) as f:
        end = f.size()
        f.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{bundle} has no seek table")
        f.seek(end - 9 - 8 * count)
        sizes = struct.unpack(f"<{2 * count}I", f.read(8 * count))
    out, start = [], 0
    for packed, raw in zip(sizes[::2], sizes[1::2]):
        out.append((start, packed, raw))
        start += packed
    return out


def rows_table(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def write_task(folder: str):
    names = [f.strip().split(" ")[0] for f in INDEX.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for lo, hi in text_slices([batch.column("html")]):
                part = batch.slice(lo, hi - lo).to_pydict()
                for page_id, url, html, digest, refers_to in zip(*(part[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    writer = writer or BundleWriter(folder)
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    writer.add(page_id, warc_record(page_id, url, payload, digest, refers_to))
                    if writer.total >= BUNDLE_BYTES:
                        yield rows_table(names, types, writer.close())
                        writer = None
        if writer:
            yield rows_table(names, types, writer.close())

    return task


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Write all rows; returns the index (INDEX), one row per record, itself stored."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"),
    )
    # Digests with one response and at least one revisit. Mostly few, and of known size once stored.
    shared = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    shared = stored(shared.filter("n > 1 and top is not null").select("digest", "top"))
    marked = rows.join(shared, "digest", "left").withColumn(
        "refers_to", F.when(F.col("page_id").eqNullSafe(F.col("top")), F.lit(None)).otherwise(F.col("top"))
    )
    return stored(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write_task(folder), INDEX))


def read_task(payloads: bool):
    names = [f.strip().split(" ")[0] for f in RECORD.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                for start, packed, raw in seek_table(bundle):
                    data = zstandard.ZstdDecompressor().decompress(read_at(bundle, start, packed), max_output_size=raw)
                    at, rows = 0, []
                    while at < len(data):
                        record, at = parse_record(data, at)
                        if not payloads:
                            record["payload"] = None
                        rows.append(tuple(record[n] for n in names))
                    yield rows_table(names, types, rows)

    return task


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles an index names (RECORD), each bundle read once."""
    bundles = stored(index.select("bundle").distinct())
    spread = bundles.repartition(parts_for(bundles.count(), 1), "bundle")
    return spread.mapInArrow(read_task(payloads), RECORD)


def fetch_record(index: DataFrame, page_id: int) -> list[dict]:
    """Records of one page by the index: one frame is read for each."""
    out = []
    for row in index.filter(F.col("record_id") == record_name(page_id)).toLocalIterator():
        data = zstandard.ZstdDecompressor().decompress(read_at(row["bundle"], row["frame_start"], row["frame_size"]))
        out.append(parse_record(data[row["record_start"]:row["record_start"] + row["record_size"]])[0])
    return out


@query("""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), t AS (
  SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN t.top IS NULL OR t.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN t.top IS NULL OR t.top = p.page_id THEN NULL ELSE t.top END AS refers_to
FROM p LEFT JOIN t USING (payload_digest)
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to bundles and read back."""
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_dir(spark))
    return read_warc(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
