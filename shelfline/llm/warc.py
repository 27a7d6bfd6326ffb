"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes one archive. It trains a dictionary on the payloads of its first batch (at most
``TRAIN_RECORDS``, a bounded sample) and puts it into a skippable frame; then every record is a frame of its own
that states its content size and checksum. Spark's text writer stores the frames, with an empty skippable frame
as line separator, so archives go to any file system that Spark writes to, with its task commit.

Reading: files come through Spark's binary source. The dictionary is loaded, frames are walked by their block
headers, each is decoded on its own, and version line, mandatory fields, content length, record end, HTTP length
and payload digest are validated; a violation raises ``ValueError`` naming file and position.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a response,
the others revisit it and keep the HTTP header, whose Content-Length is that of the full payload.

Defined results: a null html is an empty payload; a null url gives an empty target ``urn:x-none:``; control
characters and spaces of urls are percent-encoded. A null page_id is smaller than any other and gives a revisit
(or, if no row of the group has an id, responses). Rows that repeat id and payload are alike. An empty table
gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import scratch_dir

FRAME = 0xFD2FB528
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: An empty skippable frame, all of it ASCII: the separator between records.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
TRAIN_RECORDS = 200
DICTIONARY_BYTES = 16_384
DATE = "2024-01-01T00:00:00Z"
MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = quote(url, safe="!#$%&'()*+,-./:;=?@[]_~") if url else "urn:x-none:"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {_page_urn(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_page_urn(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the start of a sample where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of one archive, in order."""
    compressor = None
    for batch in batches:
        out = []
        ids, urls, payloads, keeps, revisits = (c.to_pylist() for c in batch.columns)
        if compressor is None and batch.num_rows:
            words = train_dictionary(payloads[:TRAIN_RECORDS])
            out.append(struct.pack("<II", DICTIONARY_FRAME, len(words)) + words)
            compressor = zstandard.ZstdCompressor(
                level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True
            )
        for page_id, url, payload, keep, revisit in zip(ids, urls, payloads, keeps, revisits, strict=True):
            out.append(compressor.compress(record_bytes(page_id, url, payload, payload_digest(payload), keep, revisit)))
        yield pa.record_batch([pa.array(out, pa.binary())], names=["frame"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One archive per task below ``path`` from rows with page_id, url and html."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("payload"),
        F.sha1(html).alias("sha"),
        F.octet_length(html).alias("size"),
    )
    groups = (
        rows.filter(F.col("size") >= least_bytes)
        .groupBy("sha", "size")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("keep"))
        .filter("n > 1")
        .drop("n")
    )
    marked = rows.join(groups, ["sha", "size"], "left").select(
        "page_id",
        "url",
        "payload",
        "keep",
        (F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))).alias("revisit"),
    )
    marked.mapInArrow(_frames, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def _frame_end(data: memoryview, at: int, name: str) -> int:
    """Position after the frame that starts at ``at``, from its block headers."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError(f"{name}: truncated frame at {at}")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * params.has_checksum
    if at > len(data):
        raise ValueError(f"{name}: truncated frame")
    return at


def records_of(content: bytes, name: str = "archive") -> Iterator[bytes]:
    """The records of one archive, each decoded from its own frame."""
    data, at, decoder = memoryview(content), 0, zstandard.ZstdDecompressor()
    seen_record = False
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"{name}: stray bytes at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + size
            if end > len(data):
                raise ValueError(f"{name}: truncated skippable frame at {at}")
            if magic == DICTIONARY_FRAME and not seen_record and size:
                words = bytes(data[at + 8 : end])
                if words[:4] == struct.pack("<I", FRAME):
                    words = zstandard.ZstdDecompressor().decompress(words)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at = end
            continue
        if magic != FRAME:
            raise ValueError(f"{name}: no frame at {at}")
        end = _frame_end(data, at, name)
        frame = data[at:end]
        size = zstandard.frame_content_size(frame)
        if size < 0:
            raise ValueError(f"{name}: frame at {at} states no content size")
        try:
            record = decoder.decompress(frame) if size else b""
        except zstandard.ZstdError as problem:
            raise ValueError(f"{name}: frame at {at}: {problem}") from problem
        if len(record) != size:
            raise ValueError(f"{name}: frame at {at} has {len(record)} bytes, not {size}")
        seen_record = True
        yield record
        at = end


def _fields(head: bytes, where: str) -> dict[bytes, bytes]:
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"{where}: no header field: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    return fields


def _page_of(urn: bytes, where: str) -> int | None:
    m = re.fullmatch(rb"<urn:x-page:(-?\d*)>", urn)
    if not m:
        raise ValueError(f"{where}: unknown record id {urn[:80]!r}")
    return int(m[1]) if m[1] else None


def parse_record(record: bytes, where: str = "record") -> dict | None:
    """Fields of a validated response or revisit record; None for other types."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"{where}: not a WARC record: {version[:40]!r}")
    fields = _fields(head, where)
    if missing := [n for n in MANDATORY if n not in fields]:
        raise ValueError(f"{where}: lacks {missing}")
    length = int(fields[b"content-length"]) if fields[b"content-length"].isdigit() else -1
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{where}: content length {fields[b'content-length']!r}, but {len(rest) - 4} bytes follow")
    kind = fields[b"warc-type"]
    if kind not in (b"response", b"revisit"):
        return None
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    status, _, http_head = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError(f"{where}: no HTTP header")
    stated = int(_fields(http_head, where)[b"content-length"])
    digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii")
    if kind == b"response":
        if stated != len(payload):
            raise ValueError(f"{where}: HTTP length {stated}, but {len(payload)} bytes")
        if payload_digest(payload) != digest:
            raise ValueError(f"{where}: payload digest differs")
    elif payload:
        raise ValueError(f"{where}: a revisit with a payload")
    refers = fields.get(b"warc-refers-to")
    return {
        "page_id": _page_of(fields[b"warc-record-id"], where),
        "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": kind.decode("ascii"),
        "refers_to": _page_of(refers, where) if refers is not None else None,
        "payload": payload,
    }


_RECORD_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)
_BATCH_BYTES = 16 << 20


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for k, record in enumerate(records_of(content.as_py(), name)):
                    fields = parse_record(record, f"{name}, record {k}")
                    if fields is None:
                        continue
                    if not with_payload:
                        fields["payload"] = None
                    rows.append(fields)
                    held += len(fields["payload"] or b"") + 200
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Response and revisit records of all archives below ``path``; any violation fails the job."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder and read back, without payloads."""
    path = scratch_dir(pages.sparkSession, "archives")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path, with_payload=False).drop("payload", "url")
