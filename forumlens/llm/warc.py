"""WARC archives with a shared Zstandard dictionary.

An archive is a skippable frame that holds the dictionary, then every record as a frame of its own. Archives are written
by Spark's text writer, whose committer survives lost tasks on any file system: a row is a frame, and the line separator
is an empty skippable frame, which Zstandard readers pass over. Every archive can be read alone.

Records of equal payloads: the one with the largest page id is a response, the others are revisits that refer to it and
hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlens.sources.snapshots import materialize

# The dictionary: its size, about how many records it is trained on, how many bytes of one record, and the level of records.
# The sample is four times the records at most, so the driver never holds more than 64 MB of it.
DICTIONARY_BYTES = 112_640
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 1 << 14
LEVEL = 6
_STEPS = 1 << 30

# Fixed values of the formats: the skippable frame of a dictionary, an empty skippable frame, the profile of revisits.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL_SIGNS = "!#$%&'()*+,/:;=?@[]~"


def _id(page: int | None) -> str:
    return f"<urn:page:{page}>"


def _record(kind: str, page: int | None, url: str | None, date: str, digest: str, size: int, payload: bytes, more: str) -> bytes:
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    )
    # White space and signs that no address may have are percent-encoded; a page without an address is named by its id.
    target = quote(url, safe=URL_SIGNS) if url else f"urn:page:{page}"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_id(page)}\r\nWARC-Date: {date}\r\n"
        f"WARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    )
    return head.encode() + http + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, page: str, url: str, html: str, date: str) -> bytes:
    """A dictionary from about ``SAMPLE_RECORDS`` records as they are archived, chosen by the hash of the page id.

    A record gives its first ``SAMPLE_BYTES`` bytes, header included. Where the sample is too small to train on, its bytes are
    the dictionary; without any record there is none.
    """
    share = min(_STEPS, SAMPLE_RECORDS * _STEPS // max(1, pages.count()) + 1)
    chosen = pages.where(F.pmod(F.xxhash64(page, F.lit("dictionary")), F.lit(_STEPS)) < share)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    chosen = chosen.limit(4 * SAMPLE_RECORDS).select(
        F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.sha1(payload).alias("hex"),
        F.octet_length(payload).alias("size"), F.substring(payload, 1, SAMPLE_BYTES).alias("payload"),
    )
    samples = [
        _record("response", row.page, row.url, date, _base32(row.hex), row.size, bytes(row.payload), "")[:SAMPLE_BYTES]
        for row in chosen.collect()
    ]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known)


def write_archives(
    pages: DataFrame, directory: str, page: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write a record for every row into archives in ``directory``, which must be new.

    The payload is the HTML in UTF-8, NULL is empty. Rows that repeat page id and payload are the same capture and get
    the same kind. A NULL page id is below all others. NULL and odd addresses are made valid. An empty table writes no record.
    Other columns are left out. Payloads are compressed where they are scanned; what may shuffle, to meet the largest page id of
    equal payloads, are compressed records, and only if there are repeated payloads too many to broadcast.
    """
    dictionary = train_dictionary(pages, page, url, html, date)
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page).cast("long").alias("page"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("hex")
    )
    repeated = rows.groupBy("hex").agg(F.max("page").alias("first"), F.count("*").alias("records"))
    repeated = materialize(repeated.where(F.col("records") > 1).select("hex", "first"))

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressor(shared.value).compress
        for batch in batches:
            columns = [batch.column(name) for name in ("page", "url", "payload", "hex")]
            sizes, frames = [], []
            for number, address, body, digest in zip(*columns):
                body = body.as_py()
                made = _record(
                    "response", number.as_py(), address.as_py(), date, _base32(digest.as_py()), len(body), body, ""
                )
                sizes.append(len(body))
                frames.append(compress(made))
            yield pa.RecordBatch.from_arrays(
                [columns[0], columns[1], columns[3], pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())],
                names=["page", "url", "hex", "size", "frame"],
            )

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressor(shared.value).compress
        begun = not shared.value
        for batch in batches:
            frames = []
            if not begun and batch.num_rows:
                frames.append(DICTIONARY_MAGIC + struct.pack("<I", len(shared.value)) + shared.value)
                begun = True
            columns = [batch.column(name) for name in ("page", "url", "hex", "size", "first", "frame")]
            for row in zip(*columns):
                number, address, digest, size, first = (value.as_py() for value in row[:-1])
                if first is None or first == number:
                    frames.append(row[-1].as_py())
                else:
                    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_id(first)}\r\n"
                    frames.append(compress(_record("revisit", number, address, date, _base32(digest), size, b"", more)))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    records = rows.mapInArrow(compressed, "page long, url string, hex string, size long, frame binary")
    known = records.join(repeated, "hex", "left").select("page", "url", "hex", "size", "first", "frame")
    frames = known.mapInArrow(archived, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(directory)


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an archive."""
    known = None
    if content[:4] == DICTIONARY_MAGIC:
        (size,) = struct.unpack_from("<I", content, 4)
        known, content = zstandard.ZstdCompressionDict(content[8 : 8 + size]), content[8 + size :]
    reader = zstandard.ZstdDecompressor(dict_data=known).stream_reader(io.BytesIO(content), read_across_frames=True)
    lines = io.BufferedReader(reader, 1 << 18)
    while lines.readline():  # the version
        fields = dict(_fields(lines))
        block = lines.read(int(fields["content-length"]))
        lines.read(4)
        yield fields, block


def _fields(lines) -> Iterator[tuple[str, str]]:
    while (line := lines.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(":")
        yield name.strip().lower(), value.strip()


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    """Records as ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` (NULL for revisits).

    Sizes and digests of responses are those of the payload as read, those of revisits are what the record says of the
    payload it refers to.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def page_of(name: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return int(found[1]) if found else None

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for fields, block in _records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    whole = fields["warc-type"] == "response"
                    if whole:
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((
                        page_of(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"],
                        page_of(fields.get("warc-refers-to")), payload.decode() if whole else None,
                    ))
                    held += len(payload)
                    if held > 1 << 24:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
                yield _batch(rows, names, kinds)

    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "payload string"
    )
    files = spark.read.format("binaryFile").load(directory).select("content")
    return files.mapInArrow(of_batches, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
