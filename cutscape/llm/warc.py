"""WARC archives in Zstandard with a dictionary (.warc.zst).

Writing: each partition of pages makes files. A file's first frame is a skippable one (magic 0x184D2A5D) that holds the
file's dictionary, trained on records from all over the file; then each record is one frame of its own, compressed with the
dictionary, with content size and checksum. Of records with equal payloads (of at least `least_bytes`) the one with the
smallest page id is a response, the others are revisits that name it.

Reading: the dictionary comes from the leading skippable frame (itself compressed or not); each frame is decoded alone
to one record, and its version line, required headers, block length and payload digest are validated; a damaged or cut
file raises ValueError.

A null html has an empty payload; a null url is an empty target. Rows are written one by one: repeated rows of the
smallest page id are all responses, and null page ids count as larger than any other. Other columns are not written. An
empty table makes no files. A partition writes a new file after `file_bytes` of payload, so a task holds one file at most.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutscape.llm.common import joined_evenly, written
from cutscape.llm.token_io import put, read_each

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
FILE_BYTES = 48 << 20
#: Size of a file's dictionary, and about that of the records, evenly spread over the file, that train it.
DICTIONARY_BYTES, TRAIN_BYTES = 64 << 10, 4 << 20
DATE = "2020-01-01T00:00:00Z"  # the tables have no capture times


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: object, url: str, payload: bytes, first: object | None) -> bytes:
    """A WARC/1.1 record; first is the page id of the response that a revisit names, None for a response."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"Page-ID: {page_id}", f"Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        block = http + payload
    else:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first)}", f"Refers-To-Page-ID: {first}",
        ]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """One file: the dictionary in a skippable frame, then a frame for each record."""
    samples = records[:: max(1, sum(map(len, records)) // TRAIN_BYTES)]
    held = sum(map(len, samples))
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, held // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few records to train on
        trained = b"".join(samples)[:DICTIONARY_BYTES]
    shared = zstandard.ZstdCompressionDict(trained)
    packed = zstandard.ZstdCompressor(level=3).compress(trained)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True, write_content_size=True)
    head = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
    return b"".join([head, *map(compressor.compress, records)])


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of a file."""
    if len(content) < 8:
        raise ValueError("archive is too short")
    magic, size = struct.unpack_from("<II", content)
    at = 0
    dictionary = None
    if magic == DICTIONARY_MAGIC:
        raw = content[8 : 8 + size]
        if len(raw) < size:
            raise ValueError("cut dictionary frame")
        at = 8 + size
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(content):
        one = unpacker.decompressobj()
        try:
            out = one.decompress(content[at:] if at + WINDOW >= len(content) else content[at : at + WINDOW])
            end = at + WINDOW
            while not one.eof and end < len(content):
                out += one.decompress(content[end : end + WINDOW])
                end += WINDOW
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame at byte {at}: {e}") from e
        if not one.eof:
            raise ValueError(f"cut frame at byte {at}")
        at = min(end, len(content)) - len(one.unused_data)
        yield out


#: Bytes that are handed to the decoder at a time.
WINDOW = 64 << 10

REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def parsed(content: bytes) -> dict:
    """Headers (names in lower case) and block of a decoded frame, which must be exactly one valid record."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError(f"malformed header {line!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ValueError(f"record without {missing}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    block = rest[:-4]
    http, found, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        if not found or not stated or int(stated[1]) != len(payload):
            raise ValueError("response of a wrong payload length")
        digest = headers.get("warc-payload-digest")
        if digest is not None and digest != f"sha1:{payload_digest(payload)}":
            raise ValueError("response with a wrong payload digest")
    elif headers["warc-type"] == "revisit" and "warc-refers-to" not in headers:
        raise ValueError("revisit that names no record")
    return {"headers": headers, "payload": payload}


def with_first(pages: DataFrame, least_bytes: int = 0, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, url, payload, first): first is the smallest id of equal payloads, null for responses."""
    body = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    own = pages.select(F.col(id).alias("_id"), F.col("url").alias("_url"), body.alias("_body"))
    own = own.withColumn("_sha", F.sha1("_body")).withColumn("_len", F.octet_length("_body"))
    # Narrow rows only: a payload's digest and length stand for it; a hot digest is reduced before it is shuffled.
    key = own.select("_id", "_sha", "_len").filter(F.col("_len") >= least_bytes)
    firsts = key.groupBy("_sha", "_len").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    told = joined_evenly(own, firsts, ["_sha", "_len"], "_n", pages.count())
    return told.select("_id", "_url", "_body", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_first"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; returns (file, records), a row for each file."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, made, held, n = uuid.uuid4().hex, [], 0, 0
        for batch in batches:
            for key, url, body, first in zip(batch["_id"], batch["_url"], batch["_body"], batch["_first"]):
                key, first = (None if pd.isna(x) else int(x) for x in (key, first))
                made.append(record("" if key is None else key, url or "", body, first))
                held += len(body)
                if held >= file_bytes:
                    yield pd.DataFrame({"file": [put(folder, f"{attempt}-{n:05d}.warc.zst", archive(made))], "records": [len(made)]})
                    made, held, n = [], 0, n + 1
        if made:
            yield pd.DataFrame({"file": [put(folder, f"{attempt}-{n:05d}.warc.zst", archive(made))], "records": [len(made)]})

    return written(with_first(pages, least_bytes).mapInPandas(write, "file string, records bigint"), "warc-files")


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of the files."""
    schema = RECORD if with_payload else T.StructType(RECORD.fields[:-1])

    def read(content: bytes, _) -> pd.DataFrame:
        rows = []
        for frame in frames(content):
            r = parsed(frame)
            h = r["headers"]
            number = lambda name, h=h: int(h[name]) if h.get(name) else None
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
            rows.append((number("page-id"), h.get("warc-target-uri"), h["warc-type"], number("payload-length"), digest, number("refers-to-page-id"), r["payload"]))
        out = pd.DataFrame(rows, columns=RECORD.names).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})
        return out if with_payload else out.drop(columns="payload")

    return read_each(files.select("file"), read, schema)
