"""Zstandard WARC archives: written with a dictionary in front, read back one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, save

#: Fixed values of the formats: the skippable frame that holds a dictionary, other skippable frames, a data frame.
DICTIONARY_MAGIC, SKIP_FIRST, SKIP_LAST, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0x184D2A5F, 0xFD2FB528
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Spark's text writer ends each row with a line feed; a skippable frame of one byte takes it in.
LINE_END = struct.pack("<II", SKIP_FIRST, 1)
#: Bytes of records from which an archive's dictionary is trained, the dictionary's size, and bytes a row of the writer holds.
SAMPLE, DICTIONARY, CHUNK = 1 << 20, 16 << 10, 1 << 20
#: Chunks after which a new archive begins, so that a reader can hold one: about 128 MB, or one longer record.
ARCHIVE = 128


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is the payload's, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for an archive, or none where its records are too few or too small for one."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICTIONARY:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes], most: int = 1 << 62) -> Iterator[bytes]:
    """The bytes of one archive in chunks: the dictionary of its first records, then a frame per record.

    Ends after `most` chunks (three at least) and leaves the other records to the next archive.
    """
    head: list[bytes] = []
    size = 0
    for r in records:
        head.append(r)
        size += len(r)
        if size >= SAMPLE:
            break
    if not head:
        return
    chosen = trained(head)
    out = b""
    if chosen:
        content = zstandard.ZstdCompressor(level=10).compress(chosen.as_bytes())
        out = struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content
    compressor = zstandard.ZstdCompressor(level=3, dict_data=chosen, write_checksum=True)
    parts, size, made = [out], len(out), 0
    for source in (head, records):
        for r in source:
            parts.append(compressor.compress(r))
            size += len(parts[-1])
            if size >= CHUNK:
                yield b"".join(parts)
                parts, size, made = [], 0, made + 1
                if made >= max(3, most):
                    return
    if parts:
        yield b"".join(parts)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunks: int = ARCHIVE) -> None:
    """Writes one record per page into archives under `path`, of at most `chunks` chunks of CHUNK bytes each.

    Of pages with the same payload of at least `min_bytes` bytes, the one with the smallest id is a
    response and the others are revisits of it; shorter ones are all responses. (digest, smallest
    id) of repeated payloads is joined to the pages, a payload of very many pages in several parts. The files go through Spark's own writer, so
    the path can be on any store and a lost task is written again.

    A null payload is an empty one, a null URL becomes urn:page:<id>, and a page without id is a
    response. Rows that repeat the smallest id are responses too.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("_sha1"))
    repeated = rows.where(F.length("payload") >= min_bytes).groupBy("_sha1").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    marked = join_skewed(rows, save(repeated), ["_sha1"], "_n", "page_id", "left").select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"))

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, data, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                    page, url, first = page.as_py(), url.as_py(), first.as_py()
                    kind = "response" if first is None else "revisit"
                    uri = f"urn:page:{page}" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~ ").strip()
                    yield record(kind, f"urn:page:{page}", uri, data.as_py(), f"urn:page:{first}", date)

        rest = records()
        while (first := next(rest, None)) is not None:
            for chunk in frames(chain([first], rest), chunks):
                yield pa.RecordBatch.from_arrays([pa.array([chunk + LINE_END], pa.binary())], ["chunk"])

    # a row is a chunk, so the writer begins a file where an archive begins
    marked.mapInArrow(archived, "chunk binary").select(F.col("chunk").cast("string").alias("value")).write.option("maxRecordsPerFile", max(3, chunks)).text(path)


def archive_frames(data: bytes) -> Iterator[bytes]:
    """The content of each data frame of an archive, decoded with the dictionary in front if there is one."""
    decompressor, at, view = zstandard.ZstdDecompressor(), 0, memoryview(data)
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError(f"{len(data) - at} bytes after the last frame")
        magic = struct.unpack_from("<I", data, at)[0]
        if SKIP_FIRST <= magic <= SKIP_LAST:
            if at + 8 > len(data) or at + 8 + (size := struct.unpack_from("<I", data, at + 4)[0]) > len(data):
                raise ValueError(f"skippable frame at {at} is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                content = bytes(view[8 : 8 + size])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):
                    content = zstandard.ZstdDecompressor().decompress(content)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        frame, parts = decompressor.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(data):
                    raise ValueError("the last frame is cut off")
                part = view[at : at + 16384]
                parts.append(frame.decompress(part))
                at += len(part)
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame before {at}: {e}") from e
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; ValueError unless its frame holds just that record, whole and well formed."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line or header end")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.strip()] = value.strip()
    for name in REQUIRED:
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["Content-Length"].isdigit() or int(headers["Content-Length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    return headers, rest[:-4]


def page_of(data: bytes) -> dict:
    """A record's fields, with its payload checked against the lengths and the digest it states."""
    headers, block = parse_record(data)
    kind = headers["WARC-Type"]
    http, sep, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^Content-Length:\s*(\d+)\s*$", http)
    if not sep or not stated:
        raise ValueError("no HTTP header with a length")
    size = int(stated[1])
    sha = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or not re.fullmatch("[A-Z2-7]{32}", sha) or "WARC-Refers-To" not in headers):
        raise ValueError("a revisit needs a digest and a reference, and no payload")
    number = lambda s: None if s.endswith(":null") or s.endswith(":None") else int(s.rpartition(":")[2].rstrip(">"))
    return {
        "page_id": number(headers["WARC-Record-ID"].rstrip(">")),
        "payload_bytes": size,
        "payload_digest": sha,
        "record_type": kind,
        "refers_to": number(headers["WARC-Refers-To"].rstrip(">")) if kind == "revisit" else None,
        "url": headers.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, error of every record.

    Each archive is read whole by one task and its records are given on in small batches. A record
    that fails a check stops the job; with strict=False it becomes a row with the reason in `error`,
    and what follows a broken frame in its archive is one such row. A revisit has no payload.
    """
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string())]
    schema = pa.schema(fields)

    def rows(name: str, data: bytes) -> Iterator[dict]:
        found = archive_frames(data)
        while True:
            try:
                frame = next(found, None)
                if frame is None:
                    return
            except ValueError as e:
                if strict:
                    raise ValueError(f"{name}: {e}") from e
                yield {"error": str(e)}
                return
            try:
                yield page_of(frame)
            except ValueError as e:
                if strict:
                    raise ValueError(f"{name}: {e}") from e
                yield {"error": str(e)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                held, size = [], 0
                for r in rows(name.as_py(), content.as_py()):
                    held.append(r)
                    size += r.get("payload_bytes") or 0
                    if size >= 4 * CHUNK or len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string")
