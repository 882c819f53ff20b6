"""WARC archives in Zstandard frames with a shared dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then each
record is one frame of its own, so records can be decoded apart. Equal payloads are stored once:
the others become revisit records. Between records stands an empty skippable frame, which any
Zstandard reader passes over. Readers check frame sizes, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.llm.common import materialize, n_bytes, partitions, read_files, scratch, shuffles, write_frames

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame; its eight bytes are ASCII.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
LEVEL = 3
#: Pages whose text the dictionary is trained on, at most, and bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 16_384, 32_768

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that doesn't hold what its headers say."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    digest, kind = base32_sha1(payload), "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_DIGEST = re.compile("sha1:[A-Z2-7]{32}")


def _number(text: str | None, name: str) -> int:
    if text is None or not re.fullmatch("[0-9]+", text):
        raise WarcError(f"{name} is no length: {text!r}")
    return int(text)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (lower-case names) and payload, with its lengths and digests checked.

    A revisit has no payload; its length and digest are those of the record that it refers to, and
    the length has to be the one that its HTTP header declares.
    """
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header without a colon: {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    length = _number(headers["content-length"], "Content-Length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, {length} are declared")
    block = rest[:length]
    for name in ("warc-block-digest", "warc-payload-digest"):
        if name in headers and not _DIGEST.fullmatch(headers[name]):
            raise WarcError(f"{name} is no digest: {headers[name]!r}")
    if headers.get("warc-block-digest", digest := f"sha1:{base32_sha1(block)}") != digest:
        raise WarcError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] in ("response", "revisit"):
        found = re.search(rb"(?im)^content-length: *([^\r\n]*?) *\r?$", http)
        declared = _number(found and found[1].decode(errors="replace"), "the payload's Content-Length")
        if "x-payload-length" in headers and _number(headers["x-payload-length"], "X-Payload-Length") != declared:
            raise WarcError(f"a payload of {headers['x-payload-length']} bytes, its HTTP header has {declared}")
        if "warc-payload-digest" not in headers:
            raise WarcError("warc-payload-digest is missing")
        if headers["warc-type"] == "revisit":
            if payload:
                raise WarcError("a revisit has a payload")
        elif declared != len(payload) or headers["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise WarcError("payload differs from its length or digest")
    return headers, payload


def skippable(data: bytes, magic: int = DICTIONARY_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def frame_size(data: memoryview) -> int:
    """Bytes of the Zstandard frame at the start of ``data``, from its block headers."""
    if len(data) < 6:
        raise WarcError("a frame is cut off")
    flags = data[4]
    single, at = flags >> 5 & 1, 5
    at += (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise WarcError("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise WarcError("a frame is cut off")
    return at


def unpack(reader: zstandard.ZstdDecompressor, frame: bytes | memoryview) -> bytes:
    """What a frame holds, whether or not its header has the size."""
    unpacker = reader.decompressobj()
    try:
        out = unpacker.decompress(frame)
    except zstandard.ZstdError as e:
        raise WarcError(f"a frame is damaged: {e}") from None
    if not unpacker.eof:
        raise WarcError("a frame is cut off")
    return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame at a time."""
    view, at = memoryview(data), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise WarcError("an archive is cut off")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise WarcError("a skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                held = bytes(view[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                    held = unpack(zstandard.ZstdDecompressor(), held)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            size = frame_size(view[at:])
            yield parse(unpack(reader, view[at : at + size]))
            at += size
        else:
            raise WarcError(f"neither a frame nor a skippable frame at {at}")


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; where they are too few, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or record(0, "http://", b"<html></html>", None, False)


def _writer(dictionary: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        out, held = [skippable(dictionary)], 0
        for b in batches:
            ids, urls, pages, first = (b.column(n) for n in ("page_id", "url", "html", "first_id"))
            for i in range(b.num_rows):
                page, to, has = ids[i].as_py(), first[i].as_py(), pages[i].as_py()
                revisit = to is not None and page != to
                frame = packer.compress(record(page, urls[i].as_py(), (has or "").encode("utf-8", "surrogatepass"), to, revisit))
                out.append(frame)
                held += len(frame)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out, held = [], 0
        if held or len(out) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return write


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; null html: empty).

    Of equal payloads the one with the largest page_id is stored, the others refer to it. Null
    ids are below all others; rows that share payload and page_id are each a response. Payloads of
    any length are one frame each. Extra columns are ignored, whatever their names; an empty table
    gives no archive.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url"), "html").withColumn("digest", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    same = rows.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = materialize(same.select("digest", "first_id"), "payloads")
    sample = rows.filter("html is not null").select("page_id", F.col("url"), F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE_PAGES).collect()
    dictionary = train([record(r.page_id, r.url, r.html.encode("utf-8", "surrogatepass"), None, False) for r in sample])
    with shuffles(spark, partitions(spark, n_bytes(pages, "html"))):
        joined = rows.join(same, "digest", "left").select("page_id", "url", "html", "first_id")
        write_frames(joined.mapInArrow(_writer(dictionary), "frame binary"), path, SEPARATOR)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())])
    for b in batches:
        for content in b.column(1):
            rows, held = [], 0
            for h, payload in records(content.as_py()):
                number = lambda k, h=h: int(h[k]) if k in h else None
                revisit = h["warc-type"] == "revisit"
                rows.append((number("x-page-id"), h.get("warc-target-uri"), number("x-payload-length"), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number("x-refers-to-page-id"), h["warc-record-id"], None if revisit else payload))
                held += len(payload)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``; a revisit has no payload of its own."""
    return read_files(spark, path).mapInArrow(_reader, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return what they hold, read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
