"""Dictionary-compressed WARC archives through Spark's own writers and readers (operator 6)."""

from __future__ import annotations

import base64
import hashlib
import math
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm._common import pick

#: Skippable frames of the Zstandard format: one holds the dictionary, an empty one ends each record. The bytes of the
#: empty frame are ASCII, so it can be the line separator of Spark's text writer.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
_SEP = SEPARATOR.encode()
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _record_id(page, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}:{copy}')}>"


def record(page, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str, copy: int) -> bytes:
    """One WARC/1.1 record with its block; a revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join((url or f"urn:page:{page}").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"Page-Id: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archive(level: int, date: str, dictionary_bytes: int, sample_bytes: int):
    def run(batches):
        def records():
            last, copy = object(), 0
            for b in batches:
                for page, url, html, sha, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "first")), strict=True):
                    copy = copy + 1 if (page, sha) == last else 0
                    last = (page, sha)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    yield record(page, url, html.encode(), digest, first, copy > 0 or page != first, date, copy)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

        stream, sample, size = records(), [], 0
        for r in stream:
            sample.append(r)
            size += len(r)
            if size >= sample_bytes:
                break
        if not sample:
            return
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, [r[:65536] for r in sample], k=256, d=8)
        except zstandard.ZstdError:  # too few or too small records: their own bytes serve as a plain dictionary
            trained = zstandard.ZstdCompressionDict(b"".join(sample)[-dictionary_bytes:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = trained.as_bytes()
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
        yield out([DICTIONARY_MAGIC + len(raw).to_bytes(4, "little") + raw])
        rows, held = [], 0
        for part in (sample, stream):
            for r in part:
                rows.append(zip_.compress(r))
                held += len(rows[-1])
                if held > 1 << 20:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    return run


def write_warc(pages: DataFrame, path: str, archive_bytes: int = 32 << 20, level: int = 3, date: str = "2020-01-01T00:00:00Z") -> None:
    """Archive every row of pages (page_id, url, html) below ``path``, in files of about ``archive_bytes`` of payload.

    Each file is a Zstandard stream that any decoder reads: a leading skippable frame with a dictionary trained on the
    file's own first records (a bounded sample: 1 MB), then one frame per record, each followed by an empty skippable
    frame. Files are made by Spark's text writer and so get its commit protocol on any file system Spark can reach.

    Of rows with equal payloads the one of largest page_id is the response, the others are revisits. That is decided on
    digests alone, with one maximum per digest that combines before the shuffle; payloads travel once, dealt out by
    page and digest, so a payload in a third of the pages is spread evenly.

    Nulls and edge cases: a null html is an empty payload; a null page_id counts as smaller than any other; of rows
    equal in page_id and payload one is the response (if the page is), the others revisit it; a null url becomes a URN.
    """
    src = pick(pages, page_id="page_id", url="url", html="html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("sha", F.sha1("html")).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    total = src.agg(F.sum(F.octet_length("html").cast("long")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / archive_bytes))
    slim = src.select("page_id", "sha", "key")
    first = slim.groupBy("sha").agg(F.max("page_id").alias("first"))
    info = slim.groupBy("key", "sha").agg(F.max("page_id").alias("own")).join(first, "sha").select("key", "sha", "first")
    rows = src.repartition(n, "key", "sha").join(info.repartition(n, "key", "sha").hint("merge"), ["key", "sha"])
    # the merge join leaves rows of one page and digest next to each other
    rows = rows.sortWithinPartitions("key", "sha")
    frames = rows.select("page_id", "url", "html", "sha", "first").mapInArrow(_archive(level, date, 16 << 10, 1 << 20), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frames(data: bytes):
    """Contents of the frames of one archive; the leading skippable frame is the dictionary of the others."""
    at, view, zip_ = 0, memoryview(data), zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if magic[1:] == b"\x2a\x4d\x18" and 0x50 <= magic[0] <= 0x5F:
            if magic == DICTIONARY_MAGIC:
                zip_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        one, parts = zip_.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + 16384]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """The header fields (lower-case names) and the block of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    out["block"] = rest[: int(out["content-length"])]
    return out


_ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows(with_payload: bool):
    def run(batches):
        for b in batches:
            for data in b.column("content"):
                rows, held = [], 0
                for raw in frames(data.as_py()):
                    r = parse(raw)
                    http, _, payload = r["block"].partition(b"\r\n\r\n")
                    page = int(r["page-id"]) if "page-id" in r else None
                    if r["warc-type"] == "response":
                        size, digest = len(payload), base32_sha1(payload)
                        if f"sha1:{digest}" != r["warc-payload-digest"]:
                            raise ValueError(f"record {r['warc-record-id']} does not have the payload of its digest")
                    else:
                        size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                        digest = r["warc-payload-digest"].partition(":")[2]
                    refers = int(r["refers-to-page-id"]) if "refers-to-page-id" in r else None
                    rows.append((page, r["warc-target-uri"], size, digest, r["warc-type"], refers, payload if with_payload else None))
                    held += len(payload) if with_payload else 100
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and payload (null for revisits, or without ``with_payload``). The size and digest of a response are taken
    from its payload as read, those of a revisit from its headers."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_rows(with_payload), _ROW)
