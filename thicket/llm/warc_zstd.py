"""WARC archives in Zstandard with a dictionary of their own, written and read by Spark's file sources.

An archive is a skippable frame that holds the dictionary, then a frame for each record.  Spark's text writer puts a
separator behind each row; here it is an empty skippable frame, which readers of Zstandard pass over.  So archives go to
any file system that Spark writes to, under its commit protocol.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir

# Fixed values of the formats: magic numbers of skippable frames and of data frames, in little-endian order.
DICTIONARY_MAGIC, EMPTY_FRAME = struct.pack("<I", 0x184D2A5D), struct.pack("<II", 0x184D2A50, 0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 1000
#: Bytes of a dictionary, bytes of an archive's first records that it is built from, and the Zstandard level.
DICTIONARY_BYTES, TRAINING_BYTES, LEVEL = 32 << 10, 1 << 20, 3
#: An archive is closed once its frames have so many bytes.
ARCHIVE_BYTES = 64 << 20

RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def _name(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def _page(uri: bytes | None) -> int | None:
    name = uri.decode().strip("<>").rpartition(":")[2] if uri else "none"
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_name(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_name(refers_to)}>"]
    return "\r\n".join([*lines, "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[bytes, bytes], int, bytes]:
    """WARC header, payload length by the HTTP header, and the payload that the record has."""
    head, _, rest = data.partition(b"\r\n\r\n")
    header = dict(_HEADER.findall(head + b"\r\n"))
    block = rest[: int(header[b"Content-Length"])]
    if len(block) != int(header[b"Content-Length"]) or not head.startswith(b"WARC/1."):
        raise ValueError("a record is cut off or is none")
    http, _, payload = block.partition(b"\r\n\r\n")
    return header, int(dict(_HEADER.findall(http + b"\r\n"))[b"Content-Length"]), payload


def dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary of these records; of few or tiny ones, which cannot be trained on, their bytes as they are."""
    whole = b"".join(records)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, len(whole) // 8)), records, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return whole[-DICTIONARY_BYTES:]


def dictionary_frame(data: bytes) -> bytes:
    return DICTIONARY_MAGIC + struct.pack("<I", len(data)) + data


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    if data[:4] != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    size = struct.unpack_from("<I", data, 4)[0]
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest = memoryview(data)[8 + size :]
    while len(rest):
        if rest[:4] == EMPTY_FRAME[:4]:
            rest = rest[8 + struct.unpack_from("<I", rest, 4)[0] :]
            continue
        frame = unpack.decompressobj()
        out = frame.decompress(rest)
        if not frame.eof:
            raise ValueError("an archive is cut off")
        yield out
        rest = rest[len(rest) - len(frame.unused_data) :]


def _archived(rows: Iterator[tuple], date: str) -> Iterator[tuple[str, int, bytes]]:
    """(archive, place, frame) for rows of a page; holds TRAINING_BYTES of records at most, until the dictionary is built."""
    task, n, place, size, waiting, pack = TaskContext.get().partitionId(), 0, 0, 0, [], None

    def begin() -> Iterator[tuple[str, int, bytes]]:
        nonlocal pack, place, size, waiting
        data = dictionary(waiting)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True).compress
        for frame in [dictionary_frame(data), *map(pack, waiting)]:
            yield f"{task:06d}-{n:04d}", place, frame
            place, size = place + 1, size + len(frame)
        waiting = []

    held = 0
    for row in rows:
        made = record(*row, date)
        if pack is None:
            waiting.append(made)
            held += len(made)
            if held >= TRAINING_BYTES:
                yield from begin()
        else:
            frame = pack(made)
            yield f"{task:06d}-{n:04d}", place, frame
            place, size = place + 1, size + len(frame)
        if pack is not None and size >= ARCHIVE_BYTES:
            pack, n, place, size, held = None, n + 1, 0, 0, 0
    if waiting:
        yield from begin()


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of (page_id, url, html) to archives ``archive=.../part-*`` below `path`.

    Of records with equal payloads of MIN_REVISIT_BYTES at least, that with the largest page_id is the response, and the
    others are revisits that refer to it; smaller payloads are all responses.  Payloads are equal if their length, SHA-1
    and SHA-256 are.  The leader of each payload comes from a partial aggregation and is joined back, so a payload that a
    third of all pages share is spread by the skew-aware join; pages are shuffled once.

    Null html is an empty payload.  Rows that share the largest page_id are all responses, and so are copies of which
    none has an id; else a null page_id is never the leader.  A null url is written as about:blank.  An empty table gives
    an empty folder.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sized = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    sized = sized.select("*", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha2"))
    leads = sized.filter(F.col("n") >= MIN_REVISIT_BYTES).groupBy("n", "sha1", "sha2").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("copies"))
    leads = leads.filter("copies > 1 and leader is not null").drop("copies")
    rows = sized.join(leads, ["n", "sha1", "sha2"], "left")
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    rows = rows.select("page_id", "url", "payload", "sha1", "leader", revisit.alias("revisit"))
    schema = pa.schema([("archive", pa.string()), ("place", pa.int32()), ("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages_of = ((c.as_py() for c in row) for batch in batches for row in zip(*batch.columns))
        out: list[tuple] = []
        size = 0
        for found in _archived(pages_of, date):
            out.append(found)
            size += len(found[2])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    frames = rows.mapInArrow(run, "archive string, place int, frame binary").sortWithinPartitions("archive", "place")
    framed = frames.select("archive", F.col("frame").cast("string").alias("value"))
    framed.write.partitionBy("archive").option("lineSep", EMPTY_FRAME.decode("ascii")).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RESULT for each record of the archives below `path`.

    payload_bytes and payload_digest are of the full payload, for revisits as the record states them; those of a response
    are checked against its payload.  Records come as they were written, repeated ones too; an empty folder gives none.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(data: bytes) -> Iterator[tuple]:
        for header, n, payload in map(parse, read_archive(data)):
            kind = header[b"WARC-Type"].decode()
            sha1 = base64.b32decode(header[b"WARC-Payload-Digest"].removeprefix(b"sha1:"))
            if kind == "response" and (len(payload) != n or hashlib.sha1(payload).digest() != sha1):
                raise ValueError("a payload is not what its record states")
            yield _page(header[b"WARC-Record-ID"]), n, sha1.hex(), kind, _page(header.get(b"WARC-Refers-To"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = list(rows(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RESULT)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: RESULT for each row.  See `write_archives`."""
    path = shared_dir(pages.sparkSession)
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
