"""WARC archives whose records are compressed one by one against an embedded dictionary.

An archive is a skippable Zstandard frame that holds the dictionary, then one frame
per record: a ``warcinfo`` record, and a ``response`` or ``revisit`` for each page.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from itertools import chain, groupby
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, new_folder, written

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.zst"

LEAST_REVISIT = 1_000
ARCHIVE_BYTES = 32 << 20  # of payload in an archive, about
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
LEVEL = 3


def write_archives(
    pages: DataFrame, folder: str, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` into archives in ``folder``.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest id
    is the response and the others revisit it; smaller payloads are all responses.
    A null html is an empty payload; a row with a null id is a response.  Rows of one
    id and payload have records alike.  Further columns are ignored.  ``folder`` is
    a URI that executors can write to.  Returns the manifest ``(archive, records)``.

    Rows are dealt to archives by hash, sorted and streamed: a task holds one record
    and the sample that the dictionary is trained on.  An archive appears under its
    name when it is whole, so a task that is run again replaces what it wrote.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    big = pages.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    holders = big.groupBy("digest").agg(F.max("page_id").alias("holder"), F.min("page_id").alias("other")).where("holder <> other").drop("other")
    revisits = big.select("page_id", "digest").join(written(holders, "holders"), "digest").where("page_id <> holder").distinct()
    total = pages.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    dealt = (
        pages.join(written(revisits, "revisits"), ["page_id", "digest"], "left")
        .withColumn("archive", F.pmod(F.xxhash64("page_id", "digest", "url"), F.lit(archives)).cast("int"))
        .select("archive", "page_id", "url", "digest", "holder", F.when(F.col("holder").isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"))
    )
    sorted_ = dealt.repartitionById(int(archives), "archive").sortWithinPartitions("archive", "page_id", "digest", "url")
    return written(mapped(sorted_, _writer(folder, date), "archive string, records long"), "manifest")


def read_archives(spark, folder: str) -> DataFrame:
    """All page records of the archives in ``folder``.

    Returns ``(page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to)``; ``payload`` is null for revisits.  A payload that doesn't have the
    length or digest its record states is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return mapped(files, _read, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages and read them back, from a new shared folder unless one is named."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    if write_archives(pages, folder, **options).agg(F.sum("records")).first()[0] is None:
        schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
        return spark.createDataFrame([], schema)
    return read_archives(spark, folder)


def _page_uri(page_id: int | None) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}"


def _page_id(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, holder: int | None, date: str) -> bytes:
    """One record; a page's HTTP head goes with it, the payload only with a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if holder is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if holder is None else 'revisit'}",
        f"WARC-Record-ID: <{_page_uri(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if holder is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_page_uri(holder)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: What a URL may keep; white space, control and other characters are percent-encoded.
SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    size = int(headers["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:size]


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from records; empty where there are too few to train one."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def compress(records: Iterator[bytes], out) -> int:
    """Write an archive to the binary stream ``out``; returns how many records it got.

    The dictionary is trained on the records up to ``SAMPLE_BYTES``; longer records
    lend their first part to the training, and are written whole.
    """
    samples, held, size = [], [], 0
    for raw in records:
        held.append(raw)
        samples.append(raw[: SAMPLE_BYTES // 16])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    content = train(samples)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
    options = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
    coder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
    n = 0
    for raw in chain(held, records):
        out.write(coder.compress(raw))
        n += 1
    return n


def decompress(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    options = {"dict_data": zstandard.ZstdCompressionDict(content[8 : 8 + size])} if size else {}
    decoder = zstandard.ZstdDecompressor(**options)
    rest = memoryview(content)[8 + size :]
    while len(rest):
        one = decoder.decompressobj()
        raw = one.decompress(rest[: 1 << 16])
        at = min(len(rest), 1 << 16)
        parts = [raw]
        while not one.eof:
            if at >= len(rest):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(rest[at : at + (1 << 20)]))
            at = min(len(rest), at + (1 << 20))
        rest = rest[at - len(one.unused_data) :]
        yield b"".join(parts)


def _info(name: str, date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\nsoftware: rallygrid\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for archive, own in groupby(rows, key=lambda row: row[0]):
            system, path = fs.FileSystem.from_uri(folder)
            system.create_dir(path, recursive=True)
            name = f"pages-{archive:06d}{SUFFIX}"
            whole = io.BytesIO()  # about the size of the archive, which archive_bytes bounds
            records = (record(i, url, digest, size, payload, holder, date) for _, i, url, digest, holder, payload, size in own)
            n = compress(chain([_info(name, date)], records), whole) - 1
            hidden = f"{path}/.{name}.{hashlib.sha1(whole.getbuffer()).hexdigest()}"
            with system.open_output_stream(hidden) as out:
                out.write(whole.getbuffer())
            system.move(hidden, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for raw in decompress(content.as_py()):
                headers, block = parse(raw)
                kind = headers["warc-type"]
                if kind == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = int(http.rpartition(b"Content-Length:")[2])
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{headers['warc-record-id']} doesn't hold the payload it states")
                refers = _page_id(headers["warc-refers-to"]) if kind == "revisit" else None
                rows.append((_page_id(headers["warc-record-id"]), headers.get("warc-target-uri"), payload if kind == "response" else None, stated, digest, kind, refers))
                size += len(payload)
                if size > 8 << 20:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)
