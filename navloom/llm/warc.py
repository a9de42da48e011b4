r"""Zstandard WARC archives: writer and validating reader.

An archive starts with a skippable frame that holds a Zstandard dictionary, trained on the archive's
own records, plain or itself compressed; then comes one frame for each record, so a record can be read
alone. The reader loads the dictionary, decodes one frame after another and checks that a frame is
exactly one record: the version line, the mandatory headers, Content-Length against the block, the
closing blank lines, the block digest, and the payload digest of whole payloads.

Of records with equal payloads (by SHA-1 and length) of at least `least_bytes`, the one with the largest
id is a response and the others are revisits that refer to it and carry no payload. A payload that a
third of all records share is dealt out over salted keys, so its records spread over many tasks.
Archives are bounded in size and live in a column; `read_files` reads archives from any file system.

Defined results: null html is an empty payload. Rows that repeat the largest id of their payload are
responses too. A row without an id has a record of its own and refers to the group's response if there
is one. A null url leaves out the target URI. An empty table gives no archive. A damaged archive raises
WarcError.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.text import blocks
from navloom.session import ready

ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 16 << 10
SALTS = 64
# Fixed values of the formats.
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
FRAME = (0xFD2FB528).to_bytes(4, "little")
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # the tables have no crawl date


class WarcError(ValueError):
    """A damaged or unexpected archive."""


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, part: int, place: int) -> str:
    return f"<urn:navloom:page:{page_id}>" if page_id is not None else f"<urn:navloom:row:{part}-{place}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers), f"WARC-Block-Digest: sha1:{digest(block)}".encode(), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join([*lines, b"", block]) + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str) -> bytes:
    """A response record, or with refers_to a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", REVISIT), ("WARC-Refers-To", _name(refers_to, 0, 0))], http)


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    """The dictionary in a skippable frame, then one frame for each record."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in records[:256]]).as_bytes()
    except zstandard.ZstdError:  # too few or too equal records to train on: their headers serve as they are
        trained = b"".join(r[:1024] for r in records[:4])
    stored = zstandard.ZstdCompressor(level=19).compress(trained)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    return b"".join([SKIPPABLE, len(stored).to_bytes(4, "little"), stored, *map(packer.compress, records)])


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, each whole."""
    at, known = 0, None
    if archive[:4] == SKIPPABLE:
        size = int.from_bytes(archive[4:8], "little")
        stored = archive[8 : 8 + size]
        if len(stored) != size:
            raise WarcError("the dictionary ends early")
        if stored[:4] == FRAME:
            stored = zstandard.ZstdDecompressor().decompressobj().decompress(stored)
        known, at = zstandard.ZstdCompressionDict(stored), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(archive):
        if archive[at : at + 4] != FRAME:
            raise WarcError(f"no frame at byte {at}")
        one, out = reader.decompressobj(), []
        try:
            while not one.eof:
                step = archive[at : at + (64 << 10)]
                if not step:
                    raise WarcError("a frame ends early")
                out.append(one.decompress(step))
                at += len(step) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame cannot be decoded: {e}") from e
        yield b"".join(out)


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of exactly one record, checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not key.strip():
            raise WarcError(f"no header: {line[:60]!r}")
        headers[key.strip().lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in headers:
            raise WarcError(f"no {key}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("Content-Length is not the length of the block")
    block = rest[:size]
    if headers.get("warc-block-digest", "").startswith("sha1:") and headers["warc-block-digest"][5:] != digest(block):
        raise WarcError("the block digest is wrong")
    return headers, block


def _id(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:navloom:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def pages_of(archive: bytes) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of each page's record; payload is null for revisits."""
    for frame in frames(archive):
        headers, block = read_record(frame)
        kind = headers["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, blank, payload = block.partition(b"\r\n\r\n")
        length = [line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        if not blank or not length:
            raise WarcError("no HTTP header with a length")
        size, told = int(length[0]), headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and (size != len(payload) or told != digest(payload)):
            raise WarcError("the payload is not the one that the headers tell")
        if kind == "revisit" and (payload or "warc-refers-to" not in headers):
            raise WarcError("a revisit with a payload or without its response")
        yield _id(headers["warc-record-id"]), size, told, kind, _id(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload if kind == "response" else None


def owners(pages: DataFrame, least_bytes: int) -> DataFrame:
    """`pages` (page_id, url, html as binary) and owner: the largest id with the same payload, null where no other row has it."""
    keyed = pages.select("page_id", "url", "html", F.sha1("html").alias("sha1"), F.length("html").alias("size"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    groups = keyed.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(groups, ["sha1", "size", "salt"], "left").select("page_id", "url", "html", "owner")


def archives(pages: DataFrame, least_bytes: int = 0, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, n_records, archive): the pages' records in archives of about most_bytes before compression."""
    ready(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, place, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def done() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{number:06d}.warc.zst"
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:navloom:archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: navloom\r\nformat: WARC File Format 1.1\r\n")
            return pa.record_batch([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([write_archive([info, *held])], pa.binary())], ["name", "n_records", "archive"])

        for block in blocks(batches, "html"):
            for page, url, html, owner in zip(*(c.to_pylist() for c in block.columns), strict=True):
                refers = owner if owner is not None and owner != page else None
                held.append(page_record(page, url, html, refers, _name(page, part, place)))
                size, place = size + len(held[-1]), place + 1
                if size >= most_bytes:
                    yield done()
                    number, held, size = number + 1, [], 0
        if held:
            yield done()

    return owners(pages, least_bytes).mapInArrow(work, "name string, n_records long, archive binary")


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_archives(rows: DataFrame) -> DataFrame:
    """PAGES: a row for each page's record of the archives in column `archive`. Null archives hold none."""
    ready(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in PAGES.split(", ")]
        for batch in batches:
            for i in range(len(batch)):
                archive = batch.column(0)[i].as_py()
                found = list(pages_of(archive)) if archive is not None else []
                if found:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return rows.select("archive").mapInArrow(work, PAGES)


def read_files(spark, glob: str) -> DataFrame:
    """PAGES of the .warc.zst files at a path or glob that Spark can read."""
    return read_archives(spark.read.format("binaryFile").load(glob).select(F.col("content").alias("archive")))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record, written into archives in the shared checkpoint folder and read back."""
    ready(spark)
    written = archives(spark.read.parquet(f"{sf_dir}/pages.parquet")).checkpoint()
    return read_archives(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB SQL for op5: base32 takes the 160 bits of the SHA-1 five at a time, out of the two bytes they lie in.
OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, hex,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex || '00', 1 + 2 * ((5 * i) // 8), 4))::INT >> (11 - (5 * i) % 8)) & 31)::INT, 1)), '') AS payload_digest
  FROM p
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS owner FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END::BIGINT AS refers_to
FROM o
"""
