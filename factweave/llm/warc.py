"""WARC archives: a writer with revisit records and a splittable reader.

Writer: one gzip member per record. Members go through Spark's text sink, which adds one byte after
each value; each value therefore ends in an empty gzip member less its last byte, a zero, which is the
sink's separator. So archives are plain multi-member gzip, written with Spark's commit protocol
to any file system Spark knows, and a lost or repeated task leaves no half archive.

Reader: files are cut into byte ranges. A task scans its range for gzip magic, takes a candidate as a
member only if it decodes to a WARC header, and owns each record whose member starts inside
the range, reading past its end to finish the last one. Ranges are opened by URI (local
or any store that Arrow's file systems reach).

Edge cases: a null payload is an empty one; a null url leaves the target out; control characters and
spaces in a url are percent-encoded in the header, which may be of any length; equal payloads under ``min_bytes`` are never
revisits; rows with a null page_id revisit a named equal payload, else are responses; rows that share the smallest page_id
of a payload are all responses, repeated rows are records of their own; other columns of a table aren't written, so they may have
any names; an empty table gives an empty archive. A member that begins like a WARC record but is damaged, truncated or without
header end raises an error that names its byte. What a byte range can't tell: a WARC member held uncompressed inside another
member of a foreign archive is read as a record of its own if a range begins inside the outer one; members written here
are compressed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
READ = 1 << 20
RECORD = "file string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def classified(pages: DataFrame, key: str, payload: Column, min_bytes: int = 100) -> DataFrame:
    """pages with __payload, __bytes, __digest, __refers (null: a response)."""
    full = pages.withColumn("__payload", F.coalesce(payload, F.lit(b""))).withColumn("__bytes", F.octet_length("__payload").cast("long")).withColumn("__digest", F.sha2("__payload", 256))
    # One row for each payload that occurs twice, written: where these are few Spark broadcasts them and payloads stay
    # where they are; else both sides of the join are plain, so that Spark can split a payload that occurs very often.
    firsts = full.where(F.col("__bytes") >= min_bytes).groupBy("__digest").agg(F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    joined = full.join(written(firsts, "warc-firsts"), "__digest", "left")
    later = F.col("__first").isNotNull() & (F.col(key).isNull() | (F.col(key) > F.col("__first")))
    return joined.withColumn("__refers", F.when(later, F.col("__first"))).drop("__first")


def _record(record_id: str, url: str | None, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    body = b"" if refers is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers is not None else 'response'}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=-._~' + chr(39))}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


@F.arrow_udf(T.BinaryType())
def _members(ids: pa.Array, urls: pa.Array, digests: pa.Array, sizes: pa.Array, payloads: pa.Array, refers: pa.Array) -> pa.Array:
    rows = zip(ids, urls, digests, sizes, payloads, refers, strict=True)
    return pa.array([_record(*(x.as_py() for x in r)) + EMPTY_MEMBER[:-1] for r in rows], pa.binary())


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100) -> None:
    """Write a record for each row to archives below path (a folder)."""
    rows = classified(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).cast("binary").alias("p")), "key", F.col("p"), min_bytes)
    member = _members(F.coalesce(F.col("key").cast("string"), F.lit("null")), "url", "__digest", "__bytes", "__payload", F.col("__refers").cast("string"))
    rows.select(member.cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, start, stop) of the byte ranges; only names and lengths are listed."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    ranges = files.where("length > 0").select("file", F.explode(cuts).alias("start"))
    return ranges.select("file", "start", (F.col("start") + size).alias("stop"))


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:] if x))


class _Member:
    """One gzip member, decoded from a file at an offset."""

    def __init__(self, file, start: int):
        self.file, self.at, self.start = file, start, start
        self.unpacker = zlib.decompressobj(31)
        self.data = bytearray()

    def more(self, size: int = READ) -> bool:
        if self.unpacker.eof:
            return False
        if not (raw := self.unpacker.unconsumed_tail):
            self.file.seek(self.at)
            self.at += len(raw := self.file.read(size))
        before = len(self.data)
        self.data += self.unpacker.decompress(raw, 8 * READ)  # what one read unpacks to has a bound
        if self.unpacker.eof:
            self.at -= len(self.unpacker.unused_data)
        return self.unpacker.eof or len(self.data) > before or bool(raw)

    def head(self) -> bytes | None:
        """The WARC header, of any length, or None if this isn't a record."""
        end, seen, size = -1, 0, 4096
        try:
            while (end := self.data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(self.data)
                if not self.more(size):
                    break
                if self.data[:5] != b"WARC/"[: len(self.data)]:
                    return None
                size = min(2 * size, READ)
        except zlib.error as e:
            if self.data.startswith(b"WARC/"):
                raise ValueError(f"damaged WARC member at byte {self.start}") from e
            return None
        if not self.data.startswith(b"WARC/"):
            return None
        if end < 0:
            raise ValueError(f"WARC member without header end at byte {self.start}")
        return bytes(self.data[:end])


def scan_range(file, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records whose members start in [start, stop)."""
    at, buffer, base = start, b"", start
    while at < stop:
        if at < base or at - base + len(MAGIC) > len(buffer):
            file.seek(at)
            base, buffer = at, file.read(min(READ, stop - at) + len(MAGIC) - 1)
        found = buffer.find(MAGIC, at - base)
        if found < 0 or base + found >= stop:
            if base + len(buffer) >= stop or not buffer[len(MAGIC) - 1 :]:
                return
            at = base + len(buffer) - len(MAGIC) + 1
            continue
        at = base + found
        member = _Member(file, at)
        head = member.head()
        if head is None:
            at += 1
            continue
        try:
            while member.more():
                pass
        except zlib.error as e:
            raise ValueError(f"damaged WARC member at byte {at}") from e
        if not member.unpacker.eof:
            raise ValueError(f"truncated WARC member at byte {at}")
        fields = _parse(head)
        body = member.data[len(head) + 4 :]
        yield at, fields, bytes(body[: int(fields.get("content-length", len(body)))])
        at = member.at


def _named(uri: str | None) -> str | None:
    return re.sub(r"^<(.*)>$", r"\1", uri) if uri else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for r in b.to_pylist():
            store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", r["file"]))
            held, size = [], 0
            with store.open_input_file(path) as file:
                for offset, h, block in scan_range(file, r["start"], r["stop"]):
                    kind = h.get("warc-type")
                    digest, length = h.get("warc-payload-digest", "").removeprefix("sha256:"), len(block)
                    if kind == "revisit":
                        length = int(h.get("x-payload-length", 0))
                    else:
                        own = hashlib.sha256(block).hexdigest()
                        if digest and digest != own:
                            raise ValueError(f"payload digest differs at byte {offset} of {r['file']}")
                        digest = own
                    held.append((r["file"], offset, _named(h.get("warc-record-id")), kind, h.get("warc-target-uri"), _named(h.get("warc-refers-to")), digest, length, None if kind == "revisit" else block))
                    size += len(block)
                    if size > 8 << 20:
                        yield table(held)
                        held, size = [], 0
            if held:
                yield table(held)


def read_warc(spark: SparkSession, path: str, range_bytes: int = 4 << 20) -> DataFrame:
    """RECORD rows of all archives at path. Revisits have a null payload; digest and bytes are those of
    the full payload."""
    ranges = _ranges(spark, path, range_bytes)
    n = spark.sparkContext.defaultParallelism * 4
    return ranges.repartition(n).mapInArrow(_read, RECORD)
