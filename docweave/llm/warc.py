"""WARC archives: writing with revisits, and a reader that salvages damaged ones.

Writing. Payloads are hashed where they are read. Of equal payloads the record of the
largest id carries it, found by a maximum per hash that is taken map-side first; a merge
join by hash brings the decision to the rows, whose hot hashes AQE may split as the other
side repeats no hash. Tasks stream records into archives of bounded size, a gzip member a
record, which one commit publishes; a revisit holds the HTTP head only.

Reading. Archives are read whole, a task's some at a time, and walked member by member.
Where a member or record fails a check (gzip's CRC, the version line, the length, the
line ends behind the block, the digests), the reader looks for the next place where a
whole valid member or record begins, goes on from there, and reports the bytes between
as a gap with the check that failed. Nothing of a gap counts as read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from docweave.llm._shared import map_arrow, small_batches
from docweave.sources.staged import Moves, StagedWriter, store

#: Bytes after which an archive is closed, and zlib's level.
ARCHIVE_BYTES, LEVEL = 8 << 20, 2
# The format's version line, line end, and the profile of revisits.
VERSION, END = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_BEGIN = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")

RECORDS = "archive string, offset long, length long, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary, gap string"


def base32(hex_: Column) -> Column:
    """A hex string of 40 digits in upper-case base 32."""
    part = lambda i: F.lpad(F.conv(F.substring(hex_, i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*(part(i) for i in (1, 11, 21, 31))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# writing


def record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", CAPTURED), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {_one_line(v)}".encode() for k, v in head if v is not None), b"", b""]
    return END.join(lines) + block + END + END


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


class ArchiveWriter(StagedWriter):
    """Streams rows (page_id, uri, payload, sha1, key, n, refers) into archives."""

    def __init__(self, folder: str, archive_bytes: int, level: int) -> None:
        super().__init__(folder)
        self.archive_bytes, self.level = archive_bytes, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moves:
        system, root = store(self.folder)
        moves, part, count, size, out = Moves(), TaskContext.get().partitionId(), 0, 0, None
        for batch in iterator:
            for page, uri, payload, sha1, key, n, refers in zip(*(batch.column(i) for i in range(7)), strict=True):
                page, uri, sha1, key, refers = (x.as_py() for x in (page, uri, sha1, key, refers))
                about = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha1}")]
                head = http_head(n.as_py())
                if refers is None:
                    made = record("response", f"<urn:page:{page}:{key}>", [*about, ("Content-Type", "application/http; msgtype=response")], head + payload.as_buffer().to_pybytes())
                else:
                    made = record("revisit", f"<urn:page:{page}:{part}.{count}>", [*about, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}:{key}>"), ("Content-Type", "application/http; msgtype=response")], head)
                if out is None:
                    out = self.stage(system, root, f"part-{part:05d}-{len(moves.files):05d}.warc.gz", moves)
                member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                packed = member.compress(made) + member.flush()
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= self.archive_bytes:
                    out.close()
                    out, size = None, 0
        if out is not None:
            out.close()
        return moves


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_archives"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)), int(self.options.get("level", LEVEL)))


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row into archives in the new ``folder``.

    The payload is the text in UTF-8, empty for null. Of equal payloads of ``least`` bytes
    or more, the row with the largest id (ids before null; of these the largest url, of rows
    alike any one) is a response and the others revisit it; shorter ones are all responses.
    Payloads are equal if length and SHA-256 are. A null url leaves its field out, line ends
    in one are written as %0D and %0A. An empty table writes no archive. A payload of any
    size is one record. Other columns are not read."""
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    top = F.struct(F.col("page").isNotNull().alias("known"), F.coalesce("page", F.lit(0).cast("long")).alias("page"), F.col("uri").isNotNull().alias("named"), F.coalesce("uri", F.lit("")).alias("uri"))
    best = rows.where(F.col("n") >= least).select("key", top.alias("top")).groupBy("key", "top").agg(F.count(F.lit(1)).alias("same"))
    best = best.groupBy("key").agg(F.max(F.struct("top", "same")).alias("best")).select(F.col("key").alias("k"), "best.*")
    met = rows.join(best.hint("merge"), F.col("key") == F.col("k"), "left")
    first = F.col("k").isNull() | (top == F.col("top"))
    refers = F.when(first, None).otherwise(F.when(F.col("top.known"), F.col("top.page").cast("string")).otherwise(F.lit("")))
    columns = [F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page"), "uri", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), base32(F.sha1("payload")).alias("sha1"), "key", "n", "refers"]
    named = met.withColumn("refers", refers)
    repeated = best.where("same > 1")
    if repeated.isEmpty():
        out = named.select(*columns)
    else:  # of rows alike one carries the payload; the others need no payload, only their number
        alike = F.col("refers").isNull() & F.coalesce(F.col("same") > 1, F.lit(False))
        one = named.where(alike).dropDuplicates(["key"])
        blocks = one.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("same") - 2) / COPIES))))
        copies = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("same") - 1 - F.col("block") * COPIES).cast("int"))))
        again = copies.withColumn("refers", F.when(F.col("top.known"), F.col("top.page").cast("string")).otherwise(F.lit("")))
        out = named.where(~alike).select(*columns).unionByName(one.select(*columns)).unionByName(again.select(*columns))
    spark.dataSource.register(ArchiveSink)
    out.write.format(ArchiveSink.name()).mode("append").option("archiveBytes", archive_bytes).save(folder)


#: Copies of a row that are made from one row at once.
COPIES = 1 << 12


# reading


class Bad(Exception):
    """A check that failed."""


@dataclass
class Found:
    """A record, or a gap if ``gap`` tells the check that failed; offset and length are
    those of its bytes in the archive (of a member: the member's)."""

    offset: int
    length: int
    fields: dict[str, str] | None = None
    block: bytes = b""
    gap: str | None = None


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(fields by lower-case name, block, end) of the record at ``at``; raises ``Bad``."""
    begin = _BEGIN.match(data, at)
    if not begin:
        raise Bad("version line")
    close = data.find(b"\r\n\r\n", begin.end() - 2)
    if close < 0:
        raise Bad("header")
    fields: dict[str, str] = {}
    for line in data[begin.end() : close].split(END):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdecimal() or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Bad("header")
    end = close + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("length")
    block = data[close + 4 : end]
    given = fields.get("warc-block-digest", "")
    if given.lower().startswith("sha1:") and given[5:].upper() != digest(block):
        raise Bad("block digest")
    if fields["warc-type"] == "response" and (given := fields.get("warc-payload-digest", "")).lower().startswith("sha1:") and given[5:].upper() != digest(payload_of(fields, block)):
        raise Bad("payload digest")
    return fields, block, end + 4


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP head of an HTTP record; else the block."""
    if fields.get("content-type", "").startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        return block[head + 4 :] if head >= 0 else b""
    return block


def member(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``at``; raises ``Bad``."""
    unpack = zlib.decompressobj(31)
    out, step = [], 1 << 16
    place = at
    try:
        while not unpack.eof:
            if place >= len(data):
                raise Bad("truncated member")
            out.append(unpack.decompress(data[place : place + step]))
            place += step
    except zlib.error:
        raise Bad("member") from None
    return b"".join(out), min(place, len(data)) - len(unpack.unused_data)


def walk(data: bytes, packed: bool = True) -> Iterator[Found]:
    """The records and gaps of an archive, in order; ``packed`` allows gzip members."""
    at = 0
    while at < len(data):
        try:
            found, end = _unit(data, at, packed)
        except Bad as bad:
            reason, start = str(bad), at
            found, end = [], len(data)
            for next_ in _NEXT.finditer(data, at + 1):
                try:
                    found, end = _unit(data, next_.start(), packed)
                except Bad:
                    continue
                at = next_.start()
                break
            else:
                at = len(data)
            yield Found(start, at - start, gap=reason)
        yield from found
        at = end


def _unit(data: bytes, at: int, packed: bool) -> tuple[list[Found], int]:
    """What stands in the valid member or record at ``at``, and its end; raises ``Bad``.

    A member that unpacks is valid if any record in it is; others in it may be gaps."""
    if packed and data.startswith(MAGIC, at):
        content, end = member(data, at)
        inner = list(walk(content, False))
        if content and all(x.gap for x in inner):
            raise Bad(inner[0].gap)
        return [Found(at, end - at, x.fields, x.block, f"{x.gap} in a member, {x.length} bytes from {x.offset}" if x.gap else None) for x in inner], end
    fields, block, end = parse_record(data, at)
    return [Found(at, end - at, fields, block)], end


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = False) -> DataFrame:
    """One row (``RECORDS``) for each record of the archives in ``folder``, and one for each
    gap, whose ``gap`` names the check that failed and whose other columns but archive,
    offset and length are null.

    Archives hold gzip members, plain records or both. Sizes and digests are of the whole
    payload: of a response as read, of a revisit as its fields and HTTP head tell. ``payload``
    is filled if asked for. An archive is held by one task at a time and may have as many
    bytes as Spark reads of a binary file (2 GB). An empty file has no rows."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    length = re.compile(rb"(?im)^content-length:\s*(\d+)\s*$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                size = 0
                for x in walk(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    rows.append(_row(path.as_py(), x, payloads, length))
                    size += len(rows[-1][9] or b"")
                    if len(rows) >= 1000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])
    names = schema.names
    return map_arrow(files, run, RECORDS)


def _row(path: str, x: Found, payloads: bool, length: re.Pattern) -> tuple:
    if x.gap or x.fields is None:
        return path, x.offset, x.length, None, None, None, None, None, None, None, x.gap
    kind, payload = x.fields["warc-type"], payload_of(x.fields, x.block)
    told = x.fields.get("warc-payload-digest", "")
    if kind == "revisit":
        known = length.search(x.block.partition(b"\r\n\r\n")[0])
        size, sha1 = int(known[1]) if known else None, told[5:].upper() if told.lower().startswith("sha1:") else None
    else:
        size, sha1 = len(payload), digest(payload)
    return path, x.offset, x.length, kind, x.fields["warc-record-id"], x.fields.get("warc-refers-to"), x.fields.get("warc-target-uri"), size, sha1, payload if payloads else None, None


def page_of(urn: Column) -> Column:
    """The page id in a record id that :func:`write_archives` made; null for none."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d*):", 1).try_cast("long")
