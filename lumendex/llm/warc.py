"""WARC archives and their salvage reader (operator 8).

Writing: each page is a record in a gzip member of its own; of equal payloads from ``MIN_REVISIT``
bytes on, the page with the largest id keeps the payload (response), the others point
to it (revisit). Groups are found by a pre-aggregated count of digests; the join back has
payload digests as keys, only where a payload is long enough, so short
payloads are spread by page, and hot digests are split by Spark's skew join.

Reading: a record must decompress, have a version line, a header, its full block, a matching block
digest (if it states one of a known algorithm, in hex or base32) and the closing line breaks. After a failed check the reader searches the
next byte where a whole record can be read, and reports the bytes between as a quarantined gap. A gzip member may hold many records (and
gaps): all have its offset, the first has its length and the others 0.

Null html is an empty payload; a null url leaves the field out; rows with equal ids are kept each
(all rows of a group's largest id are responses); null ids never win, and come back null, as do identities that hold no 64-bit number.
A record without a type has the type "unknown". Long texts are one member, however long (one of 15 MiB and more is followed by an empty member). Empty tables
give no records. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 1000
#: A member that ends its row has less than 2**24 bytes, so that its last one (of its size) is 0; uncompressed, a file has about FILE_BYTES and never more than MOST_BYTES.
MEMBER_BYTES, FILE_BYTES, MOST_BYTES = 15 << 20, 64 << 20, 1 << 30
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


# -- records -------------------------------------------------------------------------------


def _identity(page_id: int | None) -> str:
    return f"<urn:lumendex:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record; a revisit if ``refers_to`` is given (then the payload isn't stored)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_identity(page_id)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_identity(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _deflated(data: bytes) -> bytes:
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


#: A gzip member of no data: it ends in a zero byte.
EMPTY = _deflated(b"")


def compress(data: bytes) -> bytes:
    """One member, which ends in a zero byte; a large one is followed by an empty one for that."""
    return _deflated(data) if len(data) < MEMBER_BYTES else _deflated(data) + EMPTY


@dataclass
class Found:
    """A record, or (with a reason) a gap of bytes that hold none."""

    offset: int
    length: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class Broken(Exception):
    pass


class Unfinished(Broken):
    """What is there so far ends within a record."""


def _member(content: memoryview, at: int) -> tuple[bytes, int]:
    """The data of the gzip member at a place, and where it ends."""
    inflate, out = zlib.decompressobj(31), []
    size = 1 << 13
    while not inflate.eof:
        if at >= len(content):
            raise Broken("truncated member")
        chunk = content[at : at + size]
        try:
            out.append(inflate.decompress(chunk))
        except zlib.error as e:
            raise Broken("damaged member") from e
        at += len(chunk)
        size = min(size * 2, 1 << 20)
    return b"".join(out), at - len(inflate.unused_data)


def _header(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Fields, where the block begins and how long it is, of the record at a place; a header is as long as it is."""
    if not _VERSION.match(data, at):
        raise Broken("no version line")
    at, fields = data.index(b"\n", at) + 1, {}
    while (end := data.find(b"\r\n", at)) != at:
        if end < 0:
            raise Unfinished("unfinished header")
        name, colon, value = data[at:end].partition(b":")
        if not colon:
            raise Broken("bad header line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        at = end + 2
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Broken("bad content length")
    return fields, at + 2, int(length)


#: Names of digests, without punctuation, in lower case.
_ALGORITHMS = {"sha1": hashlib.sha1, "md5": hashlib.md5, "sha256": hashlib.sha256, "sha512": hashlib.sha512}


def _digest(stated: str | None) -> tuple[str, bytes] | None:
    """Algorithm and value of a stated digest (hex or base32, either case); None if it isn't of a known kind."""
    name, _, value = (stated or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in _ALGORITHMS:
        return None
    size = _ALGORITHMS[name]().digest_size
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        bare = value.rstrip("=").upper()
        found = base64.b32decode(bare + "=" * (-len(bare) % 8))
    except ValueError:
        return None
    return (name, found) if len(found) == size else None


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields and block of the uncompressed record at a place, and where it ends."""
    fields, start, length = _header(data, at)
    after = start + length + 4
    if len(data) < after:
        raise Unfinished("truncated record")
    block = data[start : after - 4]
    if data[after - 4 : after] != b"\r\n\r\n":
        raise Broken("truncated record")
    stated = _digest(fields.get("warc-block-digest"))
    if stated and stated[1] != _ALGORITHMS[stated[0]](block).digest():
        raise Broken("block digest differs")
    return fields, block, after


def _packed(content: bytes, at: int) -> tuple[list[Found], int]:
    """What the gzip member at a place holds, with those that its last record goes on in, and where they end."""
    begin, view = at, memoryview(content)
    data, at = _member(view, at)
    if not data:
        return [], at
    found, place, valid, lost = [], 0, 0, None
    while place < len(data):
        try:
            fields, block, place = _plain(data, place)
        except Broken as e:
            reason = str(e)
            if isinstance(e, Unfinished) and content[at : at + 2] == b"\x1f\x8b":
                try:
                    more, after = _member(view, at)
                    if not _VERSION.match(more):
                        data, place, at = data[place:] + more, 0, after
                        continue
                except Broken as damage:
                    reason = str(damage)
            if lost is None:
                lost = reason
                found.append(Found(begin, 0, reason))
            version = _VERSION.search(data, place + 1)
            place = version.start() if version else len(data)
        else:
            found.append(Found(begin, 0, None, fields, block))
            valid, lost = valid + 1, None
    if not valid:
        raise Broken(lost or "no version line")
    if content.startswith(EMPTY, at):
        at += len(EMPTY)
    found[0].length = at - begin
    return found, at


def _records_at(content: bytes, at: int) -> tuple[list[Found], int]:
    if content[at : at + 2] == b"\x1f\x8b":
        return _packed(content, at)
    fields, block, after = _plain(content, at)
    return [Found(at, after - at, None, fields, block)], after


_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(content: bytes) -> Iterator[Found]:
    """All records of an archive (plain or gzip) in order, and the gaps between them."""
    at = 0
    while at < len(content):
        try:
            found, end = _records_at(content, at)
        except Broken as e:
            reason, after, found = str(e), len(content), []
            for m in _CANDIDATE.finditer(content, at + 1):
                try:
                    found, end = _records_at(content, m.start())
                except Broken:
                    continue
                if found:
                    after = m.start()
                    break
            yield Found(at, after - at, reason)
            if not found:
                return
        yield from found
        at = end


# -- jobs ----------------------------------------------------------------------------------


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive all pages below ``path``, as gzip WARC files of a bounded size."""
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("bigint").alias("k"), F.col(url).alias("u"), payload.alias("p")).select(
        "k", "u", "p", F.length("p").cast("bigint").alias("n"), F.sha1("p").alias("d")
    )
    long_enough = F.col("n") >= MIN_REVISIT
    kept = rows.where(long_enough).groupBy(F.col("d").alias("same"), F.col("n").alias("size")).agg(F.max("k").alias("kept"), F.count("*").alias("c")).where("c > 1").select("same", "size", "kept")
    most = F.col("n") + 3 * F.coalesce(F.octet_length("u"), F.lit(0))  # an escaped byte of the url takes three
    longest, mean = rows.agg(F.coalesce(F.max(most), F.lit(0)), F.coalesce(F.avg(most), F.lit(0.0))).first()
    spread = rows.withColumn("same", F.when(long_enough, F.col("d")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("k").cast("string"), F.lit("none")))))
    joined = spread.join(kept, (spread["same"] == kept["same"]) & (spread["n"] == kept["size"]), "left")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("k").eqNullSafe(F.col("kept")), F.col("kept"))
    ready = joined.select("k", "u", F.when(refers.isNull(), F.col("p")).alias("p"), "n", "d", refers.alias("r"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows_ = zip(*(c.to_pylist() for c in part.columns), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([compress(record(*r)) for r in rows_], pa.binary())], names=["record"])

    per_file = max(1, min(FILE_BYTES // (int(mean) + 1000), MOST_BYTES // (longest + 1000)))
    out = ready.mapInArrow(records, "record binary")
    body = F.substring("record", F.lit(1), F.length("record") - 1).cast("string")
    out.select(body.alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", per_file).text(path)


def read(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """A row for every record and every gap: ``file``, ``offset``, ``length``, ``gap_reason`` (null for records), and
    of records ``key``, ``record_type``, ``refers_to``, ``url``, ``payload_bytes``, ``payload_digest``."""
    schema = f"file string, offset bigint, length bigint, gap_reason string, `{key}` bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string"
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def number(identity: str | None) -> int | None:
        tail = (identity or "").rstrip(">").rsplit(":", 1)[-1]
        found = int(tail) if re.fullmatch(r"-?[0-9]{1,19}", tail) else None
        return found if found is not None and -(1 << 63) <= found < 1 << 63 else None

    def row(name: str, f: Found) -> tuple:
        if f.reason is not None:
            return (name, f.offset, f.length, f.reason, None, None, None, None, None, None)
        h = f.headers
        head, _, payload = f.block.partition(b"\r\n\r\n")
        kind = h.get("warc-type") or "unknown"
        if kind == "revisit":
            stated, told = re.search(rb"(?i)\r\ncontent-length: ([0-9]{1,18})\r\n", head + b"\r\n"), _digest(h.get("warc-payload-digest"))
            size, digest = int(stated[1]) if stated else None, told[1].hex() if told else None
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        return (name, f.offset, f.length, None, number(h.get("warc-record-id")), kind, number(h.get("warc-refers-to")), h.get("warc-target-uri"), size, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for f in salvage(content.as_py()):
                    rows.append(row(name, f))
                    if len(rows) == 5000:
                        yield _batch(rows, names, types)
                        rows = []
                if rows:
                    yield _batch(rows, names, types)

    return common.read_files(spark, path).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
