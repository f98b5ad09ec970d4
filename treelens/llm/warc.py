"""Web archives: records with segments, written and put together again.

A page becomes an HTTP response in chunked transfer framing. A long block is cut
into segments: the first stands in the response record, the others follow in
continuation records that name the first one's id and carry a segment number,
the last with the total length. Segments may lie in different archives. Reading
back, continuations are grouped by the id they name, ordered by number, checked
against the total length, and the framing is decoded.

Of pages with equal payloads one is stored, the others refer to its record.

Defined results: a null payload is empty and stored; rows with null or repeated
ids are kept apart by a number of their own; of equal payloads whose largest id
occurs on several rows, all of these are stored, and the others refer to the id;
an empty table gives no archive and an empty result. Records that lack segments or whose lengths differ come back
with `error` set instead of a payload.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.operators.workspace import written


@dataclass(frozen=True)
class WarcRules:
    """Sizes in bytes; pages with equal payloads of `min_revisit` and more are stored once.

    Up to `listed` digests that occur again, some 60 bytes each, are sent to all
    tasks; more are joined by shuffle.
    """

    min_revisit: int = 1000
    segment: int = 4096
    http_chunk: int = 1024
    archive: int = 4 << 20
    date: str = "2025-01-01T00:00:00Z"
    listed: int = 500_000


# ---- which page is stored, which refers to it ----


def record_types(pages: DataFrame, rules: WarcRules) -> DataFrame:
    """Pages with their `name`, payload, its digest and length, record type, and what a revisit refers to.

    `name` tells records apart: what others refer to goes by page and digest, the
    rest by row. One payload may be on a third of all pages: the largest id per
    digest is found by partial aggregates, and the join back is one that Spark
    may split.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    again = (
        rows.where(F.col("size") >= rules.min_revisit)
        .groupBy("digest", "size", "page_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest", "size")
        .agg(F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("copies"))
        .where("copies > 1")
        .select("digest", "size", F.col("last.page_id").alias("target"), (F.col("last.n") == 1).alias("single"))
    )
    again = written(again, "again")
    # Payloads stay where they are read if the list is known to be small.
    joined = rows.join(F.broadcast(again) if again.count() <= rules.listed else again, ["digest", "size"], "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    named = F.when(F.col("single"), F.concat_ws(" ", "target", "digest"))
    row = F.monotonically_increasing_id()
    return joined.select(
        F.when(~revisit & named.isNotNull(), named).otherwise(F.concat(F.lit("row "), row)).alias("name"),
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "digest",
        "size",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("target")).alias("refers_to"),
        F.when(revisit, named).alias("refers_to_name"),
    )


# ---- writing ----

ROWS = 64  # pages taken from a batch at once
LEVEL = 1  # of compression
WINDOW = 1 << 13  # bytes of an archive unpacked at once
# Headers of this library: the ids of a page and of the one it repeats.
PAGE, REFERS_TO_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"


def chunked(payload: bytes, size: int) -> bytes:
    """A payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join(parts) + b"0\r\n\r\n"


def one_line(value: object) -> str:
    return value if isinstance(value, str) and value.isprintable() else re.sub(r"[\r\n]+", " ", str(value))


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {one_line(value)}" for name, value in headers]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return b"".join((head.encode(), block, b"\r\n\r\n"))


def record_uri(name: str, number: int = 1) -> str:
    """A record's own identifier, which follows from its name and the segment's number."""
    bits = hashlib.md5(f"{name} {number}".encode()).hexdigest()
    return f"<urn:uuid:{bits[:8]}-{bits[8:12]}-4{bits[13:16]}-8{bits[17:20]}-{bits[20:]}>"


def warcinfo(rules: WarcRules) -> bytes:
    """The record that an archive begins with."""
    block = b"software: treelens\r\nformat: WARC File Format 1.1\r\n"
    own = f"<urn:uuid:{uuid4()}>"
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", own), ("WARC-Date", rules.date)]
    return record([*headers, ("Content-Type", "application/warc-fields")], block)


def page_records(row: dict, rules: WarcRules) -> Iterator[bytes]:
    """The records of one page; its id stands in a header of this library."""
    own = record_uri(row["name"])
    common = [
        ("WARC-Record-ID", own),
        ("WARC-Date", rules.date),
        ("WARC-Target-URI", row["url"] or ""),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if row["page_id"] is not None:
        common.append((PAGE, row["page_id"]))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["record_type"] == "revisit":
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        more = [("WARC-Profile", profile), (REFERS_TO_PAGE, row["refers_to"])]
        if row["refers_to_name"] is not None:
            more.append(("WARC-Refers-To", record_uri(row["refers_to_name"])))
        # The block of a revisit is the HTTP head alone; it still tells the length.
        block = head + b"Content-Length: %d\r\n\r\n" % row["size"]
        yield record([("WARC-Type", "revisit"), *common, *more], block)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"], rules.http_chunk)
    cuts = range(0, len(block), rules.segment)
    if len(cuts) == 1:
        yield record([("WARC-Type", "response"), *common], block)
        return
    for number, at in enumerate(cuts, 1):
        part = block[at : at + rules.segment]
        if number == 1:
            yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], part)
            continue
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", record_uri(row["name"], number)),
            ("WARC-Date", rules.date),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", number),
        ]
        if number == len(cuts):
            headers.append(("WARC-Segment-Total-Length", len(block)))
        yield record(headers, part)


def member(one: bytes) -> bytes:
    """A record as a gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(one) + packer.flush()


def archives(rows: DataFrame, rules: WarcRules) -> DataFrame:
    """Archives of about `rules.archive` bytes, one gzip member per record, as rows of `content`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = member(warcinfo(rules))
        members, size = [first], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for row in batch.slice(at, ROWS).to_pylist():
                    for one in page_records(row, rules):
                        members.append(member(one))
                        size += len(members[-1])
                    if size >= rules.archive:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["content"])
                        members, size = [first], 0
        if len(members) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["content"])

    return rows.mapInArrow(run, "content binary")


# ---- reading ----

FIELDS = (
    "origin string, number int, total long, record_type string, page string, refers_to string, url string, "
    "digest string, block binary"
)


def unpacked(content: bytes) -> bytes:
    """What the gzip members of an archive hold, one after the other; zeros may follow each.

    A window goes over the archive, since a member hands back all bytes behind it: with the whole
    archive given, it would be copied once for each of its records.
    """
    parts, at, view = [], 0, memoryview(content)
    while at < len(content):
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            piece = view[at : at + WINDOW]
            if not piece:
                raise EOFError("archive ends inside a gzip member")
            parts.append(unpacker.decompress(piece))
            at += len(piece)
        at -= len(unpacker.unused_data)
        while content[at : at + 1] == b"\0":
            at += 1
    return b"".join(parts)


def members_of(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Records of an archive, compressed or not, one by one: headers in lower case, and the block."""
    data = unpacked(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        fields = {}
        for line in data[start:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.lower()] = value.strip()
        at = end + 4 + int(fields.get(b"content-length") or 0)
        yield fields, data[end + 4 : at]


def parsed(fields: dict[bytes, bytes], block: bytes) -> tuple:
    def text(name: bytes) -> str | None:
        value = fields.get(name)
        return None if value is None else value.decode("utf-8", "replace")

    number, total = fields.get(b"warc-segment-number"), fields.get(b"warc-segment-total-length")
    return (
        text(b"warc-segment-origin-id") or text(b"warc-record-id"),
        int(number) if number else None,
        int(total) if total else None,
        text(b"warc-type"),
        text(PAGE.lower().encode()),
        text(REFERS_TO_PAGE.lower().encode()),
        text(b"warc-target-uri"),
        text(b"warc-payload-digest"),
        block,
    )


def records(stored: DataFrame) -> DataFrame:
    """The records of pages in the `content` of archives, such as `spark.read.format("binaryFile")` gives as well."""
    names = [field.split()[0] for field in FIELDS.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 5, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                members = members_of(content.as_py() or b"")
                rows = [parsed(fields, block) for fields, block in members if fields.get(b"warc-type") != b"warcinfo"]
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return stored.select("content").mapInArrow(run, FIELDS)


def assembled(found: DataFrame) -> DataFrame:
    """One row per response or revisit with its whole block, or with what is wrong with it.

    Only segmented records are shuffled; the segments of one record are those of one page.
    """
    whole = found.where("number IS NULL").withColumn("error", F.lit(None).cast("string"))
    keep = ("record_type", "page", "refers_to", "url", "digest")
    grouped = (
        found.where("number IS NOT NULL")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
            F.max("total").alias("total"),
            *[F.max(F.when(F.col("number") == 1, F.col(n))).alias(n) for n in keep],
        )
    )
    # Joined as text in one go: adding one by one would copy a long page for every segment.
    hexes = F.transform("parts", lambda p: F.hex(p["block"]))
    joined = F.unhex(F.array_join(hexes, ""))
    expected = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: n)
    error = F.when(F.transform("parts", lambda p: p["number"]) != expected, "segments missing or doubled").when(
        F.col("total").isNull() | (F.col("total") != F.octet_length("block")), "length differs from total"
    )
    put = grouped.withColumn("block", joined).withColumn("error", error)
    columns = ["origin", *keep, "block", "error"]
    return whole.select(*columns).unionByName(put.select(*columns))


def unchunked(body: bytes) -> bytes | None:
    """The payload in chunked transfer framing; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        parts.append(piece)
        at = end + 4 + size


def http_payload(block: bytes) -> tuple[bytes | None, int | None]:
    """Payload of an HTTP response and the length that its head tells."""
    head, _, body = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", head + b"\r\n", re.I)
    if re.search(rb"\r\nTransfer-Encoding:[ \t]*chunked", head, re.I):
        return unchunked(body), None
    return body, int(length[1]) if length else None


READ = (
    "page_id long, url string, record_type string, refers_to long, payload binary, "
    "payload_bytes long, payload_digest string, error string"
)


def read_archives(stored: DataFrame) -> DataFrame:
    """Pages from archives: payload, its length and digest, record type and target."""
    names = [field.split()[0] for field in READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    columns = ("record_type", "page", "refers_to", "url", "digest", "block", "error")

    def number(told: str | None) -> int | None:
        return int(told) if told and re.fullmatch(r"-?\d+", told) else None

    def page(row: dict) -> tuple:
        payload, length = http_payload(row["block"] or b"")
        told = (row["digest"] or "").removeprefix("sha1:")
        error = row["error"]
        if row["record_type"] == "revisit":
            payload, size, digest = None, length, told
        else:
            size = None if payload is None else len(payload)
            digest = None if payload is None else hashlib.sha1(payload).hexdigest()
            error = error or ("framing broken" if payload is None else None if digest == told else "digest differs")
        return number(row["page"]), row["url"], row["record_type"], number(row["refers_to"]), payload, size, digest, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page(row) for row in batch.to_pylist()]
            values = zip(*rows, strict=True) if rows else [[] for _ in names]
            arrays = [pa.array(list(v), t) for v, t in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return assembled(records(stored)).select(*columns).mapInArrow(run, READ)


def write_archives(pages: DataFrame, rules: WarcRules | None = None) -> DataFrame:
    """Archives of all pages in the shared folder, read back as rows of `content`."""
    rules = rules or WarcRules()
    return written(archives(record_types(pages, rules), rules), "archives")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )
