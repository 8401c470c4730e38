"""Legacy ARC archives turned into WARC archives, and both read back.

An ARC file begins with a version block that names its version and fields. A record is a header line with those fields,
the last of which is the declared length of what follows. The converter reads files by these lengths alone, so payloads
may hold anything, and gives each record a WARC identifier from its place, a timestamp, a type, and SHA-1 digests. What
begins as an HTTP message is a response; of responses with equal long payloads one stays and the others are revisits to
it. Anything else (``dns:`` records, files, answers without a head) is a resource of the type that its header names.

Archives are written and read by Spark alone, so they may lie in any store. A file is what one task writes, and is read as
one value of at most 2 GB. Archives aren't shuffled: each file meets its list of revisits by broadcast, in groups of files
with at most ``REVISITS`` of them.

Damaged and odd archives: a length beyond the end of a file makes a record truncated (``WARC-Truncated``); a line that is
no header is passed over until one is; a further version block sets the fields anew; heads may end lines with line feeds
alone, lack Content-Length, blanks behind colons or colons; a short date is filled up, one that is none is the epoch.

Cases: a null payload is empty; a null or blank url is given as ``urn:page``, blanks in one are escaped; a null page_id
is smaller than any other; of equal payloads and ids the first place in the archives is the response; repeated rows are
records of their own; an empty table gives no record; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import checkpointed, shared_folder, table

# Payloads of fewer bytes are never revisits.
LEAST = 1000
# Revisits that are broadcast together (some 100 bytes each), and groups of files that one job converts.
REVISITS = 400_000
WAVE = 16
# Bytes of records handed to Spark at once.
BATCH_BYTES = 4 << 20
DATE = "20240101000000"
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# What parts records in a file: it follows each of them. Spark's text writer adds it.
ARC_END, WARC_END = b"\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def written(records: DataFrame, folder: str, end: bytes) -> str:
    """Binary ``record``s, each followed by ``end``, as gzip files; Spark's text writer leaves bytes as they are."""
    records.select(F.col("record").cast("string")).write.mode("append").option("lineSep", end.decode()).option("compression", "gzip").text(folder)
    return folder


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, a piece at a time."""
    wanted = zlib.decompressobj(31)
    view = memoryview(content)
    for at in range(0, len(view), step):
        piece = wanted.decompress(view[at : at + step])
        while wanted.eof and wanted.unused_data:
            rest, wanted = wanted.unused_data, zlib.decompressobj(31)
            piece += wanted.decompress(rest)
        yield piece


class Reader:
    """Lines and byte counts from pieces; ``place`` is how far it has read."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.place = pieces, b"", 0, 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end of the file."""
        searched = 0
        while (end := self.held.find(b"\n", self.at + searched)) < 0:
            searched = len(self.held) - self.at
            if not self.more():
                return None
        out = self.held[self.at : end]
        self.place += end + 1 - self.at
        self.at = end + 1
        return out.removesuffix(b"\r")

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or what is left."""
        if len(self.held) - self.at < n:
            # A long record is gathered once, not a piece at a time.
            pieces = [self.held[self.at :]]
            have = len(pieces[0])
            while have < n and (piece := next(self.pieces, None)) is not None:
                pieces.append(piece)
                have += len(piece)
            self.held, self.at = b"".join(pieces), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        self.place += len(out)
        return out


HEADER = re.compile(rb"[^ ].* [0-9]+")


def arc_records(reader: Reader) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields by name, and block of each record, after the version block.

    A block is shorter than its ``Archive-length`` only where the file ends in it.
    """
    fields = ARC_FIELDS[1].split(" ")
    while True:
        place = reader.place
        line = reader.line()
        if line is None:
            return
        if not HEADER.fullmatch(line):
            continue
        if line.startswith(b"filedesc:"):
            # The version block: its own line has version 1's fields, its text the version and the fields of all others.
            block = reader.take(int(line.rsplit(b" ", 1)[1])).decode("latin-1").split("\n")
            named = block[1].strip().split(" ") if len(block) > 1 else []
            if named not in [known.split(" ") for known in ARC_FIELDS.values()]:
                raise ValueError(f"unknown version of an archive: {block[:2]}")
            fields = named
            continue
        values = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(values) == len(fields):
            found = dict(zip(fields, values, strict=True))
            yield place, found, reader.take(int(found["Archive-length"]))


def arc_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> str:
    """The pages as legacy archives of both versions, in turn: HTTP responses that name their page in a header."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(payload_column).cast("string").alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = 1 + task % 2
        name = f"pages-{task:06d}.arc"
        about = f"{version} 0 sitelode\n{ARC_FIELDS[version]}\n".encode()
        out = [f"filedesc://{name} 0.0.0.0 {DATE} text/plain {len(about)}\n".encode() + about]
        size, offset = 0, len(out[0]) + len(ARC_END)
        for batch in batches:
            for page, url, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                body = (payload.as_py() or "").encode()
                page = page.as_py()
                named = b"" if page is None else f"X-Page-Id: {page}\r\n".encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + named + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
                where = "%20".join((url.as_py() or "").split()) or "urn:page"
                middle = "" if version == 1 else f" 200 - - {offset} {name}"
                out.append(f"{where} 0.0.0.0 {DATE} text/html{middle} {len(block)}\n".encode() + block)
                size += len(block)
                offset += len(out[-1]) + len(ARC_END)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return written(rows.mapInArrow(write, "record binary"), folder, ARC_END)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, content`` of each archive file. A condition on the name is one on the listing: other files aren't opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return found.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "content")


@dataclass
class Message:
    """An HTTP message, or any other block (``is_http`` is false, the head is empty): head with the blank line, payload, page named in it."""

    is_http: bool
    head: bytes
    payload: bytes
    page: int | None


def message(block: bytes) -> Message:
    end = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
    if not end:
        # A message without a blank line is all head.
        http = block.startswith(b"HTTP/")
        return Message(http, block if http else b"", b"" if http else block, None)
    head = block[: end.end()]
    page = re.search(rb"(?im)^x-page-id:[ \t]*(-?[0-9]+)[ \t]*\r?$", head)
    return Message(True, head, block[end.end() :], None if page is None else int(page[1]))


def warc_records(reader: Reader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record."""
    while (line := reader.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while named := reader.line():
            name, value = named.decode().split(": ", 1)
            fields[name] = value
        yield fields, reader.take(int(fields["Content-Length"]))


def record_id(name: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{place}')}>"


def stamp(date: str) -> str:
    if not re.fullmatch("[0-9]{4,}", date):
        date = "1970"
    date = date[:14] + "00000101000000"[len(date) :] if len(date) < 8 else date.ljust(14, "0")
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_head(fields: dict[str, str | None], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def arc_payloads(spark: SparkSession, arcs: str) -> DataFrame:
    """``name, place, page_id, size, sha1`` of each whole HTTP message in the legacy archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                out = []
                for place, fields, block in arc_records(Reader(inflated(content.as_py()))):
                    m = message(block)
                    if m.is_http and len(block) == int(fields["Archive-length"]):
                        out.append((name.as_py(), place, m.page, len(m.payload), hashlib.sha1(m.payload).digest()))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "place", "page_id", "size", "sha1"])

    return files(spark, arcs).mapInArrow(read, "name string, place long, page_id long, size long, sha1 binary")


def converted(spark: SparkSession, arcs: str, folder: str, least: int = LEAST) -> str:
    """The legacy archives as WARC archives; a revisit has no payload and refers to the response with the same one."""
    known = checkpointed(arc_payloads(spark, arcs))
    # Of equal payloads the greatest page; of equal pages the first place. Only payloads that occur again are kept.
    first = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), (-F.col("page_id")).alias("less"), "name", "place")).alias("first")
    again = known.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.count("*").alias("n"), first).where("n > 1")
    pairs = known.join(again.select("sha1", "size", "first"), ["sha1", "size"])
    others = pairs.where((F.col("name") != F.col("first.name")) | (F.col("place") != F.col("first.place")))
    # One row for each file, with its revisits: where each is, and what it refers to.
    target = F.struct("place", F.col("first.name").alias("to_name"), F.col("first.place").alias("to_place"), (-F.col("first.less")).alias("to_page"))
    revisits = checkpointed(others.groupBy("name").agg(F.collect_list(target).alias("revisits")))
    groups = max(1, -(-(revisits.agg(F.sum(F.size("revisits"))).first()[0] or 0) // REVISITS))
    own = F.pmod(F.xxhash64("name"), F.lit(groups))
    parts = [files(spark, arcs).where(own == g).join(F.broadcast(revisits.where(own == g)), "name", "left").select("name", "content", "revisits") for g in range(groups)]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, listed in zip(*(batch.column(i) for i in range(3)), strict=True):
                name = name.as_py()
                to = {r["place"]: r for r in listed.as_py() or []}
                about = b"software: sitelode\r\nformat: WARC File Format 1.1\r\n"
                info = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, -1), "WARC-Date": stamp(DATE), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
                out, size = [warc_head(info, len(about)) + about], 0
                for place, fields, block in arc_records(Reader(inflated(content.as_py()))):
                    m, target = message(block), to.get(place)
                    whole = len(block) == int(fields["Archive-length"])
                    block = m.head if target else block
                    head = {
                        "WARC-Type": "revisit" if target else "response" if m.is_http else "resource",
                        "WARC-Record-ID": record_id(name, place),
                        "WARC-Date": stamp(fields["Archive-date"]),
                        "WARC-Target-URI": fields["URL"],
                        "WARC-IP-Address": fields["IP-address"],
                        "WARC-Payload-Digest": f"sha1:{hashlib.sha1(m.payload).hexdigest()}",
                        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
                        "WARC-Profile": PROFILE if target else None,
                        "WARC-Refers-To": record_id(target["to_name"], target["to_place"]) if target else None,
                        "WARC-Truncated": None if whole else "unspecified",
                        "X-Refers-To-Page": target["to_page"] if target else None,
                        "X-Payload-Bytes": len(m.payload) if target else None,
                        "Content-Type": "application/http;msgtype=response" if m.is_http else fields["Content-type"],
                    }
                    out.append(warc_head(head, len(block)) + block)
                    size += len(out[-1])
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    for at in range(0, groups, WAVE):
        written(reduce(DataFrame.unionByName, parts[at : at + WAVE]).mapInArrow(convert, "record binary"), folder, WARC_END)
    return folder


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of WARC archives; digests are checked against what was read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                out = []
                for fields, block in warc_records(Reader(inflated(content.as_py()))):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    if fields["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
                        raise ValueError(f"{fields['WARC-Record-ID']}: the block has another digest")
                    m = message(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and hashlib.sha1(m.payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload has another digest")
                    to = fields.get("X-Refers-To-Page")
                    size = len(m.payload) if kind != "revisit" else int(fields["X-Payload-Bytes"])
                    out.append((m.page, size, digest, kind, None if to is None else int(to), fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Date"], fields["WARC-Target-URI"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4)
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "warc_date", "target_uri"]
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, warc_date string, target_uri string"
    return files(spark, folder).mapInArrow(read, kinds)


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    arcs = arc_archives(table(spark, folder, "pages"), shared_folder(spark, "arc"))
    found = read_warc(spark, converted(spark, arcs, shared_folder(spark, "warc")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_WARC = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, row_number() OVER o AS n, first_value(page_id) OVER o AS top FROM p
  WINDOW o AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND n > 1 THEN top END AS refers_to FROM r
"""

QUERIES = {"op1_warc": op1_warc}
SQL = {"op1_warc": SQL_WARC}
