"""Converter from the legacy ARC format to WARC.

An ARC file opens with a version block (``filedesc://``) whose second line
names the version and whose third line names the fields of every record
header: five fields in version 1, ten in version 2. A record is one header
line, then as many bytes as its last field declares, then a line feed. Fields
are taken by the version block's names, records are cut by their declared
lengths alone, so bodies may hold anything.

Each ARC record becomes a WARC record: a type from the scheme (web pages are
``response``, others ``resource``), a date from the 14-digit archive date, the
payload's SHA-256, and a record id made from place and content, so that a
second conversion gives the same ids. Of records with equal payloads of at
least ``MIN_BYTES`` bytes, the one with the smallest page id (then file and
place) stays a response; the others become ``revisit`` records that refer to
it and hold the HTTP header only. Equality is decided by digest and length:
one aggregation over narrow rows and a join back. Payloads never pass a
shuffle; each task converts whole ARC files of bounded size.

Files are gzipped record by record. The page's id travels in an HTTP header,
``X-Page-Id``.

Defined results: a null payload is empty; a null url is written as
``unknown:`` and read as null; a null page id has no ``X-Page-Id``, reads as
null and comes after all others when the smallest is sought; rows that repeat
a page id with an equal payload are one response and revisits of it; an empty
table gives no archives and an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, batches, new_folder, pick, read_bytes, stored, write_bytes

MIN_BYTES = 100
#: An archive is closed when its compressed records reach this size.
ARCHIVE_BYTES = 8 << 20
GZIP_LEVEL = 1
#: Capture time and address written into the ARC records of pages that have none.
CAPTURED, ADDRESS = "20240101000000", "0.0.0.0"

#: The field names of the version blocks.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# ---------------------------------------------------------------------------
# gzip members, HTTP heads
# ---------------------------------------------------------------------------

def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def gunzip(raw: bytes) -> bytes:
    """All members of a gzip file, one after another; other bytes as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out, at, z = [], 0, zlib.decompressobj(31)
    while at < len(raw):
        chunk = raw[at:at + 32768]
        out.append(z.decompress(chunk))
        at += len(chunk) - len(z.unused_data)
        if z.eof:
            z = zlib.decompressobj(31)
    return b"".join(out)


def http_message(page_id: int | None, payload: bytes) -> bytes:
    mine = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mine
            + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(head with its blank line, payload, headers by lower-case name); no head if it isn't HTTP."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return b"", block, {}
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return block[:end + 4], block[end + 4:], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


# ---------------------------------------------------------------------------
# ARC
# ---------------------------------------------------------------------------

class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    body: bytes


def arc_version_block(version: int, name: str) -> bytes:
    about = f"{version} 0 colloquy\n{ARC_FIELDS[version]}\n".encode()
    spec = ["filedesc://" + name, ADDRESS, CAPTURED, "text/plain"]
    if version == 2:
        spec += ["200", "-", "-", "0", name]
    return " ".join([*spec, str(len(about))]).encode() + b"\n" + about + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, body: bytes) -> bytes:
    # blanks and control characters would break the header line
    where = "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url or "") or "unknown:"
    fields = [where, ADDRESS, CAPTURED, "text/html"]
    if version == 2:
        fields += ["200", "-", "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode("utf-8", "surrogatepass") + b"\n" + body + b"\n"


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block; raises ValueError where a header or length is wrong."""
    data = gunzip(raw)
    names: list[str] = []
    at = 0
    while at < len(data):
        if data[at:at + 1] == b"\n":  # separators, any number of them
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header without an end at {at}")
        values = data[at:end].decode("utf-8", "surrogatepass").split(" ")
        if values[-1].isdigit() is False:
            raise ValueError(f"ARC header without a length at {at}")
        body = data[end + 1:end + 1 + int(values[-1])]
        if len(body) != int(values[-1]):
            raise ValueError(f"ARC record at {at} is shorter than declared")
        if values[0].startswith("filedesc://"):
            lines = body.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            names = lines[1].split(" ")
        else:
            if len(values) != len(names):
                raise ValueError(f"ARC header at {at} has {len(values)} fields, its version {len(names)}")
            yield ArcRecord(at, dict(zip(names, values)), body)
        at = end + 1 + len(body)


def write_arc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """Write pages as ARC files, of version 1 and 2 in turn; a row (path, records) per file."""
    folder = folder or new_folder(pages.sparkSession, "arc")
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)

    def write(it):
        from pyspark import TaskContext

        part, seq, made, members, size, offset, name, version = TaskContext.get().partitionId(), 0, [], [], 0, 0, "", 1

        def close():
            path = f"{folder}/{name}"
            write_bytes(path, b"".join(members))
            made.append((path, len(members) - 1))

        for b in batches(it):
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if not members:
                    version = 1 + (part + seq) % 2
                    name = f"pages-{part:06d}-{seq:05d}.arc.gz"
                    head = arc_version_block(version, name)
                    members, size, offset = [gzip_member(head)], 0, len(head)
                body = http_message(page_id, (html or "").encode("utf-8", "surrogatepass"))
                record = arc_record(version, name, offset, url, body)
                members.append(gzip_member(record))
                offset += len(record)
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    members, seq = [], seq + 1
        if members:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["path", "records"])

    return stored(arrow_map(rows, write, "path string, records long"), "arc-manifest")


# ---------------------------------------------------------------------------
# WARC
# ---------------------------------------------------------------------------

def record_id(arc: str, record: ArcRecord) -> str:
    """The same place and content give the same id."""
    at = f"{arc.rsplit('/', 1)[-1]}#{record.offset}#{hashlib.sha256(record.body).hexdigest()}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, at)}>"


def warc_date(archive_date: str) -> str:
    d = (archive_date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, identity: str, date: str, block: bytes, fields: dict[str, str | None]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": identity, "WARC-Date": date, **fields,
            "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def convert(arc: str, record: ArcRecord, refers_to: str | None) -> bytes:
    """The WARC record of an ARC record: a revisit of ``refers_to`` if that is given."""
    url = record.fields["URL"]
    head, payload, _ = split_http(record.body)
    web = url.split(":", 1)[0].lower() in ("http", "https", "unknown") and bool(head)
    fields = {
        "WARC-Target-URI": None if url == "unknown:" else url,
        "WARC-IP-Address": record.fields["IP-address"],
        "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(),
        "Content-Type": "application/http; msgtype=response" if head else record.fields["Content-type"],
    }
    date = warc_date(record.fields["Archive-date"])
    if refers_to is not None:
        fields |= {"WARC-Refers-To": refers_to,
                   "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return warc_record("revisit", record_id(arc, record), date, head, fields)
    # A record of an unknown place is a web page too if it holds an HTTP message.
    return warc_record("response" if web or head else "resource", record_id(arc, record), date, record.body, fields)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record, cut by declared lengths."""
    data, at = gunzip(raw), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = data[end + 4:end + 4 + n]
        if len(block) != n or data[end + 4 + n:end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at {at} is not as long as declared")
        yield fields, block
        at = end + 8 + n


def arc_digests(archives: DataFrame) -> DataFrame:
    """A narrow row per ARC record: arc, place, record_id, page_id, digest, payload_bytes."""
    def read(it):
        for b in it:
            for path in b.column("path").to_pylist():
                rows = []
                for r in parse_arc(read_bytes(path)):
                    _, payload, headers = split_http(r.body)
                    page = headers.get("x-page-id")
                    rows.append((path, r.offset, record_id(path, r), None if page is None else int(page),
                                 hashlib.sha256(payload).hexdigest(), len(payload)))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     ["arc", "place", "record_id", "page_id", "digest", "payload_bytes"])

    return arrow_map(_dealt(archives), read, "arc string, place long, record_id string, page_id long, digest string, "
                     "payload_bytes long")


def _dealt(files: DataFrame) -> DataFrame:
    """File names, one to a task as far as the scheduler likes."""
    return files.select("path").repartition(max(1, files.count()))


def to_warc(archives: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Convert ARC files (rows with ``path``) to WARC files; a row (path, records) per file."""
    spark = archives.sparkSession
    folder = folder or new_folder(spark, "warc")
    found = stored(arc_digests(archives), "arc-digests")
    same = ["digest", "payload_bytes"]
    # the first record of every payload that is there twice or more
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "arc", "place", "record_id")
    firsts = stored(found.where(F.col("payload_bytes") >= min_bytes).groupBy(*same)
                    .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select(*same, F.col("first.record_id").alias("refers_to")), "arc-firsts")
    decided = found.join(firsts, same, "left").select(
        "arc", "place", F.when(F.col("refers_to") != F.col("record_id"), F.col("refers_to")).alias("refers_to"))
    # the decisions of an archive come together again; an archive is bounded. They are narrow, so the
    # number of partitions is given: left to itself, Spark would convert all archives in one task
    ordered = decided.repartition(max(1, archives.count()), "arc").sortWithinPartitions("arc", "place")

    def write(it):
        name, refers, made = None, {}, []

        def close():
            target = f"{folder}/{name.rsplit('/', 1)[-1].replace('.arc', '.warc')}"
            about = b"software: colloquy arc_warc\r\nformat: WARC File Format 1.1\r\n"
            info = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, target)}>"
            out = [gzip_member(warc_record("warcinfo", info, warc_date(CAPTURED), about,
                                           {"Content-Type": "application/warc-fields"}))]
            out += [gzip_member(convert(name, r, refers[r.offset])) for r in parse_arc(read_bytes(name))]
            write_bytes(target, b"".join(out))
            made.append((target, len(out) - 1))

        for b in it:
            for arc, place, to in zip(*(b.column(c).to_pylist() for c in ("arc", "place", "refers_to"))):
                if arc != name:
                    if name is not None:
                        close()
                    name, refers = arc, {}
                refers[place] = to
        if name is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["path", "records"])

    return stored(arrow_map(ordered, write, "path string, records long"), "warc-manifest")


def read_warc(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of WARC files: record_id, record_type, target_uri, date, page_id, payload_bytes,
    payload_digest, refers_to_id and, if asked for, the payload (null for revisits).

    The digest of a record that holds its payload is computed anew and must be the one declared.
    """
    names = ["record_id", "record_type", "target_uri", "date", "page_id", "payload_bytes", "payload_digest",
             "refers_to_id", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    n = len(names) if with_payload else len(names) - 1

    def read(it):
        for b in it:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                for fields, block in parse_warc(read_bytes(path)):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    _, payload, headers = split_http(block)
                    declared = fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "revisit":
                        length, payload = int(headers.get("content-length", 0)), None
                    else:
                        length = len(payload)
                        if hashlib.sha256(payload).hexdigest() != declared:
                            raise ValueError(f"the payload of {fields['warc-record-id']} is not as declared")
                    page = headers.get("x-page-id")
                    rows.append((fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields["warc-date"],
                                 None if page is None else int(page), length, declared, fields.get("warc-refers-to"),
                                 payload)[:n])
                    size += len(payload or b"") * with_payload
                    if len(rows) >= 2000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[:n])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[:n])

    schema = "record_id string, record_type string, target_uri string, date string, page_id long, payload_bytes long, " \
             "payload_digest string, refers_to_id string" + ", payload binary" * with_payload
    return arrow_map(_dealt(files), read, schema)


def with_referred_pages(records: DataFrame) -> DataFrame:
    """``refers_to``: the page id of the record that a revisit refers to.

    Only records that are referred to are looked up, each once."""
    referred = records.where(F.col("refers_to_id").isNotNull()).select(F.col("refers_to_id").alias("_target")).distinct()
    own = records.select(F.col("record_id").alias("_own"), F.col("page_id").alias("refers_to"))
    targets = own.join(referred, F.col("_own") == F.col("_target"), "left_semi")
    return records.join(targets, F.col("refers_to_id") == F.col("_own"), "left").drop("_own")
