"""WARC: a converter from the legacy archive format, and readers and writers for both.

An archive is a row (name, content). Legacy archives have versions 1 and 2, whose record lines
differ: ``URL IP date type length``, and ``URL IP date type status checksum location offset file
length``. Bodies are found by the declared length alone, never by searching for a separator.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, store, text_or_empty

#: Bytes of a legacy archive, and of a WARC file before compression, give or take a record.
ARCHIVE_BYTES, WARC_BYTES = 4 << 20, 32 << 20
#: Bytes that are inflated at a time, and rows of a batch of records read.
_CHUNK, _ROWS = 1 << 16, 1000
MIN_REVISIT_BYTES = 1000
CAPTURED = "20240101000000"
#: Fields of a record line after the URL, by version. Fixed values of the format.
LINE_FIELDS = {
    1: ("ip", "stamp", "type", "length"),
    2: ("ip", "stamp", "type", "status", "checksum", "location", "offset", "file", "length"),
}
LINE_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_ARCHIVE = pa.schema([("name", pa.string()), ("content", pa.binary())])
_RECORD = pa.schema([
    ("name", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()),
    ("head", pa.string()), ("payload", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])
_READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("warc_date", pa.string()),
])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int64': 'long'}).get(str(f.type), str(f.type))}" for f in schema)


def _clean(url: str | None) -> str:
    """A URL as one field of a line: white space and controls in percent form; none is a dash."""
    if not url:
        return "-"
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def arc_version_block(name: str, version: int) -> bytes:
    about = f"{version} 0 tidemark\n{LINE_NAMES[version]}\n".encode()
    middle = {1: "", 2: "200 - - 0 " + name + " "}[version]
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {middle}{len(about)}\n".encode() + about


def arc_record(name: str, version: int, offset: int, page_id: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8")
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode() + payload
    middle = {1: "", 2: f"200 {hashlib.md5(payload).hexdigest()} - {offset} {name} "}[version]
    return f"\n{_clean(url)} 0.0.0.0 {CAPTURED} text/html {middle}{len(body)}\n".encode() + body


def pages_to_arc(pages: DataFrame, version: int | None = None) -> DataFrame:
    """Pages as legacy archives of about ARCHIVE_BYTES; of both versions, dealt by a hash of the row.

    An archive lives only as long as its row; a longer page gets an archive of its own size. Names
    hold a checksum of the content's first record, so that they differ between tasks.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
            for kind in LINE_FIELDS if version is None else (version,):
                parts: list[bytes] = []
                size, name = 0, ""
                for row in rows:
                    if version is None and 1 + zlib.crc32(repr(row[:2]).encode("utf-8", "surrogatepass")) % 2 != kind:
                        continue
                    if not parts:
                        name = f"pages-{zlib.crc32(arc_record('', kind, 0, *row)):08x}-{row[0]}.arc"
                        parts.append(arc_version_block(name, kind))
                        size = len(parts[0])
                    parts.append(arc_record(name, kind, size + 1, *row))
                    size += len(parts[-1])
                    if size >= ARCHIVE_BYTES:
                        yield archive(name, parts)
                        parts = []
                if parts:
                    yield archive(name, parts)

    def archive(name: str, parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"name": name, "content": b"".join([*parts, b"\n"])}], schema=_ARCHIVE)

    return pages.select("page_id", "url", "html").mapInArrow(write, _ddl(_ARCHIVE))


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of one legacy archive: the line's fields by name, and ``body``.

    The version is that of the version block. A line is split from the right, so a URL may hold
    spaces. A wrong or missing length is an error, not a guess.
    """
    at, version = 0, 0
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8").rstrip("\r")
        if not version:
            about = content[end + 1 : content.index(b"\n", end + 1)].split(b" ")
            version = int(about[0])
            if version not in LINE_FIELDS or not line.startswith("filedesc://"):
                raise ValueError(f"not a legacy archive of a known version: {line[:80]}")
        names = LINE_FIELDS[version]
        url, *fields = line.rsplit(" ", len(names))
        if len(fields) != len(names) or not fields[-1].isdigit():
            raise ValueError(f"not a version {version} record line: {line[:80]}")
        row = dict(zip(names, fields, strict=True)) | {"url": url}
        size = int(row["length"])
        if end + 1 + size > len(content):
            raise ValueError(f"the archive ends within {url[:80]}")
        row["body"] = content[end + 1 : end + 1 + size]
        at = end + 1 + size
        if not url.startswith("filedesc://"):
            yield row


def arc_records(archives: DataFrame) -> DataFrame:
    """Rows of all records in archives (name, content), with the payload's length and SHA-1."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for r in parse_arc(content):
                    head, _, payload = r["body"].partition(b"\r\n\r\n")
                    ids = [x[10:].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")]
                    rows.append({
                        "name": name, "url": r["url"], "ip": r["ip"], "stamp": r["stamp"], "page_id": int(ids[0]) if ids and ids[0] else None,
                        "head": head.decode(), "payload": payload.decode(), "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return archives.select("name", "content").mapInArrow(read, _ddl(_RECORD))


def _record_id(page_id: Column, digest: Column) -> Column:
    """A name-based identifier: the same record has the same one in every run."""
    h = F.sha1(F.concat_ws("|", F.lit("record"), page_id.cast("string"), digest))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def find_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Digests that several records of at least ``min_bytes`` share, with the largest page_id.

    Counts and maxima are combined before the shuffle, so a payload that a third of all pages have
    is one row per task.
    """
    return (
        records.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .filter("n > 1").select("payload_digest", "response_id")
    )


def warc_text(records: DataFrame, revisits: DataFrame) -> DataFrame:
    """Each record in WARC/1.1 as one string, without the two line ends that follow a record."""
    refers = F.when(F.col("page_id").eqNullSafe(F.col("response_id")), F.lit(None)).otherwise(F.col("response_id"))
    stamp = [F.substring("stamp", a, n) for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    date = F.concat(stamp[0], F.lit("-"), stamp[1], F.lit("-"), stamp[2], F.lit("T"), stamp[3], F.lit(":"), stamp[4], F.lit(":"), stamp[5], F.lit("Z"))
    is_revisit = F.col("_refers").isNotNull()
    head = F.concat(F.col("head"), F.lit("\r\n\r\n"))
    block = F.when(is_revisit, head).otherwise(F.concat(head, F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("_block")))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            is_revisit,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                line("WARC-Refers-To", _record_id(F.col("_refers"), F.col("payload_digest"))),
                line("X-Refers-To-Page", F.col("_refers").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    joined = records.join(revisits, "payload_digest", "left").withColumn("_refers", refers).withColumn("_block", block)
    return joined.select(F.concat(header, F.col("_block")).alias("value"))


def write_warc(records: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = WARC_BYTES) -> None:
    """Convert legacy records to WARC and write compressed archive files to ``path``, a member for each record.

    Only digests that repeat are joined back to the records, from a stored table, so that Catalyst
    sees its size: if small it is broadcast and the payloads don't move. A file has about
    ``archive_bytes`` before compression, so neither a writer nor a reader holds more than that and
    one record. Each file ends with a zero byte, the padding that readers of gzip skip.
    """
    revisits, _ = store(find_revisits(records, min_bytes), "revisits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for value in batch.column("value"):
                raw = value.as_py().encode("utf-8", "surrogatepass") + b"\r\n\r\n"
                if parts and size + len(raw) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])
                    parts, size = [], 0
                parts.append(gzip.compress(raw, 6, mtime=0))
                size += len(raw)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    archives = warc_text(records, revisits).mapInArrow(pack, "content binary").select(F.col("content").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(raw: bytes) -> Iterator[bytes]:
    """The parts of an archive, each inflated: one for each gzip member, or all if it isn't compressed."""
    if raw[:2] != b"\x1f\x8b":
        yield raw.rstrip(b"\0")
        return
    at, view = 0, memoryview(raw)
    while raw[at : at + 2] == b"\x1f\x8b":
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof and at < len(raw):
            chunk = view[at : at + _CHUNK]
            parts.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        if not inflate.eof:
            raise ValueError("the archive ends within a member")
        yield b"".join(parts)
    if raw[at:].strip(b"\0"):
        raise ValueError("bytes after the last member")


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; lengths and digests in hex are checked."""
    at = 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("the archive ends within a header")
        first, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:80]}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"a record without a length: {fields.get('warc-record-id')}")
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        want = fields.get("warc-block-digest", "")
        if len(block) < size or (_hex_digest(want) and want.lower() != f"sha1:{hashlib.sha1(block).hexdigest()}"):
            raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
        yield fields, block
        at = end + 4 + size


def _hex_digest(text: str) -> bool:
    """Digests are often in base 32; only those in hex are compared here."""
    kind, _, value = text.partition(":")
    return kind.lower() == "sha1" and len(value) == 40


def _row(f: dict[str, str], block: bytes) -> dict:
    """One record as a row; what a foreign record lacks is null or computed from its block."""
    kind = f.get("warc-type")
    http = f.get("content-type", "").startswith("application/http") or block.startswith(b"HTTP/")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    ids = [x[10:].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")]
    declared, own = f.get("warc-payload-digest", ""), hashlib.sha1(payload).hexdigest()
    if kind == "response" and _hex_digest(declared) and declared.lower() != f"sha1:{own}":
        raise ValueError(f"the payload isn't that of the header: {f.get('warc-record-id')}")
    revisit = kind == "revisit"
    length, to = f.get("x-payload-length", ""), f.get("x-refers-to-page", "")
    digest = declared.partition(":")[2] or None if revisit else own
    return {
        "page_id": int(ids[0]) if ids and ids[0] else None, "payload_bytes": (int(length) if length.isdigit() else None) if revisit else len(payload),
        "payload_digest": digest, "record_type": kind, "refers_to": int(to) if revisit and to else None,
        "record_id": f.get("warc-record-id"), "url": f.get("warc-target-uri"), "warc_date": f.get("warc-date"),
    }


def warc_records(archives: DataFrame) -> DataFrame:
    """One row per record of archives in ``content``, compressed by member, as a whole, or not at all.

    Records of any type give a row; warcinfo and others have no page_id. Damaged ones are errors.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for part in members(content.as_py()):
                    rows += [_row(f, block) for f, block in parse_warc(part)]
                    if len(rows) >= _ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return archives.select("content").mapInArrow(read, _ddl(_READ))


def read_warc(spark, path: str) -> DataFrame:
    """One row per record of the archive files below ``path``; names that begin with _ or . are no archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return warc_records(files)


def pages_through_warc(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages to legacy archives, from there to WARC on disk, and back from the archives.

    Null html is an empty payload; null page_ids stay null and are never referred to while another
    page has the payload. Pages that agree in payload and in the largest page_id are all responses.
    An empty table gives no archive and no row. Other columns of the input are not archived.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    held = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    write_warc(arc_records(pages_to_arc(held)), path, min_bytes)
    return read_warc(spark, path)
