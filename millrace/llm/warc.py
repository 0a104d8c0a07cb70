"""Conversion of legacy ARC archives to WARC, deduplication by payload, writing and reading back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import discard, new_folder, staged

# The header fields of the two ARC versions, as their version blocks spell them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

RECORD = "record_id string, key long, type string, uri string, date string, http string, payload binary, payload_bytes long, payload_digest string, truncated boolean"
_RECORD = pa.schema([("record_id", pa.string()), ("key", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("http", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("truncated", pa.bool_())])
_ARCHIVE_BYTES = 4 << 20


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of about 4 MB by the length of field number weight."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + 200
        if size > _ARCHIVE_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _uri(url: str | None) -> str:
    """A URL without white space or control characters, as a header field needs it; unknown: for null or empty."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  \s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"


def arc_record(version: int, url: str | None, date: str, block: bytes, offset: int, name: str) -> bytes:
    """One ARC record: the version's header line with the declared length, the block, a newline."""
    fields = {"URL": _uri(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(fields[f] for f in ARC_FIELDS[version].split(" ")).encode() + b"\n" + block + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 millrace\n{ARC_FIELDS[version]}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    return (f"{line} {len(body)}\n" if version == 1 else f"{line} 200 - - 0 {name} {len(body)}\n").encode() + body


def to_arc(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """Pages (page_id, url, html) as ARC files of about 4 MB, rows (path, content) like the binaryFile source's.

    Blocks are HTTP responses whose body is the html in UTF-8 (null: empty) and whose X-Page-Id is the page's id (left out
    if null). Files take the format's versions 1 and 2 in turn. Other columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                version, name = count % 2 + 1, f"pages-{part:06d}-{count:06d}.arc"
                if not held:
                    held, size = [head := arc_head(version, name, date)], len(head)
                own = "" if page is None else f"X-Page-Id: {page}\r\n"
                held.append(arc_record(version, url, date, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n".encode() + (html or "").encode(), size, name))
                size += len(held[-1])
                if size > _ARCHIVE_BYTES:
                    yield _batch([(name, b"".join(held))], schema)
                    held, count = [], count + 1
        if held:
            yield _batch([(f"pages-{part:06d}-{count:06d}.arc", b"".join(held))], schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, "path string, content binary")


def parse_arc(path: str, content: bytes) -> Iterator[tuple]:
    """RECORD rows of one ARC file (gzip or plain). Field names come from the version block, the block's extent from the
    declared length; a block cut off by the file's end is kept and marked truncated. A file without a version block raises."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    if not content.startswith(b"filedesc://"):
        raise ValueError(f"{path} does not begin with an ARC version block")
    at = content.index(b"\n") + 1
    length = int(content[:at].split()[-1])
    version, names = content[at : at + length].decode("latin-1").split("\n")[:2]
    fields = names.split(" ")
    if fields != ARC_FIELDS.get(int(version.split(" ")[0]), "").split(" "):
        raise ValueError(f"{path}: version {version!r} with fields {names!r}")
    at += length
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        head = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if len(head) != len(fields) or not head[-1].isdigit():
            raise ValueError(f"{path}: malformed header line at byte {at}")
        line = dict(zip(fields, head))
        block = content[end + 1 : end + 1 + (size := int(line["Archive-length"]))]
        is_http = block.startswith(b"HTTP/") and b"\r\n\r\n" in block
        http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
        key = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", http)
        when = line["Archive-date"].ljust(14, "0")
        date = f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:14]}Z"
        identity = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{at} {line['URL']}')}"
        yield identity, int(key[1]) if key else None, "response" if is_http else "resource", line["URL"], date, http.decode("latin-1"), payload, len(payload), digest(payload), len(block) < size
        at = end + 1 + size


def convert(archives: DataFrame) -> DataFrame:
    """ARC files (path, content) to WARC records: identifiers from place and URL, ISO dates, types, payload digests.

    A file that isn't ARC raises, as does a null content; an empty table gives no rows; other columns are ignored. Files of
    equal path and content give equal identifiers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _in_batches(parse_arc(path, content.as_py()), _RECORD, 6)

    return archives.select("path", "content").mapInArrow(read, RECORD)


def mark_revisits(records: DataFrame, least_bytes: int = 0, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Makes every record but one of each payload of at least least_bytes a revisit of that one.

    The one kept is that with the smallest key (null last), then the smallest record_id, so repeated rows are one
    response and revisits. records must give the same identifiers each time it is evaluated (a staged table does): it is
    read once for the digests' firsts, without payloads, and once to be marked. Only digests that occur more than once are
    looked up. While these are at most broadcast_bytes they go to the records, and payloads aren't shuffled; beyond, records are shuffled by
    digest, and a digest that a third of them share is split by the join's skew handling.
    """
    first = records.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(F.struct(F.col("key").isNull().alias("n"), "key", "record_id", "uri", "date")).alias("first"), F.count("*").alias("times"))
    first = staged(first.filter("times > 1").select("payload_digest", "first"), "warc-repeated")
    size = first.agg(F.sum(F.length("first.uri") + F.length("first.record_id") + 200)).first()[0] or 0
    joined = records.join(F.broadcast(first) if size <= broadcast_bytes else first, "payload_digest", "left").withColumn("again", (F.col("payload_bytes") >= least_bytes) & F.coalesce(F.col("first.record_id") != F.col("record_id"), F.lit(False)))
    kept = [c for c in records.columns if c not in ("type", "payload")]
    return joined.select(
        *kept,
        F.when(F.col("again"), F.lit("revisit")).otherwise(F.col("type")).alias("type"),
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
        *[F.when(F.col("again"), F.col(f"first.{c}")).alias(f"refers_{c}") for c in ("record_id", "key", "uri", "date")],
    )


def _warc_bytes(r: dict) -> bytes:
    """One WARC/1.1 record without its two closing line ends."""
    http = r["http"].encode("latin-1")
    block = http + b"\r\n\r\n" * bool(http) + (r["payload"] or b"")
    head = {
        "WARC-Type": r["type"], "WARC-Record-ID": f"<{r['record_id']}>", "WARC-Date": r["date"], "WARC-Target-URI": r["uri"],
        "WARC-Payload-Digest": f"sha1:{r['payload_digest']}", "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response" if http else "application/octet-stream",
        "X-Payload-Length": r["payload_bytes"], "X-Key": r["key"], "WARC-Truncated": "length" if r["truncated"] else None,
    }
    if r["type"] == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{r['refers_record_id']}>", "WARC-Refers-To-Target-URI": r["refers_uri"], "WARC-Refers-To-Date": r["refers_date"], "X-Refers-To-Key": r["refers_key"]}
    head["Content-Length"] = len(block)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block


def write(records: DataFrame, folder: str, file_bytes: int = 64 << 20) -> None:
    """Writes marked records as gzipped WARC files by Spark's committing text writer, whose line separator is a record's end.

    Files hold about file_bytes of payload: as many records as that makes at the records' mean length, by a count over their
    lengths only. Each task's first file opens with a warcinfo record. A task that is lost is run again; only committed
    files appear. The writer makes one gzip stream a file, so records can't be reached without what precedes them; read()
    passes over a file once and keeps one record at a time. Null keys have no key field; no records give an empty folder.
    """

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, first = pa.schema([("value", pa.binary())]), True
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64).to_pylist()
                made = [_warc_bytes(r) for r in rows]
                if first and made:
                    body = b"software: millrace\r\nformat: WARC File Format 1.1\r\n"
                    made.insert(0, f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'info ' + rows[0]['record_id'])}>\r\nWARC-Date: {rows[0]['date']}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body)
                    first = False
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=schema)

    mean = records.agg(F.avg(F.col("payload_bytes") + 1000)).first()[0] or file_bytes
    per_file = max(1, int(file_bytes / mean))
    records.mapInArrow(form, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").text(folder)


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header, block) of each record, by declared lengths; a gzipped file is decompressed record by record, whether it is
    one stream or has one a record. A cut-off record raises."""
    raw = io.BytesIO(content)
    file = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {file.tell()}")
        head = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().removesuffix("\r\n").partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        block = file.read(size)
        if len(block) < size or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('WARC-Record-ID')} is cut off")
        yield head, block


READ = "key long, type string, uri string, payload_bytes long, payload_digest string, refers_key long, payload binary"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Response, resource and revisit records of WARC files (rows of the binaryFile source). Lengths and digests of
    responses are of the payload found, checked against the header; those of revisits are the header's. Memory is a file's
    compressed bytes and one batch of records; an empty table gives no rows."""
    schema = pa.schema([("key", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_key", pa.int64()), ("payload", pa.binary())])

    def rows(content: bytes) -> Iterator[tuple]:
        for head, block in parse_warc(content):
            if (kind := head["WARC-Type"]) == "warcinfo":
                continue
            number = lambda name, head=head: int(head[name]) if name in head else None
            size, own = number("X-Payload-Length"), head["WARC-Payload-Digest"].removeprefix("sha1:")
            payload = None
            if kind != "revisit":
                payload = block.partition(b"\r\n\r\n")[2] if head["Content-Type"].startswith("application/http") else block
                if (len(payload), digest(payload)) != (size, own):
                    raise ValueError(f"record {head['WARC-Record-ID']} does not hold the payload that its header declares")
            yield number("X-Key"), kind, head["WARC-Target-URI"], size, own, number("X-Refers-To-Key"), payload if payloads else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _in_batches(rows(content.as_py()), schema, 6)

    return archives.select("content").mapInArrow(parse, READ)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """pages through ARC files to deduplicated WARC files in folder (by default a new shared one), read back.

    An empty table gives an empty folder and no rows.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    records = staged(convert(to_arc(pages)), "warc-records")  # converted once, so identifiers can't differ between its readers
    write(mark_revisits(records, least_bytes), folder)
    discard(records)
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder), payloads=False)
