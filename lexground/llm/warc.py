"""Legacy archives to WARC: ARC version 1 and 2 files are parsed by their header lines and declared lengths, and equivalent
WARC records (ids, timestamps, types, digests) are made, deduplicated by payload digest, written and read back.

Files are written by Spark's text writer (a WARC record ends in two line breaks, which is the writer's line separator) and
read by its binaryFile source, so any store that Spark knows will do.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices
from .common import bound_batches

# Field names of the two ARC versions' record lines, and line ends of WARC.
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
END = "\r\n"

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 100
#: Bytes of one ARC archive, and records of one WARC file.
ARCHIVE_BYTES, RECORDS_PER_FILE = 4_000_000, 4096

ARCHIVES = "archive string, content binary"
RECORDS = "archive string, offset long, page_id long, record_type string, record_id string, date string, target_uri string, ip string, mime string, block binary, payload_bytes long, payload_digest string"


def _url(url: str | None) -> str:
    """A url fit for a header line: no white space, no control characters, never empty."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  　\x85]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def _pack(version: int | None, date: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        for n, batch in enumerate(slices(batches, "html", most=ARCHIVE_BYTES)):
            v = version or 1 + n % 2
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
            # By place and content: a task that runs again gives the same name, and no other does.
            own = hashlib.sha1(f"{task}/{n}".encode())
            for row in rows:
                own.update(repr(row).encode("utf-8", "surrogatepass"))
            name = "arc-" + own.hexdigest()[:20]
            about = f"{v} 0 {'Origin' if v == 1 else 'reserved Origin'}\n{V1 if v == 1 else V2}\n\n".encode()
            middle = "" if v == 1 else f"200 - - 0 {name} "
            out = [f"filedesc://{name}.arc 0.0.0.0 {date} text/plain {middle}{len(about)}\n".encode(), about]
            at = sum(map(len, out))
            for key, url, html in rows:
                body = (html or "").encode()
                own = "" if key is None else f"X-Page-Id: {key}{END}"
                block = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{own}Content-Length: {len(body)}{END}{END}".encode() + body
                middle = "" if v == 1 else f"200 {zlib.crc32(block):08x} - {at} {name} "
                line = f"{_url(url)} 0.0.0.0 {date} text/html {middle}{len(block)}\n".encode()
                out += [line, block, b"\n"]
                at += len(line) + len(block) + 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], names=["archive", "content"])

    return pack


def write_arc(pages: DataFrame, version: int | None = None, date: str = "20240101000000") -> DataFrame:
    """Pack ``pages(page_id, url, html)`` into ARC archives of about ARCHIVE_BYTES: rows (archive, content).

    ``version`` 1 or 2; None alternates. A null html is an empty payload, a null url the url '-'; a null page_id has no
    X-Page-Id line. Each record holds an HTTP response whose body is the html in UTF-8.
    """
    bound_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_pack(version, date), ARCHIVES)


def _inflated(content: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """``content`` in pieces, ``step`` packed bytes at a time, unpacked if it is gzip of one or more members."""
    view, at = memoryview(content), 0
    if view[:2] != b"\x1f\x8b":
        yield content
    while view[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            yield z.decompress(view[at : at + step])
            at += step
        at = min(at, len(view)) - len(z.unused_data)


def _inflate(content: bytes) -> bytes:
    return b"".join(_inflated(content))


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of every record of an ARC file, the version block first.

    The field names come from the version block; without one, those of the version whose field count fits. A declared
    length that runs past the end, or a line that is no header, ends the archive with ValueError.
    """
    content, at, names = _inflate(content), 0, None
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(content):
            return
        stop = content.find(b"\n", at)
        fields = content[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ") if stop >= 0 else []
        if len(fields) < 5 or not fields[-1].isdigit():
            raise ValueError(f"no ARC header at byte {at}")
        length = int(fields[-1])
        block = content[stop + 1 : stop + 1 + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} declares {length} bytes and has {len(block)}")
        if fields[0].startswith("filedesc:") and names is None:
            lines = block.decode("utf-8", "replace").split("\n")
            names = lines[1].split(" ") if len(lines) > 1 else None
        own = names if names and len(names) == len(fields) else (V1 if len(fields) == 5 else V2).split(" ")
        yield at, dict(zip(own, fields, strict=False)), block
        at = stop + 1 + length


def _payload(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and body of a block; without a head all is body."""
    if block[:5] == b"HTTP/":
        cut = block.find(b"\r\n\r\n")
        if cut >= 0:
            return block[: cut + 4], block[cut + 4 :]
    return b"", block


def _date(stamp: str) -> str:
    """14 (or fewer) digits to W3C form; missing digits are the least."""
    s = (stamp if stamp.isdigit() else "") + "00000101000000"[len(stamp if stamp.isdigit() else "") :]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


_FIELDS = [c.split(" ") for c in RECORDS.split(", ")]
_TYPES = [{"long": pa.int64(), "binary": pa.binary()}.get(kind, pa.string()) for _, kind in _FIELDS]


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            archive, content = batch.column("archive")[i].as_py(), batch.column("content")[i].as_py()
            rows = []
            for at, head, block in arc_records(content or b""):
                http, body = _payload(block)
                page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
                kind = "warcinfo" if head["URL"].startswith("filedesc:") else "response" if http else "resource"
                rows.append((archive, at, int(page[1]) if page else None, kind, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{at}')}>", _date(head["Archive-date"]), head["URL"], head["IP-address"], head["Content-type"], block, len(body), hashlib.sha256(body).hexdigest()))
            for k in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 512], strict=True), _TYPES, strict=True)], names=[n for n, _ in _FIELDS])


def convert_arc(archives: DataFrame) -> DataFrame:
    """ARC archives (archive, content) to WARC records, one row each (schema RECORDS).

    Types: the version block is ``warcinfo``, an HTTP reply ``response``, all else ``resource``. The record id is a name-based
    UUID of archive and offset; the digest is SHA-256 (hex) of the payload, the HTTP body.
    A null content has no record.
    """
    return archives.select("archive", "content").mapInArrow(_convert, RECORDS)


def convert_pages(pages: DataFrame, version: int | None = None, date: str = "20240101000000") -> DataFrame:
    """``convert_arc(write_arc(pages))`` in one pass: each archive is parsed as soon as it is packed, so that a task holds one."""
    bound_batches(pages.sparkSession)
    pack = _pack(version, date)
    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: _convert(pack(batches)), RECORDS)


def mark_revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``refers_to`` (page) and ``refers_to_id`` (record): of responses with equal payloads of at least ``least`` bytes all
    but the one with the smallest page_id become ``revisit`` and keep only their HTTP head.

    Digests are counted before they are joined, so a hot payload is one row a task there; its many records are split by AQE.
    Records that can't be revisits have keys of their own in the join, which spread.
    """
    can = (F.col("record_type") == "response") & (F.col("payload_bytes") >= least)
    shared = (
        records.where(can)
        .groupBy(F.col("payload_digest").alias("d"))
        .agg(F.count("*").alias("n"), F.min(F.struct("page_id", "record_id")).alias("first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("known"))
        .where("n > 1")
        .select("d", F.coalesce("known", "first").alias("first"))
    )
    out = records.withColumn("_key", F.when(can, F.col("payload_digest")).otherwise(F.col("record_id"))).join(shared, F.col("_key") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    head = F.expr("substring(block, 1, length(block) - cast(payload_bytes as int))")
    return out.select(
        *[c for c in records.columns if c not in ("record_type", "block")],
        F.when(again, F.lit("revisit")).otherwise(F.col("record_type")).alias("record_type"),
        F.when(again, head).otherwise(F.col("block")).alias("block"),
        F.when(again, F.col("first.page_id")).alias("refers_to"),
        F.when(again, F.col("first.record_id")).alias("refers_to_id"),
    )


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as gzipped WARC files below ``path``."""
    line = lambda name, value: F.when(F.col(value).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(value).cast("string"), F.lit(END))).otherwise("")
    mime = F.when(F.col("record_type").isin("response", "revisit"), F.lit("application/http; msgtype=response")).otherwise(F.coalesce("mime", F.lit("application/octet-stream")))
    profile = F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}")).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Date", "date"), line("WARC-Target-URI", "target_uri"), line("WARC-IP-Address", "ip"),
        profile, line("WARC-Refers-To", "refers_to_id"), line("X-Refers-To-Page", "refers_to"), F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit(END), line("X-Payload-Length", "payload_bytes"),
        F.lit("Content-Type: "), mime, F.lit(END), F.lit("Content-Length: "), F.length("block").cast("string"), F.lit(END + END),
    )
    whole = F.concat(head.cast("binary"), F.col("block")).cast("string")
    records.select(whole.alias("value")).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def warc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of every record of a WARC file, unpacked as far as the record goes; ValueError where one is
    damaged."""
    pieces, held, base = _inflated(content), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while not held and more():
            pass
        if not held:
            return
        while (stop := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if held[:5] != b"WARC/" or stop < 0:
            raise ValueError(f"no WARC record at byte {base}")
        head = dict(x.split(": ", 1) for x in bytes(held[:stop]).decode("utf-8", "replace").split(END)[1:])
        length = int(head["Content-Length"])
        end = stop + 4 + length
        while len(held) < end + 4 and more():
            pass
        if len(held) < end:
            raise ValueError(f"the record at byte {base} declares {length} bytes and has {len(held) - stop - 4}")
        yield base, head, bytes(held[stop + 4 : end])
        del held[: end + 4]
        base += end + 4


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, target_uri string, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the WARC files below ``path``. Sizes and digests of responses are taken from the payload that was read, and
    a response whose SHA-256 differs from its header fails the task; those of revisits are the declared ones (null size if none is
    declared). Digests of other kinds are not compared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            names = [c.split(" ")[0] for c in READ.split(", ")]
            for i in range(batch.num_rows):
                rows, held = [], 0
                for at, head, block in warc_records(batch.column("content")[i].as_py()):
                    http, body = _payload(block)
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
                    size, digest = len(body), hashlib.sha256(body).hexdigest()
                    declared = head.get("WARC-Payload-Digest", "")
                    if head["WARC-Type"] == "revisit":
                        known = head.get("X-Payload-Length")
                        size, digest = int(known) if known else None, declared.removeprefix("sha256:")
                    elif declared.startswith("sha256:") and digest != declared.removeprefix("sha256:"):
                        raise ValueError(f"damaged payload at byte {at}")
                    to = head.get("X-Refers-To-Page")
                    rows.append((int(page[1]) if page else None, size, digest, head["WARC-Type"], int(to) if to else None, head["WARC-Record-ID"], head["WARC-Date"], head.get("WARC-Target-URI"), body if payloads else None))
                    held += len(body) if payloads else 0
                    if len(rows) == 1024 or held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, READ)
