"""Media columns: a Spark data source of media archives.

An archive is a file of members, each behind its own header with length and CRC, and a footer with all offsets. The reader
plans byte ranges over the archives of a directory, streams members in Arrow batches, and reads a damaged or interrupted
member again by its offset, without touching the others. Writers add files under new names; only those named in a manifest,
written at commit, are ever read, so tasks that are run again or lost leave nothing behind that counts.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "doc_id bigint, media binary"
#: Bytes of a read range, of an archive file, of an Arrow batch.
RANGE_BYTES, FILE_BYTES, BATCH_BYTES = 8_000_000, 64_000_000, 4_000_000
#: Read ranges that the driver plans at about this number are made larger instead of more.
MOST_RANGES = 100_000
_HEAD, _FOOT = struct.Struct("<4sBqII"), struct.Struct("<QI4s")
_MEMBER, _INDEX = b"MBR1", b"IDX1"
WIDTH = 576


def _crc(key: int | None, media: bytes) -> int:
    """Over a member's id and bytes."""
    return zlib.crc32(media, zlib.crc32(repr(key).encode()))


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Range(InputPartition):
    """Spans (path, size of the file, first byte, end), of one archive or of several small ones."""

    def __init__(self, spans: list[tuple[str, int, int, int]]):
        self.spans = spans


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(dir)`` and ``df.write.format("media_archives").mode("append").save(dir)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("media archives can only be added to: use mode('append')")
        return ArchiveWriter(self.options)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, offsets, at, name = [], None, [], 0, ""

        def close():
            nonlocal out
            if out is not None:
                index = np.array(offsets, "<u8").tobytes()
                out.write(index + _FOOT.pack(at, zlib.crc32(index), _INDEX))
                out.close()
                files.append((name, at + len(index) + _FOOT.size))
                out = None

        for batch in iterator:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name, offsets, at = f"media-{uuid.uuid4().hex}.mar", [], 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                media = media or b""
                offsets.append(at)
                out.write(_HEAD.pack(_MEMBER, key is not None, key or 0, len(media), _crc(key, media)) + media)
                at += _HEAD.size + len(media)
                if at >= self.file_bytes:
                    close()
        close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


def read_index(f, size: int) -> np.ndarray:
    """Offsets of the members of an open archive."""
    f.seek(size - _FOOT.size)
    at, crc, magic = _FOOT.unpack(f.read(_FOOT.size))
    f.seek(at)
    index = f.read(size - _FOOT.size - at)
    if magic != _INDEX or zlib.crc32(index) != crc:
        raise OSError("damaged index")
    return np.frombuffer(index, "<u8").astype(np.int64)


def read_member(f, offset: int) -> tuple[int | None, bytes]:
    f.seek(offset)
    magic, known, key, size, crc = _HEAD.unpack(f.read(_HEAD.size))
    media = f.read(size)
    key = key if known else None
    if magic != _MEMBER or len(media) != size or _crc(key, media) != crc:
        raise OSError(f"damaged member at byte {offset}")
    return key, media


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.most_ranges = int(options.get("most_ranges", MOST_RANGES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[Range]:
        """Byte ranges, from file sizes alone: no member is listed on the driver. A range is ``range_bytes`` of the archives, one after
        the other, and larger where that would be over ``most_ranges`` of them; small files share a range."""
        from pyarrow import fs as pafs

        fs, root = _fs(self.path)
        files = []
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path, compression=None) as f:
                    files += json.loads(f.read())
        step = max(self.range_bytes, -(-sum(size for _, size in files) // self.most_ranges))
        out, spans, held = [], [], 0
        for name, size in files:
            lo = 0
            while lo < size:
                hi = min(size, lo + step - held)
                spans.append((f"{root}/{name}", size, lo, hi))
                held, lo = held + hi - lo, hi
                if held == step:
                    out.append(Range(spans))
                    spans, held = [], 0
        return [*out, Range(spans)] if spans or not out else out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Members that begin within the range."""
        for span in partition.spans:
            yield from self.members(*span)

    def members(self, path: str, size: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        """Members of one archive that begin from byte ``lo`` on, before ``hi``."""
        keys, media, held = [], [], 0
        archive = Archive(self.path, path, self.retries)
        try:
            offsets = archive.again(lambda f: read_index(f, size))
            for offset in offsets[(offsets >= lo) & (offsets < hi)].tolist():
                key, member = archive.again(lambda f, at=offset: read_member(f, at))
                keys.append(key), media.append(member)
                held += len(member)
                if held >= BATCH_BYTES:
                    yield _batch(keys, media)
                    keys, media, held = [], [], 0
            if keys:
                yield _batch(keys, media)
        finally:
            archive.close()


class Archive:
    """An archive file that is opened anew after an error: each action is tried up to ``retries`` times more, opening included."""

    def __init__(self, root: str, path: str, retries: int):
        self.fs, self.path, self.retries, self.file = _fs(root)[0], path, retries, None

    def again(self, action):
        for attempt in range(self.retries + 1):
            try:
                if self.file is None:
                    self.file = self.fs.open_input_file(self.path)
                return action(self.file)
            except (OSError, struct.error):
                self.close()
                if attempt == self.retries:
                    raise

    def close(self) -> None:
        if self.file is not None:
            with contextlib.suppress(OSError):
                self.file.close()
            self.file = None


def _batch(keys: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])


def payload_of(text: str | None, unit: int = WIDTH) -> bytes:
    """UTF-8 bytes, filled with bytes 255 up to a positive multiple of ``unit``."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey PNG whose samples, row by row, are the payload."""
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG without row filters."""
    at, data, width = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        data += [body] if kind == b"IDAT" else []
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filters are not in use here")
    return rows[:, 1:]


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty) as a PNG and add it to the archives below ``path``. Rows that repeat are members each, an empty
    table adds none, ids are whole numbers, and other columns are not stored."""
    from pyspark.sql import functions as F

    from .arrays import slices
    from .common import bound_batches, whole_ids

    bound_batches(docs.sparkSession)
    whole_ids(docs, id_col)
    docs.sparkSession.dataSource.register(MediaArchives)

    def encode(batches):
        for batch in slices(batches, "text", most=BATCH_BYTES):
            yield _batch(batch.column("doc_id").to_pylist(), [encode_png(payload_of(t)) for t in batch.column("text").to_pylist()])

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))  # names may have dots
    slim.mapInArrow(encode, "doc_id bigint, media binary").write.format("media_archives").mode("append").save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, media) of every member below ``path``; no archive: no row."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(path)


def features(media: DataFrame) -> DataFrame:
    """Decode members and describe them: sizes, digests, and ``feature``: mean, deviation, entropy in bits and the shares of
    eight equal brightness bands of the samples (padding included)."""

    def describe(batches):
        for batch in batches:
            rows = []
            for key, member in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples = decode_png(member)
                payload = samples.tobytes()
                counts = np.bincount(samples.ravel(), minlength=256)
                p = counts[counts > 0] / samples.size
                mean = float((counts * np.arange(256)).sum() / samples.size)
                dev = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / samples.size))
                bands = ",".join(f"{x:.4f}" for x in counts.reshape(8, 32).sum(1) / samples.size)
                feature = f"mean={mean:.4f};dev={dev:.4f};bits={float(-(p * np.log2(p)).sum()):.4f};bands={bands}"
                rows.append((key, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(member), hashlib.sha256(member).hexdigest(), feature))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in FEATURES.split(", ")])

    return media.mapInArrow(describe, FEATURES)
