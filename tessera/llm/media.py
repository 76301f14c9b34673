"""Media columns: payloads stored as 8-bit samples in archives, read back by a custom data source.

write_archives() stores every text as a mono 8-bit WAV member of ZIP archives in the shared folder;
a task's archives have names that depend on its partition alone and appear by renaming, so a task
that runs again replaces them with the same bytes. ArchiveSource (format "archive_media") plans
byte ranges over the archives of a folder from their sizes alone; a task reads an archive's own
directory, takes the members whose header lies in its range, and streams their payloads in Arrow
batches of BATCH_BYTES. Each member is read by its offset, checked against its checksum, and tried
again by itself up to RETRIES times with the file opened anew; one that cannot be read gives a row
with `error` and no payload. An archive's directory is tried again as well; an archive without a
readable one gives a single row with `error` and no member.

Defined results: null and empty texts have a payload of 64 zero bytes; repeated rows are members of
their own; members of any size are batches of their own when larger than a batch; an empty table
gives no archives and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from .common import load, map_arrow, scratch, utf8

UNIT = 64
RATE = 8000
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 4
#: A fixed date, so that equal inputs give equal archives.
DATE = (1980, 1, 1, 0, 0, 0)
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def pad(payload: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of UNIT."""
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def to_wav(samples: bytes) -> bytes:
    return HEADER.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def from_wav(data: bytes) -> bytes:
    x = HEADER.unpack_from(data)
    if (x[0], x[2], x[3], x[5], x[6], x[10], x[11]) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data") or x[12] != len(data) - HEADER.size:
        raise ValueError("not a mono 8-bit WAV")
    return data[HEADER.size :]


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_archives(docs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Stores each row of docs (doc_id, text) as a member "<doc_id>/<bytes>/<n>.wav"; returns the number of members."""

    def run(batches):
        fs, folder = _place(path)
        part, n_archives, total = TaskContext.get().partitionId(), 0, 0
        out = sink = temp = None

        def close() -> None:
            nonlocal out, n_archives
            out.close()
            sink.close()
            fs.move(temp, f"{folder}/part-{part:06d}-{n_archives:04d}.zip")
            out, n_archives = None, n_archives + 1

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    temp = f"{folder}/_{uuid.uuid4().hex}.tmp"
                    sink = fs.open_output_stream(temp)
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{len(raw)}/{total}.wav", DATE)
                info.compress_type = zipfile.ZIP_DEFLATED
                out.writestr(info, to_wav(pad(raw)), compresslevel=1)
                total += 1
                if sink.tell() >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    return map_arrow(docs.select("doc_id", "text"), run, "n long").agg(F.sum("n")).first()[0] or 0


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        super().__init__((archive, start, stop))
        self.archive, self.start, self.stop = archive, start, stop


def member_bytes(fs: pafs.FileSystem, archive: str, info: zipfile.ZipInfo, source=None) -> bytes:
    """One member by its offset: local header, data, checksum."""
    f = source or fs.open_input_file(archive)
    try:
        f.seek(info.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member at this offset")
        names = sum(struct.unpack("<HH", head[26:30]))
        data = f.read(names + info.compress_size)[names:]
    finally:
        if source is None:
            f.close()
    if info.compress_type == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15, info.file_size)
    elif info.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"compression {info.compress_type}")
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError("checksum differs")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.wait = float(options.get("retryseconds", 0.2))

    def partitions(self) -> list[ByteRange]:
        fs, folder = _place(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return [ByteRange(x.path, a, min(a + self.range_bytes, x.size)) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".zip") for a in range(0, x.size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def member(self, fs: pafs.FileSystem, archive: str, info: zipfile.ZipInfo, source) -> tuple[bytes | None, str | None, int]:
        for attempt in range(self.retries):
            try:
                return member_bytes(fs, archive, info, source if attempt == 0 else None), None, attempt
            except (OSError, ValueError, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(self.wait * attempt)
        return None, error, self.retries

    def directory(self, fs: pafs.FileSystem, archive: str) -> tuple[list[zipfile.ZipInfo], str | None]:
        for attempt in range(self.retries):
            try:
                with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                    return z.infolist(), None
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(self.wait * attempt)
        return [], error

    def read(self, partition: ByteRange):
        if not partition.archive:
            return
        fs, _ = _place(self.path)
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()), ("error", pa.string()), ("attempts", pa.int32())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x.type) for k, x in enumerate(schema)], schema=schema)
        rows, size = [], 0
        infos, error = self.directory(fs, partition.archive)
        if error and partition.start == 0:
            rows.append((partition.archive, None, None, None, error, self.retries))
        infos = sorted((x for x in infos if partition.start <= x.header_offset < partition.stop), key=lambda x: x.header_offset)
        try:
            f = fs.open_input_file(partition.archive)
        except OSError:
            f = None  # every member opens the file for itself
        try:
            for info in infos:
                data, error, attempts = self.member(fs, partition.archive, info, f)
                rows.append((partition.archive, info.filename, info.header_offset, data, error, attempts))
                size += len(data or b"")
                if size >= self.batch_bytes:
                    yield batch(rows)
                    rows, size = [], 0
        finally:
            if f is not None:
                f.close()
        yield batch(rows)


class ArchiveSource(DataSource):
    """format("archive_media"); options: rangeBytes, batchBytes, retries, retrySeconds."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "archive string, member string, offset long, payload binary, error string, attempts int"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def features(samples: bytes) -> str:
    """Mean, root mean square about 128, share of crossings of 128, and peak, of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    squares = int(np.dot(x.astype(np.float64), x.astype(np.float64)))
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={int(x.sum(dtype=np.int64)) / len(x):.6f};rms={(squares / len(x)) ** 0.5:.6f};zcr={crossings / max(1, len(x) - 1):.6f};peak={int(np.abs(x).max())}"


def media_columns(members: DataFrame) -> DataFrame:
    """doc_id, n_bytes and columns of the payload for each member that write_archives() stored."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for name, media, error in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if error is not None:
                    raise OSError(f"{name}: {error}")
                x = from_wav(media)
                doc_id, n, _ = name.split("/")
                rows.append((None if doc_id == "null" else int(doc_id), int(n), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(x)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return map_arrow(members.select("member", "payload", "error"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_media").options(**options).load(path)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    write_archives(load(spark, sf_dir, "documents"), path)
    return media_columns(read_archives(spark, path))
