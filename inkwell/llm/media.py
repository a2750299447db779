"""Media columns: lossless images of payloads in archives, read by a Spark data source.

``store`` writes each payload as an 8-bit greyscale PNG (576 samples a row) into ZIP archives in the
shared folder; a task rolls to a new archive every ``ARCHIVE_BYTES``. Archives of failed attempts
are never read, because the list of archives is committed by Spark with the tasks that ended well.

``MediaArchives`` is the data source ``media_archives``. It plans byte ranges over the archives of a
folder; a range owns the members whose local header starts in it. A reader opens the archive's
directory, streams its members in Arrow batches of bounded size, and reads each member by offset on
its own: if that fails (or the checksum is wrong) only this member is read again, on a new handle and
after a pause that doubles from PAUSE.
A member that keeps failing ends the task, as results have to be whole; with ``on_error=null`` it
gives a null payload and the message instead.

Folders are reached through Arrow's file systems (file, hdfs, s3, gs), not through local paths.

Edge cases: null or empty text is one row of padding; a null doc_id is kept as null; texts of any
length are one member each; repeated rows are stored once each, and equal texts give equal values; an
empty table gives no archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkwell.llm import scratch
from inkwell.llm.batches import slices, texts

WIDTH = 576
PAD = b"\xff"
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 4
#: Seconds before the first further try.
PAUSE = 0.05
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    """UTF-8 with bytes 255 appended up to a positive multiple of WIDTH."""
    data = text.encode()
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), PAD)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A greyscale PNG of 8-bit samples, WIDTH to a row, rows without a filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png made; each chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, [], (0, 0)
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("wrong checksum in a PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body.append(data)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a row filter that isn't used here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and mean step between neighbours of the samples."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    q = p[p > 0]
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ (np.arange(256) - mean) ** 2)))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.3f};sd={deviation:.3f};entropy={float(-(q * np.log2(q)).sum()):.4f};step={step:.3f}"


def _open(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


class _Archives:
    """Writes members into archives of a folder, a new one every ARCHIVE_BYTES."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = _open(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.done: list[tuple[str, int]] = []
        self.zip = self.out = None

    def add(self, name: str, data: bytes) -> None:
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.zip"
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}")
            self.zip, self.members, self.size = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED), 0, 0
        self.zip.writestr(zipfile.ZipInfo(name), data)
        self.members += 1
        self.size += len(data) + 150
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.out.close()
            self.done.append((self.name, self.members))
            self.zip = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of docs (doc_id, text) into archives below folder; the archives' names and numbers of members."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, n = _Archives(folder), 0
        for b in slices(batches):
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                archives.add(f"{'' if doc_id is None else doc_id}/{n}.png", to_png(payload_of(text)))
                n += 1
        archives.close()
        yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in archives.done], "members": [x[1] for x in archives.done]}, pa.schema([("archive", pa.string()), ("members", pa.int64())]))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(put, "archive string, members bigint")


class _Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int) -> None:
        self.archive, self.start, self.end = archive, start, end


class _Reader(DataSourceReader):
    SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range = int(options.get("range_bytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.lenient = options.get("on_error") == "null"
        self.listed = options.get("list")

    def partitions(self) -> list[_Range]:
        fs, base = _open(self.folder)
        names = None
        if self.listed:
            import pyarrow.dataset as ds

            lfs, lbase = _open(self.listed)
            names = set(ds.dataset(lbase, filesystem=lfs, format="parquet").to_table(columns=["archive"])["archive"].to_pylist())
        found = [x for x in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)) if x.is_file and (x.base_name.endswith(".zip") if names is None else x.base_name in names)]
        if names is not None and len(found) != len(names):
            raise FileNotFoundError(f"{len(names) - len(found)} archives of the list are missing in {self.folder}")
        return [_Range(x.base_name, at, min(at + self.range, x.size)) for x in sorted(found, key=lambda x: x.base_name) for at in range(0, x.size, self.range)] or [_Range("", 0, 0)]

    def _member(self, fs, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset, on a handle of its own for each try."""
        for left in reversed(range(self.retries)):
            time.sleep(PAUSE * 2 ** (self.retries - 1 - left))
            try:
                with fs.open_input_file(path) as f:
                    return self._at(f, info)
            except (OSError, ValueError, struct.error):
                if not left:
                    raise
        raise ValueError("no try is left")

    @staticmethod
    def _at(f, info: zipfile.ZipInfo) -> bytes:
        head = f.read_at(30, info.header_offset)
        names = sum(struct.unpack_from("<HH", head, 26))
        data = f.read_at(info.file_size, info.header_offset + 30 + names)
        if head[:4] != b"PK\x03\x04" or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise ValueError(f"member {info.filename} is damaged")
        return data

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, base = _open(self.folder)
        path = f"{base}/{partition.archive}"
        with fs.open_input_file(path) as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.end]
            rows, size = [], 0
            for m in members:
                error = media = None
                try:
                    try:
                        media = self._at(f, m)
                    except (OSError, ValueError, struct.error):
                        media = self._member(fs, path, m)
                except (OSError, ValueError, struct.error) as e:
                    if not self.lenient:
                        raise
                    error = str(e)
                rows.append((partition.archive, m.filename, m.header_offset, media, error))
                size += len(media or b"")
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.SCHEMA, strict=True)], schema=self.SCHEMA)


class MediaArchives(DataSource):
    """Options: path; list (a Parquet table whose column archive names the files to read); range_bytes; retries; on_error=null."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, offset bigint, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for b in slices(batches):
        rows = []
        for member, media in zip(b["member"].to_pylist(), b["media"].to_pylist(), strict=True):
            payload, doc_id = from_png(media), member.split("/")[0]
            rows.append((int(doc_id) if doc_id else None, len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def features(media: DataFrame) -> DataFrame:
    """Digests and features of the samples, from the rows of the data source. UTF-8 has no byte 255, so padding can be told from text."""
    return media.select("member", "media").mapInArrow(_features, FEATURES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents into archives, and back through the data source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch.new_path(spark, "archives")
    listed = scratch.save(store(docs, folder), "archive-list")
    return features(read(spark, folder, list=listed._inkwell_path))
