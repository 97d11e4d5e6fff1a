"""Operator 6, media columns through a Spark data source of its own over archive directories.

Archives are ZIP files of stored members, each a lossless 8-bit grey PNG. The data source `media_archive` plans its
partitions as byte ranges of the archives (it lists files, never members, on the driver). A partition reads its
archive's directory, takes the members whose offset lies in its range, and streams their payloads as Arrow batches; a
member that can't be read is tried again at its own offset, apart from all others.
"""

from __future__ import annotations

import binascii
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import shared_dir, slices

#: Samples in a row of the picture; a payload fills whole rows.
WIDTH = 64
#: Bytes of members in an archive, about; bytes of an archive in a partition; bytes of payload in an Arrow batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 16 << 20, 8 << 20, 4 << 20
_CHUNK = 1 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- the stored form


def payload_of(text: str | None) -> bytes:
    """UTF-8, then bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def encode(payload: bytes, level: int = 2) -> bytes:
    """An 8-bit grey PNG of WIDTH samples a row; pixel data in chunks of 1 MB, so one text may be of any length."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)  # filter 0 before each row
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    data = zlib.compress(raw.tobytes(), level)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(body, binascii.crc32(kind)))
    parts = [_SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0))]
    parts += [chunk(b"IDAT", data[i : i + _CHUNK]) for i in range(0, len(data), _CHUNK)]
    return b"".join([*parts, chunk(b"IEND", b"")])


def decode(media: bytes) -> bytes:
    """The payload of what encode() made; a damaged picture raises ValueError."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width, rows = 8, [], 0, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", media, at + 8 + size)[0] != binascii.crc32(body, binascii.crc32(kind)):
            raise ValueError(f"damaged chunk at {at}")
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != rows * (width + 1):
        raise ValueError("pixel data of another size")
    return raw.reshape(rows, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Samples, mean and deviation, then 64 bits in hex: which of the 64 columns are brighter than the mean column."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = x.sum(0, dtype=np.int64)
    mean = x.mean(dtype=np.float64)
    bits = np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()
    return f"{x.size}:{mean:.4f}:{x.std(dtype=np.float64):.4f}:{bits}"


# ---------------------------------------------------------------- archives


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(named: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores (name string, text) as archives in folder; (archive, members, bytes) of each, to be run once by an action.

    A task writes archives of about archive_bytes, each in one piece under a name of its own. A task that ran twice, or
    that was lost, leaves archives that no row names: what counts are the rows that the action commits (see `manifest`).
    Null text is an empty text. Memory: one archive, or one member if larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        held: list[tuple[str, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                for name, media in held:
                    archive.writestr(zipfile.ZipInfo(name), media)
            data = out.getvalue()
            file = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{root}/{file}") as to:
                to.write(data)
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], ["archive", "members", "bytes"])

        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                for name, text in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), strict=True):
                    media = encode(payload_of(text))
                    held.append((name, media))
                    size += len(media)
                    if size >= archive_bytes:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return named.select("name", "text").mapInArrow(run, "archive string, members long, bytes long")


class _Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int) -> None:
        self.file, self.begin, self.end = file, begin, end


def member_at(file, offset: int, name: str) -> bytes:
    """The bytes of the stored member whose local header stands at offset; checked by name, size and CRC."""
    file.seek(offset)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    crc, size, _, n, extra = struct.unpack_from("<IIIHH", head, 14)
    if (found := file.read(n + extra)[:n].decode()) != name:
        raise ValueError(f"{found} stands where {name} should")
    data = file.read(size)
    if len(data) != size or binascii.crc32(data) != crc:
        raise ValueError(f"damaged member {name}")
    return data


def with_retries(read: Callable[[], bytes], tries: int, wait: float = 0.05) -> tuple[bytes | None, str | None]:
    """What read gives, or after so many tries its last error."""
    for k in range(tries):
        try:
            return read(), None
        except (OSError, ValueError, zlib.error, struct.error, UnicodeDecodeError) as e:
            error = f"{type(e).__name__}: {e}"
            time.sleep(wait * 2**k if k + 1 < tries else 0)
    return None, error


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", 3))
        self.on_error = options.get("onerror", "raise")
        self.manifest = options.get("manifest")

    def partitions(self) -> list[_Range]:
        store, root = _store(self.folder)
        if self.manifest:
            listed = pq.read_table(_store(self.manifest)[1], columns=["archive", "bytes"], filesystem=store)
            files = [(f"{root}/{name}", size) for name, size in zip(*(c.to_pylist() for c in listed.columns), strict=True)]
        else:
            files = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".zip")]
        return [_Range(path, at, min(at + self.range_bytes, size)) for path, size in sorted(files) for at in range(0, size, self.range_bytes)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _store(self.folder)
        rows: list[tuple] = []
        size = 0
        with store.open_input_file(partition.file) as file:
            members = [m for m in zipfile.ZipFile(file).infolist() if partition.begin <= m.header_offset < partition.end]
            for m in members:
                media, error = with_retries(lambda m=m: member_at(file, m.header_offset, m.filename), self.tries)
                if error and self.on_error == "raise":
                    raise OSError(f"{partition.file}, {m.filename} at {m.header_offset}: {error}")
                rows.append((m.filename, partition.file.rpartition("/")[2], m.header_offset, media, error))
                size += len(media or b"")
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["name", "archive", "offset", "media", "error"])


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder): (name, archive, offset, media, error) of all members.

    Options: manifest (a table of archive and bytes: only those archives count; else all in the folder), rangeBytes (of an
    archive in a partition), tries (of each member), onError: `raise` fails the query when a
    member stays unreadable, `row` gives it null media and its error. An empty or missing folder: no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, archive string, offset long, media binary, error string"

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader({k.lower(): v for k, v in self.options.items()})


def features(media: DataFrame) -> DataFrame:
    """(name, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pad) of stored members.

    pad: bytes 0 at the payload's end. Unreadable members (media null) are left out; see onError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = stored.as_py()
                payload = decode(stored)
                out.append((name, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), sha256(stored).hexdigest(), feature(payload)))
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["name", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "name string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.filter("media IS NOT NULL").select("name", "media").mapInArrow(run, schema)


def media_columns(docs: DataFrame, key: str, folder: str) -> DataFrame:
    """Stores the text of each row of docs in folder, reads it back and gives key, n_bytes and the columns of features().

    The member's name carries key and n_bytes, so no join brings them back: null keys and repeated rows are members of
    their own, and order doesn't matter. Empty and null texts are 64 bytes 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.concat_ws("|", F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.col(key).cast("string")).alias("name"), "text")
    write_archives(named, folder).write.parquet(f"{folder}/manifest")
    found = features(spark.read.format("media_archive").option("manifest", f"{folder}/manifest").load(folder))
    parts = F.split("name", r"\|", 2)
    return found.select(F.get(parts, 1).cast(kind).alias(key), F.get(parts, 0).cast("long").alias("n_bytes"), *[c for c in found.columns if c != "name"])


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_columns(docs, "doc_id", shared_dir(spark))


QUERIES = {"op6_media_columns": op6_media_columns}
SQL: dict[str, str] = {}
