"""Seekable Zstandard bundles of WARC records.

Records of a partition are gathered into independent frames of about ``frame_bytes``; frames make up a bundle, which ends
with a seek table in a skippable frame (the public "seekable format"). An index maps each record to its bundle, its frame
and its place in the frame's plain bytes: reading one record takes one ranged read and the decompression of one frame.
Pages are written where they are read: no shuffle, and memory is bounded by a frame and the longest record.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalens.llm import _io

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, bundle string, frame long, frame_start long, frame_bytes long, offset long, length long"


def record(record_id: str, url: str | None, body: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record. A null body is written as empty and marked; line breaks in a URL are percent-encoded."""
    raw = (body or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if body is None:
        head.append("X-Null-Content: 1")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(raw)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + raw + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], str | None]:
    """Headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return h, None if "X-Null-Content" in h else rest[: int(h["Content-Length"])].decode("utf-8", "surrogatepass")


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def read_seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, plain bytes) of each frame, from the footer alone."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        raw, at, out = f.read_at(8 * n, size - 9 - 8 * n), 0, []
        for i in range(n):
            c, d = struct.unpack_from("<II", raw, 8 * i)
            out.append((at, c, d))
            at += c
        return out


def read_record(uri: str, frame_start: int, frame_bytes: int, offset: int, length: int) -> bytes:
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(frame_bytes, frame_start))[offset : offset + length]


class _Writer:
    """Bundles of one task attempt, which no other attempt, task or run writes to or has records of the same identifiers as."""

    def __init__(self, folder: str, stem: str, frame_bytes: int, bundle_bytes: int, level: int):
        self.folder, self.stem, self.frame_bytes, self.bundle_bytes = folder, stem, frame_bytes, bundle_bytes
        self.zip, self.out, self.made, self.records = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True), None, 0, 0
        self.plain, self.held = io.BytesIO(), []

    def add(self, key, url: str | None, body: str | None) -> list[tuple]:
        name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.stem}/{self.records}')}"
        raw = record(name, url, body)
        self.records += 1
        self.held.append((key, name, self.plain.tell(), len(raw)))
        self.plain.write(raw)
        return self.flush() if self.plain.tell() >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.held:
            return []
        if self.out is None:
            self.uri = f"{self.folder}/{self.stem}-{self.made:04d}.warc.zst"
            system, path = _open(self.uri)
            self.out, self.at, self.sizes = system.open_output_stream(path, compression=None), 0, []  # else compressed once more, by the name's ending
            self.made += 1
        packed = self.zip.compress(self.plain.getvalue())
        self.out.write(packed)
        rows = [(key, name, self.uri, len(self.sizes), self.at, len(packed), offset, length) for key, name, offset, length in self.held]
        self.sizes.append((len(packed), self.plain.tell()))
        self.at += len(packed)
        self.plain, self.held = io.BytesIO(), []
        if self.at >= self.bundle_bytes:
            self.close()
        return rows

    def close(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.sizes))
            self.out.close()
            self.out = None


def bundle(pages: DataFrame, folder: str | None = None, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes all pages into bundles in ``folder`` (a URI; by default a folder of its own in the shared one, which goes when the
    application ends) and returns the index, with one row a page: id, record_id, bundle, frame, frame_start, frame_bytes, offset,
    length.

    Every row gets a record with an identifier of its own, repeated rows and null ids too; null URLs and bodies are kept apart
    from empty ones. Columns other than these three are not bundled. An empty table makes no bundle. Names of bundles hold an
    identifier of the run and of the task attempt: calls into one folder don't touch each other's files nor any others; only what
    attempts of this run that were lost have left is deleted.
    """
    spark = pages.sparkSession
    folder = folder or _io.new_path(spark, "bundles")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    kind, run = pages.schema[id_col].dataType, uuid.uuid4().hex
    p = pages.select(_io.column(pages, id_col).alias("id"), _io.column(pages, url_col).cast("string").alias("url"), _io.column(pages, body_col).cast("string").alias("body"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        w = _Writer(folder, f"{run}-{task.partitionId():05d}-{task.taskAttemptId()}", frame_bytes, bundle_bytes, level)
        names = ["id", "record_id", "bundle", "frame", "frame_start", "frame_bytes", "offset", "length"]

        def batch(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], like), pa.array(cols[1]), pa.array(cols[2]), *[pa.array(c, pa.int64()) for c in cols[3:]]], names=names)

        like = None
        for b in batches:
            like, rows = b.schema.field(0).type, []
            for i in range(b.num_rows):
                rows += w.add(*[b.column(c)[i].as_py() for c in range(3)])
            if rows:
                yield batch(rows, like)
        if rows := w.flush():
            yield batch(rows, like)
        w.close()

    index = _io.written(p.mapInArrow(part, f"id {kind.simpleString()}, {INDEX}"), "index")
    named = {r[0].rpartition("/")[2] for r in index.select("bundle").distinct().collect()}
    for f in system.get_file_info(fs.FileSelector(path)):
        if f.is_file and f.base_name.startswith(run) and f.base_name not in named:
            system.delete_file(f.path)  # of an attempt that was lost
    return index.withColumnRenamed("id", id_col) if id_col != "id" else index


def fetch(index: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Reads records back: (id, record_id, url, body) of every row of an index."""
    kind = index.schema[id_col].dataType.simpleString()
    i = index.select(F.col(id_col).alias("id"), "record_id", "bundle", "frame_start", "frame_bytes", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame_start", "offset")

    def part(frames):
        last, plain = None, b""
        for df in frames:
            urls, bodies = [], []
            for r in df.itertuples():
                if (r.bundle, r.frame_start) != last:
                    system, path = _open(r.bundle)
                    with system.open_input_file(path) as f:
                        plain = zstandard.ZstdDecompressor().decompress(f.read_at(r.frame_bytes, r.frame_start))
                    last = (r.bundle, r.frame_start)
                head, body = parse(plain[r.offset : r.offset + r.length])
                urls.append(head.get("WARC-Target-URI"))
                bodies.append(body)
            yield df[["id", "record_id"]].assign(url=urls, body=bodies)

    return i.mapInPandas(part, f"id {kind}, record_id string, url string, body string").withColumnRenamed("id", id_col)
