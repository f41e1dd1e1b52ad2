"""ZIP archives as a data source: written by all tasks at once to fixed bytes, listed and read entry by entry.

The archive and its folder must lie where driver and executors see them under one path.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .pushed import Pushed, register

ZIP = "ord bigint, path string, attributes bigint, length bigint, packed bigint, crc bigint, at bigint, stamp string, content binary"
#: Fixed value: the time stamped on every entry, 2026-01-01 00:00:00, as the format's date and time.
STAMP = ((2026 - 1980) << 9 | 1 << 5 | 1, 0)
DEFLATED, UNIX, UTF8 = 8, 3, 0x800
LOCAL, CENTRAL, END = b"PK\3\4", b"PK\1\2", b"PK\5\6"
END64, LOCATOR64 = b"PK\6\6", b"PK\6\7"
SMALL, FEW = 0xFFFFFFFF, 0xFFFF


def local_path(path: str) -> str:
    """The mounted path that a file: URL or a plain path names."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: archives need a folder that is mounted on all machines")
    return path


def deflated(data: bytes, level: int = 9) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    return packer.compress(data) + packer.flush()


@dataclass(frozen=True)
class Entry:
    """What the central directory says of an entry; at is relative to the entry's segment until the archive is joined."""

    name: bytes
    attributes: int
    length: int
    packed: int
    crc: int
    at: int

    def flags(self) -> int:
        return 0 if self.name.isascii() else UTF8

    def local(self) -> bytes:
        return LOCAL + struct.pack("<5H3I2H", 20, self.flags(), DEFLATED, STAMP[1], STAMP[0], self.crc, self.packed, self.length, len(self.name), 0) + self.name

    def central(self, base: int) -> bytes:
        at = base + self.at
        extra = struct.pack("<2HQ", 1, 8, at) if at >= SMALL else b""
        need = 45 if extra else 20
        head = struct.pack("<6H3I5H2I", UNIX << 8 | need, need, self.flags(), DEFLATED, STAMP[1], STAMP[0], self.crc, self.packed, self.length, len(self.name), len(extra), 0, 0, 0, self.attributes, min(at, SMALL))
        return CENTRAL + head + self.name + extra


def end_record(entries: int, size: int, at: int) -> bytes:
    """The archive's end: how many entries, and where their directory stands; in the 64-bit form as well where numbers are large."""
    out = b""
    if entries >= FEW or size >= SMALL or at >= SMALL:
        out += END64 + struct.pack("<Q2H2I4Q", 44, UNIX << 8 | 45, 45, 0, 0, entries, entries, size, at)
        out += LOCATOR64 + struct.pack("<IQI", 0, at + size, 1)
    return out + END + struct.pack("<4H2IH", 0, 0, min(entries, FEW), min(entries, FEW), min(size, SMALL), min(at, SMALL), 0)


@dataclass
class Segment(WriterCommitMessage):
    """One task's run of rows: its place in the order, its file (with notes beside it), and its size."""

    number: int
    file: str
    size: int
    entries: int


def append(target: int, source: str) -> None:
    """Copies a file to the end of an open one; the kernel does it where it can."""
    with open(source, "rb") as f:
        left = os.fstat(f.fileno()).st_size
        while left:
            try:
                n = os.copy_file_range(f.fileno(), target, min(left, 1 << 30))
            except OSError:
                n = os.write(target, f.read(min(left, 1 << 20)))
            left -= n


class SegmentWriter(DataSourceWriter):
    """One file of rows in order, written by all tasks: each writes a segment, and the commit puts these end to end and renames, so
    the file is whole or absent. Which rows make up a segment leaves no trace in the bytes. A repeated task writes files of its own.

    Kinds of files say what stands for a row (piece) and what comes after all rows (tail).
    """

    def __init__(self, path: str):
        self.path = local_path(path)
        self.folder = f"{self.path}.{uuid.uuid4().hex}.segments"

    def piece(self, row, at: int) -> tuple[bytes, bytes]:
        """A row's bytes at a place in its segment, and what the tail has to know of it."""
        raise NotImplementedError

    def tail(self, out, segments: list[Segment], bases: list[int], at: int) -> None:
        """Writes what comes after the segments, which start at bases and end at `at`."""

    def write(self, iterator: Iterator) -> Segment:
        os.makedirs(self.folder, exist_ok=True)
        number = TaskContext.get().partitionId()
        file = os.path.join(self.folder, f"{number}-{uuid.uuid4().hex}")
        at = rows = 0
        with open(file, "wb") as data, open(f"{file}.notes", "wb") as notes:
            for row in iterator:
                body, note = self.piece(row, at)
                at += data.write(body)
                notes.write(note)
                rows += 1
        return Segment(number, file, at, rows)

    def commit(self, messages: list) -> None:
        segments = sorted((m for m in messages if m is not None), key=lambda s: s.number)
        part = f"{self.path}.{uuid.uuid4().hex}.partial"
        try:
            with open(part, "wb", buffering=0) as out:
                bases, at = [], 0
                for s in segments:
                    append(out.fileno(), s.file)
                    bases.append(at)
                    at += s.size
                self.tail(out, segments, bases, at)
            os.replace(part, self.path)
        finally:
            if os.path.exists(part):
                os.unlink(part)
            self.abort(messages)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class ZipWriter(SegmentWriter):
    """Rows (path, attributes, content) as entries, deflated by tasks; the directory is corrected by each segment's place."""

    def piece(self, row, at: int) -> tuple[bytes, bytes]:
        body, name = bytes(row.content), row.path.encode()
        packed = deflated(body)
        entry = Entry(name, row.attributes, len(body), len(packed), zlib.crc32(body), at)
        return entry.local() + packed, struct.pack("<H5Q", len(name), entry.attributes, entry.length, entry.packed, entry.crc, at) + name

    @staticmethod
    def directory(file: str) -> Iterator[Entry]:
        """The entries of a segment, one at a time."""
        with open(file, "rb") as f:
            while head := f.read(42):
                size, *numbers = struct.unpack("<H5Q", head)
                yield Entry(f.read(size), *numbers)

    def tail(self, out, segments: list[Segment], bases: list[int], at: int) -> None:
        start = at
        for s, base in zip(segments, bases, strict=True):
            held = []
            for k, entry in enumerate(self.directory(f"{s.file}.notes"), 1):
                held.append(entry.central(base))
                if k % 10_000 == 0 or k == s.entries:
                    at += out.write(b"".join(held))
                    held = []
        out.write(end_record(sum(s.entries for s in segments), at - start, start))


class LinesWriter(SegmentWriter):
    """Rows (line) as a text file, each with a line end."""

    def piece(self, row, at: int) -> tuple[bytes, bytes]:
        return f"{row.line}\n".encode(), b""


class Lines(DataSource):
    """format('lines'): writes rows (line) as one text file."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite):
        return LinesWriter(self.options["path"])


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of (line) in the given order, the same bytes however the rows are dealt."""
    register(lines.sparkSession, Lines)
    lines.select("line").write.format("lines").mode("append").save(path)


def find_end(f) -> tuple[int, int, int]:
    """(entries, size of the directory, where it stands) of an open archive."""
    f.seek(0, os.SEEK_END)
    size = f.tell()
    f.seek(max(0, size - 65_557))
    tail = f.read()
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not an archive: no end record")
    entries, length, start = struct.unpack_from("<H2I", tail, at + 10)
    back = at - 20
    if back >= 0 and tail[back : back + 4] == LOCATOR64:
        f.seek(struct.unpack_from("<Q", tail, back + 8)[0] + 32)
        entries, length, start = struct.unpack("<3Q", f.read(24))
    return entries, length, start


def central_entries(f, start: int, size: int) -> Iterator[tuple]:
    """(attributes, packed, length, crc, at, date, time, name) of an archive's entries in the order of its directory."""
    f.seek(start)
    end = start + size
    while f.tell() < end:
        head = f.read(46)
        if head[:4] != CENTRAL:
            raise ValueError("the archive's directory is damaged")
        _, _, _, _, t, d, crc, packed, length, n, extra, comment, _, _, attributes, at = struct.unpack("<6H3I5H2I", head[4:])
        name, more = f.read(n), f.read(extra)
        f.seek(comment, os.SEEK_CUR)
        wide = [k for k, v in enumerate((length, packed, at)) if v == SMALL]
        while wide and len(more) >= 4:
            kind, m = struct.unpack_from("<2H", more)
            if kind == 1:
                values = dict(zip(wide, struct.unpack_from(f"<{len(wide)}Q", more, 4), strict=True))
                length, packed, at = (values.get(k, v) for k, v in enumerate((length, packed, at)))
                break
            more = more[4 + m :]
        yield attributes, packed, length, crc, at, d, t, name


class ZipReader(DataSourceReader):
    """Partitions of neighbouring entries, each a slice of the directory: the driver goes through it for the slices' ends and keeps
    nothing else, tasks read their slices again and the contents. Entries that a filter rules out are left out before any of their bytes are read."""

    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.content = options.get("content", "false").lower() == "true"
        self.batch = int(options.get("bytes", str(64 << 20)))
        self.pushed = Pushed(("ord", "path", "attributes", "length", "packed", "crc", "at"), options)

    def pushFilters(self, filters):
        return self.pushed.take(filters)

    @staticmethod
    def known(k: int, entry: tuple) -> dict:
        """An entry's values for filters."""
        attributes, packed, length, crc, at, *_, name = entry
        return {"ord": k, "path": name.decode(), "attributes": attributes, "length": length, "packed": packed, "crc": crc, "at": at}

    def partitions(self):
        out, wanted = [], self.pushed.compiled()
        with open(self.path, "rb") as f:
            _, length, start = find_end(f)
            first, held, size, end = 0, 0, 0, start
            for k, entry in enumerate(central_entries(f, start, length)):
                end = f.tell()
                if wanted(self.known(k, entry)):
                    held += 1
                    size += entry[1] + 100
                    if size >= self.batch or held >= 20_000:
                        out.append(InputPartition((first, start, end - start)))
                        first, start, held, size = k + 1, end, 0, 0
        return [*out, InputPartition((first, start, end - start))] if held or not out else out

    def read(self, partition):
        first, start, size = partition.value
        wanted = self.pushed.compiled()
        with open(self.path, "rb") as directory, open(self.path, "rb") as f:
            for k, entry in enumerate(central_entries(directory, start, size), first):
                if not wanted(self.known(k, entry)):
                    continue
                attributes, packed, length, crc, at, d, t, name = entry
                data = None
                if self.content:
                    f.seek(at + 26)
                    n, extra = struct.unpack("<2H", f.read(4))
                    f.seek(at + 30 + n + extra)
                    data = zlib.decompress(f.read(packed), -zlib.MAX_WBITS)
                    if zlib.crc32(data) != crc or len(data) != length:
                        raise ValueError(f"{name.decode()}: damaged in the archive")
                stamp = f"{1980 + (d >> 9)}-{d >> 5 & 15:02}-{d & 31:02} {t >> 11:02}:{t >> 5 & 63:02}:{2 * (t & 31):02}"
                yield k, name.decode(), attributes, length, packed, crc, at, stamp, data


class Zip(DataSource):
    """format('zip'): writes rows (path, attributes, content) as one archive, or lists an archive's entries, with contents where
    option content is true."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return ZIP

    def reader(self, schema):
        return ZipReader(self.options)

    def writer(self, schema, overwrite):
        return ZipWriter(self.options["path"])


def write_entries(entries: DataFrame, path: str) -> None:
    """One archive of (path, attributes, content) in the given order, the same bytes however the rows are dealt."""
    register(entries.sparkSession, Zip)
    entries.select("path", "attributes", "content").write.format("zip").mode("append").save(path)


def read_zip(spark: SparkSession, path: str, content: bool = False, filtered: bool = False) -> DataFrame:
    """The entries of an archive; filtered as in trees.read_tree."""
    register(spark, Zip)
    return spark.read.format("zip").option("content", str(content).lower()).option("filtered", str(filtered).lower()).load(path)
