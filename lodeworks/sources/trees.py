"""File trees and tar archives as Python data sources.

Spark's own file sources skip names that begin with '_' or '.', and give no modes; these list every entry.
A tree must lie where every executor sees it.
"""

from __future__ import annotations

import os
import stat
import tarfile
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .pushed import Pushed, register

COLUMNS = ("path", "name", "suffix", "parent", "is_dir", "is_symlink", "inside", "mode", "length")
TREE = "path string, name string, suffix string, parent string, is_dir boolean, is_symlink boolean, inside boolean, mode int, length bigint"
TAR = "path string, is_dir boolean, mode int, length bigint, content binary, link string"


def _suffix(name: str) -> str:
    stem, dot, last = name.rpartition(".")
    return "." + last if stem and dot and last else ""


class TreeReader(DataSourceReader):
    """Partitions of so many subtrees: the driver lists the two upper levels, tasks what lies below.

    Entries that a filter rules out are left out before their contents are read.
    """

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.content = options.get("content", "false").lower() == "true"
        self.follow = options.get("follow", "false").lower() == "true"
        self.batch = int(options.get("folders", "64"))
        self.pushed = Pushed(COLUMNS, options)

    def pushFilters(self, filters):
        return self.pushed.take(filters)

    def folders(self, folder: str) -> list[str]:
        """Folders in a folder; linked ones only if links are followed, and never back to a folder they lie in."""
        out = []
        for e in os.scandir(folder):
            if e.is_dir(follow_symlinks=self.follow) and not (e.is_symlink() and (folder + os.sep).startswith(os.path.join(os.path.realpath(e.path), ""))):
                out.append(e.path)
        return sorted(out)

    def partitions(self):
        upper = [self.root, *self.folders(self.root)]
        work = [(f, False) for f in upper] + [(g, True) for f in upper[1:] for g in self.folders(f)]
        return [InputPartition(work[k : k + self.batch]) for k in range(0, len(work), self.batch)]

    def below(self, folder: str, seen: tuple = ()):
        """The folder and all beneath it; a link to a folder that is being listed ends there."""
        real = os.path.realpath(folder)
        if real not in seen:
            yield folder
            for f in self.folders(folder):
                yield from self.below(f, (*seen, real))

    def read(self, partition):
        real_root, wanted = os.path.realpath(self.root), self.pushed.compiled()
        for folder in (f for top, deep in partition.value for f in (self.below(top) if deep else [top])):
            for entry in os.scandir(folder):
                link, is_dir = entry.is_symlink(), entry.is_dir(follow_symlinks=False)
                real = os.path.realpath(entry.path)
                try:
                    info = entry.stat()
                except OSError:  # a link to nothing
                    info = entry.stat(follow_symlinks=False)
                path = os.path.relpath(entry.path, self.root).replace(os.sep, "/")
                row = (path, entry.name, _suffix(entry.name), path.rpartition("/")[0], is_dir, link, os.path.isfile(real) and real.startswith(real_root + os.sep), stat.S_IMODE(info.st_mode), info.st_size)
                if not wanted(dict(zip(COLUMNS, row, strict=True))):
                    continue
                if self.content:
                    data = None
                    if os.path.isfile(entry.path):
                        with open(entry.path, "rb") as f:
                            data = f.read()
                    row = (*row, data)
                yield row


class Tree(DataSource):
    """format('tree'): files, folders and links under a root, with content where option content is true."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return TREE + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema):
        return TreeReader(self.options)


def safe_member(member: tarfile.TarInfo) -> bool:
    """Whether a member stays beneath the folder it is unpacked to and is a plain file, folder or inner link."""
    path = os.path.normpath(member.name)
    if os.path.isabs(member.name) or path.startswith("..") or not (member.isfile() or member.isdir() or member.issym() or member.islnk()):
        return False
    if member.issym() or member.islnk():
        base = os.path.dirname(path) if member.issym() else ""
        target = os.path.normpath(os.path.join(base, member.linkname))
        return not os.path.isabs(member.linkname) and not target.startswith("..")
    return True


class Member(NamedTuple):
    """A member as its header tells it: where its bytes stand, and for a hard link those of the member that it names."""

    path: str
    is_dir: bool
    mode: int
    length: int
    link: str | None
    offset: int | None


class TarReader(DataSourceReader):
    """Members of tar archives.

    A plain archive is indexed first: its headers are read one after another, contents passed over. Then neighbouring members make up
    partitions of some bytes each, and tasks read just the ranges of members that the filters leave. A compressed
    archive has no ranges; it is one partition.
    """

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.bytes = int(options.get("bytes", str(64 << 20)))
        self.pushed = Pushed(("path", "is_dir", "mode", "length", "link"), options)

    def pushFilters(self, filters):
        return self.pushed.take(filters)

    @staticmethod
    def members(archive: tarfile.TarFile) -> Iterator[tuple[Member, tarfile.TarInfo]]:
        places: dict[str, tuple[int | None, int]] = {}
        for m in archive:
            if not safe_member(m):
                raise ValueError(f"{m.name} would leave the folder it is unpacked to")
            at, size = (m.offset_data, m.size) if m.isfile() else (None, 0)
            if m.islnk():
                at, size = places[m.linkname]
            places[m.name] = (at, size)
            yield Member(m.name.rstrip("/"), m.isdir(), m.mode, size, m.linkname if m.issym() else None, at), m

    def partitions(self):
        wanted = self.pushed.compiled()
        out = []
        for path in self.paths:
            try:
                archive = tarfile.open(path, "r:")
            except tarfile.ReadError:
                out.append(InputPartition((path, None)))
                continue
            held, size = [], 0
            with archive:
                for m, _ in self.members(archive):
                    if wanted(m._asdict()):
                        held.append(m)
                        size += m.length + 512
                    if size >= self.bytes:
                        out.append(InputPartition((path, held)))
                        held, size = [], 0
                    archive.members = []  # tarfile keeps every header it has seen
            if held:
                out.append(InputPartition((path, held)))
        return out or [InputPartition((None, []))]

    def read(self, partition):
        path, held = partition.value
        if held is None:
            wanted = self.pushed.compiled()
            with tarfile.open(path) as archive:
                for m, info in self.members(archive):
                    if wanted(m._asdict()):
                        yield m.path, m.is_dir, m.mode, m.length, None if m.offset is None else archive.extractfile(info).read(), m.link
        elif held:
            with open(path, "rb") as f:
                for m in held:
                    data = None
                    if m.offset is not None:
                        f.seek(m.offset)
                        data = f.read(m.length)
                    yield m.path, m.is_dir, m.mode, m.length, data, m.link


class Tar(DataSource):
    """format('tar'): the members of tar archives; one that would escape is an error."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return TAR

    def reader(self, schema):
        return TarReader(self.options)


def read_tree(spark: SparkSession, root: str, content: bool = False, follow: bool = False, filtered: bool = False) -> DataFrame:
    """All entries under a root; follow also lists what lies behind links to folders, under the link's name.

    With filtered, entries that the query's filters rule out are not read; see Pushed for when that holds.
    """
    register(spark, Tree)
    return spark.read.format("tree").option("content", str(content).lower()).option("follow", str(follow).lower()).option("filtered", str(filtered).lower()).load(root)


def contents(files: DataFrame, root: str, head: int | None = None) -> DataFrame:
    """(path, content) of listed files, read one at a time: filter the listing first. head takes just the first bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(os.path.join(root, path), "rb") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read(head)], pa.binary())], ["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content binary")


def copied(tree: DataFrame, to: str, below: str = "") -> DataFrame:
    """A tree's entries beneath a folder, moved under another one; links and modes stay as they are."""
    from ..functions.paths import relative

    rest = relative(F.col("path"), below) if below else F.col("path")
    rows = tree.where(F.col("path").startswith(below.rstrip("/") + "/")) if below else tree
    return rows.withColumn("path", F.concat(F.lit(to.rstrip("/") + "/"), rest) if to else rest)


def write_tree(rows: DataFrame, root: str) -> int:
    """Writes (path, is_dir, mode, content, link) under a root that all executors see; returns how many entries.

    A repeated task writes the same files again: each is written beside its place and renamed.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = 0
            for path, is_dir, mode, data, link in zip(*(batch.column(k) for k in range(5)), strict=True):
                at = os.path.normpath(os.path.join(root, path.as_py()))
                if not at.startswith(os.path.join(os.path.normpath(root), "")):
                    raise ValueError(f"{path.as_py()} would leave the folder it is written to")
                os.makedirs(at if is_dir.as_py() else os.path.dirname(at), exist_ok=True)
                if link.as_py() is not None:
                    if not os.path.islink(at):
                        os.symlink(link.as_py(), at)
                elif not is_dir.as_py():
                    part = f"{at}.{os.getpid()}.partial"
                    with open(part, "wb") as f:
                        f.write(data.as_py() or b"")
                    os.chmod(part, (mode.as_py() or 0o644) & 0o777)
                    os.replace(part, at)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select("path", "is_dir", "mode", "content", "link").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_tar(spark: SparkSession, path: str, filtered: bool = False) -> DataFrame:
    """The members of archives, comma-separated; filtered as in read_tree."""
    register(spark, Tar)
    return spark.read.format("tar").option("filtered", str(filtered).lower()).load(path)
