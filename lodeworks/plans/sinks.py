"""Sinks whose bytes are fixed: archives, checksums, manifests, notices, records."""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import components
from ..sources.archives import write_entries
from ..sources.archives import write_lines as lines_file

#: Fixed value: the time stamped on every archive entry.
STAMP = (2026, 1, 1, 0, 0, 0)
#: Bytes of contents for a task that writes an archive, on average, and of a piece of a file that is compared.
SHARE, PIECE = 32 << 20, 8 << 20


def entry_mode(mode: Column) -> Column:
    """Executable for all if for anyone, as the high half of an archive entry's attributes (bigint)."""
    bits = F.when(mode.cast("bigint").bitwiseAND(0o111) != 0, F.lit(0o755)).otherwise(F.lit(0o644))
    return F.shiftleft(bits.cast("bigint").bitwiseOR(F.lit(stat.S_IFREG).cast("bigint")), 16)


def _files(tree: DataFrame) -> DataFrame:
    return tree.where(~F.col("is_dir") & F.col("content").isNotNull())


def shares(tree: DataFrame) -> int:
    """How many tasks write a tree's archive: one for each core at least, and more as the contents grow."""
    size = _files(tree).agg(F.sum(F.octet_length("content") + 100)).first()[0] or 0
    return max(tree.sparkSession.sparkContext.defaultParallelism, size // SHARE + 1)


def write_zip(tree: DataFrame, path: str, tasks: int | None = None) -> None:
    """One archive of a tree's files in the order of path components, the same bytes each time, however many tasks deflate it.

    Files are dealt to tasks (shares, unless given) by ranges of that order; a path that stands twice is two entries, in the order of their contents.
    """
    rows = _files(tree).select("path", entry_mode(F.col("mode")).alias("attributes"), "content")
    dealt = rows.withColumn("at", components(F.col("path"))).repartitionByRange(tasks or shares(tree), "at")
    write_entries(dealt.sortWithinPartitions("at", "attributes", "content"), path)


def same_bytes(spark: SparkSession, one: str, other: str, piece: int = PIECE) -> DataFrame:
    """(same), one row: whether two files hold the same bytes, compared piece by piece by all tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            with open(one, "rb") as a, open(other, "rb") as b:
                for k in batch.column(0).to_pylist():
                    a.seek(k * piece)
                    b.seek(k * piece)
                    found.append(a.read(piece) == b.read(piece))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.bool_())], ["same"])

    pieces = spark.range(max(map(os.path.getsize, (one, other))) // piece + 1)
    return pieces.mapInArrow(run, "same boolean").agg(F.bool_and("same").alias("same"))


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, digest) of files, read piece by piece in tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names = batch.column(0).to_pylist()
            found = []
            for at in names:
                with open(at, "rb") as f:
                    found.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["path", "digest"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(run, "path string, digest string")


def checksum_line(content: Column, name: Column) -> Column:
    return F.concat(F.sha2(content, 256), F.lit("  "), name, F.lit("\n"))


def write_checksum(path: str) -> str:
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    with open(f"{path}.sha256", "w") as f:
        f.write(f"{digest}  {os.path.basename(path)}\n")
    return digest


def write_lines(lines: Iterable[str], path: str) -> None:
    """A handful of lines from the driver; a table's lines are written by archives.write_lines."""
    with open(path, "w", newline="\n") as f:
        f.writelines(f"{x}\n" for x in lines)


def write_checksums(files: DataFrame, path: str, order: str = "name") -> None:
    """A checksum file of all files (name, content) in order of their names, digested and written by tasks."""
    rows = files.select("name", F.concat(F.sha2("content", 256), F.lit("  "), "name").alias("line"))
    lines_file(rows.repartitionByRange(order).sortWithinPartitions(order, "line"), path)


def manifest(pins: DataFrame, target: str, versions: dict[str, str]) -> str:
    """The manifest's text; versions names, in order, where in the pins each version stands."""
    row = pins.select(F.col("model.name").alias("model"), F.col("model.alphabet").alias("alphabet"), *(F.col(at).alias(f"v_{n}") for n, at in versions.items())).first()
    from ..operators.pins import layout

    python = pins.select(layout(F.lit(target))["python"]).first()[0]
    out = {"format_version": 1, "target": target, "python": python, "model": f"model/{row.model}", "model_alphabet": row.alphabet, "versions": {n: row[f"v_{n}"] for n in versions}}
    return json.dumps(out, indent=2) + "\n"


def notice_line(*cells: Column) -> Column:
    """A row of a Markdown table; null cells are empty."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))


def notice_table(components_: DataFrame) -> str:
    """A Markdown table of (component, version, licence, source) in row order of column rank."""
    rows = components_.orderBy("rank").select(notice_line(*map(F.col, ("component", "version", "licence", "source"))).alias("line")).collect()  # a handful
    return "\n".join(["| Component | Version | Licence | Source |", "|---|---|---|---|", *(r.line for r in rows)]) + "\n"


def notices(title: str, opening: str, components_: DataFrame, closing: str) -> str:
    """The notices document: title, opening, table, closing; braces in the texts are not special."""
    return f"# {title}\n\n{opening}\n\n{notice_table(components_)}\n{closing}\n"
