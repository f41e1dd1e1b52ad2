"""Installer records: CSV without a header whose first column is a path."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans


def iter_record(text: str) -> Iterator[tuple[int, list[str]]]:
    """(line number, fields) of every row that is not blank; quoting is undone, empty fields stay empty."""
    return ((k, row) for k, row in enumerate(csv.reader(io.StringIO(text))) if row)


def parse_record(text: str) -> list[tuple[int, list[str]]]:
    """The rows of iter_record at once."""
    return list(iter_record(text))


def read_record(spark: SparkSession, text: str) -> DataFrame:
    """(line_no, path, fields): a record's rows in order. A record is one small file."""
    rows = [(k, row[0], row) for k, row in parse_record(text)]
    return spark.createDataFrame(rows, "line_no bigint, path string, fields array<string>")


def record_text(rows: Iterable[list[str]]) -> str:
    """A record's text: quoting only where needed, one \\n after each row."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


# ------------------------------------------------------------------------------------------ records of any size

_QUOTE = '"'


def logical_rows(lines: DataFrame) -> DataFrame:
    """(record, line_no, text): the rows of records given as lines, where a quoted field may hold line ends.

    lines: (record, line_no, line) with lines numbered in order within each record, from wherever they were read, so the
    order stands before any shuffle. A row begins at a line with an even number of quotes before it in its record; that number is a running
    total over range parts, so one huge record is no single task. line_no is the row's first line; text is null-free and has \n between
    lines. Blank rows are dropped. A last row whose quotes are never closed goes to the end of its record.
    """
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit(_QUOTE), F.lit("")))
    counted = scans.running_total(lines.select("record", "line_no", F.coalesce("line", F.lit("")).alias("line")), ["record"], ["line_no"], quotes.cast("bigint"), "upto")
    begins = (F.col("upto") - quotes) % 2 == 0
    # most rows are one line; only lines within quotes look for the line their row begins at
    alone = begins & (F.col("upto") % 2 == 0)
    placed = scans.carry(counted.where(~alone).select("record", "line_no", "line", begins.alias("begins")), ["record"], ["line_no"], F.when(F.col("begins"), F.col("line_no")), "first")
    several = placed.groupBy("record", "first").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))  # the lines of one row
    several = several.select("record", F.col("first").alias("line_no"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    single = counted.where(alone).select("record", "line_no", F.col("line").alias("text"))
    return single.union(several).where(F.regexp_replace("text", r"[\r\n]+$", "") != "")


def fields(text: Column) -> Column:
    """The fields of a row: quoting undone, empty fields kept."""
    # with a comma before the first field every match takes something
    found = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))
    return F.transform(found, lambda f: F.when(f.startswith(_QUOTE), F.replace(F.regexp_replace(f, r'(?s)^"(.*)"[^"]*$', "$1"), F.lit('""'), F.lit(_QUOTE))).otherwise(f))


def row_text(values: Column) -> Column:
    """A row of fields as text, quoted only where needed."""
    quoted = lambda f: F.concat(F.lit(_QUOTE), F.replace(f, F.lit(_QUOTE), F.lit('""')), F.lit(_QUOTE))
    return F.array_join(F.transform(values, lambda f: F.when(f.rlike('[,"\r\n]'), quoted(f)).otherwise(f)), ",")


def read_records(lines: DataFrame) -> DataFrame:
    """(record, line_no, path, fields) of all rows of records given as lines; see logical_rows."""
    rows = logical_rows(lines).withColumn("fields", fields(F.col("text")))
    return rows.select("record", "line_no", F.get("fields", F.lit(0)).alias("path"), "fields")
