"""Installer records: rows of files that are still there."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalized
from ..sources.records import iter_record, record_text

#: Rows of a record that a task hands on at once.
ROWS = 10_000


def prune(record: DataFrame, tree: DataFrame, site: str) -> DataFrame:
    """Rows of record whose path, seen from site, is in the tree (files and folders), in order, repeats kept."""
    return still_there(record, tree, site).orderBy("line_no")


def still_there(record: DataFrame, tree: DataFrame, site: str) -> DataFrame:
    """The rows of prune in any order; each distinct path is normalized once. Both sides grow with the tree, and a tree read from
    Parquet is far larger than its files: nothing is broadcast. The joins are inner ones with distinct keys: Spark moves a semi join below the
    normalizing and the distinct, and then normalizes every row again for each comparison of its sort."""
    full = F.coalesce(normalized(F.concat(F.lit(site + "/"), F.col("path"))), F.lit(""))  # never null, or the join would work it out again to test that
    there = tree.select(F.col("path").alias("_there")).distinct()
    kept = record.select("path").where("path is not null").distinct().withColumn("_at", full).join(there.hint("merge"), F.col("_at") == F.col("_there"))
    return record.join(kept.select("path").hint("merge"), "path").select(*record.columns)


def _parsed(batches: Iterator) -> Iterator:
    """Arrow batches of (path, content) of records to their rows, each with its text."""
    import pyarrow as pa

    for batch in batches:
        for record, content in zip(batch.column(0), batch.column(1), strict=True):
            for rows in batched(iter_record((content.as_py() or b"").decode()), ROWS):
                columns = [record.as_py()] * len(rows), [k for k, _ in rows], [f[0] for _, f in rows], [record_text([f]) for _, f in rows]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["record", "line_no", "path", "text"])


def prune_records(tree: DataFrame, site: str) -> DataFrame:
    """tree (path, content, ...) with every installer record below site rewritten to the rows whose files are in the tree.

    Only records meet their new texts in a join, other files pass by; the texts grow with the tree and are not broadcast.
    """
    own = F.coalesce(F.col("path").startswith(site + "/") & F.substr("path", F.lit(len(site) + 2)).rlike(r"^[^/]+\.dist-info/RECORD$"), F.lit(False))
    rows = tree.where(own).select("path", "content").mapInArrow(_parsed, "record string, line_no bigint, path string, text string")
    kept = still_there(rows, tree, site).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))  # one record's rows
    new = kept.select(F.col("record").alias("_record"), F.encode(F.array_join(F.transform("rows", lambda r: r["text"]), ""), "UTF-8").alias("_text"))
    records = tree.where(own).drop("content").join(new.hint("merge"), F.col("path") == F.col("_record"), "left")
    return tree.where(~own).union(records.withColumn("content", F.coalesce("_text", F.lit(b""))).select(*tree.columns))
