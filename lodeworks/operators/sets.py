"""Set operations within groups, range lookup, and search sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_covered(rows: DataFrame, group: str, item: str, allowed: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(group, missing): per group the sorted distinct items outside a constant list and prefixes; groups without any are left out."""
    bad = ~F.col(item).isin(allowed)
    for p in prefixes:
        bad = bad & ~F.col(item).startswith(p)
    return rows.where(bad).groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("missing"))


def first_range(value: Column, ranges: Column) -> Column:
    """The first of an array of structs (low, high, ...) that holds value, null if none does: low <= value < high."""
    return F.get(F.filter(ranges, lambda r: (value >= r["low"]) & (value < r["high"])), F.lit(0))


def file_offset(address: Column, sections: Column) -> Column:
    """raw + address - low of the first section (low, high, raw) that holds the address; none is an error."""
    found = first_range(address, sections)
    missing = F.raise_error(F.concat(F.lit("address 0x"), F.lower(F.hex(address.cast("bigint"))), F.lit(" lies in no section"))).cast("bigint")
    return F.when(found.isNull(), missing).otherwise((found["raw"] + address - found["low"]).cast("bigint"))


def only(rows: DataFrame, order: str, what: str = "match") -> DataFrame:
    """The one row of rows; none or several are an error that lists them in order. At most a handful are expected."""
    names = rows.select(F.col(order).alias("_lw_name")).limit(100).agg(F.array_sort(F.collect_list("_lw_name")).alias("_lw_names"))
    n = F.size("_lw_names")
    listed = F.array_join(F.transform("_lw_names", lambda x: x.cast("string")), ", ")
    error = F.raise_error(F.concat(F.lit(f"one {what} expected, found "), n.cast("string"), F.lit(": "), listed))
    held = names.join(rows.limit(1), F.lit(True), "left")  # one row with one or none
    return held.select(*(F.when(n == 1, F.col(c)).otherwise(error.cast(k)).alias(c) if c == order else F.col(c) for c, k in rows.dtypes))


def search_sets(files: DataFrame, root: str = "") -> DataFrame:
    """(scope, dll) of names that a loader finds: scope is a folder, or '*' for what every file sees.

    Every folder's own names are seen by its files; the root's and those of folders named *.libs by all.
    """
    names = files.select(F.col("parent").alias("scope"), F.lower("name").alias("dll"))
    shared = names.where((F.col("scope") == root) | F.col("scope").endswith(".libs")).select(F.lit("*").alias("scope"), "dll")
    return names.union(shared).distinct()
