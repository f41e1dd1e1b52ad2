"""Lookups of values in tables of ranges, as equi-joins.

A range of integers is cut into aligned blocks of 2**k values, at most two of each size, as the nodes of a segment tree
cover it; a value lies in the range just if the block of some size that holds the value is one of these. So values and ranges meet
by (size, block), however long ranges are and however many overlap. For each block only the first range counts, so a block is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of ranges lie within +-2**LEVELS.
LEVELS = 61


def _blocks(low: Column, high: Column) -> Column:
    """(level, block) of the blocks that make up low <= v < high."""

    def at(k: Column) -> Column:
        a = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k)
        b = F.call_function("shiftright", high, k)
        inner = a < b
        left = F.when(inner & (a.bitwiseAND(F.lit(1).cast("bigint")) == 1), a)
        right = F.when(inner & (b.bitwiseAND(F.lit(1).cast("bigint")) == 1), b - 1)
        return F.array_distinct(F.array_compact(F.array(left, right)))

    each = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.transform(at(k), lambda block: F.struct(k.alias("level"), block.alias("block"))))
    return F.flatten(each)


def covered(ranges: DataFrame, low: str, high: str, order: list[str]) -> DataFrame:
    """(level, block, first): for each block the row of the first range in order that has it. Empty ranges hold nothing; ranges with a null
    end are left out."""
    rest = [c for c in ranges.columns if c not in order]
    row = F.struct(*order, *rest)
    sound = ranges.where(F.col(low) < F.col(high))
    at = sound.select(F.explode(_blocks(F.col(low).cast("bigint"), F.col(high).cast("bigint"))).alias("b"), row.alias("row"))
    return at.groupBy("b.level", "b.block").agg(F.min("row").alias("first"))


def first_match(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, order: list[str]) -> DataFrame:
    """rows with `range`, the first of ranges in order with low <= value < high as a struct, null where none has it.

    Value, low and high are integers (cast dates and times to them), ends within +-2**61. Ranges may overlap, repeat and nest;
    equal rows and misses stay. Ties in order go by the other columns, all of which must be of kinds that can be ordered.
    Distinct values are looked up, so values of very many rows are no hot keys.
    """
    spark = rows.sparkSession
    blocks = covered(ranges, low, high, order)
    levels = sorted(r[0] for r in blocks.select("level").distinct().collect())  # LEVELS at most
    kind = blocks.schema["first"].dataType
    if not levels:
        return rows.withColumn("range", F.lit(None).cast(kind))
    values = rows.select(F.col(value).cast("bigint").alias("_lw_value")).where("_lw_value is not null").distinct()
    keyed = values.select("_lw_value", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("_lw_value", k).alias("block")) for k in levels))).alias("b"))
    found = keyed.select("_lw_value", "b.*").join(blocks, ["level", "block"]).groupBy("_lw_value").agg(F.min("first").alias("range"))
    return rows.join(found, rows[value].cast("bigint") == found["_lw_value"], "left").drop("_lw_value")
