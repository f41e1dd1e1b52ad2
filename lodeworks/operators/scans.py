"""Running values over groups of any size: totals, carried states, ranks.

A window function takes each of its groups in one task, so one huge group, or a table without groups, does not get
faster with more machines. Here the rows are dealt by ranges of (hash of the group, order) into parts of about equal size, each
part is scanned by itself, and what stands before a part in its group is added afterwards from one row per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import cut

#: Ranges for each shuffle partition: several small ones in a task even out.
RANGES = 2
PART = "_lw_part"


def dealt(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """rows with _lw_part: parts that follow one another within each group in order, nulls first. Groups stand by a hash of their keys,
    as it takes less to sample than the keys do.

    Rows that agree in keys and order share a part, so an order with few values needs more columns to break ties.
    The rows are written once: a part's number is of no use unless it stays.
    """
    n = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [F.xxhash64(*keys)] if keys else []
    return cut(rows.repartitionByRange(n, *groups, *order).withColumn(PART, F.spark_partition_id()))


def _with_before(parts: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """parts with the columns of before, which has a row for each part that continues a group; null keys meet.

    At most one group goes on from a part to the next, so there are no more rows than parts. They are written, so
    that Spark knows their size before it plans the join.
    """
    names = {k: f"_lw_key{i}" for i, k in enumerate([*keys, PART])}
    small = cut(before.select(*(F.col(k).alias(v) for k, v in names.items()), *(c for c in before.columns if c not in names)))
    on = F.lit(True)
    for k, v in names.items():
        on = on & parts[k].eqNullSafe(small[v])
    return parts.join(small, on, "left").drop(*names.values())


def _earlier(keys: list[str]):
    return W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def _so_far(keys: list[str], order: list[str | Column]):
    return W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def running_total(rows: DataFrame, keys: list[str], order: list[str | Column], amount: Column, out: str = "running") -> DataFrame:
    """rows with the total of amount up to and with each row of its group, in order. A null amount counts as 0.

    order must tell the rows of a group apart, or the order of equals is open. Amounts must add up exactly
    whatever the order (integers, decimals). keys may be empty: then the whole table is one group.
    """
    parts = dealt(rows.withColumn("_lw_amount", F.coalesce(amount, F.lit(0))), keys, order)
    sums = parts.groupBy(*keys, PART).agg(F.sum("_lw_amount").alias("_lw_sum"))
    sums = sums.withColumn("_lw_before", F.sum("_lw_sum").over(_earlier(keys))).drop("_lw_sum").where("_lw_before is not null")
    within = parts.withColumn("_lw_within", F.sum("_lw_amount").over(_so_far(keys, order)))
    both = _with_before(within, sums, keys)
    return both.withColumn(out, F.coalesce("_lw_before", F.lit(0)) + F.col("_lw_within")).drop("_lw_before", "_lw_within", "_lw_amount", PART)


def rank(rows: DataFrame, keys: list[str], order: list[str | Column], out: str = "rank") -> DataFrame:
    """rows with their number in the order of their group, from 1 without gaps; see running_total."""
    return running_total(rows, keys, order, F.lit(1).cast("bigint"), out)


def carry(rows: DataFrame, keys: list[str], order: list[str], state: Column, out: str = "carried") -> DataFrame:
    """rows with the last non-null state up to and with each row of its group, in order; null before the first.

    Takes the arguments of sequences.carry and gives the same rows.

    The summary of a part is its last state, if it has one, and two summaries put together give the later one:
    an associative scan, so that a part needs just one value of all that stands before it.
    """
    parts = dealt(rows.withColumn("_lw_state", state), keys, order)
    numbered = parts.withColumn("_lw_within", F.last("_lw_state", ignorenulls=True).over(_so_far(keys, order)))
    # the last state of a part is the one with the greatest place
    last = parts.groupBy(*keys, PART).agg(F.max_by("_lw_state", F.when(F.col("_lw_state").isNotNull(), F.struct(*order))).alias("_lw_last"))
    last = last.withColumn("_lw_before", F.last("_lw_last", ignorenulls=True).over(_earlier(keys))).drop("_lw_last").where("_lw_before is not null")
    both = _with_before(numbered, last, keys)
    return both.withColumn(out, F.coalesce("_lw_within", "_lw_before")).drop("_lw_before", "_lw_within", "_lw_state", PART)
