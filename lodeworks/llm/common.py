"""Shared pieces: reading tables, cutting lineage, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, drop, noted, shared_folder

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


__all__ = ["WORD", "connected_components", "cut", "drop", "noted", "shared_folder", "shared_keys", "small_batches", "table", "with_shared", "word_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Sets the session's bytes of an Arrow batch, unless it has been set: Spark's default of 64 MB of texts stands several times in memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, size)


def shared_keys(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(_lw_key): the keys, null among them, that stand with more than one value."""
    ends = rows.select(key.alias("_lw_key"), value.alias("v")).groupBy("_lw_key").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return cut(ends.where("low <> high").select("_lw_key"))


def with_shared(rows: DataFrame, key: str, shared: DataFrame, out: str) -> DataFrame:
    """rows with `out`, whether the key is among shared_keys. Spark broadcasts these by their measured size."""
    both = rows.join(shared.withColumn("_lw_is", F.lit(True)), rows[key].eqNullSafe(shared["_lw_key"]), "left")
    return both.withColumn(out, F.coalesce("_lw_is", F.lit(False))).drop("_lw_key", "_lw_is")


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as long columns (a, b); component is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each step is one aggregation and one
    join by node, so a node with very many neighbours is pre-aggregated and its join partition can be split. After
    a large-star step few edges lead down from a node, so the small-star join has no such nodes.
    Nulls and loops are ignored; nodes without edges do not occur in the result.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").distinct()

    def large_star(df: DataFrame) -> DataFrame:
        both = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written out, so that the join has two plain shuffles: Spark can split a node with very many neighbours
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        return tidy(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small_star(df: DataFrame) -> DataFrame:
        down = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        onto = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return tidy(onto.union(low.select("a", F.col("m").alias("b"))))

    def digest(df: DataFrame):
        h = F.xxhash64(F.col("a"), F.col("b"))
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(h, 40))).first())

    now = cut(tidy(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")))
    seen = None
    for _ in range(rounds):
        now = cut(small_star(large_star(now)))
        mark = digest(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components did not settle")
    low = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return low.union(roots.join(low, "node", "left_anti"))
