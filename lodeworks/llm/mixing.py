"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, word_count


def seeded(key: Column, seed: int) -> Column:
    """A hash of key and seed as 32 hex digits, the same in every engine that has MD5."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def source_targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Adds target to (key, source, source_size): shares by weight of all sizes, none above cap times its size.

    Sources by code point, null last, take the weights in turn. Resharing the excess until none is above is
    water filling: in order of cap/weight each source is held at its cap while the level that the rest would
    share stays above it.
    """
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    by_level = W.orderBy("room", "rn")
    return (
        sources.withColumn("rn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last(), "key")))
        .withColumn("weight", weight.cast("long"))
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("pos", F.row_number().over(by_level))
        .withColumn("fixed", F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("fixed")).cast("double") / F.col("open"))
        .withColumn("first_open", F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("pos"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("pos") == F.col("first_open"), F.col("level"))).over(everything))
        .withColumn("held", F.coalesce(F.col("pos") < F.col("first_open"), F.lit(True)))
        .withColumn("target", F.when(F.col("held"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")))
        .select("key", "source_size", "rn", "total", "target", "held")
    )


def sainte_lague(parties: DataFrame, group: str | None, votes: str, seats: str, tie: str) -> DataFrame:
    """Adds quota: seats of each group go to the highest quotients votes / (2j + 1), ties to the smaller tie.

    The final divisor lies between V / (seats + n/2) and V / (seats - n/2) for n parties with V votes, so a
    party's seats below the first bound are certain and only about 2n quotients are ranked, however many
    seats there are.
    """
    rows = parties.where(F.col(votes) > 0)
    part = W.partitionBy(group) if group else W.partitionBy(F.lit(0))
    n, v = F.count(F.lit(1)).over(part), F.sum(votes).over(part)
    sure = F.when(F.col(seats) > n / 2, F.floor(F.col(votes) * (F.col(seats) - n / 2) / v + 0.5) - 1).otherwise(F.lit(0))
    rows = rows.select("*", F.greatest(F.lit(0), sure).cast("long").alias("base"), (F.floor(F.col(votes) * (F.col(seats) + n / 2) / v + 0.5) + 1).cast("long").alias("top"))
    rows = rows.withColumn("left_over", F.col(seats) - F.sum("base").over(part))
    ranked = rows.select("*", F.explode(F.sequence("base", "top")).alias("j"))
    order = part.orderBy((F.col(votes) / (2 * F.col("j") + 1)).desc(), F.col(tie))
    won = ranked.withColumn("won", (F.row_number().over(order) <= F.col("left_over")).cast("long"))
    keys = [c for c in parties.columns]
    return won.groupBy(*keys).agg((F.first("base") + F.sum("won")).alias("quota"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, block_tokens: int = 16, shard_rows: int = 100_000, least_shards: int = 64, seed: int = 20, full: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, part) for every row of docs; full adds row, all its columns.

    Tokens are words. Targets: see source_targets. The blocks of block_tokens words that the targets come to
    are apportioned to sources, and each source's quota to its shards by their words, both by Sainte-Lague.
    Shards are dealt by a seeded hash of doc_id and grow in number with the rows, so no source's rows meet in
    one task. Within a shard the documents form one stream in seeded order that is cut into equal blocks; its
    quota is taken from the start, again from the start after a full pass, and at most cap passes. copies is
    how often the whole document is taken and part the words of one more, unfinished copy.

    Null text has size 0 and takes nothing; a null source is a source of its own, last in order; an empty table
    gives no rows; equal rows are ordered arbitrarily among themselves, which changes nothing but which of the
    equals is cut. Only doc_id, text and source are read, unless full. Shares are worked out over one row per source, in one
    task: sources are meant to be tens or thousands, not one per document.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_lw_row")] if full else []
    key = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    sized = cut(docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"), seeded(F.col("doc_id"), seed).alias("draw"), *row))
    shards = max(least_shards, -(-sized.count() // shard_rows))
    # the first nine hex digits of the draw deal the shards, the whole draw orders a shard
    sized = sized.withColumn("shard", F.conv(F.substring("draw", 1, 9), 16, 10).cast("long") % shards)
    cells = sized.groupBy("key", "shard").agg(F.first("source").alias("source"), F.sum("size").alias("cell_size"))
    sources = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size"))
    targets = source_targets(sources, weights, cap).withColumn("seats", F.round(F.col("total") / block_tokens).cast("long"))
    quotas = sainte_lague(targets.select("rn", "target", "seats"), None, "target", "seats", "rn")
    targets = targets.join(quotas.select("rn", F.col("quota").alias("source_quota")), "rn", "left").na.fill(0, ["source_quota"])
    cells = cells.drop("source").join(targets, "key")
    dealt = sainte_lague(cells.select("key", "shard", "cell_size", "source_quota"), "key", "cell_size", "source_quota", "shard")
    cells = cells.join(dealt.select("key", "shard", "quota"), ["key", "shard"], "left").na.fill(0, ["quota"])
    most = F.col("cell_size") * cap
    take = F.when(F.col("held"), most).otherwise(F.least(F.col("quota") * block_tokens, most))
    cells = cells.select("key", "shard", "source_size", "target", "cell_size", take.alias("take"))
    stream = W.partitionBy("key", "shard").orderBy("draw", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("cell_size") > 0, F.floor(F.col("take") / F.col("cell_size"))).otherwise(0).cast("long")
    rest = F.col("take") - F.col("copies") * F.col("cell_size") - F.col("before")
    return (
        sized.withColumn("before", before)
        .join(cells, ["key", "shard"])
        .withColumn("copies", passes)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies") + F.col("part")).alias("taken"), "source", "copies", "part", *([F.col("_lw_row").alias("row")] if full else []))
    )
