"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PRIME = 2_147_483_647


def round_keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    """Multiplier and increment of each round, by a linear congruence on the seed."""
    out, x = [], seed % PRIME
    for _ in range(rounds):
        a = x = (x * 48271 + 11) % PRIME
        b = x = (x * 48271 + 11) % PRIME
        out.append((a | 1, b))
    return out


def permute(numbers, n: int, seed: int = 7, rounds: int = 6):
    """A permutation of 0..n-1 applied to an int64 array: a balanced Feistel network on the smallest even
    number of bits that holds n, walked along its cycle until the value is below n again."""
    import numpy as np

    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = (1 << half) - 1
    keys = round_keys(seed, rounds)

    def once(x):
        left, right = x >> half, x & mask
        for a, b in keys:
            mixed = ((right % PRIME) * a + b) % PRIME  # below 2**62
            mixed = ((mixed ^ (mixed >> 13)) * 69621) % PRIME
            left, right = right, left ^ ((mixed ^ (mixed >> 9)) & mask)
        return (left << half) | right

    out = once(np.asarray(numbers, dtype=np.int64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out


def shard(docs: DataFrame, shards: int = 8, seed: int = 7, digits: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null).

    Rows are numbered 0..n-1 without gaps: by hash bucket of doc_id and checksum, then doc_id, checksum and size within the
    bucket, with the bucket's first number from the counts of the buckets before it (16 ** digits of them, so
    the counts are a table of bounded size; a bucket is sorted by one task, which may spill). The Feistel
    permutation sends a row number to p; its shard is p mod shards and its slot p div shards, so the shards'
    counts differ by one at most, slots have no gaps, and both can be computed from the row number alone.

    size is the UTF-8 bytes of the text (null: none) plus 1, the checksum of a null text is 0. Rows that are
    equal in doc_id and text take neighbouring numbers in any order, which cannot be told apart; they share a bucket,
    while rows that share only a doc_id (null, say) or only a text are spread. An empty table
    gives no rows; only doc_id and text are read.
    """
    from pyspark.sql.functions import pandas_udf

    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    named = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), crc.cast("string")).cast("binary"))
    bucket = F.conv(F.substring(named, 1, digits), 16, 10).cast("int")
    counts = docs.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("bucket", before.alias("first"), F.sum("rows").over(W.partitionBy(F.lit(0))).alias("n"))
    rows = docs.select("doc_id", bucket.alias("bucket"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), crc.alias("text_crc32"))
    order = W.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(firsts), "bucket")  # at most 16 ** digits rows

    @pandas_udf("long")
    def placed(number, n):
        import pandas as pd

        return pd.Series(permute(number.to_numpy(), int(n.iloc[0]), seed)) if len(number) else pd.Series([], dtype="int64")

    numbered = numbered.withColumn("p", placed(F.col("first") + F.col("rank"), F.col("n")))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % shards).cast("int").alias("shard"),
        F.floor(F.col("p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
