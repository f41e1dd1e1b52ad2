"""Mergeable quantile summaries: rank bounds of a few values, merged pairwise in a balanced tree and pruned at each height.

A summary of n rows is a list of points (x, low, high) in order of x: at least `low` rows are <= x, and at most
high - 1 rows are < x. An exact point of a value on ranks r to s has low = s and high = r. For a rank t the point with
the smallest max(high - t, t - low) is returned; that maximum bounds its error, ties among rows included.

Merging two summaries (combine) adds to a point's bounds what the other summary says about its x: the low of the last
point <= x, the high of the first point >= x. Merging adds no error beyond the sum of both. Pruning keeps the best
points for evenly spaced ranks (0/b, 1/b, ... of n) and adds at most half a space, n/2b + 1/2. A tree of height h
prunes at most h + 1 times on the way from a row to the root, so with b = (h + 1) / error the root is within error * n.

Rows that agree in x count as one value with a number of rows. The rows of a part are dealt by a hash of x to leaves
of at most `capacity` values; a leaf's summary is exact but for its pruning, and made by Spark's own functions.
Summaries are merged in tasks of FAN at a time, so a task holds FAN lists of at most b + 5 points for each row of its batch,
whatever the size of the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import scans
from .common import cut

#: Heights merged in one shuffle, and the leaves that come together there.
STEP = 3
FAN = 1 << STEP
#: A pruned summary keeps its first values in any case, so that one value on nearly all ranks leaves some others.
FIRST = 4
POINTS = "array<struct<x: bigint, low: bigint, high: bigint>>"


def spaces(height: int, error: float) -> int:
    """The spaces between kept ranks that a tree of this height needs."""
    return math.ceil((height + 1) / error)


def combine(a, b):
    """The summary of the rows of both: (n, x, low, high) each, with sorted arrays of integers."""
    import numpy as np

    def seen_from(own, other):
        n, x, low, high = other
        before = np.searchsorted(x, own[1], "right")
        after = np.searchsorted(x, own[1], "left")
        return own[2] + np.concatenate(([0], low))[before], own[3] + np.concatenate((high - 1, [n]))[after]

    (la, ha), (lb, hb) = seen_from(a, b), seen_from(b, a)
    x, at = np.unique(np.concatenate((a[1], b[1])), return_index=True)  # a value of both has the same bounds from either side
    return a[0] + b[0], x, np.concatenate((la, lb))[at], np.concatenate((ha, hb))[at]


def best(summary, ranks):
    """For each rank the index of the point with the smallest bound on its error, the first of equals."""
    import numpy as np

    _, _, low, high = summary
    return np.maximum(high[:, None] - ranks, ranks - low[:, None]).argmin(0)


def prune(summary, b: int):
    """At most b + FIRST + 1 points: the best for evenly spaced ranks, the first values and the last."""
    import numpy as np

    n, x, low, high = summary
    if len(x) <= b + 1:
        return summary
    ranks = np.maximum(1, -(-np.arange(b + 1, dtype=np.int64) * n // b))
    keep = np.unique(np.concatenate((best(summary, ranks), np.arange(FIRST), [len(x) - 1])))
    return n, x[keep], low[keep], high[keep]


def merge_tree(nodes: list, b: int):
    """One summary of (number, summary) pairs: neighbours in a balanced binary tree over the numbers, pruned at every height."""
    now = dict(nodes)
    while len(now) > 1 or any(now):
        up: dict = {}
        for k in sorted(now):
            up[k >> 1] = prune(combine(up[k >> 1], now[k]), b) if k >> 1 in up else now[k]
        now = up
    return now[0]


def _read(column) -> tuple:
    """(offsets, n, x, low, high) of an Arrow column of summaries as structs with n and points."""
    points = column.field("points")
    values = points.values
    return (points.offsets.to_numpy(), column.field("n").to_numpy(), *(values.field(k).to_numpy() for k in ("x", "low", "high")))


def _written(summaries: list):
    """Arrow arrays (n, points) of summaries."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *(len(s[1]) for s in summaries)]).astype(np.int32)
    flat = [pa.array(np.concatenate([s[k] for s in summaries]) if summaries else np.array([], np.int64), pa.int64()) for k in (1, 2, 3)]
    points = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(flat, ["x", "low", "high"]))
    return pa.array([int(s[0]) for s in summaries], pa.int64()), points


def _merging(b: int):
    """Arrow batches of (keys..., nodes) to (keys..., n, points): the nodes of a row are merged."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            nodes = batch.column(batch.num_columns - 1)
            ends = nodes.offsets.to_numpy()
            number = nodes.values.field("node").to_numpy()
            at, n, x, low, high = _read(nodes.values)
            one = lambda i: (n[i], x[at[i] : at[i + 1]], low[at[i] : at[i + 1]], high[at[i] : at[i + 1]])
            out = [merge_tree([(int(number[i]) % FAN, one(i)) for i in range(ends[r], ends[r + 1])], b) for r in range(batch.num_rows)]
            keys = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *_written(out)], [*keys, "n", "points"])

    return run


def merged(summaries: DataFrame, keys: list[str], node: str, b: int) -> DataFrame:
    """(keys..., n, points): the summaries (keys..., node, n, points) of each group merged in a tree over the low STEP bits of node."""
    kinds = dict(summaries.dtypes)
    held = summaries.groupBy(*keys).agg(F.collect_list(F.struct(F.col(node).cast("bigint").alias("node"), "n", "points")).alias("nodes"))  # FAN at most
    return held.mapInArrow(_merging(b), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n bigint", f"points {POINTS}"]))


def answers(summaries: DataFrame, parts: int) -> DataFrame:
    """summaries (..., n, points) with n_points and found: for i in 1..parts - 1 the x that stands for rank ceil(i * n / parts)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        i = np.arange(1, parts, dtype=np.int64)
        for batch in batches:
            keys = batch.schema.names[:-1]
            points = batch.column(len(keys))
            at, flat = points.offsets.to_numpy(), [points.values.field(k).to_numpy() for k in ("x", "low", "high")]
            found = []
            for r, n in enumerate(batch.column(batch.schema.get_field_index("n")).to_numpy()):
                s = (n, *(f[at[r] : at[r + 1]] for f in flat))
                found.append(s[1][best(s, -(-i * n // parts))])
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (parts - 1)
            held = pa.array(np.concatenate(found) if found else np.array([], np.int64), pa.int64())
            size = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), size, pa.ListArray.from_arrays(pa.array(ends), held)], [*keys, "n_points", "found"])

    kept = [c for c in summaries.columns if c != "points"]
    kinds = dict(summaries.dtypes)
    return summaries.select(*kept, "points").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in kept), "n_points bigint", "found array<bigint>"]))


def counted(rows: DataFrame, keys: list[str], c: Column | None = None) -> DataFrame:
    """(keys..., x, c): how many rows of each group have a value; the sum of c where rows stand for several."""
    return rows.groupBy(*keys, "x").agg((F.count(F.lit(1)) if c is None else F.sum(c)).alias("c"))


def leaves(counts: DataFrame, keys: list[str], b: int, many: DataFrame) -> DataFrame:
    """(keys..., node, n, n_leaves, points): the pruned summaries of a group's leaves. counts: (keys..., x, c), each x once;
    many: (keys..., n_leaves) of the groups with more than one leaf."""
    of = counts.join(many, keys, "left").withColumn("node", F.coalesce(F.pmod(F.xxhash64("x"), F.col("n_leaves")), F.lit(0)))
    of = of.repartition(*keys, "node")  # by leaf, or a join by group would keep a large one in one task
    leaf = W.partitionBy(*keys, "node")
    upto = F.sum("c").over(leaf.orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    of = of.withColumn("upto", upto).withColumn("nth", F.row_number().over(leaf.orderBy("x"))).withColumn("n", F.sum("c").over(leaf))
    of = of.withColumn("size", F.count(F.lit(1)).over(leaf))
    # a value stands for rank ceil(k * n / b) if that is among its ranks, and so for some k if k's real place is
    space = lambda upto: F.expr(f"({b} * ({upto})) div n")
    kept = (F.col("size") <= b + 1) | (F.col("nth") <= FIRST) | (space("upto") > space("upto - c"))
    point = F.struct("x", F.col("upto").alias("low"), (F.col("upto") - F.col("c") + 1).alias("high"))
    return of.where(kept).groupBy(*keys, "node").agg(F.max("n").alias("n"), F.max("n_leaves").alias("n_leaves"), F.sort_array(F.collect_list(point)).alias("points"))  # b + FIRST + 1 points at most


def summaries(rows: DataFrame, keys: list[str], part: str, parts: int, c: Column | None = None, error: float = 0.05, most: int = 400, capacity: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(counts, summaries): the summaries (keys..., part, n, points) of every part of each group, and of the whole group
    as part -1, merged from these alone; counts (keys..., part, x, c) are what they were made of.

    rows: (keys..., part, x), part in 0..parts - 1, x bigint; parts at most FAN. Rows with a null among these are left
    out. Repeated rows count as often as they stand there, or c times each where given. A summary keeps all values
    of up to b + 1, else FIRST to `most` points. A rank's error is at most error * n for every n (see the module).
    Empty rows give no summary; other columns are not read.

    Where a group has so many leaves that b would pass most, leaves are made larger instead.
    """
    if parts > FAN:
        raise ValueError(f"at most {FAN} parts")
    own = [*keys, part]
    counts = cut(counted(rows.dropna(subset=[*own, "x"]), own, c))
    sizes = counts.groupBy(*own).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > capacity)
    top = sizes.agg(F.max("size")).first()[0] or 0  # one number
    up = (parts - 1).bit_length()
    height = lambda: up + max(0, math.ceil(math.log2(max(1, top / capacity))))
    while spaces(height(), error) + FIRST + 1 > most:
        capacity *= 2
    b = spaces(height(), error)
    leaf_heights = height() - up
    n_leaves = F.pow(F.lit(2), F.ceil(F.log2(F.col("size") / capacity))).cast("bigint")
    many = cut(sizes.where(F.col("size") > capacity).select(*own, n_leaves.alias("n_leaves")))
    leaf = leaves(counts, own, b, many)
    leaf = cut(leaf) if leaf_heights else leaf
    single = leaf.where("n_leaves is null").select(*own, "n", "points")
    tree = leaf.where("n_leaves is not null").select(*own, "node", "n", "points")
    for _ in range(0, leaf_heights, STEP):
        above = F.shiftright("node", STEP)
        tree = merged(tree.withColumn("above", above), [*own, "above"], "node", b).withColumnRenamed("above", "node")
    each = cut(single.unionByName(tree.select(*own, "n", "points")))
    whole = merged(each, keys, part, b).withColumn(part, F.lit(-1).cast(dict(each.dtypes)[part]))
    return counts, each.unionByName(whole)


def ranked(counts: DataFrame, keys: list[str], least: int, capacity: int = 4096) -> DataFrame:
    """(keys..., x, n, n_below, n_upto): exact ranks of all values of the groups of at least `least` rows. counts: (keys..., x, c), each x once.

    Groups of up to `capacity` values are ranked by a window, larger ones by running totals over range parts: no group is sorted in one
    task beyond that size.
    """
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum("c").alias("n")).where(F.col("size") > capacity)
    large = cut(sizes.select(*keys, "n"))
    group = W.partitionBy(*keys)
    upto = F.sum("c").over(group.orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    few = counts.join(large, keys, "left_anti").withColumn("n_upto", upto).withColumn("n", F.sum("c").over(group))
    many = scans.running_total(counts.join(large, keys), keys, ["x"], F.col("c"), "n_upto")
    columns = [*keys, "x", "n", (F.col("n_upto") - F.col("c")).alias("n_below"), "n_upto"]
    return few.select(*columns).union(many.select(*columns)).where(F.col("n") >= least)


def checked(counts: DataFrame, found: DataFrame, keys: list[str], part: str, parts: int, least: int) -> DataFrame:
    """One row for each answer of found (keys..., part, n, n_points, found): i, n, target, exact_x, points, answer, n_below, n_upto,
    with the exact counts from all of counts (keys..., part, x, c). found has the groups of at least `least` rows.
    """
    own = [*keys, part]
    whole = counted(counts, keys, F.col("c")).withColumn(part, F.lit(-1).cast(dict(counts.dtypes)[part]))
    ranked_ = cut(ranked(cut(counts.unionByName(whole.select(*counts.columns))), own, least))
    # rank ceil(i * n / parts) is above n_below and at most n_upto just if i * n / parts is
    low, high = (F.expr(f"({parts} * {c}) div n") for c in ("n_below", "n_upto"))
    exact = ranked_.where((low < high) & (low < parts - 1)).select(*own, F.explode(F.sequence(low + 1, F.least(high, F.lit(parts - 1)))).alias("i"), F.col("x").alias("exact_x"))
    given = found.select(*own, "n", F.col("n_points").alias("points"), F.posexplode("found").alias("at", "x"))
    met = given.join(ranked_.drop("n"), [*own, "x"]).withColumn("i", (F.col("at") + 1).cast("bigint"))
    both = met.join(exact, [*own, "i"])
    target = F.expr(f"(i * n + {parts - 1}) div {parts}")
    return both.select(*own, F.col("i").cast("int").alias("i"), "n", target.alias("target"), "exact_x", "points", F.col("x").alias("answer"), "n_below", "n_upto")


# ------------------------------------------------------------------------------------------- the query's streams

BATCHES = 8


def batch_of(ident: Column) -> Column:
    """crc32 of the decimal id mod BATCHES; a missing id counts as empty text."""
    return (F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % BATCHES).cast("int")


def money_x(money: Column) -> Column:
    """floor(100 * money + 0.5) as bigint; null where money is missing, not finite or has no such integer."""
    fits = F.abs(money) < 9e16
    return F.when(fits, F.floor(100 * F.when(fits, money) + 0.5).cast("bigint"))


def streams(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """(stream, grp, batch, x) of both streams.

    value: one row per click_id, the smallest (client_id, value) where rows of one differ; grp client_id. price: every sale line with its
    item (the smallest (brand, price) where an item_id stands twice); grp brand. Rows without grp or money (not
    finite counts as missing) go, as do sale lines without an item. Lines are counted by item and batch before they meet items, so that an
    item of very many lines is no hot key; x is repeated as a count, see counted.
    """
    value = clicks.where(F.col("client_id").isNotNull() & money_x(F.col("value")).isNotNull())
    value = value.groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("r"))
    value = value.select(F.lit("value").alias("stream"), F.col("r.client_id").cast("string").alias("grp"), batch_of(F.col("click_id")).alias("batch"), money_x(F.col("r.value")).alias("m"), F.lit(1).cast("bigint").alias("c"))
    lines = sale_lines.where("item_id is not null").groupBy("item_id", batch_of(F.col("vendor_id")).alias("batch")).agg(F.count(F.lit(1)).alias("c"))
    one = items.where(F.col("item_id").isNotNull() & F.col("brand").isNotNull() & money_x(F.col("price")).isNotNull()).groupBy("item_id").agg(F.min(F.struct("brand", "price")).alias("r"))
    price = lines.join(one, "item_id").select(F.lit("price").alias("stream"), F.col("r.brand").alias("grp"), "batch", money_x(F.col("r.price")).alias("m"), "c")
    both = value.union(price)
    return both.select("stream", "grp", "batch", (F.col("m") + 1000 * F.col("batch")).alias("x"), "c")
