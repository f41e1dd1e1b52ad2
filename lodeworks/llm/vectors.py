"""Near-duplicate vectors by an inverted multi-index (Babenko and Lempitsky 2012)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

#: Fixed value: how many cosines are taken to cost as much as moving a vector to a cell.
MOVE = 1500


def unit(x):
    """Rows of a float array scaled to length 1 in double precision."""
    import numpy as np

    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x, k: int, rounds: int = 12, seed: int = 5):
    """k centroids of the rows of x by Lloyd's algorithm; a centroid without rows moves to the farthest row."""
    import numpy as np

    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = distances(x, centres)
        own = d.argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        if not full.all():
            far = np.argsort(-d[np.arange(len(x)), own])[: int((~full).sum())]
            centres[~full] = x[far]
    return centres


def distances(x, centres):
    """Squared distances between rows."""
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


class MultiIndex:
    """The product grid of two codebooks, one for each half of a vector."""

    def __init__(self, sample, k: int):
        self.half = sample.shape[1] // 2 or 1
        self.books = [codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k)] if sample.shape[1] > 1 else [codebook(sample, k)] * 2
        self.k = len(self.books[0])

    def cells(self, x, visits: int):
        """The cells nearest to each row of x, by the sum of the distances of its halves, nearest first.

        The traversal of two sorted distance lists: the cell of ranks (i, j) is preceded by the (i + 1)(j + 1) - 1
        cells of smaller ranks, so only ranks with (i + 1)(j + 1) <= visits can be among the first.
        """
        import numpy as np

        visits = min(visits, self.k * self.k)
        parts = [x[:, : self.half], x[:, self.half :]] if x.shape[1] > 1 else [x, x]
        d = [distances(p, b) for p, b in zip(parts, self.books, strict=True)]
        rank = [np.argsort(y, axis=1, kind="stable")[:, :visits] for y in d]
        near = [np.take_along_axis(y, r, axis=1) for y, r in zip(d, rank, strict=True)]
        ij = [(i, j) for i in range(min(self.k, visits)) for j in range(min(self.k, visits // (i + 1)))]
        i, j = np.array(ij).T
        out = np.empty((len(x), visits), np.int64)
        step = max(1, 4_000_000 // len(i))  # bounds the memory, whatever the number of visits
        for lo in range(0, len(x), step):
            at = slice(lo, lo + step)
            order = np.argsort(near[0][at][:, i] + near[1][at][:, j], axis=1, kind="stable")[:, :visits]
            out[at] = np.take_along_axis(rank[0][at], i[order], axis=1) * self.k + np.take_along_axis(rank[1][at], j[order], axis=1)
        return out

    def ranks(self, x, cells):
        """How many cells each row of x visits before the given one, ties counted in full."""
        import numpy as np

        parts = [x[:, : self.half], x[:, self.half :]] if x.shape[1] > 1 else [x, x]
        d = [distances(p, b) for p, b in zip(parts, self.books, strict=True)]
        out = np.empty(len(x), np.int64)
        for k, (near, far, cell) in enumerate(zip(*d, cells, strict=True)):
            limit = near[cell // self.k] + far[cell % self.k]
            # cells (i, j) with near[i] + far[j] <= limit, counted without listing the grid
            out[k] = np.searchsorted(np.sort(far), limit - near + 1e-12 * max(1.0, abs(limit)), side="right").sum() - 1
        return out


def turned(x, least: float, seed: int = 7):
    """Rows at cosine least exactly to those of x, each in a random direction; x itself in one dimension."""
    import numpy as np

    if x.shape[1] < 2:
        return x
    z = np.random.default_rng(seed).normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return least * x + np.sqrt(max(0.0, 1 - least * least)) * unit(z)


def visits_for(index: MultiIndex, sample, least: float, recall: float, queries: int = 1500, turns: int = 4000) -> int:
    """How many cells to visit so that the given share of links is found from either end, up to all cells.

    A sample of a large table may hold hardly any of its links. So vectors of the sample are also turned to cosine
    `least`, the farthest a link can be, at least `turns` times in all; the worse of these pairs and of the
    sample's own links counts.
    """
    import numpy as np

    def need(x, y) -> int:
        ranks = np.sort(np.minimum(index.ranks(x, index.cells(y, 1)[:, 0]), index.ranks(y, index.cells(x, 1)[:, 0])))
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1

    q = sample[:queries]
    x = np.tile(q, (-(-turns // len(q)), 1))
    out = need(x, turned(x, least))
    a, b = np.nonzero(q @ sample.T >= least)
    keep = a != b
    a, b = a[keep], b[keep]
    if len(a):
        pick = np.random.default_rng(9).permutation(len(a))[:20_000]
        out = max(out, need(sample[a[pick]], sample[b[pick]]))
    return out


def fitted(sample, n: int, least: float, recall: float, fill: int, queries: int = 1500) -> tuple[MultiIndex, int]:
    """The index for n vectors and its number of visits: of the finest grid and its halvings, the one of least cost.

    The finest grid has a cell for every `fill` vectors, as far as a codebook has four sampled vectors for each
    centre. If the sample is only a part of the table, its queries are kept out of the codebooks, as most vectors are.
    """
    import numpy as np

    rest = sample[min(queries, len(sample) // 4) :] if n > len(sample) else sample
    k = int(min(max(2, np.ceil(np.sqrt(n / fill))), max(256, len(rest) // 4), len(rest)))
    best = None
    while True:
        index = MultiIndex(rest, k)
        visits = visits_for(index, sample, least, recall, min(queries, max(1, len(sample) // 4)) if n > len(sample) else queries)
        cost = visits * (n / (k * k) + MOVE)
        if best is None or cost < best[0]:
            best = cost, index, visits
        if k <= 2:
            return best[1:]
        k = max(2, k // 2)


def _needed(index: MultiIndex, queries, ids, least: float, most: int = 4000):
    """Arrow batches of (id, times, v) to (visits, links): how many links of the queries need how many visits.

    The queries meet all rows. Visits are rounded up by about a tenth, so that few different numbers come out.
    Of more than `most` links in a batch that many are looked at, each standing for its share.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        home, draw = index.cells(queries, 1)[:, 0], np.random.default_rng(3)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(2), batch.num_rows))
            own = batch.column(0).to_numpy()
            q, r = np.nonzero(queries @ x.T >= least)
            other = ids[q] != own[r]
            q, r = q[other], r[other]
            if not len(q):
                continue
            weight = max(1.0, len(q) / most)
            if weight > 1:
                pick = draw.permutation(len(q))[:most]
                q, r = q[pick], r[pick]
            visits = 1 + np.minimum(index.ranks(queries[q], index.cells(x[r], 1)[:, 0]), index.ranks(x[r], home[q]))
            visits = np.ceil(1.1 ** np.ceil(np.log(visits) / np.log(1.1) - 1e-9)).astype(np.int64)
            names, count = np.unique(visits, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(count * weight)], ["visits", "links"])

    return run


def _calibrated(classes: DataFrame, index: MultiIndex, visits: int, least: float, recall: float, queries: int) -> tuple[int, float | None]:
    """(visits, measured recall): visits raised until so many queries find `recall` of their links among all rows.

    The queries are classes with an id divisible by 50, those of the least hashes; all their links are found by
    comparing them with every row. A link that either end visits is found. Without links the recall is None.
    """
    import numpy as np

    rows = classes.where(F.pmod("id", F.lit(50)) == 0).orderBy(F.xxhash64("id"), "id").limit(queries).collect()  # at most `queries` vectors
    if not rows:
        return visits, None
    asked = unit(np.array([r["v"] for r in rows]))
    found = classes.select("id", "times", "v").mapInArrow(_needed(index, asked, np.array([r["id"] for r in rows]), least), "visits bigint, links double")
    steps = sorted(tuple(r) for r in found.groupBy("visits").agg(F.sum("links")).collect())  # a few hundred numbers, see _needed
    total, upto = sum(n for _, n in steps), 0.0
    if not total:
        return visits, None
    for need, n in steps:
        if need > visits and upto >= recall * total:
            break
        upto += n
        visits = max(visits, need)
    return min(visits, index.k * index.k), upto / total


def _matrix(column, n: int):
    """An Arrow list column as a 2-d array."""
    import numpy as np

    return np.asarray(column.flatten()).reshape(n, -1)


def _assigned(index: MultiIndex, visits: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = index.cells(unit(_matrix(batch.column(2), batch.num_rows)), visits).astype(np.int32)
            offsets = pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ascontiguousarray(cells[:, 0])), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], ["id", "times", "v", "cell", "cells"])

    return run


def _linked(index: MultiIndex, visits: int, least: float):
    """Arrow batches of (cell, x, y, side, id, times, own, v), sorted by the first three, to (a, b, links).

    A block (cell, x, y) holds a chunk x of the vectors in a cell (side 0) and a chunk y of those that visit
    it (side 1). All cosines between the two are taken. A pair whose ends visit each other's cells would be
    met twice: then the visit by the smaller id counts. Links count for both ends; of the links themselves
    a spanning forest leaves the task.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def handle(rows: list) -> pa.RecordBatch | None:
            side = np.array([r[0] for r in rows])
            ids, times, own = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            held, asks = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(held) or not len(asks):
                return None
            x = unit(np.array([r[4] for r in rows]))
            i, j = np.nonzero(x[asks] @ x[held].T >= least)
            i, j = asks[i], held[j]
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            if not len(i):
                return None
            targets, back = np.unique(j, return_inverse=True)
            visited = index.cells(x[targets], visits)
            mutual = np.empty(len(i), bool)
            step = max(1, 20_000_000 // visited.shape[1])
            for lo in range(0, len(i), step):
                mutual[lo : lo + step] = (visited[back[lo : lo + step]] == own[i[lo : lo + step], None]).any(axis=1)
            keep = ~mutual | (ids[i] < ids[j])
            i, j = i[keep], j[keep]
            names, place = np.unique(ids, return_inverse=True)
            a, b = place[i], place[j]
            links = np.bincount(a, times[j], len(names)) + np.bincount(b, times[i], len(names))
            up = np.arange(len(names))
            while True:  # each end takes the smaller root until nothing changes
                low = np.minimum(up[a], up[b])
                new = up.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                np.minimum.at(new, up[a], low)
                np.minimum.at(new, up[b], low)
                new = new[new]
                if (new == up).all():
                    break
                up = new
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[up[some]]), pa.array(np.rint(links[some]).astype(np.int64))], ["a", "b", "links"])

        now, rows = None, []
        for batch in batches:
            for cell, x, y, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), _matrix(batch.column(7), batch.num_rows), strict=True):
                if (cell, x, y) != now:
                    if rows and (out := handle(rows)) is not None:
                        yield out
                    now, rows = (cell, x, y), []
                rows.append(row)
        if rows and (out := handle(rows)) is not None:
            yield out

    return run


def _links(classes: DataFrame, n: int, least: float, recall: float, fill: int, sample_rows: int, chunk: int, queries: int, log: list) -> DataFrame:
    """(a, b, links) of n classes (id, times, v) of one length: what the blocks of their index find, see _linked."""
    import numpy as np

    sample = [r[0] for r in classes.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()]  # at most sample_rows
    index, visits = fitted(unit(np.array(sample)), n, least, recall, fill)
    visits, measured = _calibrated(classes, index, visits, least, recall, queries)
    log.append({"length": len(sample[0]), "vectors": n, "centres": index.k, "visits": visits, "recall": measured})
    kind = dict(classes.dtypes)["v"]
    assigned = cut(classes.mapInArrow(_assigned(index, visits), f"id bigint, times bigint, v {kind}, cell int, cells array<int>"))
    asked = assigned.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("ys"))
    filled = assigned.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("xs"))
    grid = cut(filled.join(asked, "cell"))  # grows with the table; Spark broadcasts it by its measured size
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    held = assigned.join(grid, "cell").select("cell", one_of("xs").alias("x"), all_of("ys").alias("y"), F.lit(0).alias("side"), "id", "times", F.col("cell").alias("own"), "v")
    asks = assigned.select("id", "times", F.col("cell").alias("own"), "v", F.explode("cells").alias("cell")).join(grid, "cell")
    asks = asks.select("cell", all_of("xs").alias("x"), one_of("ys").alias("y"), F.lit(1).alias("side"), "id", "times", "own", "v")
    blocks = held.union(asks).repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y")
    return cut(blocks.mapInArrow(_linked(index, visits, least), "a bigint, b bigint, links bigint"))


def near(vectors: DataFrame, least: float = 0.9, recall: float = 0.995, fill: int = 128, sample_rows: int = 20_000, chunk: int = 1500, queries: int = 200, log: list | None = None) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors link when their cosine in double precision is at least `least`. Equal vectors are one class,
    joined once and counted as often as they occur.

    Index of the vectors of a length: two codebooks are fitted by k-means on at most sample_rows classes (the least
    hashes of their ids), each of sqrt(classes / fill) centres, which grow with the table up to a quarter of the sample, or
    a halving of that if it costs less (see fitted). Every class lies in the cell of its nearest centres and
    visits the cells nearest to it. Their number is the least that finds `recall` of the sample's links and of
    pairs at cosine `least` exactly; it is raised until at most `queries` queries find that share of all their links, which
    are known by comparing them with every row (_calibrated). There is no cap but all cells. log gets a line per length
    with the recall that was measured.
    All pairs of a cell's vectors and visitors are verified. A cell is dealt to chunks of about `chunk`
    vectors and visitors, each pair of chunks one task's work, so cells may grow without bound.

    Vectors of each length have an index of their own. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing: n_links 0, a component of their own. The same goes for rows with a null vec_id,
    whose component is null. vec_id names a vector: rows of equal id must be equal, and count as copies. An empty table gives no rows; only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), e.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    marks = [F.xxhash64("v"), F.xxhash64(F.lit(1), "v")]
    rows = cut(rows.select("id", F.when(F.col("sound"), F.col("v")).alias("v"), "sound", *(m.alias(n) for m, n in zip(marks, ("h", "g"), strict=True))))
    classes = cut(rows.where("sound").groupBy("h", "g").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("v").alias("v")))
    # one index for each length: vectors of different lengths have no cosine
    links = spark.createDataFrame([], "a bigint, b bigint, links bigint")
    for length, n in sorted(tuple(r) for r in classes.groupBy(F.size("v")).count().collect()):
        if n > 1:
            links = links.union(_links(classes.where(F.size("v") == length).select("id", "times", "v"), n, least, recall, fill, sample_rows, chunk, queries, [] if log is None else log))
    whole = connected_components(links.select("a", "b")).withColumnRenamed("node", "id")
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").cast("long").alias("others"))
    found = classes.select("h", "g", "id", "times").join(counts, "id", "left").join(whole, "id", "left").where("times > 1 or component is not null")
    found = cut(found.select("h", "g", F.coalesce("component", "id").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n")))
    out = rows.select("id", "sound", "h", "g").join(found, ["h", "g"], "left")
    component = F.coalesce(F.when(F.col("sound"), F.col("component")), F.col("id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce(F.when(F.col("sound"), F.col("n")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
