"""N-gram Jaccard self-join by size: fixed-size subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop, noted, shared_keys, with_shared

MASK = (1 << 64) - 1


def _mix(x):
    """A finalizer over uint64 arrays."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, n: int, fold: bool = True):
    """Sorted distinct hashes (uint64) of the n-word shingles of a text in UTF-8.

    Words are runs of other than ASCII white space; with fewer than n words the whole sequence is one shingle;
    without words there is none.
    """
    import numpy as np
    import xxhash

    words = (text or b"").split()  # bytes are split at just the six ASCII characters
    if not words:
        return np.empty(0, np.uint64)
    if fold:
        words = [w.lower() for w in words]  # bytes: A-Z alone
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(words) < n:
        # a shorter sequence is no shingle of n words: its length enters the hash
        total = np.array([len(words) + 1], np.uint64)
        for x in h:
            total = _mix((total ^ x) + np.uint64(0x9E3779B97F4A7C15))
        return total
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m] + np.uint64(k + 1))
    return np.unique(out)


class Sizes:
    """Which keys a set of a given size files, for Jaccard similarity >= num / den.

    Two sets of sizes a <= b link when they share at least need(a, b) elements, and then b <= a * den / num.

    Small: a pair with b up to `boundary` shares a subset of exactly need(a, b) elements. Each set lists its
    subsets of that size for each size that a partner may have.
    Large: sizes fall into bands that grow by half. A set is filed in its band, and near the upper end in the
    next one as well, so two linked sets meet in some band. A band allows at most D elements that are in just
    one of two linked sets; its elements are dealt by hash to D + spare(D) parts, so at least spare(D) parts
    agree. Each set has an entry in the inverted list of every non-empty part. Of a set with f non-empty parts
    and any set it links with, at least f - D non-empty parts agree: that many of a set's lists must hold
    another set, or it has no link in the band. If f - D < 1 in both sets, the agreeing parts may all be empty: such sets want
    nothing of their parts' lists and add the elements of their prefix (the least hashes; linked sets share at least `least` of these,
    as the prefix is longer by as many as it takes).

    Any boundary gives the same links; which one costs least depends on the sets, see cheapest.
    """

    GROWTH = 1.5
    LEAST = 8

    def __init__(self, num: int, den: int, boundary: int = 0):
        self.num, self.den, self.boundary = num, den, boundary
        self.known: dict[tuple, tuple] = {}

    @staticmethod
    def parts(odd: int) -> int:
        return odd + 3 + (odd + 1) * 15 // 100

    def need(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def overlap(self, n: int) -> int:
        """Elements that a set of n elements shares with any it links with, at least."""
        return self.need(-(-self.num * n // self.den), n)

    def odd(self, both: int) -> int:
        """Elements in just one of two linked sets with this sum of sizes, at most."""
        return (self.den - self.num) * both // (self.den + self.num)

    def partners(self, n: int) -> range:
        """Sizes that a linked set may have."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def subsets(self, n: int) -> int:
        """Keys that a set of n elements lists if it and all its partners are small."""
        return sum(comb(n, self.need(n, b)) for b in self.partners(n) if self.need(n, b) <= min(n, b))

    def of(self, n: int) -> tuple:
        """What small and large say of n, worked out once."""
        if n not in self.known:
            self.known[n] = (self.small(n), self.large(n))
        return self.known[n]

    def small(self, n: int) -> tuple:
        """((a, b, subset size), ...) of a set of n elements."""
        out = []
        for b in self.partners(n):
            lo, hi = min(n, b), max(n, b)
            if hi <= self.boundary and self.need(lo, hi) <= lo:
                out.append((lo, hi, self.need(lo, hi)))
        return tuple(out)

    def large(self, n: int) -> tuple:
        """((band, D, prefix, least), ...) of a set of n elements: none if all its partners and it are small."""
        top = self.den * n // self.num
        if top <= self.boundary:
            return ()
        out, low, band = [], -(-self.num * (self.boundary + 1) // self.den), 0
        while low <= top:
            high = max(low + 1, int(low * self.GROWTH))  # one past the band
            reach = self.den * (high - 1) // self.num  # the largest partner of the band's sets
            # a set is filed where it or a smaller partner is
            if n >= low and n <= reach:
                least = min(self.LEAST, self.overlap(low))  # one number for all sets of the band
                out.append((band, self.odd(2 * reach), n - self.overlap(n) + least, least))
            low, band = high, band + 1
        return tuple(out)


def keys(s, sizes: Sizes) -> list[tuple]:
    """(want, int64 keys), ...: the lists in which a set (sorted uint64 array) is filed, by pair sizes or band.

    The set can only have links there if `want` of the lists, at least, hold another set, and two linked sets share as many as the
    larger of their wants under some name, where that is not 0; want also names the band, in its upper bits.
    """
    import numpy as np

    n = len(s)
    out: list[tuple] = []
    if n == 0:
        return out
    small, large = sizes.of(n)
    if small:
        mixed = [int(x) for x in _mix(s)]
        for a, b, c in small:
            tag = sum(mixed) + (a * 1000 + b) * 0xD1B54A32D192ED03
            # subsets as what is left out of the whole
            sums = [(tag - sum(mixed[i] for i in gone)) & MASK for gone in combinations(range(n), n - c)]
            out.append((((a * 1000 + b) << 32) + 1, _mix(np.array(sums, np.uint64)).view(np.int64)))
    for band, odd, prefix, least in large:
        parts = sizes.parts(odd)
        spread = _mix(s + np.uint64(band + 1))
        part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        part = part.astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, spread)
        full = np.flatnonzero(np.bincount(part, minlength=parts))
        tag, name = 1_000_003 * (band + 1), (1 << 24) + 2 * band
        out.append(((name << 32) + max(0, len(full) - odd), _mix(sums[full] + full.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tag)).view(np.int64)))
        if len(full) - odd < 1:
            out.append((((name + 1) << 32) + least, _mix(s[:prefix] + np.uint64((tag * 0xA24BAED4963EE407) & MASK)).view(np.int64)))
    return out


def cheapest(sets: list, total: int, num: int, den: int, fetch: int = 40, most_keys: int = 400) -> int:
    """The boundary of least cost for `total` sets, of which these are a sample.

    The cost of a boundary is the keys that the sample files under it, plus `fetch` for each set that meets a
    different one in a list, as its text then has to be fetched and compared. Lists grow with the number of
    sets, so meetings in the sample are scaled to the whole. Sizes whose sets would list more than most_keys
    subsets are always large.
    """
    sets = list({s.tobytes(): s for s in sets if len(s)}.values())
    top = 0
    while Sizes(num, den).subsets(top + 1) <= most_keys:
        top += 1
    best = None
    for boundary in sorted({round(top * k / 5) for k in range(6)}):
        sizes = Sizes(num, den, boundary)
        filed, lists = 0, defaultdict(list)
        for i, s in enumerate(sets):
            if len(s) * num <= top * den:  # larger sets file the same under every boundary
                for want, held in keys(s, sizes):
                    filed += len(held)
                    for k in held.tolist():
                        lists[want >> 32, k].append(i)
        met = Counter(i for held in lists.values() if len(held) > 1 for i in held)
        cost = filed + fetch * sum(min(1.0, n * total / len(sets)) for n in met.values())
        if best is None or cost < best[0]:
            best = cost, boundary
    return best[1]


def _filed(n: int, num: int, den: int, boundary: int):
    """Arrow batches of (doc_id, k1, k2, data) to (doc_id, k1, k2, n_shingles, hashes of the set s1, s2, bands)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        sizes = Sizes(num, den, boundary)
        for batch in batches:
            size, s1, s2, lists = [], [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_py(), n)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                size.append(len(s))
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:], "little", signed=True))
                lists.append(keys(s, sizes))
            flat = [x for bands in lists for x in bands]
            ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            held = pa.ListArray.from_arrays(ends([len(k) for _, k in flat]), pa.array(np.concatenate([k for _, k in flat]) if flat else np.empty(0, np.int64)))
            bands = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.int64()), held], ["want", "keys"])
            longs = [pa.array(x, pa.int64()) for x in (size, s1, s2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *longs, pa.ListArray.from_arrays(ends([len(x) for x in lists]), bands)], ["doc_id", "k1", "k2", "n", "s1", "s2", "bands"])

    return run


class Links:
    """Union-find over positions, with the smallest as the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def join_block(sets: list, left: list[int], right: list[int] | None, num: int, den: int):
    """(i, j, linked) arrays of all links among sets[left], or between sets[left] and sets[right].

    Scans inverted lists: for each set the lists of its elements are walked, overlaps are counted, and the
    pairs whose overlap suffices for their sizes are links.
    """
    import numpy as np

    held = left if right is None else right
    held = sorted(held, key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in held])
    flat = np.concatenate([sets[i] for i in held])
    owner = np.repeat(np.arange(len(held)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    out_i, out_j = [], []
    names = np.array(held)
    for i in left:
        s = sets[i]
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        count = hi - lo
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)
        overlap = np.bincount(owner[at], minlength=len(held))
        linked = np.flatnonzero((overlap > 0) & (den * overlap >= num * (len(s) + sizes - overlap)))
        others = names[linked]
        others = others[others != i] if right is not None else others[others > i]
        out_i.append(np.full(len(others), i))
        out_j.append(others)
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _joined(n: int, num: int, den: int):
    """Arrow batches of (g, x, y, side, t, times, data), sorted by (g, x, y), to (a, b, links) per set: a spanning link and how many documents it links with.

    A task's block (g, x, y) holds the sets of chunks x and y of candidate group g; side tells which. With
    x = y all pairs of a chunk are joined, else all pairs between the two. Links are counted for both ends;
    by the other class's documents; of the links themselves only a spanning forest leaves the task.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def handle(key, rows: list) -> pa.RecordBatch:
            ids = [r[1] for r in rows]
            times = np.array([r[3] for r in rows], float)
            sets = [shingle_set(r[2], n) for r in rows]
            left = [i for i, r in enumerate(rows) if r[0] == 0]
            right = None if key[1] == key[2] else [i for i, r in enumerate(rows) if r[0] == 1]
            if right is not None and not (left and right):
                i = j = np.empty(0, np.int64)
            else:
                i, j = join_block(sets, left, right, num, den)
            size = np.bincount(i, times[j], len(rows)) + np.bincount(j, times[i], len(rows))
            links = Links(len(rows))
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                links.join(a, b)
            some = np.flatnonzero(size)
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in some], pa.int64()), pa.array([ids[links.root(int(k))] for k in some], pa.int64()), pa.array(np.rint(size[some]).astype(np.int64))], ["a", "b", "links"])

        now, rows = None, []
        for batch in batches:
            for g, x, y, side, t, times, data in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (g, x, y) != now:
                    if len(rows) > 1:
                        yield handle(now, rows)
                    now, rows = (g, x, y), []
                rows.append((side, t, data, times))
        if len(rows) > 1:
            yield handle(now, rows)

    return run


def row_keys(text: Column) -> list[Column]:
    """k1, k2: 128 bits that name a row by its doc_id and text; equal rows share them."""
    of = F.col("doc_id").cast("long")
    return [F.xxhash64(of, text).alias("k1"), F.xxhash64(F.lit(1), of, text).alias("k2")]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def filed(docs: DataFrame, n: int, num: int, den: int, sample_rows: int = 500) -> DataFrame:
    """(node, doc_id, k1, k2, n, s1, s2, bands), one row per row of docs, written out.

    node names a set: the row's doc_id, or a hash of the set where the doc_id is null or stands with several
    sets. The boundary between small and large sets is chosen on at most sample_rows short texts; it changes
    the cost and nothing else.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(F.col("text")), _text().alias("data"))
    # short texts have few shingles, and only such sets may count as small: at most sample_rows texts of 4 KB
    short = [bytes(r[0]) for r in rows.select("data").where(F.length("data") <= 4096).limit(sample_rows).collect()]
    boundary = cheapest([shingle_set(x, n) for x in short], docs.count() if short else 0, num, den)
    out = cut(rows.mapInArrow(_filed(n, num, den, boundary), "doc_id bigint, k1 bigint, k2 bigint, n bigint, s1 bigint, s2 bigint, bands array<struct<want: bigint, keys: array<bigint>>>"))
    several = shared_keys(out.where("doc_id is not null"), F.col("doc_id"), F.col("s1"))
    named = F.col("doc_id").isNotNull() & ~F.col("_lw_many")
    return with_shared(out, "doc_id", several, "_lw_many").withColumn("node", F.when(named, F.col("doc_id")).otherwise(F.xxhash64("s1", "s2"))).drop("_lw_many")


def closer(live: DataFrame, passes: int = 1, most: int = 64) -> DataFrame:
    """(a, b), written out: edges that connect whatever links among the nodes of live (node, want, key), and few strangers.

    Two linked nodes share, under one name, as many lists as the larger of their wants (see keys), strangers mostly one or two. Pairs are
    counted in the lists of `most` nodes at most. A node that is in fewer longer lists than it wants shows all its links there, as pairs
    that share max(wants) less min(longer lists) of the lists counted. Of the other nodes, large groups of near copies, each long list
    connects all with its least node; two of these that share no long list share max(wants) of those counted. So no
    link is lost at any `most`, and a list makes most / 2 pairs a node at most. Lists of the same nodes are counted as one.
    """
    rows = live.join(live.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").withColumn("long", F.col("m") > most).drop("m")
    far = rows.groupBy("node", "want").agg(F.sum(F.col("long").cast("long")).alias("far"))
    rows = cut(rows.join(cut(far), ["node", "want"]))
    need = lambda want: want.bitwiseAND(0xFFFFFFFF)
    deep = rows.where(F.col("long") & (F.col("far") >= need(F.col("want")))).select("key", "node", "want")
    heads = deep.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail"), F.max(need(F.col("want"))).alias("needed")).where("head <> tail and needed > 0").select("key", "head")
    edges = deep.join(cut(heads), "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    lists = rows.where(~F.col("long")).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("node", "want", "far"))).alias("l")).where("size(l) > 1")
    lists = cut(lists.groupBy("l").agg(F.count(F.lit(1)).alias("times")))
    pairs = lists.select("l", "times", F.explode("l").alias("x")).select("times", "x", F.explode(F.filter("l", lambda y: (y["node"] > F.col("x.node")) & (F.shiftright(y["want"], 32) == F.shiftright(F.col("x.want"), 32)))).alias("y"))
    both = (F.col("x.far") >= need(F.col("x.want"))) & (F.col("y.far") >= need(F.col("y.want")))
    least = F.greatest(need(F.col("x.want")), need(F.col("y.want"))) - F.when(both, 0).otherwise(F.least("x.far", "y.far"))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.shiftright("x.want", 32).alias("name"), least.alias("least"), "times").where("least > 0")
    for k in range(passes):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == k) if passes > 1 else pairs
        near = part.groupBy("a", "b", "name").agg(F.sum("times").alias("met"), F.max("least").alias("least")).where("met >= least")
        edges = edges.union(cut(near.select("a", "b").distinct()))
    return cut(edges)


def joined(docs: DataFrame, n: int, num: int, den: int, chunk: int = 3000, chunk_shingles: int = 4_000_000, passes: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, k1, k2 (see row_keys), n_shingles, group, component_id, n_links; see components.

    group names the component, and is null for a row whose set is empty.
    """
    with noted() as listed:
        rows = filed(docs, n, num, den)
    known = rows.where("n > 0")
    classes = known.groupBy("s1", "s2").agg(F.min(F.struct("node", "k1", "k2")).alias("one"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"))
    classes = cut(classes.select("s1", "s2", F.col("one.node").alias("rep"), "one.k1", "one.k2", "least", "n", "times"))
    live = None
    for k in range(passes):
        spread = known.select("node", F.explode("bands").alias("b")).select("node", "b.want", F.explode("b.keys").alias("key"))
        if passes > 1:
            spread = spread.where(F.pmod("key", F.lit(passes)) == k)
        shared = cut(spread.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head <> tail").select("key"))
        met = cut(spread.join(shared, "key"))
        live = met if live is None else live.union(met)
    rows = cut(rows.drop("bands"))  # the lists take about as much as the texts and are of no more use
    drop(docs.sparkSession, listed)
    for _ in range(2):  # what goes takes others with it; two rounds catch most
        enough = live.groupBy("node", "want").agg(F.count(F.lit(1)).alias("lists")).where("lists >= want & 4294967295").select("node", "want")
        live = live.join(cut(enough), ["node", "want"])
        heads = live.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head <> tail").select("key", "head")
        live = cut(live.drop("head").join(cut(heads), "key"))
    edges = live.select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()
    # copies of a class share all keys; one of each is enough to fetch
    reps = classes.select(F.col("rep").alias("node"), "k1", "k2", "n", "times")
    # a chunk holds about `chunk` sets and chunk_shingles shingles at most, whichever are reached first
    share = F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("n") / chunk_shingles))

    def grouped(edges: DataFrame) -> DataFrame:
        held = cut(connected_components(edges).withColumnRenamed("component", "g").join(reps, "node"))
        sizes = held.groupBy("g").agg(F.count(F.lit(1)).alias("held"), share.alias("chunks")).where("held > 1").select("g", "chunks")
        return cut(held.join(cut(sizes), "g").select("g", "node", "k1", "k2", "times", "chunks"))

    groups = grouped(edges)
    # a group of several chunks is mostly strangers that meet here and there, the more of them the larger the corpus; its texts would go to each pair of chunks
    if not groups.where("chunks > 1").isEmpty():
        inside = live.select("node", "want", "key").join(groups.where("chunks > 1").select("node"), "node", "left_semi")
        groups = groups.where("chunks = 1").union(grouped(closer(inside, passes)))
    # candidates grow with the corpus, so this join shuffles at every size
    texts = docs.select(*row_keys(F.col("text")), _text().alias("data"))
    fetched = texts.join(groups.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y"), (own > k).cast("int").alias("side")))
    dealt = fetched.select("g", "node", "times", "data", F.explode(others).alias("o")).select("g", "o.x", "o.y", "o.side", "node", "times", "data")
    links = dealt.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y").mapInArrow(_joined(n, num, den), "a bigint, b bigint, links bigint")
    links = cut(links)
    whole = connected_components(links.select("a", "b")).withColumnRenamed("node", "rep")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").cast("long").alias("others"))
    found = cut(classes.select("s1", "s2", "rep", "least", "times").join(counts, "rep", "left").join(whole, "rep", "left").where("times > 1 or component is not null"))
    low = found.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    verdict = found.join(cut(low), "component", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("group"), F.coalesce("lowest", "least").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = rows.select("node", "doc_id", "k1", "k2", "n", "s1", "s2").join(cut(verdict), ["s1", "s2"], "left")
    full = F.col("n") > 0
    return out.select(
        "doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(full, F.coalesce("group", "node")).alias("group"),
        F.when(full & F.col("group").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(full, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, chunk: int = 3000, chunk_shingles: int = 4_000_000, passes: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links.

    A document's set holds its distinct n-word shingles (A-Z lower-cased; words are runs of other than ASCII
    white space; with fewer words the whole sequence is one shingle). Two documents link when the Jaccard
    similarity of their sets is at least num / den; sets without elements link with nothing. Equal sets are
    one class and are joined once; n_links is how many other documents a document links with.

    1. Sets are filed under keys (class Sizes) such that linked classes share enough of them; keys met once end
       there, and so do sets that share fewer than any link would need.
       The keys are shuffled in `passes` parts of their range, one after the other, to bound the disk in use.
    2. Classes that share a key, directly or through others, make a candidate group; texts are fetched only
       for classes in groups of two or more, whose sets are joined exactly within tasks (join_block). A group
       is dealt to chunks of about `chunk` classes or chunk_shingles shingles, whichever is less, and each pair of chunks
       is one task's work, so that no task holds more than two chunks.
    3. A spanning forest of the links gives the components.

    Documents are rows: rows of one doc_id with different texts are told apart by their sets, each has its own
    links, and rows of equal text link with each other. Rows with a null doc_id take part; a component's id is
    the smallest doc_id in it that is not null, and null if there is none. Null text has no words: n_shingles 0, and such a row
    comes back with its own doc_id and no links, as does any empty set's. Equal rows give equal rows; an empty table gives none; only doc_id
    and text are read. The names of sets without a doc_id of their own are 64-bit hashes: two of a
    billion such sets meet by chance with a probability of 3 %.
    """
    return joined(docs, n, num, den, chunk, chunk_shingles, passes).select("doc_id", "n_shingles", "component_id", "n_links")
