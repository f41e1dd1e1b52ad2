"""Removal of repeated byte strings over the corpus with sorted suffixes (deep-shallow sorting)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_keys, with_shared

ANCHOR = 48  # bytes of an anchor
BITS = 24  # of a position within a chunk
CHUNK = 1 << 18  # bytes handled at once; the arrays over them fit into a core's cache
CONTEXT = "g bigint, t bigint, times bigint, a bigint, inner int, least int, most int, data binary"
OCCURRENCE = "h bigint, c bigint, t bigint, pos bigint"


def _packed(batches: Iterator) -> Iterator:
    """Compresses the last column of Arrow batches, texts that are to be shuffled."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        z = pa.array([pack(x.as_buffer()) for x in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], z], [*batch.schema.names[:-1], "z"])


def _contexts(length: int):
    """Arrow batches of (t, z, runs) to the runs' bytes, filed by what their starts share on either side.

    A run's starts are split at the middle of the possible distances d between start and anchor: strings with
    the larger d share a long piece left of the anchor, the others right of it. g names such a piece.
    """
    middle = (length - ANCHOR) // 2

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        import zstandard

        unpack, digest = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_64_intdigest
        names = [x.split()[0] for x in CONTEXT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

        def flush(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            out = []
            for t, z, runs in zip(*(batch.column(k) for k in range(3)), strict=True):
                t, data = t.as_py(), unpack(z.as_buffer())
                for r in runs.as_py():
                    low, wide, inner = r["pos"] >> 16, r["pos"] >> 8 & 255, r["pos"] & 255
                    part = data[low : low + wide + length]
                    for side, least, most in ((0, max(inner - wide, middle), inner), (1, inner - wide, min(inner, middle - 1))):
                        if least <= most:
                            piece = part[inner - middle : inner + ANCHOR] if side == 0 else part[inner : inner + length - middle + 1]
                            g = digest(piece, r["h"] * 2 + side & (1 << 64) - 1)
                            out.append((g - (1 << 64) if g >> 63 else g, t, r["times"], low + inner, inner, least, most, part))
                if len(out) >= 5000:
                    yield flush(out)
                    out = []
            yield flush(out)

    return run


# ---------------------------------------------------------------------------------------------- anchors


def anchor_runs(data, ends, length: int):
    """Runs of starts of length-byte strings that have the same anchor, as arrays (anchor, low, high, hash).

    data: uint8 array of several texts end to end, ends: where each ends. The anchor of a string is the
    ANCHOR-byte string inside it with the least hash, the leftmost of equals; it depends on the string alone,
    so equal strings have equal anchors at equal distances.
    """
    import numpy as np

    n, w = len(data), length - ANCHOR + 1
    if n < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << np.uint64(8 * k))
    m = n - ANCHOR + 1
    h = np.zeros(m, np.uint64)
    for j, odd in zip(range(0, ANCHOR, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB), strict=True):
        y = x[j : j + m] * np.uint64(odd)
        y ^= y >> np.uint64(32)
        h += y * np.uint64(odd ^ 0x5555555555555554)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    low = np.uint64((1 << BITS) - 1)
    v = (h & ~low) | np.arange(m, dtype=np.uint64)  # by hash, then from the left
    span = 1
    while 2 * span <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < w:
        v = np.minimum(v[: m - w + 1], v[w - span : m - span + 1])
    at = (v & low).astype(np.int64)  # by start
    good = np.ones(len(at), bool)
    for e in ends:
        good[max(0, e - length + 1) : e] = False  # would run into the next text
    first = np.flatnonzero(good & np.concatenate(([True], (at[1:] != at[:-1]) | ~good[:-1])))
    last = np.flatnonzero(good & np.concatenate(((at[1:] != at[:-1]) | ~good[1:], [True])))
    return at[first], first, last, h[at[first]]


def _occurrences(length: int):
    """Arrow batches of (t, text bytes) to runs: anchor hash h, content hash c, text t, and low, high, anchor in pos.

    A task takes each text once, however many copies it meets: a third of all rows may be one text.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        names = [x.split()[0] for x in OCCURRENCE.split(", ")]

        def handle(parts: list) -> pa.RecordBatch:
            raw = b"".join(p[1] for p in parts)
            data = np.frombuffer(raw, np.uint8)
            sizes = np.array([len(p[1]) for p in parts])
            ends = np.cumsum(sizes)
            a, lo, hi, h = anchor_runs(data, ends, length)
            of = np.searchsorted(ends, lo, side="right")
            shift = np.array([p[2] for p in parts], np.int64)[of] - (ends - sizes)[of]  # to the place in the text
            view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
            c = np.fromiter((digest(view[i:j]) for i, j in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.uint64, len(lo))
            pos = ((lo + shift) << 16) | ((hi - lo) << 8) | (a - lo)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(np.array([p[0] for p in parts], np.int64)[of]), pa.array(pos.astype(np.int64))], names)

        parts, total, seen = [], 0, set()
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if t in seen:
                    continue
                seen.add(t)  # one number per text of a split
                text = text.as_py()
                for first in range(0, max(1, len(text) - length + 1), CHUNK):
                    piece = text[first : first + CHUNK + length - 1]
                    if len(piece) >= length:
                        parts.append((t, piece, first))
                        total += len(piece)
                    if total >= CHUNK:
                        yield handle(parts)
                        parts, total = [], 0
        if parts:
            yield handle(parts)

    return run


# ------------------------------------------------------------------------------------------ suffix sorting


class Blind:
    """A blind trie: inner nodes hold only the position where their strings part; order and common prefixes
    come from one comparison of each new string with one leaf."""

    def __init__(self, strings: list[bytes]):
        self.s = strings
        self.size = max(map(len, strings))
        self.numbers = [int.from_bytes(x.ljust(self.size, b"\0"), "big") for x in strings]
        self.root: object = [0]
        for i in range(1, len(strings)):
            self.insert(i)

    def lcp(self, i: int, j: int) -> int:
        same = self.size - ((self.numbers[i] ^ self.numbers[j]).bit_length() + 7) // 8
        return min(same, len(self.s[i]), len(self.s[j]))

    def at(self, i: int, k: int) -> int:
        x = self.s[i]
        return x[k] if k < len(x) else -1

    def insert(self, i: int) -> None:
        node = self.root
        while type(node) is tuple:
            kids = node[1]
            node = kids.get(self.at(i, node[0])) or next(iter(kids.values()))
        j = node[0]
        same = self.lcp(i, j)
        above, key, node = None, None, self.root
        while type(node) is tuple and node[0] < same:
            above, key = node, self.at(i, node[0])
            node = node[1][key]
        own = self.at(i, same)
        if own == -1 and self.at(j, same) == -1:
            (node if type(node) is list else node[1][-1]).append(i)  # equal strings
        elif type(node) is tuple and node[0] == same:
            node[1][own] = [i]
        else:
            new = (same, {self.at(j, same): node, own: [i]})
            if above is None:
                self.root = new
            else:
                above[1][key] = new

    def walk(self) -> list[tuple[int, int]]:
        """(string, common prefix with the one before; -1 first) in order."""
        out: list[tuple[int, int]] = []
        stack: list[tuple[object, int]] = [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if type(node) is list:
                for k, i in enumerate(node):
                    out.append((i, before if k == 0 else len(self.s[i])))
            else:
                kids = sorted(node[1])
                for k in range(len(kids) - 1, -1, -1):
                    stack.append((node[1][kids[k]], node[0] if k else before))
        return out


def deep_shallow(strings: list[bytes], shallow: int = 24, step: int = 8) -> list[tuple[int, int]]:
    """(string, common prefix with the one before; -1 first) in order of strings.

    Multikey quicksort by step bytes at a time to the shallow depth; groups that are still together there are
    ordered by blind tries.
    """
    out: list[tuple[int, int]] = []
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, -1)]  # group, depth, prefix with what stands before
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            out.append((group[0], before))
            continue
        if depth >= shallow:
            trie = Blind([strings[i] for i in group])
            for k, (i, same) in enumerate(trie.walk()):
                out.append((group[i], same if k else before))
            continue
        keys = {i: strings[i][depth : depth + step] for i in group}
        pivot = keys[group[len(group) // 2]]
        less = [i for i in group if keys[i] < pivot]
        same = [i for i in group if keys[i] == pivot]
        more = [i for i in group if keys[i] > pivot]
        # common prefixes across the cuts are set by looking at the neighbours, once these are known
        for part, deeper in ((more, depth), (same, depth + step if len(pivot) == step else shallow), (less, depth)):
            if part:
                stack.append((part, deeper, -2 if part is not group else before))
    last = None
    for k, (i, same) in enumerate(out):
        if same == -2:
            out[k] = (i, _lcp(strings[last], strings[i]) if last is not None else -1)
        last = i
    return out


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def repeated_starts(groups: list[list[tuple[bytes, int, int, int]]], length: int):
    """For groups of (bytes, anchor in them, least d, most d): a boolean array [item, d] of the starts d bytes
    before the anchor whose length-byte string occurs in another item of the group too.

    Such a string is the d bytes before the anchor and length - d from it on. The suffixes that start at the
    anchors are sorted, and so are the reversed prefixes that end there; strings that agree on length - d
    bytes to the right are neighbours in the first order with common prefixes of at least that, likewise for
    d bytes to the left in the second order.
    """
    import numpy as np

    items = [x for g in groups for x in g]
    n = len(items)
    orders, shared = [], []
    for side in (0, 1):
        order, lcp, base = [], [], 0
        for g in groups:
            strings = [b[a:] if side else b[:a][::-1] for b, a, _, _ in g]
            for i, same in deep_shallow(strings):
                order.append(base + i)
                lcp.append(same)
            base += len(g)
        orders.append(np.array(order))
        shared.append(np.array(lcp))
    least, most = (np.array([x[k] for x in items]) for k in (2, 3))
    out = np.zeros((n, length), bool)
    name = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for d in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= d) & (d <= most))
        if len(rows) < 2:
            continue
        for side, need in ((0, d), (1, length - d)):
            name[side][orders[side]] = np.cumsum(shared[side] < need)
        key = name[0][rows] * (n + 1) + name[1][rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(rows), bool)
        hit[by[1:]] = same
        hit[by[:-1]] |= same
        out[rows[hit], d] = True
    return out


def _sort_groups(length: int, batch_items: int = 20_000):
    """Arrow batches of (g, t, low, anchor, least, most, bytes), sorted by g, to (t, first, last) of repeated starts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def handle(groups: list) -> pa.RecordBatch:
            flat = [x for g in groups for x in g]
            hits = repeated_starts([[x[2:] for x in g] for g in groups], length)
            edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            item, d0 = np.nonzero(edge == 1)
            _, d1 = np.nonzero(edge == -1)  # one past the last
            t = np.array([x[0] for x in flat], np.int64)[item]
            a = np.array([x[1] for x in flat], np.int64)[item]
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(a - (d1 - 1)), pa.array(a - d0)], ["t", "first", "last"])

        groups, now, group, count = [], None, [], 0
        for batch in batches:
            for g, t, a, inner, least, most, data in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if g != now:
                    if len(group) > 1:
                        groups.append(group)
                        count += len(group)
                    if count >= batch_items:
                        yield handle(groups)
                        groups, count = [], 0
                    now, group = g, []
                group.append((t, a, data, inner, least, most))
        if len(group) > 1:
            groups.append(group)
        if groups:
            yield handle(groups)

    return run


# -------------------------------------------------------------------------------------------- the operator


def repeated(texts: DataFrame, length: int = 200, heavy: int = 1000) -> DataFrame:
    """(t, first, last): ranges of starts in text t whose length-byte string also starts elsewhere.

    texts: (t, data) with t the name of the bytes; equal texts may occur any number of times.

    0. All starts of a text that occurs more than once are repeated.
    1. Every start is filed under its string's anchor; consecutive starts with one anchor form a run, about
       one in 75 starts. Runs are hashed whole. Equal runs are counted: all their starts are repeated.
    2. Anchors met once end there. For the others, one run of each content is cut out of its text and filed
       again under a longer piece that its strings share (_contexts).
    3. Groups of two or more are sorted by anchor suffixes and reversed prefixes (repeated_starts), each in
       one task. Groups of over `heavy` runs are spread over all tasks instead: each start's string is
       fingerprinted with 128 bits and counted, with partial sums before the shuffle.
    """
    copied = texts.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("data")).alias("size")).where("n > 1")
    copied = copied.select("t", F.lit(0).cast("long").alias("first"), (F.col("size") - length).cast("long").alias("last"))
    runs = texts.mapInArrow(_occurrences(length), OCCURRENCE)
    anchors = cut(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    runs = cut(runs.join(anchors, "h"))
    contents = cut(runs.groupBy("h", "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("t", "pos")).alias("one")))
    low, wide, inner = (F.shiftright("pos", 16), F.shiftright("pos", 8).bitwiseAND(255), F.col("pos").bitwiseAND(255))
    whole = runs.join(contents.where("times > 1").select("h", "c"), ["h", "c"]).select("t", low.alias("first"), (low + wide).alias("last"))

    several = cut(contents.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h"))
    single = contents.join(several, "h").select("h", "times", F.col("one.t").alias("t"), F.col("one.pos").alias("pos"))
    wanted = cut(single.groupBy("t").agg(F.collect_list(F.struct("h", "pos", "times")).alias("runs")))
    cutout = texts.select("t", "data").mapInArrow(_packed, "t bigint, z binary").dropDuplicates(["t"]).join(wanted, "t").select("t", "z", "runs")
    sides = cut(cutout.mapInArrow(_contexts(length), CONTEXT))
    sizes = cut(sides.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("times").alias("fewest")).where("size > 1 and fewest = 1").select("g", "size"))
    filed = sides.join(sizes, "g")
    small = filed.where(F.col("size") <= heavy).select("g", "t", "a", "inner", "least", "most", "data")
    small = small.repartition("g").sortWithinPartitions("g").mapInArrow(_sort_groups(length), "t bigint, first bigint, last bigint")
    large = filed.where(F.col("size") > heavy).select("t", "a", "inner", "data", F.explode(F.sequence("least", "most")).alias("d"))
    string = F.expr(f"substring(data, inner - d + 1, {length})")
    large = large.select("t", (F.col("a") - F.col("d")).alias("p"), F.xxhash64(string).alias("x"), F.xxhash64(F.lit(1), string).alias("y"))
    twice = cut(large.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y"))
    spread = large.join(twice, ["x", "y"]).select("t", F.col("p").alias("first"), F.col("p").alias("last"))
    return copied.union(whole).union(small).union(spread)


def _spans(length: int):
    """Arrow batches of (t, first, last), sorted by the first two, to (t, removed spans as (first, end) in order).

    Ranges of starts are merged as they come, so a text's array has at most a span for every length + 1 bytes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        now, spans, names, held = None, [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([[{"first": a, "end": b} for a, b in x] for x in held], kind)], ["t", "spans"])
            names.clear()
            held.clear()
            return out

        for batch in batches:
            for t, first, last in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if t != now:
                    if spans:
                        names.append(now)
                        held.append(spans)
                    now, spans = t, []
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last + length)
                else:
                    spans.append([first, last + length])
            if len(names) >= 2000:
                yield flush()
        if spans:
            names.append(now)
            held.append(spans)
        yield flush()

    return run


def remove_repeats(docs: DataFrame, length: int = 200, heavy: int = 1000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Removed is each byte covered by a length-byte string that also starts anywhere else in any row's text, the
    same one included; matches never cross rows. Equal rows repeat each other. Null text counts as empty; an
    empty table gives no rows; only doc_id and text are read.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", data.alias("data"))
    # a text's name is a 64-bit hash, and another one where that stands for several texts: 128 bits tell these apart
    one, two = F.xxhash64("data"), F.xxhash64(F.lit(1), "data")
    rows = with_shared(rows.withColumn("t", one), "t", shared_keys(rows, one, two), "_lw_many")
    rows = rows.select("doc_id", "data", F.when(F.col("_lw_many"), F.xxhash64("t", two)).otherwise(F.col("t")).alias("t"))
    ranges = repeated(rows.where(F.length("data") >= length).select("t", "data"), length, heavy).distinct()
    spans = cut(ranges.repartition("t").sortWithinPartitions("t", "first").mapInArrow(_spans(length), "t bigint, spans array<struct<first: bigint, end: bigint>>"))

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for spans, data in zip(batch.column(1).to_pylist(), map(unpack, batch.column(2).to_pylist()), strict=True):
                kept, end = [], 0
                for x in spans or ():
                    kept.append(data[end : x["first"]])
                    end = x["end"]
                kept.append(data[end:])
                rest = b"".join(kept)
                out.append((len(data), len(data) - len(rest), len(spans or ()), rest))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    both = rows.select("doc_id", "t", "data").mapInArrow(_packed, f"doc_id {kind}, t bigint, z binary").join(spans, "t", "left").select("doc_id", "spans", "z")
    return both.mapInArrow(apply, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
