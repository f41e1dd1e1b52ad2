"""Word sequences that occur more than once, by relative Lempel-Ziv parsing against reference blocks.

A window is `length` consecutive words of one text; a window whose sequence starts anywhere else is repeated.

* Every window is filed under its seed, the SEED consecutive words of it with the smallest hash: equal windows have equal
  seeds. A seed that occurs just once cannot stand for a repeated window. A seed that occurs more often belongs
  to one text, its owner: the smallest name of a text that has it.
* A text's windows with one owner, next to each other, form a fragment. All fragments of an owner's seeds meet in
  its block: the owner's own ones are the block's reference, indexed by a suffix array, the others are parsed
  against it. The parse is greedy: from each place the longest match anywhere in the reference, then on behind it.
* A factor of `length` words or more is a duplicate span, in the reference as well. Windows that cross a factor's
  boundary cannot be inside a long factor; each of them is looked up in the reference by its hash and verified.
* What the reference does not hold can still stand in two other texts: such windows are counted by 128-bit
  fingerprints over all blocks.

So a window is compared with one reference, not with all texts that share its seed: work grows with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut_only
from .common import cut, shared_keys, small_batches, with_shared

#: Words of a seed.
SEED = 12
#: Words of a piece of a fragment; followers of over SALT words in a block are dealt to several copies of it.
PIECE = 1024
SALT = 500_000
#: Bytes of a text that are cut into words at once, and windows whose seeds are sought at once.
STRETCH, STEP = 1 << 18, 10_000
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Multipliers of the rolling hashes, odd; values that stand between fragments and are nobody's hash in practice.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BREAK_REFERENCE, BREAK_FOLLOWER = 0x5851F42D4C957F2D, 0x14057B7EF767814F


class Words(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes):
        """The hashes of a text's words; bytes.split cuts at just the six characters of ASCII white space."""
        import numpy as np

        parts, at = [], 0
        while at < len(text):  # long texts piece by piece, or their words would all stand as objects at once
            end = at + STRETCH
            gap = SPACE.search(text, end) if end < len(text) else None
            end = gap.start() if gap else len(text)
            words = text[at:end].split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.array([], np.uint64)


class Rolling:
    """Hashes of all runs of k words: polynomials modulo 2**64, mixed."""

    def __init__(self):
        self.size = 0

    def _grow(self, n: int) -> None:
        import numpy as np

        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            self.up, self.down = [], []
            for base in BASES:
                for held, value in ((self.up, base), (self.down, pow(base, -1, 1 << 64))):
                    powers = np.full(self.size, value, np.uint64)
                    powers[0] = 1
                    held.append(np.cumprod(powers))

    def of(self, words, k: int, which: int = 0):
        import numpy as np

        n = len(words)
        if n < k:
            return np.array([], np.uint64)
        self._grow(n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.up[which][:n])))
        h = (sums[k:] - sums[:-k]) * self.down[which][: n - k + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def seeds(words, length: int, rolling: Rolling):
    """For every window of words, the place of its seed and the seed's hash."""
    import numpy as np

    width = length - SEED + 1
    places, hashes = [], []
    for k in range(0, len(words) - length + 1, STEP):  # the search copies what it looks at
        h = rolling.of(words[k : k + STEP + length - 1], SEED)
        views = np.lib.stride_tricks.sliding_window_view(h, width)
        at = views.argmin(1) + np.arange(len(views))
        places.append(at + k)
        hashes.append(h[at])
    return np.concatenate(places), np.concatenate(hashes)


class Reference:
    """A block's reference words with a suffix array."""

    def __init__(self, words, starts, length: int, rolling: Rolling):
        """starts: where windows start, so that none crosses from fragment to fragment."""
        import numpy as np

        self.words, self.length = words, length
        self.names, ids = np.unique(words, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        self.order = self._suffixes(ids)
        self.bits = int(len(self.names) + 1).bit_length()
        self.width = max(1, min(length, 63 // self.bits))
        self.keys = self._keys(ids)[self.order]
        h = rolling.of(words, length)[starts]
        by = np.argsort(h, kind="stable")
        self.hashes, self.places = h[by], starts[by]

    @staticmethod
    def _suffixes(ids):
        """Suffix array by doubling: suffixes are ordered by k words, then 2k, until all differ."""
        import numpy as np

        n, rank, k = len(ids), ids, 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - k] = rank[k:]
            order = np.lexsort((second, rank))
            differs = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([1], 1 + np.cumsum(differs)))
            k *= 2
            if k >= n or differs.all():
                return order

    def _keys(self, ids):
        """The first `width` words of every suffix as one integer, in the order of suffixes; 0 stands beyond the end."""
        import numpy as np

        out = np.zeros(len(ids), np.int64)
        padded = np.concatenate((ids, np.zeros(self.width, np.int64)))
        for j in range(self.width):
            out = (out << self.bits) | padded[j : j + len(ids)]
        return out

    def same(self, words, i: int, r: int) -> int:
        """Common words from i in words and r in the reference."""
        most, m, step = min(len(words) - i, len(self.words) - r), 0, 64
        while m < most:
            differs = words[i + m : i + min(m + step, most)] != self.words[r + m : r + min(m + step, most)]
            k = int(differs.argmax())
            if differs[k]:
                return m + k
            m, step = m + len(differs), step * 2
        return most

    def longest(self, words, i: int, low: int, high: int) -> tuple[int, int]:
        """(words, place) of the longest match from i among the suffixes low..high - 1, by bisection."""
        best = (0, 0)
        while low < high:
            mid = (low + high) // 2
            r = int(self.order[mid])
            m = self.same(words, i, r)
            best = max(best, (m, r))
            if i + m >= len(words):
                break
            if r + m >= len(self.words) or self.words[r + m] < words[i + m]:  # names are ordered by hash, and so are suffixes
                low = mid + 1
            else:
                high = mid
        return best

    def parse(self, words) -> list[tuple[int, int, int]]:
        """Greedy factors (start, words, place in the reference); what has no match of `width` words is passed over."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.names, words), len(self.names) - 1)
        known = self.names[at] == words
        keys = self._keys(np.where(known, at + 1, 0))
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        run = np.concatenate(([0], np.cumsum(known)))
        whole = np.zeros(len(words), bool)
        if len(words) >= self.width:
            whole[: len(words) - self.width + 1] = run[self.width :] - run[: -self.width] == self.width
        places = np.flatnonzero(whole & (high > low))
        out, i, k = [], 0, 0
        while k < len(places):
            i = int(places[k])
            m, r = self.longest(words, i, int(low[i]), int(high[i]))
            out.append((i, m, r))
            k = int(np.searchsorted(places, i + m)) if m > 1 else k + 1
        return out

    def look_up(self, words, starts, hashes):
        """Which of the windows at starts stand in the reference, and one place of each that does."""
        import numpy as np

        if not len(self.hashes) or not len(starts):
            return np.zeros(len(starts), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        i, r, step = starts[found], self.places[at[found]], np.arange(self.length)
        sure = (words[i[:, None] + step] == self.words[r[:, None] + step]).all(1)
        found[np.flatnonzero(found)[~sure]] = False
        return found, r[sure]

    def own_repeats(self):
        """Starts in the reference whose window starts elsewhere in it too."""
        import numpy as np

        near = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        step = np.arange(self.length)
        sure = near[(self.words[self.places[near][:, None] + step] == self.words[self.places[near + 1][:, None] + step]).all(1)]
        return np.concatenate((self.places[sure], self.places[sure + 1]))


FRAGMENT = "owner bigint, t bigint, start bigint, n int, words binary"
FOUND = "t bigint, first bigint, last bigint, x bigint, y bigint"


def _packed(batches: Iterator) -> Iterator:
    """Arrow batches of (..., text as bytes) with the last column compressed, for the way through a shuffle."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([pack(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*batch.schema.names[:-1], "z"])


def _text_seeds(length: int):
    """Arrow batches of (t, text as bytes) to (h, t, twice): the text's seeds, once each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def told(held: list) -> pa.RecordBatch:
            hs, ts, twice = ([x[k] for x in held] for k in range(3))
            sizes = [len(h) for h in hs]
            flat = lambda x, kind: np.concatenate(x) if x else np.array([], kind)
            return pa.RecordBatch.from_arrays([pa.array(flat(hs, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ts, np.int64), sizes)), pa.array(flat(twice, bool))], ["h", "t", "twice"])

        names, rolling = Words(), Rolling()
        for batch in batches:
            held, size = [], 0
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = names.of(text.as_py())
                if len(words) < length:
                    continue
                at, h = seeds(words, length, rolling)
                own, times = np.unique(h[np.concatenate(([True], at[1:] != at[:-1]))], return_counts=True)
                held.append((own, t, times > 1))
                size += len(own)
                if size >= 50_000:
                    yield told(held)
                    held, size = [], 0
            yield told(held)

    return run


def _fragments(length: int):
    """Arrow batches of (t, z, seeds of (h, owner)) to fragments, in pieces of PIECE windows at most."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        names, rolling, unpack = Words(), Rolling(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            held, size = [], 0
            wanted = batch.column(2)
            ends = wanted.offsets.to_numpy()
            hs, owners = (wanted.values.field(k).to_numpy() for k in ("h", "owner"))
            for row, (t, z) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                words = names.of(unpack(z.as_py()))
                _, h = seeds(words, length, rolling)
                mine = slice(ends[row], ends[row + 1])
                by = np.argsort(hs[mine])
                known, of = hs[mine][by], owners[mine][by]
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                shared = known[at] == h
                owner = np.where(shared, of[at], 0)
                edge = np.flatnonzero((np.diff(owner) != 0) | (np.diff(shared.astype(np.int8)) != 0)) + 1
                for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(h)])), strict=True):
                    if shared[a]:
                        for s in range(int(a), int(b), PIECE):
                            e = min(s + PIECE, int(b))
                            held.append((int(owner[a]), t, s, e - s, words[s : e + length - 1].tobytes()))
                            size += e - s + length
                if size >= 100_000:
                    yield _batch(held)
                    held, size = [], 0
            yield _batch(held)

    def _batch(held: list):
        import pyarrow as pa

        columns = list(zip(*held, strict=True)) if held else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["owner", "t", "start", "n", "words"])

    return run


def joined(pieces: list, gap: int):
    """(words, starts, piece of each start, first start of each piece) of arrays of words put end to end, gap between them."""
    import numpy as np

    parts, starts, of, first, at = [], [], [], [], 0
    for k, (words, n) in enumerate(pieces):
        parts += [words, np.array([gap], np.uint64)]
        starts.append(np.arange(at, at + n))
        of.append(np.full(n, k))
        first.append(at)
        at += len(words) + 1
    return np.concatenate(parts), np.concatenate(starts), np.concatenate(of), np.array(first)


def ranges(at):
    """(first, last) of the runs of neighbours in sorted numbers."""
    import numpy as np

    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    return at[np.concatenate(([0], cuts))], at[np.concatenate((cuts, [len(at)])) - 1]


def parsed(reference: Reference, words, starts, rolling: Rolling, length: int):
    """(whether each window of followers at starts stands in the reference, places in the reference that were met)."""
    import numpy as np

    hit = np.zeros(len(words), bool)
    met = []
    for i, m, r in reference.parse(words):
        if m >= length:
            hit[i : i + m - length + 1] = True
            met.append(np.arange(r, r + m - length + 1))
    rest = starts[~hit[starts]]  # windows across factor boundaries, and beside all factors
    found, places = reference.look_up(words, rest, rolling.of(words, length)[rest])
    hit[rest[found]] = True
    return hit[starts], np.concatenate([places, *met]) if met else places


def _blocks(length: int, batch_words: int = 30_000):
    """Arrow batches of (owner, salt, t, start, n, words), sorted by these with the owner's own rows first in each block, to
    (t, first, last, x, y): ranges of repeated starts, with null x and y, and fingerprints of what the reference does not hold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rolling = Rolling()
        out: list = []
        state = {"block": None, "reference": None}
        own: list = []
        others: list = []
        met: list = []

        def emit(t, first, last, x=None, y=None) -> None:
            n = len(first)
            blank = pa.nulls(n, pa.int64())
            out.append(pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), blank if x is None else pa.array(x.view(np.int64)), blank if y is None else pa.array(y.view(np.int64))], ["t", "first", "last", "x", "y"]))

        def told(pieces: list, of, first, at, which) -> None:
            """Ranges of the starts at[which] by text."""
            names, base = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
            k = of[which]
            place = base[k] + at[which] - first[k]
            cuts = np.flatnonzero((np.diff(place) != 1) | (np.diff(names[k]) != 0)) + 1
            low, high = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(place)])) - 1
            emit(names[k][low], place[low], place[high])

        def open_reference() -> None:
            words, starts, of, first = joined([p[2:] for p in own], BREAK_REFERENCE)
            state["reference"] = Reference(words, starts, length, rolling)
            state["starts"], state["of"], state["first"] = starts, of, first
            if state["block"][1] == 0:
                met.append(state["reference"].own_repeats())

        def follow() -> None:
            if not others:
                return
            if state["reference"] is None:
                open_reference()
            words, starts, of, first = joined([p[2:] for p in others], BREAK_FOLLOWER)
            hit, places = parsed(state["reference"], words, starts, rolling, length)
            met.append(places)
            if hit.any():
                told(others, of, first, starts, np.flatnonzero(hit))
            left = np.flatnonzero(~hit)
            if len(left):
                k = of[left]
                place = np.array([p[1] for p in others])[k] + starts[left] - first[k]
                emit(np.array([p[0] for p in others])[k], place, place, rolling.of(words, length, 0)[starts[left]], rolling.of(words, length, 1)[starts[left]])
            others.clear()

        def close() -> None:
            if own and state["reference"] is None:
                open_reference()
            follow()
            if met:
                places = np.unique(np.concatenate(met))
                places = places[np.isin(places, state["starts"], assume_unique=True)]
                if len(places):
                    told(own, state["of"], state["first"], state["starts"], np.searchsorted(state["starts"], places))
            own.clear()
            met.clear()
            state["reference"] = None

        size = 0
        for batch in batches:
            for owner, salt, t, start, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if (owner, salt) != state["block"]:
                    close()
                    state["block"], size = (owner, salt), 0
                piece = (t, start, np.frombuffer(data.as_buffer(), np.uint64), n)
                if t == owner:
                    own.append(piece)
                else:
                    others.append(piece)
                    size += n
                    if size >= batch_words:
                        follow()
                        size = 0
                if len(out) >= 16:
                    yield from out
                    out.clear()
        close()
        yield from out

    return run


def repeated(texts: DataFrame, length: int = 35) -> DataFrame:
    """(t, first, last): ranges of starts in text t whose window of `length` words also starts elsewhere.

    texts: (t, data) with t the name of the bytes; equal texts may occur any number of times, and all their
    windows are repeated: their last start is given as the greatest integer.
    """
    copied = texts.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = copied.select("t", F.lit(0).cast("bigint").alias("first"), F.lit(2**62).cast("bigint").alias("last"))

    def sought() -> DataFrame:
        filed = cut(texts.select("t", "data").mapInArrow(_text_seeds(length), "h bigint, t bigint, twice boolean"))
        ends = filed.groupBy("h").agg(F.min("t").alias("owner"), F.max("t").alias("other"), F.max("twice").alias("twice"))
        shared = cut(ends.where("owner < other or twice").select("h", "owner"))
        return filed.select("h", "t").join(shared, "h").groupBy("t").agg(F.collect_set(F.struct("h", "owner")).alias("seeds"))  # a text's seeds

    def fragments() -> DataFrame:
        wanted = cut_only(spark, sought)  # before the texts are shuffled, so that the seeds' files are gone by then
        once = texts.select("t", "data").mapInArrow(_packed, "t bigint, z binary").dropDuplicates(["t"])
        return once.join(wanted, "t").select("t", "z", "seeds").mapInArrow(_fragments(length), FRAGMENT)

    spark = texts.sparkSession
    pieces = cut_only(spark, fragments)
    load = pieces.where("t <> owner").groupBy("owner").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * SALT)
    copies = cut(load.select("owner", F.ceil(F.col("n") / SALT).cast("int").alias("copies")))
    dealt = pieces.join(copies, "owner", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    one = F.pmod(F.xxhash64("t", "start"), F.col("copies")).cast("int")
    salts = F.when(F.col("t") == F.col("owner"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(one))
    blocks = dealt.withColumn("salt", F.explode(salts)).select("owner", "salt", "t", "start", "n", "words", (F.col("t") != F.col("owner")).alias("follows"))
    blocks = blocks.repartition("owner", "salt").sortWithinPartitions("owner", "salt", "follows", "t", "start").drop("follows")
    found = cut(blocks.mapInArrow(_blocks(length), FOUND))
    left = found.where("x is not null")
    twice = cut(left.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y"))
    spread = left.join(twice, ["x", "y"]).select("t", "first", "last")
    return copied.union(found.where("x is null").select("t", "first", "last")).union(spread)


def _spans(length: int):
    """Arrow batches of (t, first, last), sorted by the first two, to (t, removed spans as (first, end) in order)."""

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


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the remaining words, one space between them).

    Removed is each word covered by a window of `length` words that also starts anywhere else in any row's text, the same one
    included; windows never cross rows and are judged on the input. Words are what stands between ASCII white
    space, unchanged. Equal rows repeat each other. Null text has no words; an empty table gives no rows; only
    doc_id and text are read; doc_id may be null or repeated.
    """
    if length < SEED:
        raise ValueError(f"windows have {SEED} words at least")
    small_batches(docs.sparkSession)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", data.alias("data"))
    one, two = F.xxhash64("data"), F.xxhash64(F.lit(1), "data")
    rows = with_shared(rows.withColumn("t", one), "t", shared_keys(rows, one, two), "_lw_many")
    rows = rows.select("doc_id", "data", F.when(F.col("_lw_many"), F.xxhash64("t", two)).otherwise(F.col("t")).alias("t"))

    def merged() -> DataFrame:
        found = repeated(rows.where(F.length("data") >= 2 * length - 1).select("t", "data"), length).distinct()
        return found.repartition("t").sortWithinPartitions("t", "first").mapInArrow(_spans(length), "t bigint, spans array<struct<first: bigint, end: bigint>>")

    spans = cut_only(docs.sparkSession, merged)

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for spans, z in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = unpack(z.as_py()).split()
                kept, end = [], 0
                for x in (spans or ()) if len(words) >= length else ():
                    kept += words[end : x["first"]]
                    end = x["end"]
                kept += words[end:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_words", "n_removed", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    both = rows.select("doc_id", "t", "data").mapInArrow(_packed, f"doc_id {kind}, t bigint, z binary").join(spans, "t", "left").select("doc_id", "spans", "z")
    return both.mapInArrow(apply, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")
