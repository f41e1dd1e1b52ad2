"""Line dedup over the corpus by a deletion-neighbourhood join on words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, shared_keys, with_shared

RANGE = 1 << 40


def _place() -> Column:
    """Where a line stands; the order of places is which line is earlier. Null doc_ids come first."""
    return F.struct("doc_id", "tie", F.col("at").cast("int").alias("at"))


def _plain(line: Column) -> Column:
    """A line's words with one space between them; most lines are so already, which plain searches tell."""
    odd = line.startswith(" ") | line.endswith(" ")
    for space in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " "))).otherwise(line)


def _size(plain: Column) -> Column:
    """Words of a plain line."""
    return F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1


def _cut_length(n: Column) -> Column:
    """The largest of 2, 3, 4, 6, 8, 12, ... that is at most half of n (n >= 4)."""
    power = F.pow(F.lit(2), F.floor(F.log2(F.floor(n / 2) + 0.5))).cast("int")
    return F.when(3 * power <= n, power + F.shiftright(power, 1)).otherwise(power)


def _hashes(line: str) -> list[Column]:
    """h, g: 128 bits that name a plain line."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")]


def _rows(docs: DataFrame) -> DataFrame:
    """docs with tie: 0, or a hash of the text where rows of one doc_id have different texts."""
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    held = with_shared(docs, "doc_id", shared_keys(docs, F.col("doc_id"), own), "_lw_many")
    return held.withColumn("_lw_tie", F.when(F.col("_lw_many"), own).otherwise(F.lit(0).cast("long"))).drop("_lw_many")


def _lines(rows: DataFrame, least: int) -> DataFrame:
    """place (doc_id, tie, line number from 0), two hashes of the words, and two to four segment keys of a line.

    If two lines differ by one word, they agree on all words before the middle or on all after it. A key holds
    the first or last words of a line, in number at most half of the longer line's (_cut_length); where that
    number changes from n - 1 to n, a line of n words has the keys for n - 1, too. So two near lines share one.
    """
    # lines are made plain below the explode, whose output is evaluated once
    rows = rows.select("doc_id", F.col("_lw_tie").alias("tie"), F.posexplode(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), _plain)).alias("at", "s")).where("s <> ''")
    rows = rows.select("doc_id", "tie", "at", "s", _size(F.col("s")).alias("n"))
    rows = rows.withColumns({"long": _cut_length(F.col("n")), "short": _cut_length(F.col("n") - 1)})
    ends = lambda k: [F.xxhash64(F.lit(0), F.call_function("substring_index", F.col("s"), F.lit(" "), k)), F.xxhash64(F.lit(1), F.call_function("substring_index", F.col("s"), F.lit(" "), -k))]
    keys = F.when(F.col("long") == F.col("short"), F.array(*ends(F.col("long")))).otherwise(F.array(*ends(F.col("long")), *ends(F.col("short"))))
    return rows.select("doc_id", "tie", "at", *_hashes("s"), F.when(F.col("n") >= least, keys).alias("keys"))


def _but_one(s: Column, n: Column, segments: int = 8) -> Column:
    """Keys of a plain line of n words without one of its segments; two near lines share one of them.

    A line of n words is cut against lines of up to n words and against those of n + 1: the segments before the
    one with the edit agree from the front, those after it from the back.
    """

    def key(i: Column) -> Column:
        size, k = n + F.floor(i / segments).cast("int"), i % segments
        end = lambda k: F.floor(size * k / segments).cast("int")
        front, back = (F.call_function("substring_index", s, F.lit(" "), x) for x in (end(k), end(k + 1) - size))
        return F.xxhash64(k, size, front, back)

    # an array function, not an expression per key: generated code stays small
    return F.transform(F.sequence(F.lit(0), F.lit(2 * segments - 1)), key)


def near_pairs(rows: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    """Distinct lines (h, g) that have a line one word edit away whose first place is earlier.

    rows: see _rows; lines: one row per distinct line with its first place. Only lines that share a segment key with another
    line are looked up in their texts, and only those that agree with another but for an eighth of their words
    take part in the deletion-neighbourhood join: for each of their words, the line with that word
    replaced by a gap, and the line without it. Hashes of words by position are summed, so all variants of a
    line come from running sums, in time linear in its words. Lines with the same gapped variant are one
    replacement apart; a line and the lines that lose one word to become it are one insertion apart. Either
    group needs just its earliest line compared with the others, so no pairs within a group are listed. The
    pairs found are verified word by word.
    """
    spread = lines.where("keys is not null").select("h", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    # written out, so that the join below has two plain shuffles, whose hot keys Spark can split
    some = spread.join(cut(shared.select("key")), "key", "left_semi").select("h").distinct()
    some = lines.join(some, "h", "left_semi")
    wanted = some.groupBy(F.col("first.doc_id").alias("_lw_of"), F.col("first.tie").alias("tie")).agg(F.collect_set("first.at").alias("ats"))  # at most the lines of one document
    texts = rows.select("doc_id", "_lw_tie", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_lw_of")) & (F.col("_lw_tie") == F.col("tie")))
    cutout = texts.select("doc_id", "tie", F.explode("ats").alias("at"), F.split("text", "\n").alias("l"))
    # equal rows give equal lines
    held = cutout.select(_place().alias("place"), _plain(F.get("l", F.col("at"))).alias("s")).dropDuplicates(["place"])
    held = cut(held.select("place", "s", *_hashes("s")))

    # lines go by their first hash where many rows are shuffled; by both, or their place, where they are told apart
    parts = cut(held.select("h", F.explode(_but_one(F.col("s"), _size(F.col("s")))).alias("key")))
    alike = parts.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    alike = parts.join(cut(alike), "key", "left_semi").select("h").distinct()
    held = cut(held.join(alike, "h", "left_semi").select("place", "h", "g", F.split("s", " ").alias("w")))

    words = held.select("h", "g", F.size("w").alias("n"), F.posexplode("w").alias("j", "word"))
    part = W.partitionBy("h", "g")
    upto = part.orderBy("j").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = []
    for k in (0, 1):
        own = F.pmod(F.xxhash64(F.lit(k), "j", "word"), F.lit(RANGE))
        moved = F.pmod(F.xxhash64(F.lit(k), F.col("j") - 1, "word"), F.lit(RANGE))
        words = words.withColumns({f"own{k}": own, f"moved{k}": moved})
        words = words.withColumns({f"all{k}": F.sum(f"own{k}").over(whole), f"till{k}": F.sum(f"own{k}").over(upto), f"after{k}": F.sum(f"moved{k}").over(whole) - F.sum(f"moved{k}").over(upto)})
        sums.append((F.col(f"all{k}"), F.col(f"all{k}") - F.col(f"own{k}"), F.col(f"till{k}") - F.col(f"own{k}") + F.col(f"after{k}")))
    gap = F.struct(F.xxhash64(F.lit("gap"), "n", "j", sums[0][1], sums[1][1]).alias("key"), F.lit(0).alias("role"))
    shorter = F.struct(F.xxhash64(F.lit("cut"), F.col("n") - 1, sums[0][2], sums[1][2]).alias("key"), F.lit(1).alias("role"))
    full = F.struct(F.xxhash64(F.lit("cut"), F.col("n"), sums[0][0], sums[1][0]).alias("key"), F.lit(2).alias("role"))
    variants = cut(words.select("h", F.explode(F.when(F.col("j") == 0, F.array(gap, shorter, full)).otherwise(F.array(gap, shorter))).alias("v")).select("h", "v.*"))
    met = variants.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    # few variants are met; only these get their line's place
    variants = cut(variants.join(cut(met), "key", "left_semi").join(held.select("h", "place"), "h").select("key", "role", "place"))
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("place")))
    groups = variants.groupBy("key").agg(first(0).alias("gap"), first(1).alias("shorter"), first(2).alias("full"))
    other = F.when(F.col("role") == 0, F.col("gap")).when(F.col("role") == 1, F.col("full")).otherwise(F.col("shorter"))
    pairs = variants.join(cut(groups), "key").select("place", other.alias("earlier")).where("earlier < place").distinct()

    held = held.select("place", "w")
    both = pairs.join(held, "place").withColumnRenamed("w", "a").join(held.select(F.col("place").alias("earlier"), F.col("w").alias("b")), "earlier")
    size = lambda c: F.size(c)
    # equal words from the front, then from the back
    differ = lambda a, b: F.filter(F.sequence(F.lit(0), F.least(size(a), size(b)) - 1), lambda i: F.get(a, i) != F.get(b, i))
    front = lambda a, b: F.coalesce(F.get(differ(a, b), F.lit(0)), F.least(size(a), size(b)))
    most = F.greatest(size("a"), size("b"))
    same = front(F.col("a"), F.col("b")) + front(F.reverse("a"), F.reverse("b")) >= most - 1
    near = both.where((F.abs(size("a") - size("b")) <= 1) & same & (size("a") >= least) & (size("b") >= least))
    found = near.select("place").distinct()
    return lines.join(found, lines["first"] == found["place"], "left_semi").select("h", "g", F.lit(True).alias("near"))


def dropped_lines(docs: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, tie, dropped): the numbers of the lines of each document that repeat an earlier line.

    Lines are split at \\n and compared by their words (runs of non-white-space); a line without words is never
    dropped. The earliest of equal lines is kept, by doc_id, then line number. A line of at least `least` words
    is dropped, too, if a line of at least that many words whose first place is earlier is one word edit away
    (one word replaced, inserted or deleted), so 4 words of 5 agree at least. Links are not followed further:
    what counts is the line itself, kept or not.

    Null text has no lines; documents without dropped lines do not occur in the result. Null doc_ids come first.
    Rows of one doc_id with different texts are told apart by a hash of the text (tie, else 0), and come in its
    order; rows equal in both are one document, whose lines are at the same places.
    """
    return _dropped(_rows(docs), least)


def _dropped(rows: DataFrame, least: int) -> DataFrame:
    lines = cut(_lines(rows, least))
    distinct = cut(lines.groupBy("h", "g").agg(F.min(_place()).alias("first"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("times")))
    near = near_pairs(rows, distinct, least)
    verdict = distinct.select("h", "g", "first", "times").join(near, ["h", "g"], "left").where("near or times > 1")
    gone = lines.select(_place().alias("place"), "h", "g").join(cut(verdict), ["h", "g"]).where("near or first < place")
    return gone.groupBy("place.doc_id", "place.tie").agg(F.array_sort(F.collect_set("place.at")).alias("dropped"))


def _joined(docs: DataFrame, least: int) -> DataFrame:
    """docs with _lw_dropped: the numbers of a row's dropped lines, or null."""
    rows = _rows(docs)
    gone = _dropped(rows, least).select(F.col("doc_id").alias("_lw_of"), F.col("tie").alias("_lw_its"), F.col("dropped").alias("_lw_dropped"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_lw_of")) & (F.col("_lw_tie") == F.col("_lw_its")), "left")


def report(docs: DataFrame, least: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, dropped (line numbers from 0, comma-joined)."""
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    gone = F.col("_lw_dropped")
    return _joined(docs.select("doc_id", "text"), least).select(
        "doc_id", count.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(gone, ","), F.lit("")).alias("dropped")
    )


def clean(docs: DataFrame, least: int = 5) -> DataFrame:
    """docs without the dropped lines; a document all of whose lines with words are dropped goes."""
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_lw_dropped", i)), "\n")
    text = F.when(F.col("_lw_dropped").isNull(), F.col("text")).otherwise(kept)
    out = _joined(docs, least).withColumn("text", text).where(F.col("_lw_dropped").isNull() | F.col("text").rlike(WORD))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
