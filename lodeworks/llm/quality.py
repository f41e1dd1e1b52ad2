"""Quality rules: base counts, and divergence of a document's histograms from its language's."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

# The most common words of four languages.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "with", "as", "on", "be", "are", "this", "by", "at", "from", "or", "an"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur", "pas", "plus", "par", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}

#: Classes of characters; each character is in one. wide: beyond ASCII and Latin letters; other: the rest of ASCII.
CHARACTERS = ["upper", "digit", "symbol", "stop", "space", "accent", "wide", "other"]
#: The bins of the word histogram: one for each common word of any language, and one for all other words.
BINS = list(dict.fromkeys(w for words in COMMON.values() for w in words))


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once: a one-element array names a result inside an expression."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: ASCII white space, letters, digits, symbols and stops.
SPACES, LETTERS, DIGITS, SYMBOLS, STOPS = " \t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", ".,;:!?"
ASCII, LATIN = ("".join(map(chr, range(*ends))) for ends in ((0, 0x80), (0xC0, 0x250)))


def marks(text: Column) -> Column:
    """word_chars and the counts of the classes of characters, from what is left when common characters are taken away.

    Taking away by a table of characters costs the same for any class; patterns get slow where a query has many.
    """
    gone = lambda x, some: F.translate(x, some, "")
    size = lambda x: F.length(x).cast("long")

    def of_rare(rare: Column, word_chars: Column) -> Column:
        beyond = gone(rare, ASCII)
        known = {n: size(rare) - size(gone(rare, c)) for n, c in {"upper": LETTERS.upper(), "digit": DIGITS, "symbol": SYMBOLS, "stop": STOPS}.items()}
        return F.struct(word_chars.alias("word_chars"), *(c.alias(n) for n, c in known.items()), size(beyond).alias("beyond"), size(gone(beyond, LATIN)).alias("wide"))

    return _let(gone(text, SPACES), lambda solid: _let(gone(solid, LETTERS), lambda rare: of_rare(rare, size(solid))))


def character_bins(marks: Column, n_chars: Column) -> Column:
    """Counts of a text's characters by class, in the order of CHARACTERS; they add up to all its characters."""
    known = [marks["upper"], marks["digit"], marks["symbol"], marks["stop"]]
    return F.array(*known, n_chars - marks["word_chars"], marks["beyond"] - marks["wide"], marks["wide"], marks["word_chars"] - sum(known[1:], known[0]) - marks["beyond"])


def word_bins(words: Column, n_words: Column) -> Column:
    """Counts of an array of lower-case words by BINS, then of all others.

    Each common word becomes a character, by its number; how much shorter the string of these gets without a
    character is the word's count.
    """
    signs = [chr(0x20 + k) for k in range(len(BINS))]  # one byte each
    said = F.array_join(F.transform(F.filter(words, lambda w: w.isin(BINS)), lambda w: F.char(F.array_position(F.array(*map(F.lit, BINS)), w) + 0x1F)), "")
    counts = lambda s: F.transform(F.array(*map(F.lit, signs)), lambda c: (F.octet_length(s) - F.octet_length(F.replace(s, c, F.lit("")))).cast("long"))
    return _let(_let(said, counts), lambda a: F.concat(a, F.array(n_words - F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x))))


def window_hashes(words: Column, n: int) -> Column:
    """Hashes of the n-word windows of an array of words; a single, meaningless one where there is no window."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))  # windows of these: far quicker than windows of strings
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - n))
    return F.get(F.transform(F.array(hashed), lambda a: F.transform(starts, lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(n))))), F.lit(0))


def repeated_words(words: Column, hashes: Column, n: int) -> Column:
    """Words in n-word windows found twice or more in words, first included.

    A text whose window hashes are all distinct (nearly every one) has none. Otherwise the windows are sorted
    by hash, those equal to a neighbour are kept, and the union of their spans is measured: n log n.
    """
    enough = F.size(words) > n
    alike = enough & (F.size(F.array_distinct(hashes)) < F.size(hashes))
    windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def union(a: Column) -> Column:
        twice = F.filter(a, lambda x, k: ((k > 0) & (F.get(a, k - 1)["h"] == x["h"])) | ((k + 1 < F.size(a)) & (F.get(a, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def measure(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
        step = lambda a, s: F.struct((s + n).alias("to"), (a["n"] + n - F.greatest(F.lit(0), a["to"] - s)).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    return F.when(alike, _let(F.sort_array(windows), lambda a: _let(union(a), measure))).otherwise(0).cast("long")


def counts(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """doc_id, lang, the base counts, the two histograms (c, w) and carried columns of every row, from its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"_lw_carried{k}" for k in range(len(carried))]
    out = docs.select("doc_id", "lang", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), *(c.alias(n) for c, n in zip(carried, names, strict=True)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lower = F.transform("words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    out = out.withColumns({"windows": window_hashes(F.col("words"), 8), "marks": marks(F.col("text"))})
    return out.select(
        "doc_id", "lang", *names,
        F.size("words").cast("long").alias("n_words"),
        F.col("marks.word_chars").alias("word_chars"),
        F.col("marks.symbol").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("windows"), 8).alias("n_repeat_words"),
        word_bins(lower, F.size("words").cast("long")).alias("w"),
        character_bins(F.col("marks"), F.length("text").cast("long")).alias("c"),
    )


def excess(own: Column, n: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of a histogram of n from a reference's shares, without what chance accounts for.

    A sample of n from the reference itself diverges by about (bins - 1) / (8 n ln 2) bits; only bins that the
    reference has count. The distance is the root of the divergence in bits. A bin that the histogram lacks adds
    half its share.
    """

    def part(count: Column, q: Column) -> Column:
        p = count / n
        both = F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)
        return F.when(count > 0, (p * F.log2(2 * p / (p + q)) + both - q) / 2).otherwise(0.0)

    total = F.aggregate(F.zip_with(own, shares, part), F.lit(0.5), lambda t, x: t + x)
    chance = (F.size(F.filter(shares, lambda q: q > 0)) - 1) / (n * F.lit(8 * math.log(2)))
    return F.sqrt(F.greatest(F.lit(0.0), total - chance))


def judge(docs: DataFrame, most_chars: float = 0.25, most_words: float = 0.2, least_chars: int = 200, least_words: int = 40, full: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A document that passes the base rules is kept unless its character-class histogram lies further than
    most_chars, or its common-word histogram further than most_words, from the reference of its language by
    Jensen-Shannon distance (see excess). The references are the pooled histograms of all documents of the
    language that pass the base rules. Guards: a histogram over fewer than least_chars characters or least_words
    words is not judged, and a language whose reference is that short judges nothing. Words of a language
    without common words of its own here all lie in the last bin, so its documents are judged by characters.

    full adds char_distance, word_distance, and row: all columns of the row.

    Null text counts as empty and fails the base rules; a null lang is a language of its own. Each row is judged by
    itself, so equal rows give equal rows; an empty table gives none; only doc_id, text and lang are read, unless full.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    slim = counts(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns))] if full else [])
    slim = cut(slim.withColumn("base_failed", failed).withColumn("key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))).drop("lang"))
    bins = slim.where(~F.col("base_failed")).select("key", F.posexplode(F.concat("c", "w")).alias("at", "n")).groupBy("key", "at").agg(F.sum("n").alias("n"))
    whole = bins.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("r"))  # len(BINS) and a few numbers
    reference = whole.select("key", F.slice("r", 1, len(CHARACTERS)).alias("rc"), F.slice("r", len(CHARACTERS) + 1, len(BINS) + 1).alias("rw"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)
    share = lambda a: F.transform(a, lambda x: x / total(a))
    # a row for each language: few, yet nothing bounds them; written out, so that Spark knows their size before it plans the join
    reference = cut(reference.select("key", total("rc").alias("mc"), total("rw").alias("mw"), share("rc").alias("rc"), share("rw").alias("rw")))
    both = slim.join(reference, "key", "left").withColumn("nc", total("c"))

    def distance(own: str, n: str, shares: str, m: str, least: int) -> Column:
        judged = ~F.col("base_failed") & (F.col(n) >= least) & (F.col(m) >= least)
        return F.when(judged, excess(F.col(own), F.col(n), F.col(shares))).otherwise(0.0)

    both = both.withColumn("char_distance", distance("c", "nc", "rc", "mc", least_chars)).withColumn("word_distance", distance("w", "n_words", "rw", "mw", least_words))
    both = both.withColumn("kept", ~F.col("base_failed") & (F.col("char_distance") <= most_chars) & (F.col("word_distance") <= most_words))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return both.select(*out, *(["char_distance", "word_distance", F.col("_lw_carried0").alias("row")] if full else []))
