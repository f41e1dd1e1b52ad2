"""Licence scans with a positional rare-token index over licence notices."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of the base scan and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Customary licence notices (phrases that name a licence, passages of their texts, identifier tags), and
# per notice the phrases that must stand in it.
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ["required by applicable law or agreed to in writing"]),
    ("apache", "spdx license identifier apache 2 0", ["spdx license identifier apache"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["gnu general public license for more details"]),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works", ["free copyleft license"]),
    ("gpl", "spdx license identifier gpl 3 0 or later", ["spdx license identifier gpl"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("lgpl", "spdx license identifier lgpl 2 1 or later", ["spdx license identifier lgpl"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("agpl", "spdx license identifier agpl 3 0 or later", ["spdx license identifier agpl"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", ["redistributions in binary form must reproduce"]),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived"]),
    ("bsd", "spdx license identifier bsd 3 clause", ["spdx license identifier bsd"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", ["copy of the mpl was not distributed"]),
    ("mpl", "spdx license identifier mpl 2 0", ["spdx license identifier mpl"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("isc", "spdx license identifier isc", ["spdx license identifier isc"]),
    ("cc", "licensed under a creative commons attribution license", ["creative commons"]),
    ("cc", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright and related"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ["authors be held liable for any damages"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["public domain"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", ["anyone is free to copy modify publish"]),
    ("artistic", "licensed under the terms of the artistic license", ["artistic license"]),
]

#: A word once A-Z are lower case; the scan runs on the text as it is, so it takes A-Z too.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: An alignment is kept as notice * 2**42 + (start of the notice in the file + 2**40).
STEP, ZERO = 1 << 42, 1 << 40


def _at(words: Column, start: Column, phrase: list[str]) -> Column:
    out = F.get(words, start) == phrase[0]
    for k, word in enumerate(phrase[1:], 1):
        out = out & (F.get(words, start + k) == word)
    return F.coalesce(out, F.lit(False))


def _index(notices: list) -> tuple[list[str], dict[str, list[int]]]:
    """Vocabulary by falling IDF over the notices, and each word's postings as coded alignments at word 0."""
    texts = [t.split() for _, t, _ in notices]
    df = Counter(w for t in texts for w in set(t))
    vocabulary = sorted(df, key=lambda w: (-math.log(len(texts) / df[w]), w))
    return vocabulary, {w: [n * STEP + ZERO - k for n, t in enumerate(texts) for k, x in enumerate(t) if x == w] for w in vocabulary}


def _anchor(notice: str, phrases: list[str], df: dict[str, int]) -> tuple[str, int]:
    """The rarest word of a notice's mandatory phrases (the longest of equals), and its place in the notice."""
    here, places = notice.split(), []
    for p in (x.split() for x in phrases):
        k = next(k for k in range(len(here)) if here[k : k + len(p)] == p)
        places += [(df[w], -len(w), k + i, w) for i, w in enumerate(p)]
    *_, k, word = min(places)
    return word, k


def scan(docs: DataFrame, least: float = 0.75, notices: list = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: all places where a phrase's words stand consecutively. Index: each notice is filed under the
    rarest word of its mandatory phrases, by its document frequency over the notices. Every place of such a word in a
    file names a notice and the position where it would start, and every such start is verified: the mandatory
    phrases must stand there in full, and score is the share of the notice's words found in place, the best of all
    starts. As no notice counts without its phrases, no start is missed. A notice of at least the share least gives
    its label. Each row is decided from its own text and the constant index, so
    there is no shuffle and no join. Files without any index word or base phrase skip the word list.

    Null or empty text: no words, counts 0, null positions, empty labels, score 0. Equal rows give equal rows;
    an empty table gives none; only doc_id and text are read.
    """
    vocabulary, postings = _index(notices)
    anchors = [_anchor(t, ps, {w: len({p // STEP for p in postings[w]}) for w in vocabulary}) for _, t, ps in notices]
    ends = sorted({p.split()[-1] for p in base})
    index = sorted({w for w, _ in anchors} | set(ends))
    keys = sorted({max(p.split(), key=len) for p in base} | {max(p.split(), key=len) for *_, ps in notices for p in ps})
    text = F.coalesce(F.col("text"), F.lit(""))
    # a base place or a verified notice needs the longest word of some phrase; lower() may only add matches
    maybe = F.lit(False)
    for k in keys:
        maybe = maybe | F.contains("low", F.lit(k))
    words = F.when(maybe, F.transform(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), lambda w: F.translate(w, UPPER, LOWER))).otherwise(F.array().cast("array<string>"))
    out = docs.select("doc_id", text.alias("text"), F.lower(text).alias("low"))
    text = F.col("text")
    out = out.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), words.alias("words"))
    known = F.filter(F.transform(F.col("words"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(index))
    out = out.withColumn("known", known)

    lasts = F.filter("known", lambda x: x["w"].isin(ends))

    def standing(phrase: list[str]) -> Column:
        """The starts of all places of a phrase, found by its last word."""
        back = len(phrase) - 1
        full = F.filter(lasts, lambda x: (x["i"] >= back) & _at(F.col("words"), x["i"] - back, phrase))
        return F.transform(full, lambda x: x["i"] - back)

    places = {label: standing(p.split()) for p, label in base.items()}
    for label, at in places.items():
        out = out.withColumn(f"at_{label}", at)
    every = F.concat(*(F.col(f"at_{x}") for x in places))

    def score(n: int) -> Column:
        """The best score of notice n over all starts that its anchor names, 0 without a firm one."""
        (_, notice, phrases), (word, back) = notices[n], anchors[n]
        here = notice.split()

        def firm(start: Column) -> Column:
            out = F.lit(True)
            for p in (x.split() for x in phrases):
                k = next(k for k in range(len(here)) if here[k : k + len(p)] == p)
                out = out & (start + k >= 0) & _at(F.col("words"), start + k, p)
            return out

        def share(start: Column) -> Column:
            same = F.lit(0)
            for k, w in enumerate(here):
                same = same + F.when((start + k >= 0) & (F.get("words", start + k) == w), 1).otherwise(0)
            return same / F.lit(float(len(here)))

        starts = F.transform(F.filter("known", lambda x: x["w"] == word), lambda x: x["i"] - back)
        return F.coalesce(F.array_max(F.transform(F.filter(starts, firm), share)), F.lit(0.0))

    scores = [score(n) for n in range(len(notices))]
    out = out.withColumn("scores", F.array(*scores))
    found = F.filter(F.array(*(F.when(F.get("scores", F.lit(n)) >= least, F.lit(label)) for n, (label, *_) in enumerate(notices))), lambda x: x.isNotNull())
    plain = F.filter(F.array(*(F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in places)), lambda x: x.isNotNull())
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        line(plain).alias("base_labels"), line(F.concat(plain, found)).alias("labels"), F.array_max("scores").alias("score"),
    )
