"""Each pipeline stage against brute force: on odd rows, and all of them in a row on the small table."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from test_operators import WORD, lines_brute, quality_base

from lodeworks.llm import common, lines, pipeline, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, k1 string, h string, taken string"


def table():
    """Null and repeated ids, equal rows, copies, near copies, repeated lines, junk, texts without words, one long text."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(500)]
    say = lambda n: " ".join(r.choice([*words, *quality.COMMON["en"]]) for _ in range(n))
    texts = [say(r.randint(15, 90)) + "\n" + say(r.randint(3, 30)) for _ in range(60)]
    rows = [(i, x) for i, x in enumerate(texts)]
    rows += [(100, texts[0]), (101, texts[1] + " end"), (1, texts[2]), (3, texts[3]), (3, texts[3]), (5, say(60)), (5, texts[5] + " more"), (None, texts[6]), (None, texts[6]), (None, say(50)), (102, f"{say(40)}\n  {texts[7]}")]
    rows += [(103, None), (104, ""), (104, ""), (105, " \n "), (None, None), (106, "Xq%%% ZZ$$$ kk*** QQ### " * 40 + say(30)), (107, say(4000)), (108, "é中 " * 60 + say(30)), (109, "same words again and again here now " * 12)]
    return [(i, x, r.choice(["en", "en", "de", None]), r.choice(["a", "b", "b", None]), len(x or ""), "r", "k", "h", "t") for i, x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(4).cache()


def tuples(df):
    return Counter(map(tuple, df.collect()))


def quality_brute(rows, most_chars=0.25, most_words=0.2, least_chars=200, least_words=40):
    def bins(text):
        kinds = ["[A-Z]", "[0-9]", r"[#*$%&|<>]", "[.,;:!?]", r"[\x20\x09-\x0D]", "[À-ɏ]", r"[^\x00-\x7F]"]
        c = Counter(next((k for k, x in enumerate(kinds) if re.match(x, ch)), 7) for ch in text)
        w = Counter(x if x in quality.BINS else "" for x in (w.rstrip(".,;:!?").lower() for w in WORD.findall(text)))
        return [c[k] for k in range(8)], [w[x] for x in [*quality.BINS, ""]]

    def far(own, reference, least):
        n, m = sum(own), sum(reference)
        if n < least or m < least:
            return 0.0
        half = lambda a, b: a * math.log2(2 * a / (a + b)) / 2 if a else 0.0
        total = sum(half(a / n, b / m) + half(b / m, a / n) for a, b in zip(own, reference, strict=True))
        return math.sqrt(max(0.0, total - (sum(b > 0 for b in reference) - 1) / (8 * n * math.log(2))))

    failed = [b[0] < 20 or 100 * b[4] > 30 * b[0] for b in (quality_base(r[1] or "") for r in rows)]
    held = [bins(r[1] or "") for r in rows]
    pooled = defaultdict(lambda: [[0] * 8, [0] * (len(quality.BINS) + 1)])
    for r, f, h in zip(rows, failed, held, strict=True):
        if not f:
            pooled[r[2]] = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(pooled[r[2]], h, strict=True)]
    return [not f and far(h[0], pooled[r[2]][0], least_chars) <= most_chars and far(h[1], pooled[r[2]][1], least_words) <= most_words for r, f, h in zip(rows, failed, held, strict=True)]


def check_quality(before, after):
    want = Counter(r for r, keep in zip(before, quality_brute(before), strict=True) if keep)
    assert after == want


def check_lines(before, after):
    gone = lines_brute([(r[0], r[1]) for r in before])
    want = Counter()
    for r in before:
        text = r[1]
        if (r[0], r[1]) in gone:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[r[0], r[1]])
            if not WORD.search(text):
                continue
        want[(r[0], text, r[2], r[3], None if text is None else len(text), *r[5:])] += 1
    assert after == want


def check_near(before, after):
    """One row of each group, that of the smallest doc_id; every row without words."""
    import numpy as np

    from lodeworks.llm import jaccard

    sets = [set(jaccard.shingle_set((r[1] or "").encode(), 5).tolist()) for r in before]
    up = list(range(len(before)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sizes = np.array([len(s) for s in sets])
    for a in range(len(before)):
        for b in np.flatnonzero((sizes[:a] >= 0.8 * sizes[a]) & (0.8 * sizes[:a] <= sizes[a])).tolist() if sets[a] else []:
            if sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    groups = defaultdict(list)
    for k, r in enumerate(before):
        groups[root(k) if sets[k] else ("none", k)].append(r)
    left = Counter(after)
    for held in groups.values():
        least = min(((r[0] is None, r[0] or 0) for r in held))
        found = [r for r in dict.fromkeys(held) if (r[0] is None, r[0] or 0) == least and left[r]]
        assert found, held
        left[found[0]] -= 1
    assert not +left


def check_mix(before, after):
    """Whole copies and one cut-off beginning of each text at most, in all as many words of a source as its share."""
    held, used = defaultdict(list), Counter()
    for r in before:
        held[r[0], r[2], r[3], *r[5:]].append(r[1])
    taken, size = Counter(), Counter()
    for r in before:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    cuts = 0
    for r, n in after.items():
        texts = held[r[0], r[2], r[3], *r[5:]]
        assert r[4] == len(r[1])
        whole = r[1] in texts
        assert whole or any(t is not None and t.startswith(r[1]) for t in texts)
        cuts += 0 if whole else n
        used[r[0], r[2], r[3], r[5:]] += n
        taken[r[3]] += n * len(WORD.findall(r[1]))
    assert all(n <= 3 * len(held[i, lang, s, *rest]) for (i, lang, s, rest), n in used.items())
    assert cuts <= 64 * len(size)
    order = [*sorted(s for s in size if s is not None), *([None] if None in size else [])]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * size[s] for s in capped)
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]
        if not over:
            break
        capped |= set(over)
    for s in order:
        target = 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free)
        assert abs(taken[s] - target) <= 16 + 0.01 * target, s


def check_pack(before, after):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pipeline.TOKENIZER)
    cover, sums = Counter(), defaultdict(set)
    for (i, start, length, crc, tokens, *_), n in after.items():
        cover[i] += n * length
        sums[i, tokens].add((start, length, crc))
    want = Counter()
    for r in before:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0]] += len(ids)
    assert cover == want
    ids = {(r[0], len(x)): x for r in before for x in [np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")]}
    for (i, tokens), pieces in sums.items():
        if sum(r[0] == i for r in before) == 1:
            assert all(zlib.crc32(ids[i, tokens][s : s + n].tobytes()) == c for s, n, c in pieces)


CHECKS = [check_quality, check_lines, check_near, check_mix, check_pack]


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, docs, sf_dir, k):
    name, stage = pipeline.STAGES[k]
    out = stage(spark, docs, sf_dir)
    if k < 4:
        assert out.columns == docs.columns
    CHECKS[k](table(), tuples(out))


@pytest.mark.parametrize("k", range(5))
def test_stage_of_nothing(spark, sf_dir, k):
    assert pipeline.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), sf_dir).collect() == []


def test_stages_in_a_row(spark, sf_dir, tmp_path):
    """On the small table, each stage on what its predecessor kept; the pieces are those of run()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        CHECKS[k]([tuple(r) for r in docs.collect()], tuples(out))
        assert out.count() > 0
        docs = out


def test_run(spark, sf_dir):
    """The pipeline's own tables go; those of results that are still to be read stay."""
    import os

    folder = common.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    mine = lines.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = set(os.listdir(folder))
    out = pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert mine.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert [f.split("-")[0] for f in set(os.listdir(folder)) - held] == ["pipeline"] and before <= held
