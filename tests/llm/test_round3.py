"""Quantile summaries, relative factors and whitening against brute force."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import factors, quantiles, queries, whitening

CLICKS = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, props string, x string, c string"
LINES = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double"
ITEMS = "item_id bigint, name string, brand string, kind string, size int, price double"


# ---------------------------------------------------------------------------------------------- quantiles


def summary_of(values):
    """The exact summary of a list."""
    values = sorted(values)
    x = sorted(set(values))
    low = [bisect.bisect_right(values, v) for v in x]
    high = [bisect.bisect_left(values, v) + 1 for v in x]
    return len(values), *(np.array(c, np.int64) for c in (x, low, high))


@pytest.mark.parametrize("seed", range(6))
def test_merged_and_pruned_bounds_hold(seed):
    r = random.Random(seed)
    lists = [[r.randint(0, 10 ** r.randint(1, 6)) if r.random() > 0.3 else 7 for _ in range(r.choice([0, 1, 3, 50, 900]))] for _ in range(8)]
    lists = [x for x in lists if x]
    b = quantiles.spaces(3, 0.05)
    nodes = [(k, quantiles.prune(summary_of(x), b)) for k, x in enumerate(lists)]
    n, x, low, high = quantiles.merge_tree(nodes, b)
    every = sorted(v for one in lists for v in one)
    assert n == len(every)
    assert len(x) <= b + quantiles.FIRST + 1 and len(x) >= min(4, len(set(every)))
    for v, lo, hi in zip(x, low, high, strict=True):
        assert lo <= bisect.bisect_right(every, v) and bisect.bisect_left(every, v) <= hi - 1
    ranks = np.arange(1, n + 1)
    found = x[quantiles.best((n, x, low, high), ranks)]
    assert (np.diff(found) >= 0).all()
    for t, v in zip(ranks, found, strict=True):
        assert max(0, bisect.bisect_left(every, v) + 1 - t, t - bisect.bisect_right(every, v)) <= 0.05 * n


def test_deep_tree_keeps_its_bound(spark):
    r = random.Random(5)
    rows = [("g", r.randrange(8), int(r.lognormvariate(5, 3))) for _ in range(20_000)] + [("one", 3, 5)] * 500 + [(None, 1, 1), ("g", None, 1), ("g", 1, None)]
    df = spark.createDataFrame(rows, "grp string, batch int, x bigint").repartition(4)
    counts, made = quantiles.summaries(df, ["grp"], "batch", 8, error=0.05, most=400, capacity=16)
    got = {(m.grp, m.batch): m for m in made.collect()}
    for key, m in got.items():
        every = sorted(x for g, b, x in rows if g is not None and b is not None and x is not None and g == key[0] and (key[1] == -1 or b == key[1]))
        assert m.n == len(every) and min(4, len(set(every))) <= len(m.points) <= min(m.n, 400)
        s = (m.n, *(np.array([p[k] for p in m.points]) for k in range(3)))
        ranks = np.arange(1, m.n + 1)
        for t, v in zip(ranks, s[1][quantiles.best(s, ranks)], strict=True):
            assert max(0, bisect.bisect_left(every, v) + 1 - t, t - bisect.bisect_right(every, v)) <= 0.05 * m.n
    assert {k[0] for k in got} == {"g", "one"} and ("one", -1) in got and counts.count() > 0


def expected_quantiles(clicks, lines, items):
    """Everything but the summaries' own answers: (stream, grp, batch, i) to (n, target, exact_x), and the values of each."""
    rows, seen = defaultdict(list), {}
    def sound(m):
        return m is not None and math.isfinite(m)
    def x(m, b):
        return math.floor(100 * m + 0.5) + 1000 * b
    def batch(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 8
    for c in clicks:
        if c["client_id"] is not None and sound(c["value"]):
            seen[c["click_id"]] = min(seen.get(c["click_id"], (c["client_id"], c["value"])), (c["client_id"], c["value"]))
    for i, (grp, m) in seen.items():
        rows["value", str(grp), batch(i)].append(x(m, batch(i)))
    by_item = {}
    for i in items:
        if i["item_id"] is not None and i["brand"] is not None and sound(i["price"]):
            by_item[i["item_id"]] = min(by_item.get(i["item_id"], (i["brand"], i["price"])), (i["brand"], i["price"]))
    for s in lines:
        if s["item_id"] in by_item:
            brand, price = by_item[s["item_id"]]
            rows["price", brand, batch(s["vendor_id"])].append(x(price, batch(s["vendor_id"])))
    whole = defaultdict(list)
    for (stream, grp, _), v in rows.items():
        whole[stream, grp, -1] += v
    every = {k: sorted(v) for k, v in {**rows, **whole}.items() if len(v) >= 20}
    return {(*k, i): (len(v), math.ceil(Fraction(i * len(v), 10)), v[math.ceil(Fraction(i * len(v), 10)) - 1]) for k, v in every.items() for i in range(1, 10)}, every


def held_against(out, clicks, lines, items):
    want, every = expected_quantiles(clicks, lines, items)
    got = {(r.stream, r.grp, r.batch, r.i): r for r in out}
    assert len(got) == len(out) and set(got) == set(want)
    for key, r in got.items():
        v = every[key[:3]]
        assert (r.n, r.target, r.exact_x) == want[key]
        assert (r.n_below, r.n_upto) == (bisect.bisect_left(v, r.answer), bisect.bisect_right(v, r.answer)) and r.n_below < r.n_upto
        assert r.rank_error == max(0, r.n_below + 1 - r.target, r.target - r.n_upto) and r.within == (1000 * r.rank_error <= 50 * r.n) and r.within
        assert min(4, len(set(v))) <= r.points <= min(r.n, 400)
    for key, r in got.items():
        assert key[3] == 9 or r.answer <= got[(*key[:3], key[3] + 1)].answer


def test_quantiles_query_on_given_tables(spark, sf_dir):
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("clicks", "sale_lines", "items")]
    held_against(queries.op11_quantiles(spark, sf_dir).collect(), *tables)


def test_quantiles_on_odd_rows(spark, tmp_path):
    r = random.Random(3)
    clicks = [(k, None, None, r.choice([1, 1, 2, None]), "a", r.choice([1.0, 2.5, -3.005, float("nan"), float("inf"), None, r.random() * 9e4, 1e300]), None, "x", "c") for k in range(900)]
    clicks += clicks[:200] + [(5, None, None, 1, "b", -8.0, None, None, None), (None, None, None, 1, "b", 2.0, None, None, None)]
    lines = [(1, 1, r.choice([1, 2, 3, 4, None, 99]), r.choice([1, 2, 3, None]), 1, 2.0) for _ in range(700)]
    items = [(1, "n", "B", "k", 1, 5.0), (1, "n", "B", "k", 1, 5.0), (2, "n", "B", "k", 1, 7.005), (3, "n", None, "k", 1, 5.0), (4, "n", "C", "k", 1, None), (None, "n", "D", "k", 1, 1.0)]
    for name, rows, schema in (("clicks", clicks, CLICKS), ("sale_lines", lines, LINES), ("items", items, ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    name = lambda schema: [c.split()[0] for c in schema.split(", ")]
    drop_big = [c for c in clicks if c[5] is None or abs(c[5]) < 1e16 or not math.isfinite(c[5])]
    dicts = [[dict(zip(name(s), row, strict=True)) for row in rows] for rows, s in ((drop_big, CLICKS), (lines, LINES), (items, ITEMS))]
    held_against(queries.op11_quantiles(spark, str(tmp_path)).collect(), *dicts)


def test_quantiles_of_empty_tables(spark, tmp_path):
    for name, schema in (("clicks", CLICKS), ("sale_lines", LINES), ("items", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert queries.op11_quantiles(spark, str(tmp_path)).collect() == []


# ------------------------------------------------------------------------------------------------ factors


def brute_repeats(texts, length):
    """(words, removed, kept digest) of each text by comparing all windows."""
    words = [(t or "").encode().split() for t in texts]
    places = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if places[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def texts_with_repeats(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(r.choice([2, 50, 3000]))] + ["é", "中文", "a b", "x\x1cy"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [say(r.choice([34, 35, 36, 60, 200])) for _ in range(5)]
    texts = [None, "", " \n\t", "one", " ".join(["the"] * 500), " ".join(["the"] * 36), " ".join(["a", "b"] * 300), " ".join(say(34)), " ".join(say(3500))]
    for k in range(60):
        body = say(r.randint(1, 120))
        for _ in range(r.randint(0, 3)):
            body += r.choice(passages) + say(r.randint(0, 30))
        if k % 9 == 0:
            body += body
        texts.append(r.choice([" ", "\n", "\x0b \t"]).join(body))
        if k % 4 == 0:  # near copies with edits at random places
            for _ in range(r.randint(1, 6)):
                near = list(body)
                for _ in range(r.randint(0, 3)):
                    near[r.randrange(len(near))] = r.choice(vocabulary)
                texts.append(" ".join(near))
    texts += [texts[20], texts[20], texts[8]]
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_factors_against_all_windows(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(factors, "SALT", 150)  # large blocks are dealt to copies
        monkeypatch.setattr(factors, "PIECE", 40)
    texts = texts_with_repeats(seed)
    docs = spark.createDataFrame([(k if k % 7 else None, t, "t", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, t string, n int").repartition(6)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.d) for r in factors.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("d")).collect())
    want = sorted(((k if k % 7 else -1), *x) for k, x in enumerate(brute_repeats(texts, 35)))
    assert got == want


def test_factors_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert factors.remove_repeats(docs).collect() == []


def test_factors_query_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op12_factors(spark, sf_dir).collect())
    assert got == sorted((r.doc_id, *x) for r, x in zip(rows, brute_repeats([r.text for r in rows], 35), strict=True))


def test_greedy_parse_takes_the_longest_match():
    rolling = factors.Rolling()
    r = random.Random(2)
    base = np.array([r.randrange(9) for _ in range(400)], np.uint64)
    reference = factors.Reference(base, np.arange(366), 35, rolling)
    text = np.concatenate([base[30:90], np.array([77], np.uint64), base[200:260], base[10:20], base[300:400]])
    at = 0
    for i, m, p in reference.parse(text):
        assert i >= at and (text[i : i + m] == base[p : p + m]).all()
        longest = max(next((k for k in range(min(len(text) - i, 400 - q)) if text[i + k] != base[q + k]), min(len(text) - i, 400 - q)) for q in range(400))
        assert m == longest
        at = i + m


# ---------------------------------------------------------------------------------------------- whitening


def brute_whitening(vectors, components=16):
    """(fit list, deviations, eigenvalues, trace) by exact fractions."""
    def sound(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v)
    x = [None if not sound(v) else tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted({v for v in x if v is not None})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit]
    d = len(sums)
    exact = [[sum(v[i] * v[j] for v in y) for j in range(d)] for i in range(d)]
    cov = np.array([[float(Fraction(m, n**3)) for m in row] for row in exact])
    return x, fit, n, sums, exact, cov


def check_whitening(out, ids, vectors, components=16):
    x, fit, n, sums, exact, cov = brute_whitening(vectors)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(components, len(sums))
    want = sorted((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in zip(ids, x, strict=True) if v is not None for c in range(k))
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in out) == want
    scores = defaultdict(dict)
    for r in out:
        scores[r.vec_id][r.component] = r.whitened
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 * r.explained and r.identity_error <= 1e-6
    assert len({r.identity_error for r in out}) == 1
    rows = {v: scores[i] for i, v in zip(ids, x, strict=True) if v is not None}
    w = np.array([[rows[v][c + 1] for c in range(k)] for v in fit])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6
    plain = (np.array(fit, float) - np.array([s / n for s in sums])) @ vecs[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        assert min(np.abs(w[:, c] - plain[:, c]).max(), np.abs(w[:, c] + plain[:, c]).max()) < 1e-5


def test_whitening_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check_whitening(queries.op13_whitening(spark, sf_dir).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_odd_rows(spark):
    r = random.Random(1)
    sound = [[r.gauss(0, 1) * (j + 1) for j in range(5)] for _ in range(300)]
    vectors = [*sound, sound[0], sound[0], None, [None, 1.0, 1.0, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0, 1.0], [1.0, float("-inf"), 1.0, 1.0, 1.0]]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, ids, strict=True)), "vec_id bigint, embedding array<double>, x bigint").repartition(5)
    check_whitening(whitening.whiten(df).collect(), ids, vectors)


def test_whitening_of_few_and_flat_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (None, None)], schema)).collect() == []
    out = whitening.whiten(spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [4.0, 2.0]), (5, [1e15, 2.0, 3.0]), (6, [-1e15, 2.0, 3.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in out) == [(0, 1, 3), (1, 1, 3), (2, 1, 3), (2, 1, 3), (5, 1, 2), (6, 1, 2)]
    assert all(r.identity_error < 1e-6 for r in out) and [r.deviation for r in out if r.vec_id == 5] == [None]


def test_remainders():
    moduli = whitening.primes(2 * 10**30)
    assert all(p < 1 << 20 for p in moduli) and len(set(moduli)) == len(moduli) and math.prod(moduli) > 2 * 10**30
    for v in (0, 1, -1, 10**30, -(10**30), 12345678901234567890):
        assert whitening.remaindered([v % p for p in moduli], moduli) == v
