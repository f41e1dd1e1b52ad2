"""Whitening of vectors from an exact scatter matrix in residue numbers.

Entries become integers, and so does the scatter of the centred list: with n vectors x and sums S, y = n*x - S has
integer entries, and the scatter sum(y y') is n**3 times the covariance. It would overflow machine words, so each partition
multiplies residues of y modulo several primes below 2**20: products of blocks of ROWS rows are exact in double precision and come
from one matrix product each. Residues are summed over partitions; Chinese remaindering gives the exact scatter, and its
covariance, rounded once, goes to the eigensolver in double precision. What the driver holds depends on the
vectors' length alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a matrix product: ROWS * (2**19)**2 stays below 2**53, residues being taken around zero.
ROWS = 1 << 15
#: Entries are scaled and shifted to integers.
SCALE, SHIFT = 64, 1_000_000
#: Components whose share of the greatest eigenvalue is not above rounding have no direction of their own.
FLAT = 1e-12


def primes(above: int, below: int = 1 << 20) -> list[int]:
    """The greatest primes under `below`, as many as it takes for their product to pass `above`."""
    out, product, k = [], 1, below - 1
    while product <= above:
        while any(k % d == 0 for d in range(2, math.isqrt(k) + 1)):
            k -= 1
        out.append(k)
        product *= k
        k -= 1
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of smallest magnitude with these residues (Chinese remainder theorem)."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def _matrix(column, size: int):
    """An Arrow column of arrays of one size as an integer matrix."""
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, size)


def _ends(size: int):
    """Arrow batches of (x) to (dim, n, s, low, high): a row for each dimension and task."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, s, low, high = 0, [0] * size, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), size)
                n += len(x)
                s = [a + (int(np.sum(c >> 32)) << 32) + int(np.sum(c & 0xFFFFFFFF)) for a, c in zip(s, x.T, strict=True)]  # sums of halves do not overflow
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(v) for v in s]), pa.array(low), pa.array(high)], ["dim", "n", "s", "low", "high"])

    return run


def _centred(x, n: int, centre, rest, p: int):
    """Residues around zero of n * x - S modulo p, for S = n * centre + rest, as doubles."""
    import numpy as np

    y = ((x - centre) % p * (n % p) - np.array([r % p for r in rest], np.int64)) % p
    return np.where(y > p // 2, y - p, y).astype(np.float64)


def _residues(size: int, n: int, centre: list[int], rest: list[int], moduli: list[int]):
    """Arrow batches of (x) to (k, i, j, r): residues of the task's scatter modulo prime k, upper half."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        middle = np.array(centre, np.int64)
        total = np.zeros((len(moduli), size, size), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size) if batch.num_rows else np.zeros((0, size), np.int64)
            for k, p in enumerate(moduli):
                for at in range(0, len(x), ROWS):
                    y = _centred(x[at : at + ROWS], n, middle, rest, p)
                    total[k] = (total[k] + np.rint(y.T @ y).astype(np.int64)) % p
        i, j = np.triu_indices(size)
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[k][i, j])], ["k", "i", "j", "r"])

    return run


class Fit:
    """The list's length, sums and exact scatter of one length of vectors, and what follows from them."""

    def __init__(self, fit: DataFrame, size: int, components: int):
        import numpy as np

        self.size = size
        ends = fit.select("x").mapInArrow(_ends(size), "dim int, n bigint, s string, low bigint, high bigint")
        kinds = ends.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
        rows = sorted(kinds.collect())  # one for each dimension
        self.n, self.sums = rows[0].n, [int(r.s) for r in rows]
        self.centre = [s // self.n for s in self.sums]
        self.rest = [s % self.n for s in self.sums]
        reach = self.n * max(r.high - r.low for r in rows)  # no |n * x - S| is above
        self.reach = reach
        moduli = primes(2 * self.n * reach * reach + 1)
        held = fit.select("x").mapInArrow(_residues(size, self.n, self.centre, self.rest, moduli), "k int, i int, j int, r bigint").groupBy("k", "i", "j").agg(F.sum("r").alias("r"))
        found: dict[tuple[int, int], list[int]] = {}
        for r in held.collect():  # primes * size**2 / 2 numbers
            found.setdefault((r.i, r.j), [0] * len(moduli))[r.k] = r.r % moduli[r.k]
        self.scatter = {at: remaindered(r, moduli) for at, r in found.items()}
        v = np.zeros((size, size))
        for (i, j), m in self.scatter.items():
            v[i, j] = v[j, i] = float(Fraction(m, self.n**3))
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace = float(Fraction(sum(self.scatter[i, i] for i in range(size)), self.n**3))
        keep = [k for k in range(min(components, size)) if values[k] > FLAT * max(values[0], 0)]
        self.explained = [float(values[k] / trace) for k in keep]
        self.onto = vectors[:, keep] / np.sqrt(values[keep]) if keep else np.zeros((size, 0))

    def scores(self, x):
        """x - S/n on the components, over the roots of their eigenvalues."""
        import numpy as np

        off = np.array([float(Fraction(r, self.n)) for r in self.rest])
        return ((x - np.array(self.centre, np.int64)) - off) @ self.onto


def _second_moments(scores, size: int):
    """Arrow batches of (x) to (i, j, c): sums of products of scores, and of scores where i is -1."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total, sums = 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                w = scores(_matrix(batch.column(0), size))
                total, sums = total + w.T @ w, sums + w.sum(0)
        if not np.isscalar(total):
            k = len(sums)
            i, j = np.indices((k, k)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((i, np.full(k, -1))).astype(np.int32)), pa.array(np.concatenate((j, np.arange(k))).astype(np.int32)), pa.array(np.concatenate((total.ravel(), sums)))], ["i", "j", "c"])

    return run


def identity_error(fit: DataFrame, of: Fit) -> float:
    """The largest entry of the covariance of the list's scores minus the identity."""
    import numpy as np

    k = of.onto.shape[1]
    held = fit.select("x").mapInArrow(_second_moments(of.scores, of.size), "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()  # components squared
    c, mean = np.zeros((k, k)), np.zeros(k)
    for r in held:
        if r.i < 0:
            mean[r.j] = r.c / of.n
        else:
            c[r.i, r.j] = r.c / of.n
    return float(np.abs(c - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def integers(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, x): the rows whose vector is not null nor holds null, non-finite or (beyond 1e16) too large entries, entries as integers."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < 1e16, F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT)
    return vectors.where(F.coalesce(sound, F.lit(False))).select(ident, x.alias("x"))


def whiten(vectors: DataFrame, components: int = 16, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit list holds each distinct integer vector once. Rows with null vectors, or null or non-finite entries, are left out;
    so are entries that no integer stands for (1e16 and above). Vectors of each length have a list and components of
    their own; lengths are few, and each takes its own jobs. Empty vectors have no components, nor has a list
    of one vector or any direction in which all vectors agree, so such rows return nothing. deviation, the sum of squares of
    n*x - S, is null where no 64-bit integer holds it. Rows of one id, or of none, stay apart. An empty table gives no rows. Only
    ident and vector are read.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = cut(integers(vectors, ident, vector).where(F.size("x") > 0).withColumn("size", F.size("x")))
    kind = dict(rows.dtypes)[ident]
    schema = f"`{ident}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    names = out.columns
    for size in sorted(r[0] for r in rows.select("size").distinct().collect()):  # few
        own = rows.where(F.col("size") == size)
        fit = cut(own.select("x").distinct())
        of = Fit(fit, size, components)
        error = identity_error(fit, of)

        def run(batches: Iterator, of=of, error=error, size=size) -> Iterator:
            import pyarrow as pa

            k = of.onto.shape[1]
            step = max(1, 200_000 // max(1, k))
            wide = size * of.reach**2 >= 2**63
            for batch in (b for whole in batches for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step))):
                x = _matrix(batch.column(1), size)
                z = x - np.array(of.centre, np.int64)
                if wide:
                    exact = [sum((of.n * int(v) - r) ** 2 for v, r in zip(row, of.rest, strict=True)) for row in z]
                    deviation = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
                else:
                    y = of.n * z - np.array(of.rest, np.int64)
                    deviation = pa.array((y * y).sum(1))
                n = len(x)
                row = pa.array(np.repeat(np.arange(n), k))
                flat = lambda v: pa.array(np.tile(v, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), flat(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(n * k, of.n)), deviation.take(row), pa.array(of.scores(x).ravel()), flat(np.array(of.explained, float)), pa.array(np.full(n * k, error))], names)

        out = out.union(own.select(ident, "x").mapInArrow(run, schema))
    return out
