"""Embedding whitening by an exact characteristic polynomial.

Entries become integers, so the scatter matrix A = n * sum(x x') - S S' (n^2 times the covariance) is an exact integer
matrix, summed in Spark. Its characteristic polynomial is found modulo many primes by Hessenberg reduction, one task a
few primes, and put together by Chinese remaindering. All its roots are real, so the number of roots above any
rational point is the number of sign changes of the shifted polynomial; that isolates the largest roots, which are then
halved down to the wanted precision by the polynomial's sign. A component spans the null space of A - e I and is found
by inverse iteration in fixed-point integers. Only the d x d matrix, its polynomial and the components are on the
driver; vectors never leave their tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subpanel.llm.common import map_arrow, prepare, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of an eigenvalue behind its first one, and of the fixed-point numbers of the inverse iteration.
ROOT_BITS, WORK_BITS = 160, 256
PRIMES_PER_TASK = 8
#: Entries from this size on have no integer in range.
LARGEST = float((1 << 62) // SCALE)
LIMB = 1 << 64
#: Deviations from this size on do not fit 38 digits.
MOST = 10 ** 38


# --- scatter --------------------------------------------------------------------------------

def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) of the entries."""
    return np.floor(vectors * SCALE).astype(np.int64)


def products(x: np.ndarray) -> np.ndarray:
    """x' x, exact: as floating point where every partial sum is below 2^53, else in Python integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * max(1, len(x)) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = x.astype(object)
    return o.T.dot(o)


def usable(vectors: str) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite and have an integer in range."""
    v = F.col(vectors)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)), F.lit(False))


def batch_matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def scatter(rows: DataFrame, vectors: str, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums of the shifted entries, and n^2 times their covariance, all exact.

    A task gives its partial sums, d (d + 3) / 2 + 1 numbers, which are added in Spark.
    """
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, prods = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = whole_numbers(batch_matrix(batch.column(0).slice(at, 4096), dims))
                n, sums = n + len(x), sums + x.astype(object).sum(axis=0) if len(x) else sums
                prods = prods + products(x)
        if n:
            found = [(-1, -1, n), *((-1, j, v) for j, v in enumerate(sums)),
                     *((i, j, prods[i, j]) for i in range(dims) for j in range(i, dims))]
            cols = zip(*((i, j, Decimal(int(v) // LIMB), Decimal(int(v) % LIMB)) for i, j, v in found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    parts = map_arrow(rows.select(vectors), run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    summed = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    total = {(r["i"], r["j"]): int(r["high"]) * LIMB + int(r["low"]) for r in summed.collect()}
    n = total.get((-1, -1), 0)
    sums = [total.get((-1, j), 0) for j in range(dims)]
    matrix = np.zeros((dims, dims), object)
    for i in range(dims if n else 0):
        for j in range(i, dims):
            matrix[i, j] = matrix[j, i] = n * total[i, j] - sums[i] * sums[j]
    # The shift moves the sums only.
    return n, [s + n * SHIFT for s in sums], matrix


# --- characteristic polynomial --------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Exact below 3 * 10^24 by these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37) if n != p):
        return False
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        if a % n == 0:
            continue
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31, the largest first, with a product of more than `bits` bits."""
    out, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - A) modulo p, the constant one first: Hessenberg form, then its recurrence."""
    h, d = matrix.copy() % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = int(below[0]) + k + 1
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1] % p) % p
        # The inverse step adds the columns to column k + 1; one product at a time stays below 2^62.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factors % p).sum(axis=1)) % p
    polys = [np.ones(1, np.int64)]
    for m in range(d):
        new = np.zeros(m + 2, np.int64)
        new[1:] = polys[m]
        new[:-1] = (new[:-1] - polys[m] * h[m, m]) % p
        t = 1
        for i in range(1, m + 1):
            t = t * int(h[m - i + 1, m - i]) % p
            if not t:
                break
            f = t * int(h[m - i, m]) % p
            new[:m - i + 1] = (new[:m - i + 1] - polys[m - i] * f) % p
        polys.append(new % p)
    return polys[d].tolist()


def coefficient_bits(matrix: np.ndarray) -> int:
    """Bits that hold every coefficient of the polynomial of a positive semidefinite matrix.

    Coefficients are sums of products of eigenvalues, so below (1 + trace / d)^d by the means.
    """
    d, trace = len(matrix), sum(int(matrix[i, i]) for i in range(len(matrix)))
    return d * (trace // max(d, 1) + 2).bit_length() + 2


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(x I - A), the constant one first; the primes are dealt over tasks."""
    d = len(matrix)
    primes = primes_for(coefficient_bits(matrix) + 1)
    entries = [[int(v) for v in row] for row in matrix]
    schema = pa.schema([("p", pa.int64()), ("c", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                reduced = np.array([[v % p for v in row] for row in entries], np.int64).reshape(d, d)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([polynomial_mod(reduced, p)], schema[1].type)], schema=schema)

    tasks = -(-len(primes) // PRIMES_PER_TASK)
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    found = {r["p"]: r["c"] for r in map_arrow(dealt, run, "p long, c array<long>").collect()}
    return remaindering(primes, [found[p] for p in primes])


def remaindering(primes: Sequence[int], rests: Sequence[Sequence[int]]) -> list[int]:
    """Integers of least size with the given rests, by the Chinese remainder theorem, halves first."""
    if len(primes) == 1:
        product, values = primes[0], list(rests[0])
    else:
        level = [(p, list(r)) for p, r in zip(primes, rests)]
        while len(level) > 1:
            after = []
            for k in range(0, len(level) - 1, 2):
                (p, a), (q, b) = level[k], level[k + 1]
                inverse = pow(p, -1, q)
                after.append((p * q, [x + p * ((y - x) * inverse % q) for x, y in zip(a, b)]))
            level = after + level[len(level) - len(level) % 2:]
        product, values = level[0]
    return [v - product if 2 * v > product else v for v in values]


# --- roots ----------------------------------------------------------------------------------

def roots_above(poly: Sequence[int], point: Fraction) -> int:
    """Roots greater than a rational point, with multiplicity: sign changes of the polynomial shifted there.

    That number is exact because all roots are real.
    """
    q, d = point.denominator, len(poly) - 1
    shifted = [c * q ** (d - i) for i, c in enumerate(poly)]  # roots times q
    a = point.numerator
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            shifted[j] += a * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_at(poly: Sequence[int], a: int, shift: int) -> int:
    """The polynomial at a / 2^shift, times a positive number."""
    total, power = 0, 0
    for c in reversed(poly):
        total = total * a + (c << power)
        power += shift
    return total


def largest_roots(poly: Sequence[int], count: int, bits: int = ROOT_BITS) -> list[Fraction]:
    """The `count` largest positive roots, the largest first, repeated as often as they occur.

    Each is the middle of an interval of less than 2^-bits of its size that holds it; equal roots have equal intervals.
    """
    positive = roots_above(poly, Fraction(0))
    top = 1 << max((abs(c).bit_length() for c in poly), default=1)
    high = Fraction(top)
    out: list[Fraction] = []
    # (low, high, roots above low, roots above high), the highest interval last.
    todo = [(Fraction(0), high, positive, 0)] if positive else []
    while todo and len(out) < min(count, positive):
        low, high, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1 and low > 0:
            out.append(halved(poly, low, high, bits))
            continue
        if low > 0 and (high - low) * (1 << bits) < low:  # equal, or as good as equal
            out.extend([(low + high) / 2] * inside)
            continue
        middle = (low + high) / 2 if low > 0 or high <= 1 else Fraction(1 << (math.floor(high).bit_length() // 2))
        if low == 0 and middle >= high:
            middle = high / 2
        above = roots_above(poly, middle)
        todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return out[:count]


def halved(poly: Sequence[int], low: Fraction, high: Fraction, bits: int) -> Fraction:
    """Middle of an interval that holds the one root above low and up to high, halved by the polynomial's sign."""
    shift = max((low.denominator - 1).bit_length(), (high.denominator - 1).bit_length())
    a, b = int(low * (1 << shift)), int(high * (1 << shift))
    over = value_at(poly, b, shift)
    if over == 0:
        return high
    while (b - a) << bits >= a:
        if b - a < 2:
            a, b, shift = a << 16, b << 16, shift + 16
        middle = (a + b) // 2
        here = value_at(poly, middle, shift)
        if here == 0:
            return Fraction(middle, 1 << shift)
        a, b = (a, middle) if (here > 0) == (over > 0) else (middle, b)
    return Fraction(a + b, 2 << shift)


# --- components -----------------------------------------------------------------------------

class FixedPoint:
    """LU of A - e I in fixed-point integers, A divided by its trace, rows exchanged by the largest pivot."""

    def __init__(self, matrix: np.ndarray, root: Fraction, trace: int, bits: int = WORK_BITS):
        self.bits, d = bits, len(matrix)
        m = np.array([[(int(v) << bits) // trace for v in row] for row in matrix], object).reshape(d, d)
        for i in range(d):
            m[i, i] -= (root.numerator << bits) // (root.denominator * trace)
        self.order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda r: abs(m[r, k]))
            if best != k:
                m[[k, best]] = m[[best, k]]
                self.order[k], self.order[best] = self.order[best], self.order[k]
            if m[k, k] == 0:  # the root is exact: the smallest number stands for it
                m[k, k] = 1
            factors = np.array([(v << bits) // m[k, k] for v in m[k + 1:, k]], object)
            if len(factors):
                m[k + 1:, k + 1:] -= (factors[:, None] * m[k, k + 1:]) >> bits
                m[k + 1:, k] = factors
        self.m = m

    def solve(self, v: np.ndarray) -> np.ndarray:
        m, bits, d = self.m, self.bits, len(self.m)
        y = np.array([v[r] for r in self.order], object)
        for k in range(d):
            y[k] -= int((m[k, :k] * y[:k]).sum()) >> bits if k else 0
        for k in range(d - 1, -1, -1):
            rest = int((m[k, k + 1:] * y[k + 1:]).sum()) >> bits if k < d - 1 else 0
            y[k] = ((y[k] - rest) << bits) // m[k, k]
        return self.unit(y)

    def unit(self, v: np.ndarray) -> np.ndarray:
        length = math.isqrt(int((v * v).sum()))
        return np.array([(int(x) << self.bits) // max(length, 1) for x in v], object)

    def without(self, v: np.ndarray, others: Sequence[np.ndarray]) -> np.ndarray:
        for o in others:
            v = v - ((int((v * o).sum()) >> self.bits) * o >> self.bits)
        return self.unit(v)


def components(matrix: np.ndarray, roots: Sequence[Fraction], rounds: int = 3) -> np.ndarray:
    """A unit eigenvector a row, to double precision. Equal roots get orthogonal vectors of their null space."""
    d, trace = len(matrix), sum(int(matrix[i, i]) for i in range(len(matrix)))
    rng, found, out = np.random.default_rng(13), [], []
    for k, root in enumerate(roots):
        lu = FixedPoint(matrix, root, trace)
        alike = [f for f, r in zip(found, roots) if r == root]
        v = lu.unit(np.array([int(x) for x in rng.integers(1, 1 << 30, d)], object))
        for _ in range(rounds):
            v = lu.without(lu.solve(v), alike)
        found.append(v)
        one = np.array([float(Fraction(int(x), 1 << lu.bits)) for x in v])
        out.append(-one if one[np.argmax(np.abs(one))] < 0 else one)
    return np.array(out).reshape(len(out), d)


class Whitening:
    """Fitted transformation: n, shifted sums S, components and their eigenvalues over the integer entries."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, eigenvalues: list[float], explained: list[float]):
        self.n, self.sums, self.vectors, self.eigenvalues, self.explained = n, sums, vectors, eigenvalues, explained


def fit(rows: DataFrame, vectors: str, dims: int, count: int = COMPONENTS) -> Whitening:
    """Largest components of the covariance of all rows (divisor n). Directions without variance are none."""
    n, sums, matrix = scatter(rows, vectors, dims)
    trace = sum(int(matrix[i, i]) for i in range(dims))
    if not n or not trace:
        return Whitening(n, sums, np.zeros((0, dims)), [], [])
    common = math.gcd(*(int(v) for row in matrix for v in row))  # smaller numbers, the same vectors
    matrix = np.array([[int(v) // common for v in row] for row in matrix], object).reshape(dims, dims)
    roots = largest_roots(characteristic_polynomial(rows.sparkSession, matrix), min(count, dims))
    return Whitening(n, sums, components(matrix, roots), [float(r * common / (n * n)) for r in roots],
                     [float(r * common / trace) for r in roots])


def dimension(rows: DataFrame, vectors: str) -> int:
    """The length that most vectors have, the larger one on ties; 0 without vectors."""
    top = rows.groupBy(F.size(vectors).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def whiten(table: DataFrame, id_column: str = "vec_id", vectors: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Rows of _id, deviation (decimal, null beyond 38 digits) and whitened, up to `count` values, largest component first.

    Vectors that are null or hold null or non-finite entries take no part, nor do those with an entry too large for a
    long integer, empty ones, and those of another length than most (the larger length on ties). Repeated rows and rows without id count and come back each. With fewer directions of
    variance than `count` the array is shorter; one vector, equal vectors or an empty table give empty arrays or no
    rows. Other columns are not read.
    """
    rows, dims = usable_rows(table, id_column, vectors)
    return whiten_with(rows, fit(rows, "_vector", dims, count), dims)


def usable_rows(table: DataFrame, id_column: str, vectors: str) -> tuple[DataFrame, int]:
    """Stored (_id, _vector) of the vectors that take part, and their length."""
    prepare(table.sparkSession)
    rows = table.select(F.col(id_column).cast("long").alias("_id"), F.col(vectors).cast("array<double>").alias("_vector"))
    rows = rows.where(usable("_vector"))
    dims = dimension(rows, "_vector")
    return rows.where(F.size("_vector") == dims), dims


def whiten_with(rows: DataFrame, model: Whitening, dims: int) -> DataFrame:
    """(_id, deviation, whitened) of usable rows under a fitted model."""
    schema = pa.schema([("_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
    n, sums, vectors, roots = model.n, model.sums, model.vectors, np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.array([s - n * SHIFT for s in sums], object)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = whole_numbers(batch_matrix(some.column(1), dims))
                fits = n * int(np.abs(x).max(initial=0)) + max(map(abs, shift.tolist()), default=0) < 1 << 62
                off = x * n - shift.astype(np.int64) if fits else x.astype(object) * n - shift
                if fits and int(np.abs(off).max(initial=0)) ** 2 * dims < 1 << 63:
                    deviation = (off * off).sum(axis=1).tolist()
                else:
                    deviation = (off.astype(object) ** 2).sum(axis=1).tolist()
                white = (off / n).astype(np.float64) @ vectors.T / roots if len(roots) else np.zeros((len(x), 0))
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.array([Decimal(int(v)) if v < MOST else None for v in deviation], schema[1].type),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(roots), pa.int32()), pa.array(white.ravel()))], schema=schema)

    return map_arrow(rows, run, "_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, count: int) -> float | None:
    """Largest absolute entry of the covariance of whitened values (divisor n, centred first) minus the identity."""
    if not count:
        return None
    at = [F.element_at("whitened", i + 1) for i in range(count)]
    means = white.agg(*[F.avg(a).alias(f"m{i}") for i, a in enumerate(at)]).first()
    if means["m0"] is None:
        return None
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    found = white.agg(*[F.avg((at[i] - means[i]) * (at[j] - means[j])).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
    return max(abs(found[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def components_of(table: DataFrame, id_column: str = "vec_id", vectors: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    As `whiten`; vectors without any component give no rows.
    """
    rows, dims = usable_rows(table, id_column, vectors)
    model = fit(rows, "_vector", dims, count)
    white = written(whiten_with(rows, model, dims), "whitened")
    error = identity_error(white, len(model.eigenvalues))
    share = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    return white.select(F.col("_id").alias(id_column), "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        id_column, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
