"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

1. Components become integers, x = floor(SCALE * c) + OFFSET. Sums and products are whole numbers; each task
   adds its own and Spark adds the tasks', in limbs of 40 bits, so nothing is rounded. The scatter is
   A = n * sum(x x') - S S', n * n times the covariance.
2. The characteristic polynomial of A is computed modulo many primes, a prime at a time in Spark's tasks: A
   is brought to Hessenberg form by elimination and a recurrence gives the coefficients. Chinese remaindering
   gives them whole, as their product exceeds twice a bound on any coefficient (of a matrix without negative
   eigenvalues the k-th is C(d, k) (trace / d)^k at most).
3. All roots are real, so the sign changes of p(t + a) count the roots above a (Descartes, exact here).
   Bisection by that count isolates the k-th root, by signs of p it then gets ROOT_BITS significant bits.
4. Each component spans the null space of A - e: inverse iteration in fixed-point integers with FIXED bits below
   e, next to the root by half of them, from as many starts as the root has multiplicity, made orthogonal.

Only what the dimension and the number of components bound (d * d sums, d coefficients, roots and
components) passes the driver. Rows are read three times, in Arrow batches, and never move.

Defined cases: a null vector, an empty one, or one with a null or non-finite component is left out; where
vectors differ in length, those of the most frequent one (the shortest on a tie) remain; entries of any finite size are
exact; ``deviation`` is null where a long can't hold it; components without variance have a null ``whitened`` and
``explained`` 0, and the identity is checked on the others; of a multiple root the components are some orthonormal basis;
repeated rows count as often; an empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LIMB = 40  # bits of a limb of a sum
ROOT_BITS = 256
FIXED = 384
ROWS = 2000  # rows in memory at once
CLOSE = 128  # roots that agree in so many bits are made orthogonal together


def valid(vector: str) -> Column:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


# --- integers of vectors ------------------------------------------------------------------


def whole(column: pa.ListArray, size: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c), scale a power of two, a row a vector: int64 where all are below 2^53, else Python integers."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    if c.size and np.abs(c).max() >= 2.0**53 / scale:
        return np.array([math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in c.flat], object).reshape(c.shape)
    return np.floor(c * scale).astype(np.int64)


def _fits(x: np.ndarray, factor: int) -> bool:
    """Whether sums of ``factor`` products of entries stay below 2^62."""
    return x.dtype != object and (x.size == 0 or int(np.abs(x).max()) ** 2 * factor < 1 << 62)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x, exact."""
    if _fits(x, len(x)):
        if int(np.abs(x).max(initial=0)) ** 2 * len(x) < 1 << 53:
            return (x.astype(float).T @ x.astype(float)).astype(np.int64)  # every partial sum is a whole double
        return x.T @ x
    x = x.astype(object)
    return x.T @ x


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _partial_sums(size: int):
    """A task's rows to (place, limb, value): place -1 counts, then sums, then products by rows of the triangle."""
    i, j = np.triu_indices(size)

    def run(batches):
        n, total, products = 0, np.zeros(size, object), np.zeros(len(i), object)
        for batch in _slices(batches):
            x = whole(batch.column(0), size)
            n += len(x)
            total = total + x.astype(object).sum(0) if x.dtype == object else total + x.sum(0).astype(object)
            products = products + _products(x)[i, j].astype(object)
        if not n:
            return
        place, limb, value = [-1], [0], [n]
        for at, v in enumerate([*total, *products]):
            v, k, sign = abs(int(v)), 0, -1 if v < 0 else 1
            while v:
                place.append(at)
                limb.append(k)
                value.append(sign * (v & ((1 << LIMB) - 1)))
                v, k = v >> LIMB, k + 1
        arrays = [pa.array(place, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["place", "limb", "value"])

    return run


def scatter(rows: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, A) of ``rows(vector)``, of the integers without OFFSET, which A does not depend on."""
    parts = rows.mapInArrow(_partial_sums(size), "place int, limb int, value long")
    got = parts.groupBy("place", "limb").agg(F.sum("value").alias("value")).collect()  # bounded by size * size
    n = sum(r.value for r in got if r.place < 0)
    flat = [0] * (size + size * (size + 1) // 2)
    for r in got:
        if r.place >= 0:
            flat[r.place] += r.value << LIMB * r.limb
    sums, it = flat[:size], iter(flat[size:])
    a = [[0] * size for _ in range(size)]
    for i in range(size):
        for j in range(i, size):
            a[i][j] = a[j][i] = n * next(it) - sums[i] * sums[j]
    return n, sums, a


# --- the characteristic polynomial --------------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2^31)."""
    small = np.ones(math.isqrt(top) + 2, bool)
    small[:2] = False
    for k in range(2, math.isqrt(len(small)) + 1):
        if small[k]:
            small[k * k :: k] = False
    divisors, out, high = np.flatnonzero(small), [], top
    while len(out) < count:
        low = max(2, high - (1 << 14))
        free = np.ones(high - low, bool)
        for q in divisors.tolist():
            free[max(-low % q, q * q - low if q * q >= low else 0) :: q] = False
        out += (np.flatnonzero(free)[::-1] + low).tolist()
        high = low
    return out[:count]


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """det(t - a) modulo a prime below 2^31, the coefficients of 1, t, t^2 ..."""
    h, d = a.astype(np.int64) % p, len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[at, k + 1]] = h[[k + 1, at]]
            h[:, [at, k + 1]] = h[:, [k + 1, at]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), p - 2, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    made = np.zeros((d + 1, d + 1), np.int64)  # row k: the polynomial of the leading k by k block
    made[0, 0] = 1
    for k in range(1, d + 1):
        made[k, 1:] = made[k - 1, :-1]
        made[k] = (made[k] - h[k - 1, k - 1] * made[k - 1]) % p
        through = 1
        for i in range(k - 1, 0, -1):
            through = through * int(h[i, i - 1]) % p
            if not through:
                break
            made[k] = (made[k] - int(h[i - 1, k - 1]) * through % p * made[i - 1]) % p
    return made[d].tolist()


def polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """det(t - a) of a symmetric integer matrix without negative eigenvalues: coefficients of 1, t, t^2 ..."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    bound = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes = primes_below(1 << 31, 2 + bound.bit_length() // 30)

    def run(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                p = primes[at]
                got = polynomial_mod(np.array([[x % p for x in row] for row in a]), p)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([got], pa.list_(pa.int64()))], names=["at", "c"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    got = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "at long, c array<long>").collect()
    whole_ = math.prod(primes)
    out = [0] * (d + 1)
    for r in got:
        p = primes[r.at]
        part = whole_ // p
        part *= pow(part, -1, p)
        for k, c in enumerate(r.c):
            out[k] += c * part
    return [x - whole_ if (x := c % whole_) > whole_ // 2 else x for c in out]


# --- roots and components -----------------------------------------------------------------


def roots_above(p: list[int], m: int, s: int) -> int:
    """How many roots of p, all of which are real, exceed m / 2^s: sign changes of p(t + m / 2^s)."""
    d = len(p) - 1
    c = [x << s * (d - k) for k, x in enumerate(p)]
    if m:
        for i in range(d):
            for k in range(d - 1, i - 1, -1):
                c[k] += m * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(p: list[int], m: int, s: int) -> int:
    value, d = 0, len(p) - 1
    for k in range(d, -1, -1):
        value = value * m + (p[k] << s * (d - k))
    return (value > 0) - (value < 0)


def root(p: list[int], k: int, trace: int) -> tuple[int, int]:
    """The k-th largest root (from 1, with multiplicity) as m, s: it is 0, or in ((m - 1) / 2^s, m / 2^s]."""
    between = roots_above(p, 0, 0)
    if between < k:
        return 0, 0
    low, high, s, above_high = 0, 1 << trace.bit_length(), 0, 0
    while high - low > 1 or high.bit_length() <= ROOT_BITS:
        if high - low == 1:
            low, high, s = low * 2, high * 2, s + 1
        mid = (low + high) // 2
        if between == 1:  # p has one sign between the root and high
            at, end = _sign(p, mid, s), _sign(p, high, s)
            if at == 0 or at == end:
                high = mid
            else:
                low = mid
            continue
        above = roots_above(p, mid, s)
        if above >= k:
            low, between = mid, above - above_high
        else:
            high, between, above_high = mid, between - above + above_high, above
    return high, s


def components(a: list[list[int]], m: int, s: int, trace: int, multiplicity: int) -> list[list[float]]:
    """An orthonormal basis of the null space of a - m / 2^s, of ``multiplicity`` vectors."""
    d, more = len(a), max(0, trace.bit_length() - max(1, m >> s).bit_length())
    bits = FIXED + more  # of what is below the trace
    near = ((m << bits) // trace >> s) + (1 << FIXED // 2)  # half the bits off the root, so that nothing is singular
    lu = np.array([[(x << bits) // trace for x in row] for row in a], object)
    lu[range(d), range(d)] -= near
    order = list(range(d))
    for k in range(d):
        at = max(range(k, d), key=lambda i: abs(lu[i, k]))
        if at != k:
            lu[[k, at]] = lu[[at, k]]
            order[k], order[at] = order[at], order[k]
        lu[k, k] = lu[k, k] or 1
        lu[k + 1 :, k] = (lu[k + 1 :, k] << bits) // lu[k, k]
        lu[k + 1 :, k + 1 :] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 :]) >> bits

    def solved(b: np.ndarray) -> np.ndarray:
        b = b[order]
        for k in range(d - 1):
            b[k + 1 :] -= lu[k + 1 :, k] * b[k] >> bits
        for k in range(d - 1, -1, -1):
            b[k] = (b[k] << bits) // lu[k, k]
            b[:k] -= lu[:k, k] * b[k] >> bits
        return unit(b)

    def unit(b: np.ndarray) -> np.ndarray:
        top = max(map(abs, b.tolist())) or 1
        b = np.array([(x << bits) // top for x in b.tolist()], object)
        return np.array([(x << bits) // math.isqrt(sum(y * y for y in b.tolist())) for x in b.tolist()], object)

    chance, basis = random.Random(d), []
    for _ in range(multiplicity):
        b = np.array([chance.randrange(-1 << bits, 1 << bits) for _ in range(d)], object)
        for _ in range(3):
            b = solved(b)
            for other in basis:
                b = b - (other * (sum((b * other).tolist()) >> bits) >> bits)
            b = unit(b)
        largest = max(range(d), key=lambda i: abs(b[i]))
        basis.append(b if b[largest] > 0 else -b)
    return [[x / (1 << bits) for x in b.tolist()] for b in basis]


def _float_root(m: int, s: int) -> float:
    """The square root of m / 2^s."""
    more = 128 + s % 2
    return math.isqrt(m << more) / (1 << (s + more) // 2)


def spectrum(spark: SparkSession, a: list[list[int]], count: int) -> list[tuple[float, float, list[float]]]:
    """(square root of the eigenvalue, the eigenvalue's share of the trace, unit vector) of the ``count`` largest
    eigenvalues of a, without zeros."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    if not trace:
        return []
    p = polynomial(spark, a)
    count = min(count, d, roots_above(p, 0, 0))
    most = min(d, count + 1)  # one more, to see whether the last shares its value
    tasks = min(most, spark.sparkContext.defaultParallelism)

    def found(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                m, s = root(p, k, trace)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([str(m)]), pa.array([s])], names=["k", "m", "s"])

    roots = {r.k: (int(r.m), r.s) for r in spark.range(1, most + 1, 1, tasks).mapInArrow(found, "k long, m string, s long").collect()}
    groups = [[1]]
    for k in range(2, most + 1):
        (x, s), (y, t) = roots[k - 1], roots[k]
        if ((x << t) - (y << s)) << CLOSE <= x << t:
            groups[-1].append(k)
        elif k <= count:
            groups.append([k])

    def spanned(batches):
        for batch in batches:
            for g in batch.column(0).to_pylist():
                for k, v in zip(groups[g], components(a, *roots[groups[g][0]], trace, len(groups[g]))):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v], pa.list_(pa.float64()))], names=["k", "v"])

    vectors = {r.k: r.v for r in spark.range(0, len(groups), 1, tasks).mapInArrow(spanned, "k long, v array<double>").collect()}
    return [(_float_root(*roots[k]), roots[k][0] / (trace << roots[k][1]), vectors[k]) for k in range(1, count + 1)]


# --- whitened rows ------------------------------------------------------------------------


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    if x.dtype != object and (x.size == 0 or int(np.abs(x).max()) * n < 1 << 62) and max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(x: np.ndarray) -> list[int | None]:
    if _fits(x, x.shape[1] if x.ndim > 1 else 1):
        return (x * x).sum(1).tolist()
    return [v if (v := sum(int(e) ** 2 for e in row)) < 1 << 63 else None for row in x]


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, least: int = 1
) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row for each remaining row of
    ``df`` and each of the first ``components`` components. ``least``: rows without which nothing is fitted."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.filter(valid(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    first = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if first is None or first["count"] < least:
        return spark.createDataFrame([], out)
    size, count = first.size, min(components, first.size)
    rows = rows.filter(F.size("vector") == size)
    n, sums, a = scatter(rows.select("vector"), size)
    found = spectrum(spark, a, count)
    axes = np.array([v for _, _, v in found]).reshape(len(found), size).T / np.array([e for e, _, _ in found])

    def projected(column) -> tuple[np.ndarray, np.ndarray]:
        far = _deviations(whole(column, size), n, sums)
        return far, far.astype(float) @ axes  # (x - S / n) . v / sqrt(e / (n * n))

    i, j = np.triu_indices(len(found))

    def moments(batches):
        total, products = np.zeros(len(found)), np.zeros(len(i))
        for batch in _slices(batches):
            w = projected(batch.column(0))[1]
            total += w.sum(0)
            products += (w.T @ w)[i, j]
        both = [*total, *products]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), pa.int32()), pa.array(both, pa.float64())], names=["place", "value"])

    error = 0.0
    if found:
        got = {r.place: r.value / n for r in rows.select("vector").mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}
        mean = np.array([got[k] for k in range(len(found))])
        cov = np.array([got[len(found) + k] for k in range(len(i))]) - mean[i] * mean[j]  # w is centred already, so mean is 0 but for rounding
        error = float(np.abs(cov - (i == j)).max())
    shares = [share for _, share, _ in found] + [0.0] * (count - len(found))

    def run(batches):
        for batch in _slices(batches):
            far, w = projected(batch.column(1))
            some = batch.num_rows
            each = np.repeat(np.arange(some), count)
            w = np.hstack([w, np.full((some, count - len(found)), np.nan)]).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), some)),
                    pa.array(np.full(len(each), n)),
                    pa.array(_squares(far), pa.int64()).take(pa.array(each)),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(shares, some)),
                    pa.array(np.full(len(each), error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, out)
