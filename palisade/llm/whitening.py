"""Embedding whitening by spectrum slicing.

Spark sums the vectors (as whole numbers) and then the products of what is left of them
after the mean; both sums are exact. What is small, a covariance of dimension squared, is
cut by shifts: an LDL' factorisation of covariance minus shift has as many positive pivots
as there are eigenvalues above the shift (Sylvester). Bisection by these counts gives each
leading eigenvalue an interval of its own; Rayleigh quotient iteration, whose solves use the
same factorisation, converges inside it; counts on both sides of the result certify which
eigenvalue it is. Rows are then projected where they lie.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite entry are
dropped, as are those of another dimension than most have (of equally many, the larger
one counts). Entries from 2^30 on count as 2^30. Components whose eigenvalue is zero to
rounding do not exist: equal vectors, or a single one, give no rows, and there are at most as
many components as dimensions. Of equal eigenvalues any orthonormal basis is as right as
another. A deviation beyond 64 bits is null, deviation_exact has it to 38 digits. Repeated rows
count as often as they occur; other columns stay, those named like a result are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import fresh, without, written

#: Whole numbers are floor(SCALE * entry) + OFFSET; entries are held within LARGEST.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**30
COMPONENTS = 8
#: Tasks that sum products: each sends on dimension squared numbers, so more rows to a task
#: is less to shuffle.
SUMMING_TASKS = 2048

RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact")
LONG = 1 << 63


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(dimension of each row, 0 if it is dropped; for each dimension its rows and x)."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    entries = column.flatten()
    values = np.asarray(entries.fill_null(np.nan))
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    size = np.where(bad[ends] > bad[ends - size], 0, size)
    begins = ends - np.asarray(column.value_lengths().fill_null(0))
    out = []
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        found = values[begins[rows][:, None] + np.arange(d)]
        out.append((rows, np.floor(SCALE * np.clip(found, -LARGEST, LARGEST)).astype(np.int64) + OFFSET))
    return size, out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, i, rows, sum of x_i) of a task."""
    total: dict[int, list] = {}
    for batch in batches:
        for _, x in whole_numbers(batch.column(0))[1]:
            n, s = total.get(x.shape[1], (0, 0))
            total[x.shape[1]] = (n + len(x), s + x.sum(axis=0).astype(object))
    for d, (n, s) in total.items():
        columns = [pa.repeat(pa.scalar(d, pa.int32()), d), pa.array(np.arange(d, dtype=np.int32)), pa.repeat(pa.scalar(n, pa.int64()), d)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(map(Decimal, s), pa.decimal128(38))], ["d", "i", "n", "s"])


def products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers below 2^42, exactly, as Python integers: by floating-point products
    that stay below 2^53, in halves of 21 bits where the numbers are large."""
    top = int(np.abs(y).max(initial=0))
    if top < 1 << 20:
        step, out = max(1, (1 << 53) // max(1, top * top)), 0
        for k in range(0, len(y), step):
            part = y[k : k + step].astype(float)
            out = out + (part.T @ part).astype(np.int64).astype(object)
        return out
    high, low, out = (y >> 21).astype(float), (y & ((1 << 21) - 1)).astype(float), 0
    for k in range(0, len(y), 1 << 10):
        h, l = high[k : k + 1024], low[k : k + 1024]  # noqa: E741
        hh, hl, ll = (m.astype(np.int64).astype(object) for m in (h.T @ h, h.T @ l, l.T @ l))
        out = out + (hh << 42) + ((hl + hl.T) << 21) + ll
    return out


def _products(shift: list[int]):
    d, minus = len(shift), np.array(shift, np.int64)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(i, j, sum of (x_i - shift_i)(x_j - shift_j)) of a task, j from i on."""
        out = 0
        for batch in batches:
            for _, x in whole_numbers(batch.column(0))[1]:
                if x.shape[1] == d:
                    out = out + products(x - minus)
        if isinstance(out, np.ndarray):
            i, j = np.triu_indices(d)
            columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(map(Decimal, out[i, j]), pa.decimal128(38))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "s"])

    return total


class Factored:
    """P A P' = L D L' of a symmetric matrix, with D of blocks of one or two (complete pivoting)."""

    def __init__(self, matrix: np.ndarray):
        a, d = matrix.copy(), len(matrix)
        self.order, self.blocks, self.columns, k = np.arange(d), [], [], 0
        least = np.finfo(a.dtype).eps * np.abs(a).max() or a.dtype.type(1)
        while k < d:
            rest = np.abs(a[k:, k:])
            diagonal = np.diagonal(rest)
            r = int(diagonal.argmax())
            largest = diagonal[r]
            np.fill_diagonal(rest, 0)
            p, q = divmod(int(rest.argmax()), d - k)
            # (1 + sqrt(17)) / 8 bounds the growth of entries.
            width = 1 if largest >= 0.6403882032022076 * rest[p, q] else 2
            for place, wanted in zip((k, k + 1), (k + r,) if width == 1 else sorted((k + p, k + q))):
                for x in (a, a.T):
                    x[[place, wanted]] = x[[wanted, place]]
                for column in self.columns:
                    column[[place, wanted]] = column[[wanted, place]]
                self.order[[place, wanted]] = self.order[[wanted, place]]
            block = a[k : k + width, k : k + width].copy()
            if width == 1 and block[0, 0] == 0:
                block[0, 0] = least  # all that is left is zero: a shift at an eigenvalue
            below = a[k + width :, k : k + width]
            column = np.zeros((d, width), a.dtype)
            column[k + width :] = below @ inverse(block)
            a[k + width :, k + width :] -= column[k + width :] @ below.T
            self.blocks.append((k, block))
            self.columns.append(column)
            k += width

    def positive(self) -> int:
        """Positive eigenvalues of the matrix. A block of two has one."""
        return sum(1 if len(b) == 2 else int(b[0, 0] > 0) for _, b in self.blocks)

    def solve(self, v: np.ndarray) -> np.ndarray:
        w = v[self.order].copy()
        for (k, block), column in zip(self.blocks, self.columns):
            w = w - column @ w[k : k + len(block)]
        for k, block in self.blocks:
            w[k : k + len(block)] = inverse(block) @ w[k : k + len(block)]
        for (k, block), column in zip(reversed(self.blocks), reversed(self.columns)):
            w[k : k + len(block)] -= column.T @ w
        out = np.empty_like(w)
        out[self.order] = w
        return out


def inverse(block: np.ndarray) -> np.ndarray:
    if len(block) == 1:
        return 1 / block
    (a, b), (_, c) = block
    return np.array([[c, -b], [-b, a]], block.dtype) / (a * c - b * b)


def _shifted(matrix: np.ndarray, shift) -> np.ndarray:
    out = matrix.copy()
    out[np.diag_indices(len(out))] -= shift
    return out


def leading(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues above zero, falling, and their unit eigenvectors as rows.

    covariance is in extended precision; counts need no more than double precision."""
    d, plain = len(covariance), covariance.astype(float)
    eps = float(np.finfo(float).eps)
    norm = float(np.abs(plain).sum(axis=1).max())
    near = 4 * d * eps * norm  # eigenvalues closer than this are one cluster
    counted: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counted:
            counted[shift] = Factored(_shifted(plain, shift)).positive()
        return counted[shift]

    values, vectors = [], []
    top = norm * (1 + d * eps) + near
    for k in range(1, min(most, above(near)) + 1 if norm else 1):
        # The tightest shifts known with at least k, and with fewer than k, above them.
        low = max(s for s, c in {**counted, near: above(near)}.items() if c >= k)
        high = min([top, *(s for s, c in counted.items() if c < k)])
        rng, found = np.random.default_rng(k), None
        while found is None:
            while (above(low) != k or (high != top and above(high) != k - 1)) and high - low > near:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= k else (low, middle)
            found = _iterate(covariance, low, high, rng.standard_normal(d), vectors, near)
            if found is None:  # it ran to another eigenvalue: a tighter interval
                if high - low <= near:
                    raise ArithmeticError(f"eigenvalue {k} did not converge")
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= k else (low, middle)
        value, vector = found
        if above(float(value) - near) < k or above(float(value) + near) >= k:
            raise ArithmeticError(f"eigenvalue {k} is not certified by the counts beside it")
        values.append(value)
        vectors.append(vector)
    return np.array(values, np.longdouble), np.array(vectors, np.longdouble).reshape(len(vectors), d)


def _iterate(matrix: np.ndarray, low: float, high: float, start: np.ndarray, known: list[np.ndarray], near: float):
    """(eigenvalue, eigenvector) in the interval by Rayleigh quotient iteration, None if it leaves it."""

    def unit(v):
        for u in known:  # for clusters; otherwise what is taken away is rounding
            v = v - (u @ v) * u
        return v / np.sqrt(v @ v)

    v, middle = unit(start.astype(np.longdouble)), Factored(_shifted(matrix, (low + high) / 2))
    for _ in range(4):
        v = unit(middle.solve(v))
    value, last = v @ matrix @ v, np.inf
    for _ in range(40):
        residual = matrix @ v - value * v
        size = float(np.sqrt(residual @ residual))
        if size <= near * 1e-3 and size >= last / 4:
            break
        last = size
        v = unit(Factored(_shifted(matrix, value)).solve(v))
        value = v @ matrix @ v
    slack = near if high - low <= near else 0
    return (value, v) if last < near and low - slack <= value <= high + slack else None


@dataclass
class Whitener:
    """The fitted transform: n vectors with sums, and eigenvalues and -vectors (as rows)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def shift(self) -> list[int]:
        """The mean to the next whole number."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of whole numbers."""
        left = np.array([s - self.n * m for s, m in zip(self.sums, self.shift)], np.longdouble) / self.n
        y = x - np.array(self.shift, np.int64)
        scaled = (self.vectors / np.sqrt(self.values)[:, None]).astype(float)
        return (y - left.astype(float)) @ scaled.T

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n x - S)^2) of each row, exactly: n x - S is n y - r with y = x - shift."""
        y, r = x - np.array(self.shift, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, self.shift)], object)
        top, d = int(np.abs(y).max(initial=0)), len(self.sums)
        if d * top * top >= LONG or d * top * max(map(abs, r.tolist())) >= LONG:
            y = y.astype(object)
        else:
            r = r.astype(np.int64)
        squares, mixed = (y * y).sum(axis=1).astype(object), (y @ r).astype(object)
        return (self.n * self.n * squares - 2 * self.n * mixed + sum(int(v) ** 2 for v in r)).tolist()


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """Fitted on all rows; None if no row is left. The driver gets dimension squared sums."""
    only = vectors.select(F.col(f"`{column}`").alias("embedding")).coalesce(SUMMING_TASKS)
    sums = only.mapInArrow(_sums, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = sums.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))
    best = most.orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    model = Whitener(best["n"], [int(x["s"]) for x in best["s"]], np.zeros(0), np.zeros((0, best["d"])), 0.0)
    n, d, m = model.n, best["d"], model.shift
    r = [s - n * k for s, k in zip(model.sums, m)]
    covariance = np.zeros((d, d), np.longdouble)
    for i, j, s in only.mapInArrow(_products(m), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s")).toLocalIterator():
        # Of vectors centred on a whole number; what is left of the mean is taken away exactly.
        whole, rest = divmod(n * int(s) - r[i] * r[j], n * n)
        covariance[i, j] = covariance[j, i] = np.longdouble(whole) + np.longdouble(rest) / np.longdouble(n * n)
    model.trace = float(np.trace(covariance))
    if model.trace > 0:
        model.values, model.vectors = leading(covariance, components)
    return model


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, rows, sum of products of whitened components i and j; of component i where j is -1)."""
    n, first, second = 0, 0.0, 0.0
    for batch in batches:
        w = np.asarray(batch.column(0).flatten()).reshape(len(batch.column(0)), -1)
        n, first, second = n + len(w), first + w.sum(axis=0), second + w.T @ w
    if n:
        d = len(first)
        i, j = np.indices((d, d)).reshape(2, -1)
        i, j, s = np.concatenate([np.arange(d), i]), np.concatenate([np.full(d, -1), j]), np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.repeat(pa.scalar(n, pa.int64()), len(i)), pa.array(s)], ["i", "j", "n", "s"])


def identity_error(whitened: DataFrame) -> float:
    """The largest entry of the covariance of an array column of centred components, minus the identity."""
    rows = whitened.coalesce(SUMMING_TASKS).mapInArrow(_squares, "i int, j int, n long, s double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    mean = {r["i"]: r["s"] / r["n"] for r in rows if r["j"] < 0}
    return max((abs(r["s"] / r["n"] - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows if r["j"] >= 0), default=0.0)


def whiten(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each kept row of df and component, with RESULTS; the vector itself leaves."""
    rows = without(df, *(c for c in RESULTS if c.lower() != column.lower()))
    model = fit(df, column, components)
    others = [F.col(f"`{c}`") for c in rows.columns if c.lower() != column.lower()]
    d = len(model.sums) if model else 0
    fields = T.StructType.fromDDL("whitened array<double>, deviation bigint, deviation_exact decimal(38,0)")

    @F.arrow_udf(fields)
    def project(vectors: pa.Array) -> pa.Array:
        size, found = whole_numbers(vectors)
        whitened, exact = [None] * len(size), [None] * len(size)
        for at, x in found:
            if x.shape[1] == d:
                for k, w, e in zip(at.tolist(), model.project(x).tolist(), model.deviations(x)):
                    whitened[k], exact[k] = w, e
        deviation = pa.array([e if e is not None and e < LONG else None for e in exact], pa.int64())
        digits = pa.array([Decimal(e) if e is not None and e < 10**38 else None for e in exact], pa.decimal128(38))
        return pa.StructArray.from_arrays([pa.array(whitened, pa.list_(pa.float64())), deviation, digits], ["whitened", "deviation", "deviation_exact"])

    out, place, value = fresh(rows, "__whitened", "__place", "__value")
    if model is None or not len(model.values):
        empty = rows.where(F.lit(False)).withColumn(out, F.lit(None).cast(fields))
        projected, explained, error, n = empty, [0.0], 0.0, 0
    else:
        projected = written(rows.select(*others, project(F.col(f"`{column}`")).alias(out)).where(F.col(out)["whitened"].isNotNull()))
        explained = (model.values / np.longdouble(model.trace)).astype(float).tolist()
        error, n = identity_error(projected.select(F.col(out)["whitened"].alias("whitened"))), model.n
    shares = F.array(*map(F.lit, explained))
    exploded = projected.select(*others, F.col(out), F.posexplode(F.col(out)["whitened"]).alias(place, value))
    return exploded.select(
        *others,
        (F.col(place) + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col(out)["deviation"].alias("deviation"),
        F.col(value).alias("whitened"),
        shares[F.col(place)].alias("explained"),
        F.lit(error).alias("identity_error"),
        F.col(out)["deviation_exact"].alias("deviation_exact"),
    )
