"""Whitening of embeddings: the scatter matrix is summed in whole numbers of any size and becomes floating point only at its end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

UNIT, COMPONENTS = 256, 4
#: A sum travels as so many digits of 32 bits, the last one signed: products of 65-bit numbers, summed over 2^60 rows.
DIGITS = 6
#: Digits of 20 bits, products of 4,096 rows: every partial sum of a matrix product stays below 2^53 and is exact.
DIGIT, ROWS = 20, 4096


def entries(vectors: DataFrame, vector: str = "embedding", unit: int = UNIT, key: str = "vec_id") -> DataFrame:
    """(vec_id, x): whole numbers floor(unit * c) of the vectors whose entries are all finite; beyond a long's range they stay at its ends."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & whole)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(unit)))).alias("x"))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the lists of each length, a few megabytes at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    lengths = np.diff(at)
    for d in np.unique(lengths).tolist():
        rows, step = np.flatnonzero(lengths == d), max(1, (1 << 21) // max(d, 1))
        for k in range(0, len(rows), step):
            yield d, rows[k : k + step], flat[at[rows[k : k + step]][:, None] + np.arange(d)]


def bits(x: np.ndarray) -> int:
    """Bits of the largest absolute value."""
    return max(int(x.max()).bit_length(), int(x.min()).bit_length()) if x.size else 0


def shifted(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift, as Python numbers where a long might not hold it."""
    return x - shift if max(bits(x), bits(shift)) < 62 else x.astype(object) - shift.astype(object)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of at most ROWS rows, as Python numbers."""
    parts, rest = [], x
    while bits(rest) > DIGIT:
        parts.append((rest & ((1 << DIGIT) - 1)).astype(float))
        rest = rest >> DIGIT
    parts.append(rest.astype(float))
    products = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[: i + 1]):
            p = (a.T @ b).astype(np.int64)
            products += (p if i == j else p + p.T).astype(object) << (DIGIT * (i + j))
    sums = sum(p.sum(0).astype(np.int64).astype(object) << (DIGIT * k) for k, p in enumerate(parts))
    return sums, products


@dataclass(frozen=True)
class Model:
    """What is known of the fit list's vectors of one length. shift: any whole vector, taken off before summing; sums: of the shifted ones."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    axes: np.ndarray  # a component in each column
    values: np.ndarray  # their eigenvalues, 0 where the vectors have no such direction
    explained: np.ndarray
    identity_error: float = float("nan")

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(coordinates, NaN where the eigenvalue is 0, and the exact sums of (n*x-S)^2)."""
        y = shifted(x, self.shift)
        b, s = bits(y), bits(self.sums)
        small = lambda need: y.dtype != object and need < 62
        wide, total = y.astype(object), self.sums
        d = x.shape[1].bit_length()
        squares = (y * y).sum(1) if small(2 * b + d) else (wide * wide).sum(1)
        crossed = (y * total.astype(np.int64)).sum(1) if small(b + s + d) else (wide * total).sum(1)
        rest = sum(v * v for v in total.tolist())
        exact = [self.n * self.n * int(a) - 2 * self.n * int(c) + rest for a, c in zip(squares, crossed, strict=True)]
        off = self.n * y - total.astype(np.int64) if small(max(b + self.n.bit_length(), s)) else self.n * wide - total
        with np.errstate(divide="ignore", invalid="ignore"):
            return (off.astype(float) / self.n) @ self.axes / np.where(self.values > 0, np.sqrt(self.values), np.nan), exact


def refined(v: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix of long doubles: eigh's, improved by Ogita and Aishima's iteration."""
    x = np.linalg.eigh(v.astype(float))[1][:, ::-1].astype(np.longdouble)
    for _ in range(rounds):
        r, s = np.eye(len(v)) - x.T @ x, x.T @ v @ x
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= 2 * (np.linalg.norm((s - np.diag(e)).astype(float)) + np.abs(e).max() * np.linalg.norm(r.astype(float)))
        x = x + x @ np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
    e = np.diag(x.T @ v @ x) / np.diag(x.T @ x)
    order = np.argsort(-e, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(0))[order]
    return e[order], x


def solved(n: int, shift: np.ndarray, sums: np.ndarray, products: np.ndarray, components: int) -> Model:
    """The model of n*XX'-SS'. A direction whose eigenvalue is 0 but for rounding counts as having none."""
    m = n * products - np.outer(sums, sums)
    flat = []
    for a in m.ravel().tolist():  # correctly rounded, and what the rounding left
        near = a / (n * n)
        flat.append(np.longdouble(near) + np.longdouble(float(Fraction(a, n * n) - Fraction(near))))
    e, axes = refined(np.array(flat, np.longdouble).reshape(m.shape))
    k = min(components, len(e))
    none = (e <= len(e) * 2.0**-60 * max(e[0], 0)) | (np.arange(len(e)) >= n - 1)
    values, axes = np.where(none, 0, e)[:k].astype(float), axes[:, :k].astype(float)
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    trace = sum(m.diagonal().tolist()) / (n * n)
    return Model(n, shift, sums, axes, values, values / trace if trace else values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vector in `rows` (x array<long>), every distinct x counted once.

    Distinct vectors are written once and read twice: for the sums, and to measure the whitened covariance. Only sums
    of each dimension and pair of dimensions go to the driver, whatever the number of rows."""
    distinct = written(rows.select("x").distinct())
    shifts = {r.d: np.array(r.x, np.int64) for r in distinct.groupBy(F.size("x").alias("d")).agg(F.first("x").alias("x")).where("d > 0").collect()}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, _, x in by_length(b.column(0)):
                for k in range(0, len(x) if d else 0, ROWS):
                    y = shifted(x[k : k + ROWS], shifts[d])
                    new = [len(y), *scatter(y)]
                    held[d] = [p + q for p, q in zip(held[d], new, strict=True)] if d in held else new
        for d, (n, sums, products) in held.items():
            flat = np.concatenate([np.array([n], object), sums, products[np.triu_indices(d)]])
            digits = [pa.array((flat >> (32 * k) if k == DIGITS - 1 else flat >> (32 * k) & 0xFFFFFFFF).astype(np.int64)) for k in range(DIGITS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d)), pa.array(np.arange(len(flat))), *digits], ["d", "place", *names])

    names = [f"g{k}" for k in range(DIGITS)]
    partial = distinct.mapInArrow(summed, "d long, place long, " + ", ".join(f"{g} long" for g in names))
    t = partial.groupBy("d", "place").agg(*[F.sum(g).alias(g) for g in names]).orderBy("d", "place").toArrow()
    length = t["d"].to_numpy()
    value = sum(t[g].to_numpy().astype(object) << (32 * k) for k, g in enumerate(names))
    models = {}
    for d, shift in shifts.items():
        own = value[length == d]
        products = np.zeros((d, d), object)
        products[np.triu_indices(d)] = own[d + 1 :]
        products = np.triu(products) + np.triu(products, 1).T
        models[d] = solved(int(own[0]), shift, own[1 : d + 1], products, components)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in by_length(b.column(0)):
                if d:
                    w = models[d].whiten(x)[0]
                    w = np.column_stack([np.ones(len(w)), w])
                    held[d] = held.get(d, 0) + w.T @ w
        for d, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(c.size, d)), pa.array(np.arange(c.size)), pa.array(c.ravel())], ["d", "place", "v"])

    c = distinct.mapInArrow(measured, "d long, place long, v double").groupBy("d", "place").agg(F.sum("v").alias("v")).orderBy("d", "place").toArrow()
    for d, m in models.items():
        own = c["v"].to_numpy()[c["d"].to_numpy() == d].reshape(len(m.values) + 1, -1) / m.n
        off = np.abs(own[1:, 1:] - np.outer(own[0, 1:], own[0, 1:]) - np.eye(len(m.values)))
        has = m.values > 0
        models[d] = replace(m, identity_error=float(off[has][:, has].max()) if has.any() else float("nan"))
    return models


def whitened(vectors: DataFrame, vector: str = "embedding", unit: int = UNIT, components: int = COMPONENTS, key: str = "vec_id") -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error): for each vector whose entries are all finite its coordinates on
    the leading components of the distinct vectors' covariance, each of variance 1, and the exact sum of (n*x-S)^2 in decimal digits.

    Null vectors and those with null, NaN or infinite entries are left out. Repeated vectors and repeated or null ids give a row
    each, but count once in the covariance. Vectors of each length have a fit of their own; empty ones have no component and an empty array. A
    component without variance (fewer distinct vectors than components, constant ones) has null coordinates and explains 0. No rows: no rows.
    The driver holds a matrix of the dimensions, never rows.
    """
    rows = entries(vectors, vector, unit, key)
    models = fit(rows, components)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for d, at, x in by_length(b.column(1)):
                if not d:
                    lists, n, exact, explained, error = [[]] * len(at), 0, [0] * len(at), [], None
                else:
                    m = models[d]
                    w, exact = m.whiten(x)
                    k = w.shape[1]
                    flat = pa.array(w.ravel(), from_pandas=True)  # NaN: null
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), flat)
                    n, explained, error = m.n, m.explained.tolist(), None if np.isnan(m.identity_error) else m.identity_error
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array([n] * len(at), pa.int64()), pa.array([str(v) for v in exact], pa.string()), pa.array(lists, pa.list_(pa.float64())),
                     pa.array([explained] * len(at), pa.list_(pa.float64())), pa.array([error] * len(at), pa.float64())], names)

    names = ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(each, "vec_id long, n long, deviation string, whitened array<double>, explained array<double>, identity_error double")
