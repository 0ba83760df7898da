"""Whitening of embeddings by the eigenvectors of a covariance that is formed exactly, in integers.

A vector's entries c become x = floor(64 c) + 1,000,000. Every sum goes over y = x - shift, which are small, and packed rows
of y are made distinct by Spark, so the fit list has each different x once, however many rows share it. Tasks sum y and its
cross-products without rounding: entries are cut into limbs of 20 bits, whose products of at most ROWS rows are exact in
doubles, and what is summed of them is carried in integers of any length. A task gives a row an entry of the upper
triangle, in limbs of 30 bits that Spark adds up as longs; the driver gets (d + 1)(d + 2) / 2 rows, a number that the
dimension d sets. Only then n XᵀX - SSᵀ is formed, exactly and free of the shift, divided by n² with one rounding an entry, and
decomposed by eigh. Rows are projected from n x - S, which is exact too.

The covariance of what comes out is measured over the fit list, centred by its own means in a second pass.

Defined results: rows whose vector is null, holds a null or a non-finite entry, or has another length than most (of equally
many the shorter) are left out; 64 c beyond 2^62 in size counts as 2^62; a null or repeated id keeps its rows; components are as
many as asked or as the dimension has; eigenvalues of no more than d * 2^-52 of the largest count as zero: their components
are numbered as others are, whitened is null for them and identity_error leaves them out; where all are zero (one
vector) explained and identity_error are null; a deviation beyond a long is null and stands as text in deviation_over; signs
are such that a component's entry of largest size is positive; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .util import own, shared_dir, stored, trim

SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 1 << 62
#: Rows whose products are summed in doubles at once, bits of a limb there, and bits of a limb that Spark adds.
ROWS, LIMB, CARRIED, LIMBS = 4096, 20, 30, 8


class Fit(NamedTuple):
    """What projection needs: the number of different vectors, their sums of y, eigenvalues, unit vectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scatter: list[list[int]]


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The length that most vectors have."""
    most = own(vectors, column).where(F.col(f"`{column}`").isNotNull()).groupBy(F.size(f"`{column}`").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return most["d"] if most else 0


def packed(vectors: DataFrame, d: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, y) of the rows that count; y is its d integers in as few bytes each (1, 2, 4 or 8) as the largest needs, so equal vectors have equal bytes."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(1)
            fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), d), False))
            keys, lists = b.column(0).filter(pa.array(fits)), lists.filter(pa.array(fits))
            entries = lists.flatten()
            c = np.asarray(pc.fill_null(entries, float("nan")), np.float64).reshape(-1, d)
            whole = np.isfinite(c).all(axis=1)
            with np.errstate(over="ignore"):
                y = np.floor(c[whole] * SCALE).clip(-float(LARGEST), float(LARGEST)).astype(np.int64)
            size = np.maximum(y.max(axis=1, initial=0), -1 - y.min(axis=1, initial=0)) if d else np.zeros(len(y), np.int64)
            width = np.select([size < 1 << 7, size < 1 << 15, size < 1 << 31], [1, 2, 4], 8)
            out = np.empty(len(y), object)
            for w in (1, 2, 4, 8):
                (at,) = (width == w).nonzero()
                raw, step = y[at].astype(f"<i{w}").tobytes(), w * d
                for i, row in enumerate(at):
                    out[row] = raw[i * step : (i + 1) * step]
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(whole)), pa.array(out, pa.binary())], ["key", "y"])

    shared_dir(vectors.sparkSession)
    rows = own(vectors, key, column).select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{column}`").cast("array<double>").alias("c")).where("c is not null")
    return rows.mapInArrow(pack, "key long, y binary")


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    """The rows of y as a matrix of longs."""
    width = np.asarray(pc.binary_length(column)) // d
    out = np.empty((len(column), d), np.int64)
    for w in (1, 2, 4, 8):
        (at,) = (width == w).nonzero()
        if len(at):
            out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), f"<i{w}").reshape(-1, d)
    return out


def _blocks(it: Iterator[pa.RecordBatch], at: int, d: int) -> Iterator[np.ndarray]:
    for b in it:
        for start in range(0, b.num_rows, ROWS):
            yield _unpacked(b.column(at).slice(start, ROWS), d)


def _products(y: np.ndarray, far: dict[int, np.ndarray]) -> None:
    """Add y's cross-products to far, which has them by the power of 2^LIMB they count for; a row of ones gives the sums."""
    limbs = []
    while True:
        top = y.max(initial=0) < 1 << LIMB - 1 and y.min(initial=0) >= -1 << LIMB - 1
        limbs.append((y if top else y & (1 << LIMB) - 1).astype(np.float64))
        if top:
            break
        y = y >> LIMB
    ones = np.ones((len(y), 1))
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            left = np.hstack([ones if i == 0 else 0 * ones, a])
            right = np.hstack([ones if j == 0 else 0 * ones, b])
            far[i + j] = far.get(i + j, 0) + (left.T @ right).astype(np.int64)


def scatter(fit_list: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y and n YᵀY - SSᵀ of a fit list's rows, all exact."""
    size = d + 1

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict[int, np.ndarray] = {}
        total, blocks = np.zeros((size, size), object), 0

        def carry() -> None:
            nonlocal total
            for power, part in far.items():
                total = total + part.astype(object) * (1 << LIMB * power)
            far.clear()

        for y in _blocks(it, 0, d):
            _products(y, far)
            blocks += 1
            if blocks % 64 == 0:  # a block adds less than 2^55 to an entry
                carry()
        carry()
        if not blocks:
            return
        i, j = np.triu_indices(size)
        left, cols = total[i, j], []
        for k in range(LIMBS):
            cols.append(pa.array((left if k == LIMBS - 1 else left & ((1 << CARRIED) - 1)).tolist(), pa.int64()))
            left = left >> CARRIED
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *cols], ["i", "j", *(f"l{k}" for k in range(LIMBS))])
        trim()

    rows = fit_list.select("y").mapInArrow(add, "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    sums = rows.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()
    m = [[0] * size for _ in range(size)]
    for r in sums:
        m[r["i"]][r["j"]] = m[r["j"]][r["i"]] = sum(r[f"l{k}"] << CARRIED * k for k in range(LIMBS))
    n, s = m[0][0], m[0][1:]
    return n, s, [[n * m[i + 1][j + 1] - s[i] * s[j] for j in range(d)] for i in range(d)]


def decompose(n: int, sums: list[int], exact: list[list[int]]) -> Fit:
    """The covariance of exact integers over n², rounded once an entry, and its eigenvectors by falling eigenvalue."""
    cov = np.array([[x / (n * n) for x in row] for row in exact])  # a quotient of Python's integers is rounded once
    trace = sum(exact[i][i] for i in range(len(exact))) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Fit(n, sums, np.where(values > values[0] * len(values) * 2.0**-52, values, 0.0), vectors * signs, trace, exact)


def _centred(y: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int]]:
    """(n y - S) / n as doubles of one rounding, and each row's sum of (n y - S)²."""
    bound = fit.n * max(int(y.max(initial=0)), -int(y.min(initial=0))) + max(map(abs, fit.sums))
    small = bound * bound * y.shape[1] < 1 << 63
    exact = y * fit.n - np.array(fit.sums, np.int64) if small else y.astype(object) * fit.n - np.array(fit.sums, object)
    return (exact / fit.n).astype(np.float64), (exact * exact).sum(axis=1).tolist()


def _whitener(fit: Fit, k: int) -> np.ndarray:
    """Columns that take centred rows to components; zero for eigenvalues of zero."""
    scale = np.array([e**-0.5 if e > 0 else 0.0 for e in fit.values[:k]])
    return fit.vectors[:, :k] * scale


def identity_error(fit_list: DataFrame, fit: Fit, k: int) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity, over components of positive eigenvalue."""
    d, w = len(fit.sums), _whitener(fit, k)
    real = fit.values[:k] > 0
    if not real.any():
        return None

    def sums(of):
        def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            far = sum((of(_centred(y, fit)[0] @ w) for y in _blocks(it, 0, d)), np.zeros(()))
            if far.ndim:
                flat = far.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["at", "v"])

        found = fit_list.select("y").mapInArrow(each, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(found, key=lambda r: r["at"])])

    mean = sums(lambda z: z.sum(axis=0)) / fit.n
    cov = sums(lambda z: (z - mean).T @ (z - mean)).reshape(k, k) / fit.n
    return float(np.abs(cov - np.eye(k))[np.ix_(real, real)].max())


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_over), a row a remaining row and component."""
    spark, schema = vectors.sparkSession, f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_over string"
    d = dimension(vectors, column)
    k = min(components, d)
    rows = packed(vectors, d, key, column)
    fit_list = stored(rows.select("y").distinct(), "fit") if k else None
    n, sums, exact = scatter(fit_list, d) if k else (0, [], [])
    if not n:
        return spark.createDataFrame([], schema)
    fit = decompose(n, sums, exact)
    error, w = identity_error(fit_list, fit, k), _whitener(fit, k)
    shares = [float(e) / fit.trace if fit.trace else None for e in fit.values[:k]]
    nothing = np.array([e <= 0 for e in fit.values[:k]])

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                m = part.num_rows
                centred, deviations = _centred(_unpacked(part.column(1), d), fit)
                over = [x >= 1 << 63 for x in deviations]
                repeat = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                        pa.array([None if o else x for x, o in zip(deviations, over, strict=True)], pa.int64()).take(repeat),
                        pa.array((centred @ w).ravel(), mask=np.tile(nothing, m)), pa.array(shares * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                        pa.array([str(x) if o else None for x, o in zip(deviations, over, strict=True)], pa.string()).take(repeat),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_over"],
                )

    return rows.mapInArrow(project, schema)
