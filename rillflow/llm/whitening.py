"""Operator 12: whitening of embeddings by an exact integer scatter.

Entries become whole numbers, from which a shift is taken. Tasks add up sums and cross-products of what is left as
limbs of 2^30, so that no sum is ever rounded: small numbers go through matrix products of doubles
that stay below 2^53, larger ones through Python's integers. The scatter n XtX - S St is formed from
whole numbers and only then becomes doubles, which eigh decomposes. Only d (d + 3) / 2 sums of a
d-dimensional space reach the driver, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import cut, table

#: Entries are floor(SCALE x entry) + OFFSET; SHIFT is taken from them before any product.
SCALE, OFFSET, SHIFT = 64, 1_000_000, 1_000_000
#: Components that are returned, at most.
COMPONENTS = 32
#: Larger entries count as this one: a long holds their integers.
LARGEST = float(1 << 56)
#: Rows multiplied at once.
BLOCK = 2048
LIMB = 30

OUT = "vec_id long, n long, deviation long, deviation_exact string, w array<double>"


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(SCALE * vectors, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column without nulls, all of length d."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """y as sum of digits x 2^(20 k), each below 2^20 in size, as doubles."""
    out = []
    while True:
        low = np.where(y < 0, -(-y & ((1 << 20) - 1)), y & ((1 << 20) - 1))
        out.append(low.astype(np.float64))
        y = (y - low) >> 20
        if not y.any():
            return out


def scatter(y: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(power of two, matrix) whose sum is the exact cross-product of the columns (ones, y): the
    first row holds the sums, its first entry the number of rows."""
    total: dict[int, np.ndarray] = {}
    for at in range(0, len(y), BLOCK):
        part = y[at : at + BLOCK]
        digits = [np.c_[np.ones(len(part)), d] if k == 0 else np.c_[np.zeros(len(part)), d] for k, d in enumerate(_digits(part))]
        for i, p in enumerate(digits):
            for j, q in enumerate(digits):
                # 2^20 x 2^20 x 2^11 rows: every partial sum is a whole double
                total[20 * (i + j)] = total.get(20 * (i + j), 0) + (p.T @ q).astype(np.int64).astype(object)
    return sorted(total.items())


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(d + 1)
        held = np.zeros(len(i), object)
        for batch in batches:
            if batch.num_rows:
                for power, m in scatter(integers(_matrix(batch.column("v"), d)) - SHIFT):
                    held = held + m[i, j] * (1 << power)
        limbs = []
        while held.any():
            low = np.array([abs(int(v)) & ((1 << LIMB) - 1) for v in held], np.int64) * np.array([-1 if v < 0 else 1 for v in held])
            limbs.append(low)
            held = np.array([(int(v) - int(x)) >> LIMB for v, x in zip(held, low, strict=True)], object)
        for k, low in enumerate(limbs):
            at = np.flatnonzero(low)
            yield pa.RecordBatch.from_arrays([pa.array(i[at], pa.int32()), pa.array(j[at], pa.int32()), pa.array(np.full(len(at), k), pa.int32()), pa.array(low[at])], ["i", "j", "k", "v"])

    return run


def exact_scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, n XtX - S St) of the shifted integers of ``vectors`` (v), exactly, as Python integers."""
    each = vectors.select("v").mapInArrow(_sums(d), "i int, j int, k int, v long")
    # a limb has 30 bits, so a decimal has room for the limbs of any number of tasks
    rows = each.groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()
    m = np.zeros((d + 1, d + 1), object)
    for r in rows:
        m[r.i, r.j] += int(r.v) << (LIMB * r.k) if r.v >= 0 else -(int(-r.v) << (LIMB * r.k))
    n, s = int(m[0, 0]), [int(v) for v in m[0, 1:]]
    xtx = m[1:, 1:] + np.triu(m[1:, 1:], 1).T
    return n, s, n * xtx - np.outer(np.array(s, object), np.array(s, object))


def decompose(n: int, centred: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, falling; eigenvectors in columns; trace) of the covariance; a column's largest entry is positive."""
    v = np.array([[c / (n * n) for c in row] for row in centred.tolist()], np.float64)  # quotients of integers, rounded once
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    lead = u[np.abs(u).argmax(axis=0), np.arange(len(e))]
    trace = sum(int(centred[i, i]) for i in range(len(centred))) / (n * n)
    return e, u * np.where(lead < 0, -1.0, 1.0), trace


def deviations(y: np.ndarray, n: int, s: list[int]) -> list[int]:
    """sum over dimensions of (n y - S)^2 of each row, exactly."""
    most, high = int(np.abs(y).max(initial=0)), max(map(abs, s), default=0)
    wide = y.shape[1] * (n * most + high) ** 2 < 1 << 62
    if wide:
        t = n * y - np.array(s, np.int64)
        return (t * t).sum(axis=1).tolist()
    if y.shape[1] * most * max(most, 1 << 31) < 1 << 62:
        # n^2 sum y^2 - 2 n sum y S + sum S^2, with S in two parts, so that only three numbers a row are Python's
        low, top = np.array([v & ((1 << 31) - 1) for v in s], np.int64), [v >> 31 for v in s]
        if high < 1 << 62 and y.shape[1] * most * max(1, max(map(abs, top))) < 1 << 62:
            square, a, b = (y * y).sum(axis=1).tolist(), (y @ low).tolist(), (y @ np.array(top, np.int64)).tolist()
            fixed = sum(v * v for v in s)
            return [n * n * q - 2 * n * (p + (r << 31)) + fixed for q, p, r in zip(square, a, b, strict=True)]
    return [sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)) for row in y.tolist()]


def centred_rows(y: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """y - S / n as doubles, from whole numbers that are exact."""
    if n * int(np.abs(y).max(initial=0)) + max(map(abs, s), default=0) < 1 << 62:
        return (n * y - np.array(s, np.int64)) / n
    return np.array([[(n * v - t) / n for v, t in zip(row, s, strict=True)] for row in y.tolist()], np.float64).reshape(y.shape)


def _whiten(d: int, n: int, s: list[int], e: np.ndarray, u: np.ndarray, real: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = integers(_matrix(batch.column("v"), d)) - SHIFT
            w = (centred_rows(y, n, s) @ u) * scale
            dev = deviations(y, n, s)
            fits = [v if v < 1 << 63 else None for v in dev]
            spill = [None if v < 1 << 63 else str(v) for v in dev]
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.full(len(w), n)), pa.array(fits, pa.int64()), pa.array(spill, pa.string()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                ["vec_id", "n", "deviation", "deviation_exact", "w"],
            )

    return run


def _products(width: int, mean: np.ndarray):
    """Sums over rows of products of entries about ``mean``; with no mean given, of the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width)) if mean is not None else np.zeros((1, width))
        for batch in batches:
            w = batch.column("w").flatten().to_numpy().reshape(batch.num_rows, width)
            total = total + ((w - mean).T @ (w - mean) if mean is not None else w.sum(axis=0))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def _gather(rows: DataFrame, width: int, mean: np.ndarray | None) -> np.ndarray:
    found = rows.select("w").mapInArrow(_products(width, mean), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width if mean is not None else 1, width))
    for r in found:
        out[r.i, r.j] = r.v
    return out


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out, as are those of
    another length than most have (of equally frequent lengths the largest counts): one covariance
    has one dimension. Every other row counts, repeated ids and vectors too, and so do null ids. Entries
    beyond 2^50 in size count as that. A component without variance (an eigenvalue of rounding size)
    has whitened null, and identity_error is over the others; it is 0 without any. A deviation of
    2^63 or more is null, and deviation_exact has its digits. An empty table gives no rows.
    """
    spark, v = df.sparkSession, F.col(vector).cast("array<double>")
    good = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    d = sizes[0].d
    good = good.where(F.size("v") == d)
    n, s, centred = exact_scatter(good, d)
    e, u, trace = decompose(n, centred)
    width = min(components, d)
    real = e[:width] > d * np.finfo(float).eps * max(e[0], 0.0)
    rows = cut(good.mapInArrow(_whiten(d, n, s, e[:width], u[:, :width], real), OUT))
    mean = _gather(rows, width, None)[0] / n
    cov = _gather(rows, width, mean) / n
    error = float(np.abs(cov - np.eye(width))[np.ix_(real, real)].max(initial=0.0))
    explained = F.array(*(F.lit(float(x / trace) if trace else 0.0) for x in np.maximum(e[:width], 0.0)))
    known = F.array(*(F.lit(bool(x)) for x in real))
    each = rows.select("*", F.posexplode("w").alias("at", "x"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.when(F.get(known, F.col("at")), F.col("x")).alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
