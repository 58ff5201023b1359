"""Whitening of embeddings, with covariances from variances of sums (polarisation)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

GRID = 1024  # steps of a unit of an entry
OFFSET = 100_000
SAFE = 1 << 62  # sums stay exact in 64 bits below it
LARGEST = float(1 << 51)  # of an entry's size: what is further out has no place on the grid
PART = 10**24  # large sums travel as two decimals
ROWS = 1024  # of a block of squares


def _exact(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """``x`` as it is if ``factor`` times its largest value fits in 64 bits, else as Python's integers."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return x if most * factor < SAFE else x.astype(object)


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.asarray(batch.column(0).flatten()).reshape(-1, size)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of whole numbers by column."""
    return _exact(x, len(x)).sum(axis=0).astype(object)


def squared_sums(y: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of all columns and of all sums of two, as ``pair_places`` lists them."""
    size = y.shape[1]
    most = 2 * max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    y = y if most * most * len(y) < SAFE else y.astype(object)
    total = np.zeros(size * (size + 1) // 2, dtype=y.dtype)
    at = 0
    for i in range(size):
        total[at] = (y[:, i] * y[:, i]).sum()
        s = y[:, i : i + 1] + y[:, i + 1 :]
        total[at + 1 : at + size - i] = (s * s).sum(axis=0)
        at += size - i
    return total.astype(object)


def pair_places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of ``squared_sums``: each dimension, then its sums with the later ones."""
    return np.triu_indices(size)


def _sums(rows: DataFrame, work) -> dict[int, int]:
    """Whole numbers by place, summed over the tasks: ``work`` turns a batch into an array of them."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + work(batch)
        if not isinstance(total, int):
            wide = pa.decimal128(38, 0)
            parts = [divmod(int(v), PART) for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([Decimal(h) for h, _ in parts], wide), pa.array([Decimal(lo) for _, lo in parts], wide)], ["place", "high", "low"])

    parts = rows.mapInArrow(summed, "place int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("place").agg(F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low"))
    return {r["place"]: int(r["high"]) * PART + int(r["low"]) for r in found.collect()}  # as many as pairs of dimensions


def covariance(n: int, sums: np.ndarray, squares: dict[int, int]) -> tuple[np.ndarray, float]:
    """The covariance matrix and its trace, each entry from whole numbers by one division.

    ``squares`` are of columns less the whole part of their mean. What is left of the mean, the
    remainder r of the sums by n, is taken off exactly: the squares of n*y - r add up to
    n*n*(squares of y) - n*r*r, as the y add up to r. Half the difference of the variance of a sum
    and those of its parts is their covariance.
    """
    rest = [int(s) % n for s in sums]
    rows, columns = pair_places(len(sums))
    places = list(zip(rows.tolist(), columns.tolist()))
    centred = {}
    for k, (i, j) in enumerate(places):
        r = rest[i] if i == j else rest[i] + rest[j]
        centred[i, j] = n * n * squares[k] - n * r * r
    v = np.zeros((len(sums), len(sums)))
    for i, j in places:
        cross = centred[i, i] if i == j else (centred[i, j] - centred[i, i] - centred[j, j]) // 2
        v[i, j] = v[j, i] = cross / n**3
    return v, sum(centred[i, i] for i in range(len(sums))) / n**3


def components(v: np.ndarray, trace: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) by falling eigenvalue, at most ``most`` and none without variance;
    the entry of largest size is positive."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    some = values > len(v) * np.finfo(float).eps * max(values[0], 0.0) if len(values) else np.zeros(0, dtype=bool)
    values, vectors = values[some], vectors[:, some]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * sign, values / trace if trace > 0 else values


def whiten(vectors: DataFrame, most: int = 8, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Rows whose vector is null or empty or holds null or non-finite entries go, and those with an
    entry of 2^51 and more in size, which has no place on the grid; so do vectors of another
    length than the most frequent one (of equally frequent ones the longer). Each entry c becomes
    the whole number floor(1024*c) + 100000, so all sums are exact and don't depend on how rows
    are dealt to tasks: n and the sums by dimension in a first pass; in a second one the squares
    of all centred dimensions and of all sums of two centred dimensions, each task's as one row
    a pair. Differences of these variances are the covariances; the matrix, as large as the
    dimensions, goes to the driver for its eigenvectors.

    ``deviation``: the squares of n*x - S summed over the dimensions; null if beyond 64 bits.
    ``whitened``: the projections of x - S/n on the first ``most`` components, each over the square
    root of its eigenvalue; components without variance (beyond the rank) are left out.
    ``explained``: a component's share of the variance. ``identity_error``: the largest entry, by
    size, of the whitened rows' covariance, counted on the rows themselves, less the identity.
    Null ids and repeated rows are rows like others. Columns of the five names are replaced. A
    table without any vector left gives no rows.
    """
    added = ("n", "deviation", "whitened", "explained", "identity_error")
    kept = [c for c in vectors.columns if c.lower() not in added]
    entry = lambda c: c.cast("double")
    sound = F.forall(F.col(embedding), lambda c: F.coalesce(F.abs(entry(c)) < LARGEST, F.lit(False)) & ~F.isnan(entry(c)))
    x = F.transform(embedding, lambda c: F.floor(entry(c) * GRID).cast("long") + OFFSET)
    rows = vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).where(sound)
    rows = rows.select(F.struct(*[vectors[f"`{c}`"] for c in kept]).alias("_row"), x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size, n = (lengths["size"], lengths["n"]) if lengths else (1, 1)
    rows = rows.where(F.size("x") == size)
    only = rows.select("x")
    sums = _sums(only, lambda b: column_sums(_matrix(b, size)))
    sums = np.array([sums.get(k, 0) for k in range(size)], dtype=object)
    mean = np.array([s // n for s in sums], dtype=object).astype(np.int64)
    rest = np.array([s % n for s in sums], dtype=object).astype(np.int64)

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        y = _matrix(batch, size)
        y = _exact(y, 2) - mean
        return sum(squared_sums(y[k : k + ROWS]) for k in range(0, len(y), ROWS))

    found = _sums(only, squares)
    v, trace = covariance(n, sums, {k: found.get(k, 0) for k in range(size * (size + 1) // 2)})
    values, vectors_, explained = components(v, trace, most)
    turn = vectors_ / np.sqrt(values)

    @F.pandas_udf("deviation long, whitened array<double>")
    def turned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = _exact(np.stack(b.to_numpy()), 2) - mean if len(b) else np.zeros((0, size), dtype=np.int64)
            z = _exact(z, 2 * n) * n - rest  # n*x - S
            most_ = max(abs(int(z.max())), abs(int(z.min()))) if z.size else 0
            squares_ = z if most_ * most_ * size < SAFE else z.astype(object)
            deviation = [int(d) if d < 1 << 63 else None for d in (squares_ * squares_).sum(axis=1)]
            w = (z / n).astype(float) @ turn
            yield pd.DataFrame({"deviation": pd.array(deviation, dtype="Int64"), "whitened": list(w)})

    out = cut(rows.select("_row", turned("x").alias("d")).select("_row", "d.*"))
    k = len(values)
    error = 0.0
    if k:
        w = [F.col("whitened")[i] for i in range(k)]
        middle = out.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
        centred = [c - F.lit(float(middle[i])) for i, c in enumerate(w)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        products = out.agg(*[F.avg(centred[i] * centred[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
        error = max(abs(products[f"p{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*[F.lit(float(e)) for e in explained]).cast("array<double>")
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(float(error)).alias("identity_error"))
