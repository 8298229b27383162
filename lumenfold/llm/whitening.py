"""Whitening of embeddings by their principal components.

Entries go to an integer grid, and each distinct grid vector counts once: that list is what the model
is fitted to. One aggregation sums the centred products of every pair of dimensions, the upper triangle
of the covariance matrix, as generated SQL expressions; the driver puts the d * (d + 1) / 2 sums
together and decomposes the matrix with LAPACK. A task sends one row of sums however many vectors it
reads. The projection is again a row of expressions.

Defined cases: vectors that are null or hold a null or non-finite entry are dropped; vectors of each
length are a space of their own with its own fit, and empty vectors have no components; rows repeat as
they come, their id may be null; a component without variance has a null `whitened`; `explained` is null where nothing varies;
`deviation` is null where it or a step to it exceeds a long; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Components that are returned.
COMPONENTS = 4
#: Steps of the grid within one unit.
GRID = 256
LONG = 1 << 63


def gridded(df: DataFrame, key: str, vector: str, grid: int) -> DataFrame:
    """(key, x) of the rows whose vector is whole; x holds longs."""
    v = F.col(vector).cast("array<double>")
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(whole).select(F.col(key), F.transform(v, lambda c: F.floor(c * float(grid))).alias("x"))


def _number(value: float) -> str:
    """A double within SQL."""
    return f"({float(value)!r}D)"


def sums_of(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension, from sums of upper and lower halves that do not overflow."""
    halves = [f"sum({half})" for i in range(d) for half in (f"shiftright(x[{i}], 32)", f"x[{i}] & 4294967295L")]
    n, *parts = fit.selectExpr("count(*)", *halves).first()
    return n, [(high << 32) + low for high, low in zip(parts[::2], parts[1::2], strict=True)]


def centred(df: DataFrame, mean: list[float], *others: Column) -> DataFrame:
    """others, and x less the mean as columns c0, c1, ..."""
    return df.select(*others, *(F.expr(f"x[{i}] - {_number(m)}").alias(f"c{i}") for i, m in enumerate(mean)))


def covariance(columns: DataFrame, names: list[str], n: int) -> np.ndarray:
    """Covariance of centred columns: every pair's products, summed in one aggregation."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    total = columns.selectExpr(*(f"sum({names[i]} * {names[j]}) AS s{k}" for k, (i, j) in enumerate(pairs))).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, total, strict=True):
        out[i, j] = out[j, i] = value / n
    return out


def decomposed(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; each vector's entry of largest size is positive, so that reruns agree."""
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector.T[::-1]
    most = np.abs(vector).argmax(axis=1)
    return value, vector * np.where(vector[np.arange(len(vector)), most] < 0, -1.0, 1.0)[:, None]


def _projected(df: DataFrame, axes: list[np.ndarray], d: int, *others: str) -> DataFrame:
    """others, and the product of c0, c1, ... with each axis as columns w0, w1, ..."""
    sums = (" + ".join(f"c{i} * {_number(a[i])}" for i in range(d)) for a in axes)
    return df.select(*others, *(F.expr(s).alias(f"w{k}") for k, s in enumerate(sums)))


def _deviation(n: int, total: list[int]) -> Column:
    """Exact sum over the dimensions of (n * x - total)^2."""
    if any(not -LONG <= s < LONG for s in total):
        return F.lit(None).cast("long")
    apart = lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s)
    squares = F.zip_with("x", F.lit(total).cast("array<long>"), lambda x, s: F.try_multiply(apart(x, s), apart(x, s)))
    return F.aggregate(squares, F.lit(0).cast("long"), F.try_add)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, grid: int = GRID) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each whole vector and component, numbered from 1 by falling variance.

    n: vectors of the fit. deviation: sum over the dimensions of (n * x - sum)^2. whitened: the centred x on the component, over the root of its variance.
    explained: share of the variance. identity_error: the largest entry of the covariance of `whitened` over the fit, less the identity.
    """
    rows = gridded(df, key, vector, grid)
    fit = written(rows.select("x").distinct(), "fit")
    lengths = sorted(r["d"] for r in fit.groupBy(F.size("x").alias("d")).count().collect() if r["d"])
    parts = [_space(rows, fit, key, d, min(components, d)) for d in lengths]
    if parts:
        return reduce(DataFrame.unionAll, parts)
    kind = rows.select(key).schema[0].dataType.simpleString()
    return df.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _space(rows: DataFrame, fit: DataFrame, key: str, d: int, count: int) -> DataFrame:
    """whiten() for the vectors of length d."""
    fit = fit.where(F.size("x") == d)
    n, total = sums_of(fit, d)
    mean = [s / n for s in total]
    names = [f"c{i}" for i in range(d)]
    value, vector = decomposed(covariance(centred(fit, mean), names, n))
    some = [k for k in range(count) if value[k] > value[0] * d * np.finfo(float).eps]
    axes = [vector[k] / np.sqrt(value[k]) for k in some]
    error = None
    if some:
        seen = _projected(centred(fit, mean), axes, d)
        middle = seen.agg(*(F.avg(c) for c in seen.columns)).first()
        level = seen.select(*(F.expr(f"{c} - {_number(m)}").alias(c) for c, m in zip(seen.columns, middle, strict=True)))
        error = float(np.abs(covariance(level, level.columns, n) - np.eye(len(some))).max())
    share = [float(value[k] / value.sum()) if value.sum() > 0 else None for k in range(count)]
    laid = _projected(centred(rows.where(F.size("x") == d), mean, F.col(key).alias("_key"), _deviation(n, total).alias("deviation")), axes, d, "_key", "deviation")
    shown = [
        F.struct(F.lit(k + 1).cast("int").alias("component"), (F.col(f"w{some.index(k)}") if k in some else F.lit(None).cast("double")).alias("whitened"), F.lit(share[k]).cast("double").alias("explained"))
        for k in range(count)
    ]
    whole = laid.select("_key", "deviation", F.inline(F.array(*shown)))
    return whole.select(F.col("_key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
