"""Embedding whitening by spectral divide and conquer.

Vectors become whole numbers, so counts, sums and the covariance are exact: each task sums products of entries that
are centred at the whole part of the mean, and the fraction that is left is corrected in whole numbers. Only
``d * (d + 1) / 2`` sums leave a task. The covariance is then split: the polar factor of ``A - s I``, by the
dynamically weighted Halley iteration with QR and Cholesky factorisations, is +1 on the eigenvectors above ``s`` and
-1 on those below, which gives the projector on an invariant subspace and one on its complement. Both are split
again until each has one component. The components travel to the tasks that whiten the vectors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
EPS = float(np.finfo(float).eps)
#: Numbers of the covariances at most, so that models can be broadcast: vectors of up to 2,048 entries.
MOST_NUMBERS = 1 << 22
#: Products of numbers below this are added up in whole 64-bit numbers; larger ones as Python integers.
_SMALL = 1 << 24
_LONG = 1 << 63


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: QR-based, then Cholesky-based, weighted Halley steps. The
    weights follow a lower bound of the smallest singular value."""
    m = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    r = np.linalg.qr(x, "r")
    singular = np.abs(np.diag(r)).min() < EPS * EPS
    low = EPS / m if singular else min(max(1 / float(np.linalg.norm(np.linalg.inv(r))), EPS / m), 1.0)
    for _ in range(60):
        was = x
        d = np.cbrt(4 * (1 - low**2) / low**4)
        weight = sqrt(1 + d) + 0.5 * sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * sqrt(1 + d)), 0.0))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([sqrt(c) * x, np.eye(m)]))
            x = b / c * x + (weight - b / c) / sqrt(c) * (q[:m] @ q[m:].T)
        else:
            half = np.linalg.cholesky(np.eye(m) + c * (x.T @ x))
            solved = np.linalg.solve(half, x.T)
            x = b / c * x + (weight - b / c) * np.linalg.solve(half.T, solved).T
        x = (x + x.T) / 2
        low = min(low * (weight + b * low**2) / (1 + c * low**2), 1.0)
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - was) < np.cbrt(EPS):
            break
    return x


def _range(projector: np.ndarray, k: int, seed: int) -> np.ndarray:
    """An orthonormal basis of the range of a projector of rank ``k``: two steps of subspace iteration."""
    start = np.random.default_rng(seed).standard_normal((len(projector), k))
    return np.linalg.qr(projector @ np.linalg.qr(projector @ start)[0])[0]


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases of the invariant subspaces of ``a`` above and below a shift. The mean eigenvalue lies strictly between
    the extremes, so it splits; it and shifts near it are tried if the median of the diagonal does not."""
    m = len(a)
    one = np.eye(m)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * one) / sqrt(m)
    best = None
    for shift in [np.median(np.diag(a)), *(mean + t * spread for t in (0, 0.01, -0.01, 0.05, -0.05, 0.2, -0.2, 0.4, -0.4))]:
        above = (polar(a - shift * one) + one) / 2
        k = round(float(np.trace(above)))
        if not 0 < k < m or abs(np.trace(above) - k) > 1e-6:
            continue
        q, _ = np.linalg.qr(np.hstack([_range(above, k, 1), _range(one - above, m - k, 2)]))
        left = float(np.linalg.norm(q[:, k:].T @ a @ q[:, :k]))
        if best is None or left < best[0]:
            best = left, q[:, :k], q[:, k:]
        if left <= 10 * m * EPS * np.linalg.norm(a):
            break
    if best is None:
        raise ArithmeticError("no shift splits the covariance")
    return best[1], best[2]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, in falling order of the values."""
    whole = max(float(np.linalg.norm(a)), np.finfo(float).tiny)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    open_blocks = [(a, np.eye(len(a)))]
    while open_blocks:
        block, basis = open_blocks.pop()
        m = len(block)
        if m == 1 or np.linalg.norm(block - np.trace(block) / m * np.eye(m)) <= 10 * m * EPS * whole:
            values += list(np.diag(block))
            vectors += list(basis.T)
            continue
        for part in _halves(block):
            inner = part.T @ block @ part
            open_blocks.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors)[order].T


class Fit(NamedTuple):
    """What whitens vectors of one dimension: their number, per-dimension sums, eigenvalues, their share of the
    trace, and the matrix that whitens centred vectors (NaN in the columns of eigenvalues that are 0)."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    matrix: np.ndarray


def _whole(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x of these rows) of a list column for each dimension in it. Rows that are null, hold a null, a value
    that is not finite or one whose x is no long are in none; neither are empty ones."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    child = column.values.cast(pa.float64())
    entries = child.fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = np.where(valid, np.diff(offsets), 0)
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        scaled = np.floor(SCALE * entries[offsets[rows][:, None] + np.arange(size)])
        ok = (np.abs(scaled) < 2.0**62).all(axis=1)
        if ok.any():
            yield rows[ok], scaled[ok].astype(np.int64) + SHIFT


def _partial_sums(vectors: DataFrame, column: str) -> DataFrame:
    """``dim, place, n, total``: per task and dimension, how many vectors there are and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = defaultdict(int)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _whole(batch.column(0)):
                size = x.shape[1]
                counts[size] += len(x)
                part = x.sum(axis=0) if np.abs(x).max() < _SMALL * _SMALL else x.astype(object).sum(axis=0)
                sums[size] = sums.get(size, 0) + part.astype(object)
        for size, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * size, pa.int32()),
                    pa.array(range(size), pa.int32()),
                    pa.array([counts[size]] * size, pa.int64()),
                    pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
                ],
                ["dim", "place", "n", "total"],
            )

    return vectors.select(column).mapInArrow(run, "dim int, place int, n bigint, total decimal(38,0)")


def _partial_products(vectors: DataFrame, column: str, centres: dict[int, list[int]]) -> DataFrame:
    """``dim, place, total``: per task and dimension, the sums of products of centred entries ``i <= j``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _whole(batch.column(0)):
                size = x.shape[1]
                y = x - np.array(centres[size], np.int64)
                exact = np.abs(y).max() ** 2 * len(y) < 2**52 if np.abs(y).max() < _SMALL else False
                products = (y.T.astype(float) @ y).astype(np.int64) if exact else y.T.astype(object) @ y.astype(object)
                sums[size] = sums.get(size, 0) + products[np.triu_indices(size)].astype(object)
        for size, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * len(total), pa.int32()),
                    pa.array(range(len(total)), pa.int32()),
                    pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
                ],
                ["dim", "place", "total"],
            )

    return vectors.select(column).mapInArrow(run, "dim int, place int, total decimal(38,0)")


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """A model per dimension of the vectors in ``column``; vectors of different dimension have no common covariance.
    The driver gets sums only: the size of a model does not depend on the number of vectors."""
    merged = _partial_sums(vectors, column).groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for row in merged.limit(MOST_NUMBERS).collect():
        counts[row["dim"]] = row["n"]
        sums.setdefault(row["dim"], [0] * row["dim"])[row["place"]] = int(row["total"])
    if sum(d * d for d in sums) > MOST_NUMBERS:
        raise ValueError(f"covariances of more than {MOST_NUMBERS} numbers are not broadcast")
    if not sums:
        return {}
    centres = {d: [t // counts[d] for t in totals] for d, totals in sums.items()}
    products: dict[int, dict[int, int]] = defaultdict(dict)
    summed = _partial_products(vectors, column, centres).groupBy("dim", "place").agg(F.sum("total").alias("total"))
    for row in summed.collect():
        products[row["dim"]][row["place"]] = int(row["total"])
    out = {}
    for d, found in products.items():
        n = counts[d]
        # Centred entries still add up to ``rest``; n * products - rest * rest is the exact covariance times n * n.
        rest = [t - n * c for t, c in zip(sums[d], centres[d])]
        cov = np.zeros((d, d))
        for place, (i, j) in enumerate(zip(*np.triu_indices(d))):
            cov[i, j] = cov[j, i] = (n * found[place] - rest[i] * rest[j]) / (n * n)
        values, basis = eigen(cov)
        trace = float(np.trace(cov))
        k = min(components, d)
        zero = values[:k] <= d * EPS * max(float(values[0]), 0.0)
        lengths = np.sqrt(np.where(zero, np.nan, values[:k]))
        shares = values[:k] / trace if trace > 0 else np.full(k, np.nan)
        out[d] = Fit(n, sums[d], values[:k], shares, basis[:, :k] / lengths)
    return out


def _deviations(y: np.ndarray, rest: list[int], n: int) -> list[int | None]:
    """Sums of (n * y - rest) ** 2 over the dimensions, exact; None past the range of a long."""
    if (n * (int(np.abs(y).max()) + 1)) ** 2 * y.shape[1] < _LONG:
        return ((y * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((y.astype(object) * n - np.array(rest, object)) ** 2).sum(axis=1)
    return [t if t < _LONG else None for t in exact]


def whiten(vectors: DataFrame, models: dict[int, Fit], column: str = "embedding", into: str = "whitened") -> DataFrame:
    """``vectors`` with ``into`` (array of doubles, one per component), ``deviation`` (long) and ``dim`` (int).

    Rows whose vector is null, holds a null or a value that is not finite, or one too large to be scaled to a long,
    are left out; so are vectors without entries and those of a dimension that the models do not have. Equal vectors
    give equal rows, and repeated rows stay. A component of variance 0 gives null. Other columns pass through; a given
    column of a new column's name is replaced. No rows give no rows."""
    held = vectors.sparkSession.sparkContext.broadcast(models)
    new = {into: "array<double>", "deviation": "bigint", "dim": "int"}
    kept = [c for c in vectors.columns if c not in new or c == column]
    rest = [c for c in kept if c not in new]
    schema = ", ".join([*(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in rest), *(f"`{c}` {t}" for c, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            for rows, x in _whole(batch.column(kept.index(column))):
                model = known.get(x.shape[1])
                if model is None:
                    continue
                # The mean is a whole part and a rest over n: x minus the whole part has no rounding.
                y = x - np.array([t // model.n for t in model.sums], np.int64)
                rest_sums = [t % model.n for t in model.sums]
                out = (y - np.array([t / model.n for t in rest_sums])) @ model.matrix
                k = out.shape[1]
                flat = pa.array(out.ravel(), pa.float64(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * k), flat)
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[picked.column(kept.index(c)) for c in rest],
                        lists,
                        pa.array(_deviations(y, rest_sums, model.n), pa.int64()),
                        pa.array([x.shape[1]] * len(x), pa.int32()),
                    ],
                    [*rest, *new],
                )

    return vectors.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def identity_errors(whitened: DataFrame, models: dict[int, Fit], column: str = "whitened") -> dict[int, float]:
    """Per dimension (column ``dim``), the largest absolute entry of the covariance of the whitened rows minus the
    identity, over components that have a variance. The rows are centred by ``whiten``; what is left of their mean,
    some roundings, is taken off the summed products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            listed, dims = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for size in np.unique(dims).tolist():
                rows = listed.filter(pa.array(dims == size))
                w = rows.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                part = np.concatenate([w.sum(axis=0), (w.T @ w)[np.triu_indices(w.shape[1])]])
                sums[size] = sums.get(size, 0) + part
        for size, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(total)],
                ["dim", "place", "total"],
            )

    parts = whitened.select(column, "dim").mapInArrow(run, "dim int, place int, total double")
    totals: dict[int, dict[int, float]] = defaultdict(dict)
    for row in parts.groupBy("dim", "place").agg(F.sum("total").alias("total")).collect():
        totals[row["dim"]][row["place"]] = row["total"]
    out = {}
    for size, found in totals.items():
        n, k = models[size].n, len(models[size].values)
        flat = np.array([found[place] for place in range(len(found))]) / n
        mean, error = flat[:k], 0.0
        for value, i, j in zip(flat[k:], *np.triu_indices(k)):
            if not np.isnan(value):
                error = max(error, abs(float(value - mean[i] * mean[j]) - (i == j)))
        out[size] = float(error)
    return out


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings, whitened by the components of all embeddings: a row per vector and component."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    models = fit(vectors)
    rows = whiten(vectors, models)
    errors = identity_errors(rows, models)
    told = [
        (d, i, m.n, None if np.isnan(m.explained[i - 1]) else float(m.explained[i - 1]), errors.get(d))
        for d, m in models.items()
        for i in range(1, len(m.values) + 1)
    ]
    facts = spark.createDataFrame(told, "dim int, component int, n bigint, explained double, identity_error double")
    flat = rows.select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return flat.withColumn("component", F.col("component") + 1).join(F.broadcast(facts), ["dim", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )


QUERIES = {"op12_whitening": (op12_whitening, None)}
