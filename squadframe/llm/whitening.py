"""Whitening of embeddings with exact covariances by digit-slice products.

Components become integers. Their products are summed exactly: a block's integers are split into limbs so small that the
float64 products of two limb matrices, done by BLAS, stay below 2^53; the products are carried into digits of a big
integer for each pair of dimensions. Tasks emit digits, digits are added up, and only the result, one matrix for each
length of vectors, is turned into big integers, centred without any rounding and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, work_table

#: Bits of a limb and rows of a block: sums of a block's products of limbs stay below 2^53.
LIMB, BLOCK = 20, 4096
#: Digits (of LIMB bits, the last one signed) of a sum: 2^126 for two 64-bit factors, and rows.
DIGITS = 8
#: Rows of a matrix that travel together when the tasks' sums are added up.
STRIPE = 8
_LOW = np.int64((1 << LIMB) - 1)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float64 matrices L with x = sum of L[k] * 2^(LIMB k); all but the last are not negative."""
    out, half = [], 1 << (LIMB - 1)
    while x.size and (x.max() >= half or x.min() < -half):
        out.append((x & _LOW).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def carried(digits: np.ndarray) -> np.ndarray:
    """The same numbers with every digit but the last within LIMB bits."""
    for k in range(DIGITS - 1):
        digits[k + 1] += digits[k] >> LIMB
        digits[k] &= _LOW
    return digits


def gram(x: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Adds the exact products x.T @ x of integers to the digits (DIGITS, d, d)."""
    for at in range(0, len(x), BLOCK):
        parts = limbs(x[at : at + BLOCK])
        for a, left in enumerate(parts):
            for b, right in enumerate(parts):
                digits[a + b] += (left.T @ right).astype(np.int64)
        carried(digits)
    return digits


def whole(digits: np.ndarray) -> np.ndarray:
    """Digits as a matrix of Python's integers."""
    out = digits[-1].astype(object)
    for k in range(DIGITS - 2, -1, -1):
        out = (out << LIMB) + digits[k].astype(object)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_width(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column(column).value_lengths().to_numpy()
    for width in np.unique(sizes).tolist():
        yield width, batch if len(batch) == (sizes == width).sum() else batch.take(pa.array(np.flatnonzero(sizes == width)))


def _sums(fit: DataFrame) -> dict[int, np.ndarray]:
    """For each length of the vectors in column x the integer matrix of products of (x, 1) with itself."""

    def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for width, digits in sums.items():
            for k in range(0, width + 1, STRIPE):
                data = np.ascontiguousarray(digits[:, k : k + STRIPE]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["width", "stripe", "digits"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, part in _by_width(batch, "x"):
                x = _matrix(part.column("x"), width)
                x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
                gram(x, sums.setdefault(width, np.zeros((DIGITS, width + 1, width + 1), np.int64)))
        yield from emit(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for width, k, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                digits = np.frombuffer(data, np.int64).reshape(DIGITS, -1)
                held[width, k] = carried(held[width, k] + digits) if (width, k) in held else digits
        for (width, k), digits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([k], pa.int32()), pa.array([digits.tobytes()], pa.binary())], ["width", "stripe", "digits"])

    schema = "width int, stripe int, digits binary"
    # one row for each task and stripe; the sums stream through the adding tasks
    found = fit.mapInArrow(each, schema).repartition("width", "stripe").mapInArrow(add, schema).collect()
    out = {}
    for width in {r["width"] for r in found}:
        stripes = [np.frombuffer(r["digits"], np.int64).reshape(DIGITS, -1, width + 1) for r in sorted((r for r in found if r["width"] == width), key=lambda r: r["stripe"])]
        out[width] = whole(np.concatenate(stripes, axis=1))
    return out


class Whitening:
    """Exact sums of the fit list and the leading components of its covariance."""

    def __init__(self, sums: np.ndarray, components: int):
        self.n, s, products = int(sums[-1, -1]), sums[-1, :-1], sums[:-1, :-1]
        exact = self.n * products - np.outer(s, s)  # n^2 times the covariance, centred before any rounding
        cov = np.array([[v / (self.n * self.n) for v in row] for row in exact.tolist()], np.float64)
        self.sums, self.d = s, len(s)
        values, vectors = np.linalg.eigh(cov)
        top = np.argsort(-values, kind="stable")[: min(components, self.d)]
        total = float(sum(exact[i, i] for i in range(self.d)) / (self.n * self.n))
        self.values, self.vectors = values[top], vectors[:, top]
        self.explained = self.values / total if total > 0 else np.full(len(top), np.nan)
        # what is not above the rounding of the largest value has no direction of its own
        self.varies = self.values > max(values[-1], 0.0) * self.d * np.finfo(float).eps
        self.identity_error = 0.0

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """n x - S as float64, and each row's exact sum of its squares."""
        most = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
        if most * self.n + max(map(abs, self.sums.tolist()), default=0) >= 1 << 62:
            dev = x.astype(object) * self.n - self.sums
            return dev.astype(np.float64), [sum(v * v for v in row) for row in dev.tolist()]
        dev = x * np.int64(self.n) - self.sums.astype(np.int64)
        parts = [p.astype(np.int64) for p in limbs(dev)]  # products of two stay below 2^40, their sums below 2^63
        squares = [0] * len(dev)
        for a, left in enumerate(parts):
            for b, right in enumerate(parts[a:], a):
                part = np.einsum("ij,ij->i", left, right)
                squares = [s + (v << LIMB * (a + b) + (a != b)) for s, v in zip(squares, part.tolist(), strict=True)]
        return dev.astype(np.float64), squares

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for a component without variance."""
        scale = np.sqrt(np.where(self.varies, self.values, np.nan))
        return deviations / self.n @ self.vectors / scale


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of every entry as long (beyond 64 bits: the nearest long)."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def _usable(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components that vary."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for width, part in _by_width(batch, "x"):
                model = models[width]
                w = model.project(model.deviations(_matrix(part.column("x"), width))[0])[:, model.varies]
                mean = w.mean(axis=0)
                held[width] = _joined(held.get(width), (len(w), mean, (w - mean).T @ (w - mean)))
        for width, (n, mean, spread) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([spread.ravel().tolist()], pa.list_(pa.float64()))], ["width", "n", "mean", "spread"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for width, n, mean, spread in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held[width] = _joined(held.get(width), (n, np.array(mean), np.array(spread).reshape(len(mean), len(mean))))
        for width, (n, mean, spread) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([spread.ravel().tolist()], pa.list_(pa.float64()))], ["width", "n", "mean", "spread"])

    schema = "width int, n long, mean array<double>, spread array<double>"
    out = {}
    for r in fit.mapInArrow(each, schema).repartition("width").mapInArrow(add, schema).collect():
        k = len(r["mean"])
        out[r["width"]] = float(np.abs(np.array(r["spread"]).reshape(k, k) / r["n"] - np.eye(k)).max(initial=0))
    return out


def _joined(a, b):
    """Count, mean and centred products of two sets together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fit(vectors: DataFrame, components: int = 4, vector_col: str = "embedding", scale: int = 256) -> dict[int, Whitening]:
    """A model for each length of the usable vectors, from each distinct integer vector once."""
    small_batches(vectors.sparkSession, 2048)
    rows = vectors.select(F.col(vector_col).alias("v")).where(_usable(F.col("v")) & (F.size("v") > 0))
    distinct = work_table(rows.select(integers(F.col("v"), scale).alias("x")).distinct(), "fit_list")
    models = {width: Whitening(sums, components) for width, sums in _sums(distinct).items()}
    for width, error in _identity_errors(distinct, models).items():
        models[width].identity_error = error
    return models


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Per usable row of vectors and component (from 1): id_col, component, n, deviation (decimal(38, 0)), whitened,
    explained, identity_error.

    Rows whose vector is null or empty or holds null or non-finite entries are left out. Entries are floored to integers
    (scale times the entry). Vectors of each length have a model of their own, fitted on each distinct integer vector
    once; repeated rows and ids stay as they are, other columns are ignored. deviation is exact, null beyond 38 digits.
    A component without variance has null whitened; explained is null where nothing varies.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(_usable(F.col("v")) & (F.size("v") > 0))
    models = fit(vectors, components, vector_col, scale)
    limit = 10**38

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch, "x"):
                model = models[width]
                k = len(model.values)
                dev, squares = model.deviations(_matrix(part.column("x"), width))
                white = model.project(dev).ravel()
                times = lambda x: np.tile(x, len(part))
                rows = np.repeat(np.arange(len(part)), k)
                exact = pa.array([str(s) if s < limit else None for s in squares], pa.string()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows)), pa.array(times(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(rows), model.n)), exact,
                     pa.array(white, from_pandas=True), pa.array(times(model.explained), from_pandas=True), pa.array(np.full(len(rows), model.identity_error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.select("id", integers(F.col("v"), scale).alias("x")).mapInArrow(each, f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("id", id_col)
