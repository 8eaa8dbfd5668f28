"""Whitening of embeddings: pivoted Cholesky, then one-sided Jacobi on its factor.

Entries become whole numbers, so counts, sums and the centred scatter are added up
exactly: each task emits partial sums, Spark adds them, and only one number per
pair of dimensions reaches the driver. There the scatter is factored with the
greatest remaining diagonal first, and the columns of the factor are rotated until
they are orthogonal. Their squared norms are the eigenvalues and the normalised
columns the components; the scatter itself is never diagonalised. Each row is then
projected where it lies: nothing but partial sums is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import written

SCALE = 1024
SHIFT = 100_000
#: Whole numbers a double holds exactly; entries beyond stop at this bound.
BOUND = 1 << 52
#: Rows multiplied at a time.
BLOCK_ROWS = 4096
#: Partial sums are emitted as two longs, the lower of so many bits.
LOW_BITS = 40
SWEEPS = 60

SUMS = "width int, place int, n long, high long, low long"
PRODUCTS = "i int, j int, high long, low long"
MOMENTS = "i int, j int, value double"


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per vector length: the places of the usable rows in the batch, and their entries as longs.

    Null vectors and those that hold a null or a number that is not finite are left out.
    """
    column = column.cast(pa.large_list(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for width in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == width)
        entries = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        fine = np.isfinite(entries).all(axis=1)
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(SCALE * entries[fine]), -BOUND, BOUND)
        yield places[fine], scaled.astype(np.int64) + SHIFT


def _halves(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums >> LOW_BITS, sums & ((1 << LOW_BITS) - 1)


def _whole(high: int, low: int) -> int:
    return (high << LOW_BITS) + low


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for batch in batches:
        for _, x in whole_numbers(batch.column(0)):
            own = totals.setdefault(x.shape[1], [0, 0, 0])
            own[0] += len(x)
            for begin in range(0, len(x), 1 << 10):
                high, low = _halves(x[begin : begin + (1 << 10)].sum(axis=0))
                own[1], own[2] = own[1] + high, own[2] + low
    for width, (n, high, low) in totals.items():
        if n:
            columns = [np.full(width, width, np.int32), np.arange(width, dtype=np.int32), np.full(width, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], SUMS.replace(",", "").split()[::2])


def products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns: in doubles while they hold them, else in integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        wide = y.astype(np.float64)
        return (wide.T @ wide).astype(np.int64)
    if most * most * len(y) < 2**63:
        return y.T @ y
    big = y.astype(object)
    return big.T @ big


def _products(middle: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(middle)
        high, low = np.zeros((2, width, width), object)
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                if x.shape[1] == width:
                    for begin in range(0, len(x), BLOCK_ROWS):
                        more_high, more_low = _halves(products(x[begin : begin + BLOCK_ROWS] - middle))
                        high, low = high + more_high, low + more_low
        i, j = np.triu_indices(width)
        columns = [i.astype(np.int32), j.astype(np.int32), high[i, j].astype(np.int64), low[i, j].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "high", "low"])

    return run


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """A factor ``f`` with ``f @ f.T`` equal to ``scatter``, one column per step up to the rank.

    Each step takes the dimension with the greatest remaining diagonal.
    """
    left = scatter.astype(float).copy()
    order = np.arange(len(left))
    factor = np.zeros_like(left)
    least = len(left) * np.finfo(float).eps * left.diagonal().max(initial=0)
    for step in range(len(left)):
        pivot = step + int(np.argmax(left.diagonal()[step:]))
        if left[pivot, pivot] <= least:
            return _unpermuted(factor[:, :step], order)
        for rows in (left, left.T, factor, order):
            rows[[step, pivot]] = rows[[pivot, step]]
        factor[step, step] = np.sqrt(left[step, step])
        column = left[step + 1 :, step] / factor[step, step]
        factor[step + 1 :, step] = column
        left[step + 1 :, step + 1 :] -= np.outer(column, column)
    return _unpermuted(factor, order)


def _unpermuted(factor: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(factor)
    out[order] = factor
    return out


def _rounds(count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which every two columns meet once."""
    places = np.arange(count + count % 2)
    for _ in range(len(places) - 1):
        a, b = places[: len(places) // 2], places[: len(places) // 2 - 1 : -1]
        real = (a < count) & (b < count)
        yield a[real], b[real]
        places = np.concatenate((places[:1], places[-1:], places[1:-1]))


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """The columns rotated among each other until all are orthogonal: one-sided Jacobi."""
    columns = factor.copy()
    limit = np.finfo(float).eps * max(columns.shape[0], 1) ** 0.5
    for _ in range(SWEEPS):
        turned = False
        for a, b in _rounds(columns.shape[1]):
            left, right = columns[:, a], columns[:, b]
            inner = (left * right).sum(axis=0)
            norms = (left * left).sum(axis=0), (right * right).sum(axis=0)
            open_ = np.abs(inner) > limit * np.sqrt(norms[0] * norms[1])
            if not open_.any():
                continue
            turned = True
            safe = np.where(open_, inner, 1.0)
            slope = (norms[1] - norms[0]) / (2 * safe)
            tangent = np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.hypot(1.0, slope))
            tangent = np.where(open_, tangent, 0.0)
            cosine = 1 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            columns[:, a], columns[:, b] = cosine * left - sine * right, sine * left + cosine * right
        if not turned:
            break
    return columns


def eigenpairs(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues in falling order and unit eigenvectors as columns.

    Of the two signs the one is taken that makes the greatest entry positive.
    """
    columns = orthogonal_columns(pivoted_cholesky(scatter))
    norms = np.sqrt((columns * columns).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    vectors = columns[:, order] / norms[order]
    greatest = np.abs(vectors).argmax(axis=0) if vectors.size else np.empty(0, int)
    signs = np.sign(vectors[greatest, np.arange(vectors.shape[1])])
    return norms[order] ** 2, vectors * signs


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: count, whole middle and rest of the sums, and the components."""

    n: int
    middle: np.ndarray
    rest: list[int]
    directions: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of rows of entries."""
        mean_rest = np.array([r / self.n for r in self.rest])
        return ((x - self.middle) - mean_rest) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the exact sum over dimensions of ``(n * x - S) ** 2``.

        With ``S = n * middle + rest`` this is ``sum (n * y - rest) ** 2`` of small ``y``.
        """
        rest = np.array(self.rest, object)
        y = x - self.middle
        most = max(int(np.abs(y).max(initial=0)), 1)
        small = most * max(most, max(self.rest, default=0)) * max(x.shape[1], 1) < 2**63
        y = y if small else y.astype(object)
        squares = (y * y).sum(axis=1).astype(object)
        mixed = (y @ (rest.astype(np.int64) if small else rest)).astype(object)
        return list(self.n * self.n * squares - 2 * self.n * mixed + int((rest * rest).sum()))


def fit_whitening(vectors: DataFrame, components: int) -> Whitening | None:
    """The whitening of all usable vectors of the most common length; None without any."""
    given = vectors.select("embedding")
    parts = given.mapInArrow(_sums, SUMS).groupBy("width", "place")
    sums = written(parts.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")), "sums")
    widest = sums.filter("place = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if widest is None:
        return None
    n, width = widest["n"], widest["width"]
    rows = sums.filter(F.col("width") == width).orderBy("place").collect()
    totals = [_whole(r["high"], r["low"]) for r in rows]
    middle = np.array([total // n for total in totals], np.int64)
    rest = [total % n for total in totals]
    added = given.mapInArrow(_products(middle), PRODUCTS).groupBy("i", "j").agg(F.sum("high"), F.sum("low"))
    scatter = np.zeros((width, width))
    for i, j, high, low in added.collect():
        # n squared times the covariance, as a whole number.
        exact = n * _whole(high, low) - rest[i] * rest[j]
        scatter[i, j] = scatter[j, i] = exact / (n * n)
    values, directions = eigenpairs(scatter)
    values, directions = values[:components], directions[:, :components]
    trace = scatter.trace()
    return Whitening(n, middle, rest, directions / np.sqrt(values), values / trace if trace else values)


def _moments(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(model.explained)
        added = np.zeros((count + 1, count + 1))
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                if x.shape[1] == len(model.middle):
                    values = np.column_stack((np.ones(len(x)), model.apply(x)))
                    added += values.T @ values
        i, j = np.triu_indices(count + 1)
        columns = [i.astype(np.int32), j.astype(np.int32), added[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "value"])

    return run


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The greatest absolute entry of the whitened covariance minus the identity, read off all rows."""
    added = vectors.select("embedding").mapInArrow(_moments(model), MOMENTS).groupBy("i", "j").agg(F.sum("value"))
    sums = np.zeros((len(model.explained) + 1,) * 2)
    for i, j, value in added.collect():
        sums[i, j] = sums[j, i] = value
    means = sums[0, 1:] / model.n
    covariance = sums[1:, 1:] / model.n - np.outer(means, means)
    return float(np.abs(covariance - np.eye(len(means))).max(initial=0))


def _projected(model: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(model.explained)
        numbers = np.arange(1, count + 1, dtype=np.int32)
        for batch in batches:
            for places, x in whole_numbers(batch.column("embedding")):
                if x.shape[1] != len(model.middle) or not len(x):
                    continue
                apart = [Decimal(d) if d < 10**38 else None for d in model.deviations(x)]
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(places, count))),
                    pa.array(np.tile(numbers, len(x))),
                    pa.array(np.full(len(x) * count, model.n)),
                    pa.array(apart, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), count))),
                    pa.array(model.apply(x).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(x) * count, error)),
                ]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def whitened(vectors: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Takes ``vec_id`` and ``embedding``; other columns are ignored. Rows whose vector is
    null, empty, or holds a null or a number that is not finite are dropped, also from
    the fit, and so are vectors of another length than the most common one (of equally
    common ones the longest). Repeated rows count and return each time; a null id is kept. An
    entry beyond ``BOUND`` after scaling counts as that bound. There are as many
    components as the covariance has positive eigenvalues, at most ``components``: an
    empty table, one row or equal rows have none, so the result is empty. Components of
    equal eigenvalues are any of their plane. ``deviation`` is an exact decimal, null
    from 1e38 on.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    model = fit_whitening(vectors, components)
    if model is None or not len(model.explained):
        return spark.createDataFrame([], schema)
    error = identity_error(vectors, model)
    return vectors.select("vec_id", "embedding").mapInArrow(_projected(model, error), schema)


def digest(rows: DataFrame) -> DataFrame:
    """The same rows with ``deviation`` as a long; null where it does not fit."""
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
