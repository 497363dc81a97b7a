"""Whitening of embeddings: an exact-to-double covariance, its eigenvectors, and the rows projected on them.

1. Sums of each dimension, exact in integers, give the means as pairs of doubles.
2. Every task centres its rows, the mean's low part included, and adds up their outer
   products in double-double. The products of a block of rows are free of error: centred
   values are split into slices of 21 bits at fixed places (an error-free transformation
   of the matrix product), so that each product of two slices over 1,024 rows is exact in
   a double, whatever order the library adds in; two-sums carry what an addition loses
   into the low part. Tasks pass on high and low parts, a row a dimension, which are
   merged by dimension in the same way.
3. The driver holds the covariance, a number for each pair of dimensions, and solves it
   by numpy's ``eigh``: Householder tridiagonalisation, then divide and conquer.
4. Rows are projected on the leading eigenvectors and divided by the roots of their
   eigenvalues. The covariance of what came out is measured over all rows.

Cases: see ``integer_vectors`` for nulls, odd numbers and sizes. A row with a null vec_id,
and each repeated row, counts. A component without variance (all vectors equal, or fewer
vectors than components) has a null ``whitened`` and no part in ``identity_error``, which
is null where no component has variance. Signs are chosen so that the largest entry of an
eigenvector is positive. A ``deviation`` beyond 64 bits is null. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.integer_vectors import dimension, integer_vectors, matrix

#: Rows of a block, bits of a slice and slices of a value: 2 * SLICE_BITS bits of a product and 10 of the sum stay below 53.
BLOCK, SLICE_BITS, SLICES = 1024, 21, 5


@dataclass(frozen=True)
class WhiteningConfig:
    components: int = 8
    #: Added to every scaled component.
    shift: int = 100_000


@dataclass(frozen=True)
class Whitening:
    """What was learned: the number of rows, sums, mean (high and low), and eigenvectors as columns with their eigenvalues."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    mean_low: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    #: Eigenvalues that are more than rounding.
    real: np.ndarray


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b, and what rounding took from it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(high, more)
    return two_sum(s, e + low + more_low)


def _sliced(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """``SLICES`` slices of ``SLICE_BITS`` bits each, at places that the largest value of each column sets; their sum is high + low to all their bits together."""
    largest = np.abs(high).max(axis=0, initial=0.0)
    unit = 2.0 ** (np.ceil(np.log2(np.where(largest > 0, largest, 1.0))) + 1 - SLICE_BITS)
    out = []
    for _ in range(SLICES):
        part = np.rint(high / unit) * unit
        out.append(part)
        high, low = two_sum(high - part, low)  # the difference is exact
        unit = unit * 2.0**-SLICE_BITS
    return out


def outer_sum(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows' outer products as a double-double, for at most ``BLOCK`` rows."""
    slices = _sliced(high, low)
    total, rest = slices[0].T @ slices[0], np.zeros((high.shape[1],) * 2)
    for place in range(1, SLICES):  # products from the largest to the smallest that count
        for i in range(place // 2 + 1):
            made = slices[i].T @ slices[place - i]
            total, rest = add(total, rest, made)
            if 2 * i != place:
                total, rest = add(total, rest, made.T)
    return total, rest


def _centred(x: np.ndarray, mean: np.ndarray, mean_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(x.astype(np.float64), -mean)
    return two_sum(s, e - mean_low)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, matrix(part.column("x"), width) + shift


def _rows_of(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    size = len(high)
    offsets = pa.array(np.arange(size + 1, dtype=np.int32) * high.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *[pa.ListArray.from_arrays(offsets, pa.array(m.ravel())) for m in (high, low)]], ["i", "high", "low"])


def _merged(partial: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum of the matrices that tasks have sent by rows (i, high, low); a merging task holds one row of each i."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            highs, lows = (batch.column(c).flatten().to_numpy().reshape(-1, size) for c in ("high", "low"))
            for k, i in enumerate(batch.column("i").to_pylist()):
                found[i] = add(*found[i], highs[k], lows[k]) if i in found else (highs[k].copy(), lows[k].copy())
        if found:
            rows = sorted(found)
            out = _rows_of(np.array([found[i][0] for i in rows]), np.array([found[i][1] for i in rows]))
            yield out.set_column(0, "i", pa.array(rows, pa.int32()))

    schema = "i int, high array<double>, low array<double>"
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for r in partial.repartition("i").mapInArrow(merge, schema).collect():  # one row a dimension
        high[r.i], low[r.i] = r.high, r.low
    return high, low


def covariance(rows: DataFrame, width: int, shift: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of rows, exact sums, mean and covariance (high and low parts) of ``integer_vectors``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, np.int64), 0
        for _, x in _blocks(batches, width, shift):
            total += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(total)], ["i", "n", "total"])

    found = rows.select("x").mapInArrow(sums, "i int, n long, total long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # one row a dimension
    n, total = found[0].n, np.zeros(width, np.int64)
    for r in found:
        total[r.i] = r.total
    quotients = [divmod(int(s), n) for s in total]
    mean = np.array([q + r / n for q, r in quotients])
    # what the doubles miss of the true means, from integers
    mean_low = np.array([_remainder(int(s), n, m) for s, m in zip(total, mean, strict=True)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((width, width)), np.zeros((width, width))
        for _, x in _blocks(batches, width, shift):
            high, low = add(high, low, *outer_sum(*_centred(x, mean, mean_low)))
        yield _rows_of(high, low)

    high, low = _merged(rows.select("x").mapInArrow(products, "i int, high array<double>, low array<double>"), width)
    v = high / n
    return n, total, mean, mean_low, v, ((np.longdouble(1) * high - np.longdouble(n) * v + low) / n).astype(np.float64)


def _remainder(total: int, n: int, mean: float) -> float:
    top, bottom = mean.as_integer_ratio()
    return (total * bottom - top * n) / (n * bottom)


def fit(rows: DataFrame, config: WhiteningConfig = WhiteningConfig()) -> Whitening | None:
    """The whitening of all rows of a table of ``integer_vectors``; None where there are none."""
    width = dimension(rows)
    if not width:
        return None
    n, total, mean, mean_low, v, v_low = covariance(rows, width, config.shift)
    v = v + v_low
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)
    vectors = vectors * np.where(largest < 0, -1.0, 1.0)
    keep = min(config.components, width)
    trace = float(np.trace(v))
    real = values[:keep] > max(values[0], 0.0) * width * np.finfo(float).eps
    return Whitening(n, total, mean, mean_low, vectors[:, :keep].copy(), values[:keep].copy(), trace, real)


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened components of rows; NaN for those without variance."""
    high, low = _centred(x, model.mean, model.mean_low)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.real, 1 / np.sqrt(model.values), np.nan)
    return (high @ model.vectors + low @ model.vectors) * scale


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of (n*x - S)^2, exact; null beyond 64 bits."""
    centred = model.n * x - model.sums
    about = (centred.astype(np.float64) ** 2).sum(axis=1)
    exact = (centred * centred).sum(axis=1).tolist()
    for k in np.flatnonzero(about > 9.0e18):
        whole = sum(int(c) ** 2 for c in centred[k])
        exact[k] = whole if whole < 1 << 63 else None
    return pa.array(exact, pa.int64())


def identity_error(rows: DataFrame, model: Whitening, shift: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over all rows and the components with variance."""
    real = np.flatnonzero(model.real)
    if not len(real):
        return None
    size = len(real) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((size, size)), np.zeros((size, size))
        for _, x in _blocks(batches, model.vectors.shape[0], shift):
            found = np.concatenate([project(x, model)[:, real], np.ones((len(x), 1))], axis=1)  # the ones give the sums
            high, low = add(high, low, *outer_sum(found, np.zeros_like(found)))
        yield _rows_of(high, low)

    high, low = _merged(rows.select("x").mapInArrow(products, "i int, high array<double>, low array<double>"), size)
    found = (high + low) / model.n
    mean = found[-1, :-1]
    return float(np.abs(found[:-1, :-1] - np.outer(mean, mean) - np.eye(len(real))).max())


def whiten(embeddings: DataFrame, config: WhiteningConfig = WhiteningConfig()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row and leading component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(embeddings, vec_id=F.col("vec_id").cast("long"))
    model = fit(rows, config)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, width, keep = identity_error(rows, model, config.shift), model.vectors.shape[0], len(model.values)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    share = model.values / model.trace if model.trace > 0 else np.zeros(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, width, config.shift):
            made = project(x, sent.value)
            times = pa.array(np.repeat(np.arange(len(x)), keep))
            columns = [
                batch.column("vec_id").take(times), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * keep, sent.value.n)),
                deviations(x, sent.value).take(times), pa.array(made.ravel(), mask=np.isnan(made.ravel())), pa.array(np.tile(share, len(x))), pa.array([error] * (len(x) * keep), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
