"""Embeddings as vectors of integers, which the vector operators share.

Cases: a row whose vector is null, or holds a null, NaN or infinite component, goes.
Components are held to ``HELD`` after scaling, far beyond those of any embedding, so that
sums of squares stay exact in 64 bits. Vectors of fewer components than the longest one
count as continued with zeros; so does an empty one. A null id is kept as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.scratch import materialize

SCALE = 1024
HELD = 1 << 24


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a list of doubles, as a list of floor(SCALE * x); rows without such a list go."""
    for batch in batches:
        batch = batch.filter(batch.columns[-1].is_valid())
        lists = batch.columns[-1]
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls come as NaN
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = bad[ends[1:]] == bad[ends[:-1]]
        kept = values[np.repeat(good, sizes)]
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(kept * SCALE), -HELD, HELD).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
        rest = batch.filter(pa.array(good)).columns[:-1]
        yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled))], names=batch.schema.names)


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", **others: Column) -> DataFrame:
    """A written table of the ``others`` columns and ``x array<int>`` for each row with a vector of finite numbers."""
    rows = embeddings.select(*[c.alias(name) for name, c in others.items()], F.col(vector).cast("array<double>").alias("x"))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[:-1])
    return materialize(rows.mapInArrow(_integers, f"{kinds}, x array<int>"), "integer-vectors")


def dimension(rows: DataFrame) -> int:
    """The components of the longest vector."""
    return rows.agg(F.max(F.size("x"))).first()[0] or 0


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """A row of int64 for each list, shorter ones continued with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(len(lists), width)
    found = np.zeros((len(lists), width), np.int64)
    found[np.arange(width) < sizes[:, None]] = values
    return found
