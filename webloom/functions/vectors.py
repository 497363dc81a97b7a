"""Vector functions as native columns: double arithmetic over arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_TOLERANCE = 1e-5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """One less the cosine distance; null if a vector has no length."""
    size = magnitude(a) * magnitude(b)
    return F.when(size > 0, dot(a, b) / size)


def normalized(vector: Column, dimension: int) -> Column:
    """struct<vector, error>: the unit vector, or why there is none."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = magnitude(vector)
    error = (
        F.when(vector.isNull(), "MISSING")
        .when(F.size(vector) != dimension, "DIMENSION_MISMATCH")
        .when(~finite, "NOT_FINITE")
        .when(size == 0, "ZERO_MAGNITUDE")
    )
    unit = F.when(error.isNull(), F.transform(vector, lambda x: x.cast("double") / size))
    return F.struct(unit.alias("vector"), error.alias("error"))


def is_unit(vector: Column) -> Column:
    return F.abs(magnitude(vector) - 1) <= UNIT_TOLERANCE


def literal(vector: list[float]) -> str:
    """``[a,b,...]`` as vector stores take it."""
    if not vector or not all(math.isfinite(x) for x in vector):
        raise ValueError("a vector needs finite numbers")
    return "[" + ",".join(str(x) for x in vector) + "]"


def vector_column(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])
