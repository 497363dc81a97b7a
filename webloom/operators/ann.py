"""Approximate vector search by cells: an opt-in beside the exact search of ``search``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_INDEX = "cell int, part int, id long, vector array<double>"
_FOUND = "query_id long, id long, similarity double"


def train_cells(rows: DataFrame, vector_column: str, id_column: str, cells: int = 64, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Unit centres of the cells, by spherical k-means over a sample.

    The sample is the ``sample`` rows whose ids hash lowest, so it does not depend on
    their order and its size does not grow with the table.
    """
    held = rows.select(vector_column, F.xxhash64(id_column).alias("_h"), id_column).where(F.col(vector_column).isNotNull()).orderBy("_h", id_column).limit(sample)
    taken = [r[0] for r in held.collect()]
    if not taken:
        return np.zeros((0, 0))
    size = len(taken[0])
    points = _unit(np.array([v for v in taken if len(v) == size], np.float64))
    points = points[np.abs(points).sum(axis=1) > 0]
    centres = points[np.random.default_rng(0).permutation(len(points))[:cells]].copy()
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        filled = np.abs(sums).sum(axis=1) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def _unit(m: np.ndarray) -> np.ndarray:
    sizes = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, sizes, out=np.zeros_like(m), where=sizes > 0)


def _vectors(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have one of this dimension and a size."""
    kept = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and len(v) == dimension and None not in v]
    ids = np.array([i for i, _ in kept], np.int64)
    found = _unit(np.array([v for _, v in kept], np.float64).reshape(len(kept), dimension))
    good = np.isfinite(found).all(axis=1) & (np.abs(found).sum(axis=1) > 0)
    return ids[good], found[good]


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def build_index(rows: DataFrame, vector_column: str, id_column: str, centres: np.ndarray, part_rows: int = 20_000) -> DataFrame:
    """(cell, part, id, vector) of every row with a vector of a size: its nearest centre and its unit vector.

    A cell of more than ``part_rows`` rows is dealt by id over as many parts as it needs,
    so no group of one cell and part grows with the table.
    """
    if not len(centres):
        return rows.sparkSession.createDataFrame([], _INDEX)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = _vectors(batch, centres.shape[1])
            cell = (found @ centres.T).argmax(axis=1) if len(ids) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(ids), _lists(found)], ["cell", "id", "vector"])

    placed = rows.select(F.col(id_column).cast("long"), vector_column).mapInArrow(place, "cell int, id long, vector array<double>")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts"))  # one row a cell
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "_parts").cast("int"))
    return dealt.select("cell", "part", "id", "vector")


def search_index(index: DataFrame, queries: DataFrame, vector_column: str, id_column: str, centres: np.ndarray, limit: int = 10, probes: int = 40, block: int = 512) -> DataFrame:
    """(query_id, id, similarity, rank) of the best rows in the ``probes`` cells nearest to each query.

    Queries go to the parts of their cells, in blocks, and meet the rows there in one
    matrix product; each meeting passes on ``limit`` rows a query. ``index`` should be
    a written table: it is read for its parts and for its rows.
    """
    if not len(centres):
        return queries.sparkSession.createDataFrame([], _FOUND).withColumn("rank", F.lit(1))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = _vectors(batch, centres.shape[1])
            cells = np.argsort(-(found @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            n = cells.shape[1] if len(ids) else 0
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()[: n * len(ids)]), pa.array(np.repeat(ids, n)), _lists(np.repeat(found, n, axis=0))], ["cell", "query_id", "asked"])

    asked = queries.select(F.col(id_column).cast("long"), vector_column).mapInArrow(probe, "cell int, query_id long, asked array<double>")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))  # one row a cell
    parts = index.groupBy("cell").agg((F.max("part") + 1).alias("_parts"))
    rows = index.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    sent = asked.join(F.broadcast(blocks), "cell").join(F.broadcast(parts), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "_blocks").cast("int"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def meet(held: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["query_id", "id", "similarity"]
        if not held.num_rows or not wanted.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        matrix = lambda t, c: np.asarray(t[c].combine_chunks().flatten()).reshape(t.num_rows, -1)
        score = matrix(wanted, "asked") @ matrix(held, "vector").T
        ids = np.broadcast_to(held["id"].to_numpy(), score.shape)
        best = np.lexsort((ids, -score), axis=1)[:, :limit]
        owner = np.repeat(wanted["query_id"].to_numpy(), best.shape[1])
        return pa.table([owner, np.take_along_axis(ids, best, 1).ravel(), np.take_along_axis(score, best, 1).ravel()], names)

    keys = ["cell", "part", "block"]
    found = rows.select(*keys, "id", "vector").groupBy(*keys).cogroup(sent.select(*keys, "query_id", "asked").groupBy(*keys)).applyInArrow(meet, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact pairs (query_id, id) that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("_hit") / F.count("*")).alias("recall"))
