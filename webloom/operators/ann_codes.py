"""Approximate vector search whose index grows with the table: cells of about the root of the rows, and short codes in them.

A sample of bounded size gives the cells' centres, in two levels so that a row is held
against some roots of their number only, and codebooks for pieces of what a centre leaves
of a vector. Every row is indexed: its cell and a byte for each piece. A search scans the
codes of the cells nearest to a query, in packed blocks of bounded size that queries meet in
blocks, and reads the whole vectors of the best candidates only, which are ranked exactly.

Cases: rows whose vector is null, of another size than the sample's, without length or not
finite are not indexed, and such queries find nothing. An empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.vectors import cosine_similarity
from webloom.operators.ann import _unit, _vectors
from webloom.operators.crawl import cut_lineage


@dataclass(frozen=True)
class CodeIndexConfig:
    #: Rows that centres and codebooks are learned from at most; those whose ids hash lowest.
    sample: int = 50_000
    max_cells: int = 65_536
    #: Pieces of a vector, each coded by one of up to 256 entries.
    pieces: int = 16
    rounds: int = 8
    #: Upper cells that a row is looked up in.
    uppers: int = 4
    part_rows: int = 50_000
    block: int = 512


@dataclass(frozen=True)
class Codes:
    """What was learned: upper centres, the centres below each of them, all centres, and codebooks (piece, entry, component)."""

    uppers: np.ndarray
    below: list[np.ndarray]
    centres: np.ndarray
    books: np.ndarray

    def cells(self, found: np.ndarray, uppers: int) -> np.ndarray:
        """The nearest centre of each unit vector, sought below its nearest upper centres."""
        if len(self.uppers) <= uppers:
            return (found @ self.centres.T).argmax(axis=1)
        near = np.argpartition(-(found @ self.uppers.T), uppers, axis=1)[:, :uppers]
        best, cell = np.full(len(found), -np.inf), np.zeros(len(found), np.int64)
        for u in np.unique(near):
            own = np.flatnonzero((near == u).any(axis=1))
            score = found[own] @ self.centres[self.below[u]].T
            top = score.argmax(axis=1)
            value = score[np.arange(len(own)), top]
            better = value > best[own]
            best[own[better]], cell[own[better]] = value[better], self.below[u][top[better]]
        return cell

    def encode(self, rest: np.ndarray) -> np.ndarray:
        pieces, _, width = self.books.shape
        parts = rest.reshape(len(rest), pieces, width)
        return np.stack([((b * b).sum(axis=1) - 2 * (parts[:, p] @ b.T)).argmin(axis=1) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)


def _means(points: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    """k-means of a sample; centres are kept at unit length for directions."""
    centres = points[np.random.default_rng(0).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = ((centres * centres).sum(axis=1) - 2 * (points @ centres.T)).argmin(axis=1)
        order = np.argsort(own, kind="stable")
        met, begin = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(points[order], begin, axis=0)
        centres[met] = _unit(sums) if unit else sums / np.bincount(own)[met][:, None]
    return centres


def train(rows: DataFrame, vector_column: str, id_column: str, config: CodeIndexConfig = CodeIndexConfig()) -> Codes | None:
    """Centres and codebooks from a bounded sample; None where no row has a vector."""
    sized = rows.where(F.size(vector_column) > 0)
    n = sized.count()
    held = sized.select(F.col(vector_column).cast("array<double>").alias("v"), F.xxhash64(id_column).alias("h"), id_column).orderBy("h", id_column).limit(config.sample)
    taken = [v for v in (r.v for r in held.collect()) if None not in v]
    points = _unit(np.array([v for v in taken if len(v) == len(taken[0])], np.float64)) if taken else np.zeros((0, 0))
    points = points[np.isfinite(points).all(axis=1) & (np.abs(points).sum(axis=1) > 0)]
    if not len(points):
        return None
    k = max(1, min(config.max_cells, round(n**0.5), len(points) // 8))
    centres = _means(points, k, config.rounds, True)
    uppers = _means(centres, max(1, round(k**0.5)), config.rounds, True)
    of = (centres @ uppers.T).argmax(axis=1)
    kept = np.unique(of)
    below = [np.flatnonzero(of == u) for u in kept]
    size = points.shape[1]
    pieces = max(p for p in range(1, config.pieces + 1) if size % p == 0)
    bare = Codes(uppers[kept], below, centres, np.zeros((pieces, 1, size // pieces)))
    rest = points - centres[bare.cells(points, config.uppers)]
    parts = rest.reshape(len(rest), pieces, -1)
    books = np.stack([_means(np.ascontiguousarray(parts[:, p]), min(256, len(rest)), config.rounds, False) for p in range(pieces)])
    return Codes(uppers[kept], below, centres, books)


_INDEX = "cell int, id long, code binary"


def build(rows: DataFrame, vector_column: str, id_column: str, codes: Codes | None, config: CodeIndexConfig = CodeIndexConfig()) -> DataFrame:
    """(cell, part, id, code) of every row with a vector; write it, as each search reads it."""
    spark = rows.sparkSession
    if codes is None:
        return spark.createDataFrame([], f"{_INDEX}, part int")
    sent = spark.sparkContext.broadcast(codes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = _vectors(batch, sent.value.centres.shape[1])
            cell = sent.value.cells(found, config.uppers) if len(ids) else np.zeros(0, np.int64)
            code = sent.value.encode(found - sent.value.centres[cell]) if len(ids) else np.zeros((0, len(sent.value.books)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(ids), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "id", "code"])

    placed = rows.select(F.col(id_column).cast("long"), vector_column).mapInArrow(place, _INDEX)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / config.part_rows).cast("int").alias("_parts"))  # one row a cell, of which there are max_cells at most
    return placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "_parts").cast("int")).drop("_parts")


#: Task groups that the blocks of codes are dealt to; what is shuffled of a query does not grow with the cells.
_LANES = 8


def _blocks(index: DataFrame, config: CodeIndexConfig) -> DataFrame:
    """Rows of the index packed into blocks of at most ``part_rows``, in the order of cells and ids: (cells, ids, codes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, config.part_rows):
                part = batch.slice(at, config.part_rows)
                columns = [part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), b"".join(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["cells", "ids", "codes"])

    lanes = index.select("cell", "id", "code").repartitionByRange(_LANES, "cell", "id").sortWithinPartitions("cell", "id")
    return cut_lineage(lanes.mapInArrow(pack, "cells binary, ids binary, codes binary"), "codes")


def _asked(queries: DataFrame, vector_column: str, id_column: str, dimension: int, config: CodeIndexConfig) -> DataFrame:
    """Queries packed into blocks of at most ``block``: (ids, vectors), unit vectors of doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = _vectors(batch, dimension)
            for at in range(0, len(ids), config.block):
                columns = [ids[at : at + config.block].tobytes(), found[at : at + config.block].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["query_ids", "vectors"])

    narrow = queries.select(F.col(id_column).cast("long").alias("_id"), vector_column)
    parts = -(-narrow.count() // config.block) or 1
    return cut_lineage(narrow.repartition(parts, "_id").mapInArrow(pack, "query_ids binary, vectors binary"), "asked")


class _Best:
    """The ``keep`` best rows of each query of a block so far, by falling similarity, then by id."""

    def __init__(self, n: int, keep: int):
        self.keep, self.pool, self.held = keep, [], 0
        self.least, self.last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, r = np.nonzero(score >= self.least[queries][:, None])
        value, q, r = score[q, r], queries[q], ids[r]
        better = (value > self.least[q]) | (r < self.last[q])
        self.pool.append((q[better], r[better], value[better]))
        self.held += int(better.sum())
        if self.held > 4 * self.keep * len(self.least):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, r, value = (np.concatenate([p[i] for p in self.pool]) for i in range(3)) if self.pool else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((r, -value, q))
        q, r, value = q[order], r[order], value[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept, full = rank < self.keep, rank == self.keep - 1
        self.least[q[full]], self.last[q[full]] = value[full], r[full]
        self.pool, self.held = [(q[kept], r[kept], value[kept])], int(kept.sum())
        return self.pool[0]


def _scanned(index: DataFrame, queries: DataFrame, vector_column: str, id_column: str, codes: Codes, probes: int, keep: int, config: CodeIndexConfig) -> DataFrame:
    """(query_id, id, similarity): for each query and lane the ``keep`` best rows by their codes.

    Every block of queries meets every block of codes in a product of the two packed tables, which shuffles
    neither; a task holds the best rows of one block of queries while it goes over its lane.
    """
    sent = queries.sparkSession.sparkContext.broadcast(codes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, best = sent.value, None, None
        size = known.centres.shape[1]

        def done() -> pa.RecordBatch:
            q, ids, value = best.cut()
            return pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids), pa.array(value)], ["query_id", "id", "similarity"])

        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, vectors, cells, ids, coded = (batch.column(k)[i].as_py() for k in range(5))
                if query_ids != now:
                    if best is not None:
                        yield done()
                    now, asked, wanted = query_ids, np.frombuffer(query_ids, np.int64), np.frombuffer(vectors).reshape(-1, size)
                    near = np.argsort(-(wanted @ known.centres.T), axis=1, kind="stable")[:, :probes]
                    probed = np.zeros((len(known.centres), len(asked)), bool)
                    probed[near.ravel(), np.repeat(np.arange(len(asked)), near.shape[1])] = True
                    best = _Best(len(asked), keep)
                cells, ids = np.frombuffer(cells, np.int32), np.frombuffer(ids, np.int64)
                coded = np.frombuffer(coded, np.uint8).reshape(len(ids), -1)
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.flatnonzero(probed[cells[a]])
                    for at in range(a, b if len(own) else a, _SCANNED):
                        part = slice(at, min(b, at + _SCANNED))
                        best.add(own, ids[part], wanted[own] @ (known.decode(coded[part]) + known.centres[cells[a]]).T)
        if best is not None:
            yield done()

    packed = _asked(queries, vector_column, id_column, codes.centres.shape[1], config)
    met = packed.hint("shuffle_replicate_nl").crossJoin(_blocks(index, config).coalesce(_LANES))
    return met.mapInArrow(scan, "query_id long, id long, similarity double")


#: Rows of a cell whose similarities with a block of queries are held at once.
_SCANNED = 4096


def candidates(index: DataFrame, queries: DataFrame, vector_column: str, id_column: str, codes: Codes, probes: int, keep: int, config: CodeIndexConfig = CodeIndexConfig()) -> DataFrame:
    """(query_id, id) of the ``keep`` best rows of each query by their codes, in the ``probes`` cells nearest to it."""
    found = _scanned(index, queries, vector_column, id_column, codes, probes, keep, config)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep).select("query_id", "id")


def search(index: DataFrame, rows: DataFrame, queries: DataFrame, vector_column: str, id_column: str, codes: Codes | None, limit: int = 10, probes: int | None = None, keep: int = 200, config: CodeIndexConfig = CodeIndexConfig()) -> DataFrame:
    """(query_id, id, similarity, rank) of the best rows of each query: the ``keep`` best by their codes, ranked by their vectors.

    ``probes`` cells are asked for each query, by default seven tenths of them, which vectors
    that lie evenly in all directions need; a few do where vectors lie in groups. Codes are
    scanned there, a byte a piece; whole vectors are read of ``keep`` rows a query.
    """
    if codes is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
    chosen = candidates(index, queries, vector_column, id_column, codes, probes or -(-7 * len(codes.centres) // 10), keep, config)
    held = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("_vector"))
    asked = queries.select(F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).alias("_asked"))
    ranked = chosen.join(held, "id").join(asked, "query_id").select("query_id", "id", cosine_similarity(F.col("_vector"), F.col("_asked")).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
