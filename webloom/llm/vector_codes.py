"""Compression of vectors to short codes by integer codebooks (product quantisation).

Vectors of integers are cut into equal parts, each with a codebook of its own. The
codebooks start as the parts of the smallest ids. A round broadcasts them, and every task
assigns its parts to the nearest entries: squared distances by the expansion of norms,
|c|^2 - 2xc, with exact int64 matrix products, the first of the smallest. A task passes on
one sum for each entry it met, and these are added in a grouped shuffle; an entry becomes
the floor of its parts' mean. So a round moves some thousand sums a task, whatever the
number of vectors and however many are equal. The driver holds the codebooks only.

Cases: see ``integer_vectors`` for nulls, odd numbers and sizes; zeros also fill the last
part where the size is no multiple of ``parts``. Null ids come last in the choice of the
start; equal ids are ordered by their vectors. With fewer vectors than ``entries`` the
codebooks have as many entries as there are vectors. Repeated rows each get a row. Errors
of rows without a label are summed together. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.hot import attach
from webloom.llm.integer_vectors import dimension, integer_vectors, matrix
from webloom.llm.scratch import materialize

#: Rows of one matrix product.
BLOCK = 4096


@dataclass(frozen=True)
class CodeConfig:
    parts: int = 4
    #: Entries of a codebook; a code has two hexadecimal digits a part.
    entries: int = 256
    rounds: int = 4

    def __post_init__(self):
        if self.parts < 1 or not 1 <= self.entries <= 256 or self.rounds < 0:
            raise ValueError("parts from 1, entries from 1 to 256, rounds from 0")


def _width(size: int, parts: int) -> int:
    return -(-size // parts)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the index of the nearest entry in every part, and the squared distances summed over parts."""
    parts, _, width = books.shape
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for p in range(parts):
        own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        turned = np.ascontiguousarray(books[p].T)
        norms = (books[p] * books[p]).sum(axis=1)
        less = norms - 2 * (own @ turned)
        codes[:, p] = less.argmin(axis=1)
        errors += np.take_along_axis(less, codes[:, p : p + 1], 1)[:, 0] + (own * own).sum(axis=1)
    return codes, errors


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, matrix(part.column("x"), width)


def start(rows: DataFrame, config: CodeConfig) -> np.ndarray:
    """Codebooks (part, entry, component) of the smallest ids; ``rows`` is a table of ``integer_vectors`` with vec_id."""
    width = _width(dimension(rows), config.parts)
    first = [r.x for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(config.entries).select("x").collect()]
    books = np.zeros((config.parts, len(first), width), np.int64)
    for k, x in enumerate(first):
        filled = np.zeros(config.parts * width, np.int64)
        filled[: len(x)] = x
        books[:, k] = filled.reshape(config.parts, width)
    return books


def improve(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows; an entry that no part is nearest to stays."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _blocks(batches, parts * width):
            codes, _errors = nearest(x, sent.value)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                met, begin = np.unique(codes[order, p], return_index=True)
                total[p, met] += np.add.reduceat(x[order, p * width : (p + 1) * width], begin, axis=0)
                count[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width, pa.int32())
        added = pa.ListArray.from_arrays(offsets, pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), added], ["part", "entry", "n", "total"])

    partial = rows.select("x").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(width)]).alias("total"))
    better = books.copy()
    for r in merged.collect():  # one row an entry
        better[r.part, r.entry] = np.array(r.total, np.int64) // r.n
    sent.destroy()
    return better


def train(rows: DataFrame, config: CodeConfig = CodeConfig()) -> np.ndarray:
    """Codebooks (part, entry, component) after all rounds."""
    books = start(rows, config)
    if books.size:
        for _ in range(config.rounds):
            books = improve(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``code``, two hexadecimal digits a part, and ``error`` instead of their vectors."""
    parts, _, width = books.shape
    names = [c for c in rows.columns if c != "x"]
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes if name != "x")
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, parts * width):
            codes, errors = nearest(x, sent.value)
            text = codes.astype(np.uint8).tobytes().hex()
            written = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(written, pa.string()), pa.array(errors)], [*names, "code", "error"])

    return rows.select(*names, "x").mapInArrow(run, f"{kinds}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``x array<long>``, the entries that each code names."""
    parts, _, width = books.shape
    sent = codes.sparkSession.sparkContext.broadcast(books)

    def run(code: pa.Array) -> pa.Array:
        at = np.frombuffer(bytes.fromhex("".join(code.to_pylist())), np.uint8).reshape(len(code), parts)
        found = np.concatenate([sent.value[p, at[:, p]] for p in range(parts)], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * (parts * width), pa.int32()), pa.array(found.ravel()))

    return codes.withColumn("x", F.arrow_udf(run, "array<long>")("code"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, config: CodeConfig = CodeConfig()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a vector of finite numbers."""
    rows = integer_vectors(embeddings, vec_id=F.col("vec_id").cast("long"), label=F.col("label"))
    books = train(rows, config)
    if not books.shape[1]:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = materialize(encode(rows, books), "vector-codes")
    by_label = materialize(coded.groupBy("label").agg(F.count("*").alias("_n"), F.sum("error").alias("label_error")), "label-errors")
    return attach(coded, by_label, "label", "_n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
