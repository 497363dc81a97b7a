"""Vectorised text work on Arrow batches: bytes, words, hashes.

Texts of a batch are joined into one byte array and handled with numpy, a bounded
number of bytes at a time; a longer text is handled alone, as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def _word_table(kind: str) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    if kind == "visible":  # [^\x20\x09-\x0D]+
        table[[32, *range(9, 14)]] = False
    elif kind == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
        table[:128] = False
        table[48:58] = True
        table[97:123] = True
    else:
        raise ValueError(kind)
    return table


WORD_TABLES = {k: _word_table(k) for k in ("visible", "alnum")}

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier modulo 2**64, and of its inverse, up to n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Block:
    """Some texts of a batch: rows [first, last), their bytes, and the places where each begins (one more than rows)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of at most ``size`` bytes or one text. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and raw[-1] > 0 else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(raw, raw[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Block(first, last, body[raw[first] : raw[last]], raw[first : last + 1] - raw[first])
        first = last


@dataclass
class Words:
    """Words of a block: byte bounds, 64-bit hashes, and the first word of each text (one more than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    of_text: np.ndarray


def lower(data: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[data]


def words(block: Block, kind: str, lowered: bool = True, hashed: bool = True) -> Words:
    """Find the words of every text of a block and hash them."""
    data = lower(block.data) if lowered else block.data
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = WORD_TABLES[kind][data]
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    edges = block.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts_here[edges] = inside[1:-1][edges]
    ends_here[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(starts_here)
    ends = np.flatnonzero(ends_here) + 1
    of_text = np.searchsorted(starts, block.offsets)
    hashes = span_hashes(data, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(starts, ends, hashes, of_text)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a byte array, one longer than it."""
    up, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands."""
    sums = prefix_sums(data) if sums is None else sums
    _, down = _power_tables(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values; the result is n - 1 shorter (empty if there are fewer)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total = total * _MULTIPLIER + hashes[k : k + count]
    return mix(total)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


# packed numbers, rows by key, and a filter of keys


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all highest bytes last: sorted ones compress well so."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def column_block(grams: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of columns of each shingle: equal ranges of hashes."""
    return ((grams >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)


def by_first(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    """``solve`` on the other columns of each run of rows with an equal first column."""
    held, last = [], None
    for part in (batch.slice(at, 64) for batch in batches for at in range(0, len(batch), 64)):  # so that few rows are held twice
        for key, *rest in zip(*[c.to_pylist() for c in part.columns], strict=True):
            if key != last and held:
                yield solve(held)
                held = []
            held.append(tuple(rest))
            last = key
    if held:
        yield solve(held)


#: Words of 64 bits in the filter of keys: 8 MB, whatever their number.
_FILTER_WORDS = 1 << 20


def may_be_in(keys: DataFrame, key: str):
    """A test of the column ``key`` that passes all of ``keys`` and some others (a Bloom filter of one hash and bounded size), so that texts of other rows need not be shuffled."""
    place = F.xxhash64(key).bitwiseAND(F.lit(64 * _FILTER_WORDS - 1))
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(xxhash64({key}) & 63 AS INT))")).alias("bits")).toArrow()
    bitmap = np.zeros(_FILTER_WORDS, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    @F.arrow_udf("boolean")
    def test(at: pa.Array) -> pa.Array:
        place = at.to_numpy()
        return pa.array((bitmap[place >> 6] >> (place & 63)) & 1 == 1)

    return test(place)
