"""Overlapping chunks of a text that end and begin at paragraphs, lines or white space. Offsets count UTF-16 units.

Texts of a batch are laid end to end, and the places of each kind of boundary are listed
once, in order. All texts then move on by a chunk at a time together: where a chunk ends,
where it begins and ends without white space, and where the next may begin are each a
search in one of the lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.text import WHITESPACE

#: Units of a chunk and of an overlap, part of a chunk within which it may end earlier, and how far its beginning may move.
TARGET, OVERLAP = 1000, 150
_LEAST_PART, _REACH = 0.7, 75
_BLANK = np.zeros(1 << 16, bool)
_BLANK[[ord(c) for c in WHITESPACE]] = True
_NEWLINE = 10
#: Units of texts that are laid end to end (a longer text alone).
_BATCH_UNITS = 1 << 20
CHUNKS_TYPE = "array<struct<chunk_index:int,content:string,content_hash:string,start_offset:int,end_offset:int>>"


def check_options(target: int, overlap: int) -> None:
    if not isinstance(target, int) or target < 1:
        raise ValueError("target must be a positive integer")
    if not isinstance(overlap, int) or not 0 <= overlap < target:
        raise ValueError("overlap must be a non-negative integer below target")


class _Places:
    """Places in order, sought from either side; where there is none the answer is out of every range."""

    def __init__(self, places: np.ndarray):
        self.places = np.concatenate([[-(1 << 60)], places, [1 << 60]])

    def last(self, at: np.ndarray) -> np.ndarray:
        """The last place up to ``at``."""
        return self.places[np.searchsorted(self.places, at, side="right") - 1]

    def next(self, at: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on."""
        return self.places[np.searchsorted(self.places, at)]


class _Laid:
    """Texts laid end to end as UTF-16 units, with their boundaries."""

    def __init__(self, texts: Sequence[str]):
        self.units = np.frombuffer("".join(texts).encode("utf-16-le", "surrogatepass"), np.uint16)
        sizes = np.array([len(t) for t in texts], np.int64)
        if len(self.units) > sizes.sum():  # some characters have two units
            sizes = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        blank, line = _BLANK[self.units], self.units == _NEWLINE
        double = line[:-1] & line[1:] if len(line) else line
        double[self.ends[(self.ends > 0) & (self.ends < len(self.units))] - 1] = False  # not of two texts
        self.blank = blank
        #: Where a chunk may end, the best kind first, and how far behind that the next may begin.
        self.kinds = [(_Places(np.flatnonzero(mask)), behind) for mask, behind in ((double, 2), (line, 1), (blank, 1))]
        edges = np.flatnonzero(np.diff(blank.astype(np.int8)))
        self.word_begins = _Places(edges[blank[edges]] + 1)  # after white space
        self.word_ends = _Places(edges[~blank[edges]] + 1)  # before white space

    def whole(self, at: np.ndarray) -> np.ndarray:
        """``at``, or one less where it would part the two units of a character."""
        inside = (at > 0) & (at < len(self.units))
        here, before = self.units[np.where(inside, at, 0)], self.units[np.where(inside, at - 1, 0)]
        return at - (inside & (before >> 10 == 0x36) & (here >> 10 == 0x37))

    def onward(self, at: np.ndarray, past: np.ndarray) -> np.ndarray:
        """``whole``, or the place behind the character where that would not come past ``past``."""
        found = self.whole(at)
        return np.where(found > past, found, at + 1)

    def skip(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on that is not white space, up to ``end``."""
        on_blank = (at < end) & self.blank[np.minimum(at, len(self.blank) - 1)]
        return np.where(on_blank, np.minimum(self.word_begins.next(at), end), at)

    def chunk_ends(self, at: np.ndarray, end: np.ndarray, target: int) -> np.ndarray:
        """Where chunks that begin at ``at`` end: in their last part at the last boundary of the best kind there is, else when full."""
        full = np.minimum(end, at + target)
        least = np.minimum(full - 1, at + int(target * _LEAST_PART))
        found = self.onward(full, at)
        for places, _ in reversed(self.kinds):
            last = places.last(full - 1)
            found = np.where(last >= least, last, found)
        return np.where(full == end, end, found)

    def next_begins(self, begin: np.ndarray, end: np.ndarray, overlap: int) -> np.ndarray:
        """Where the chunks after those from ``begin`` to ``end`` may begin: behind the boundary of the best kind that lies nearest to the wanted overlap, later ones before earlier ones as near."""
        if not overlap:
            return end
        wanted = np.maximum(begin + 1, end - overlap)
        reach = max(1, min(_REACH, overlap // 3))
        low, high = np.maximum(begin + 1, wanted - reach), np.minimum(end - 1, wanted + reach)
        found = self.whole(wanted)
        for places, behind in reversed(self.kinds):
            later = places.next(np.maximum(wanted, low) - behind) + behind
            earlier = places.last(np.minimum(wanted, high) - behind) + behind
            is_later, is_earlier = later <= high, earlier >= low
            nearer = is_later & (~is_earlier | (later - wanted <= wanted - earlier))
            found = np.where(nearer, later, np.where(is_earlier, earlier, found))
        return found


def _spans(laid: _Laid, target: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of all chunks, by text and place."""
    own = np.flatnonzero(laid.ends > laid.begins)
    at = laid.skip(laid.begins[own], laid.ends[own])
    found = []
    while True:
        on = at < laid.ends[own]
        own, at = own[on], at[on]
        if not len(own):
            break
        limit = laid.ends[own]
        cut = laid.chunk_ends(at, limit, target)
        begin = laid.skip(at, cut)
        solid = (cut > begin) & ~laid.blank[np.maximum(cut - 1, 0)]
        end = np.where(solid, cut, np.maximum(begin, laid.word_ends.last(cut)))
        kept = end > begin
        found.append((own[kept], begin[kept], end[kept]))
        following = laid.skip(laid.next_begins(begin, end, overlap), limit)
        moved = np.where(following > at, following, laid.onward(np.minimum(cut, at + max(1, target - overlap)), at))
        at = np.where(cut >= limit, limit, moved)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    text, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], begin[order], end[order]


def _chunked(texts: list[str], target: int, overlap: int) -> list[tuple[int, int, str, str, int, int]]:
    """(text, index, content, hash, start, end) of the chunks of all texts, in order."""
    laid = _Laid(texts)
    text, begin, end = _spans(laid, target, overlap)
    index = np.arange(len(text)) - np.searchsorted(text, text)
    plain = len(laid.units) == sum(map(len, texts))
    out = []
    for t, k, a, b in zip(text.tolist(), index.tolist(), begin.tolist(), end.tolist(), strict=True):
        base = int(laid.begins[t])
        content = texts[t][a - base : b - base] if plain else laid.units[a:b].tobytes().decode("utf-16-le", "replace")
        out.append((t, k, content, hashlib.sha256(content.encode("utf-8", "replace")).hexdigest(), a - base, b - base))
    return out


def _runs(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a column, in runs of bounded length together, a few at a time taken out of it."""
    held, size = [], 0
    for begin in range(0, len(column), 64):
        for t in column.slice(begin, 64).to_pylist():
            if held and size + len(t or "") > _BATCH_UNITS:
                yield held
                held, size = [], 0
            held.append(t or "")
            size += len(t or "")
    if held:
        yield held


def chunk(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, str, str, int, int]]:
    """(index, content, hash, start, end) of every chunk of one text."""
    check_options(target, overlap)
    return [c[1:] for c in _chunked([text or ""], target, overlap)]


def chunk_lists(columns: Iterator[pa.Array], target: int = TARGET, overlap: int = OVERLAP) -> Iterator[pa.Array]:
    """Arrays of the chunks of texts; a run's go out before the next run's are made, so a task holds one run of them."""
    names = ("chunk_index", "content", "content_hash", "start_offset", "end_offset")
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    for column in columns:
        for texts in _runs(column):
            found = _chunked(texts, target, overlap)
            counts = np.bincount(np.array([c[0] for c in found], np.int64), minlength=len(texts))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            fields = [pa.array([c[k + 1] for c in found], kind) for k, kind in enumerate(kinds)]
            yield pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names))


def chunk_text(content: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """The chunks of each text, as an array of structs."""
    check_options(target, overlap)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return chunk_lists(columns, target, overlap)

    return F.arrow_udf(run, CHUNKS_TYPE)(content)


def chunk_documents(documents: DataFrame, id_column: str, text_column: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk of each document."""
    return documents.select(F.col(id_column), F.inline(chunk_text(F.col(text_column), target, overlap)))


def overlaps(chunks: DataFrame, id_column: str) -> DataFrame:
    """Each chunk with the units it shares with the one before."""
    before = F.lag("end_offset").over(Window.partitionBy(id_column).orderBy("chunk_index"))
    return chunks.withColumn("overlap", before - F.col("start_offset"))
