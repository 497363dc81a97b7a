"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``window`` consecutive words (the whole item, if
it is shorter). Each window is a set of ``shingle``-word shingles. A first pass
counts every benchmark shingle over all documents; shingles are then ordered by
rarity. As a window must be contained whole, the necessary prefix is its rarest
shingle alone: only windows whose rarest shingle stands in a document are looked at.
There the bounds of length and position (the window must lie inside the document)
are applied and all its words are compared.

Items are read in blocks of at most ``block_windows`` windows, a longer item in pieces that
overlap by a window less a word, so what a task holds is bounded however large the
benchmark or one of its items is; every block meets all documents.

Cases: null and word-less texts have no words and are never hit, and such items
have no windows. A null item id is left out of the lists of items. Repeated items
and equal windows of several items all count. An empty benchmark hits nothing, an
empty table of documents gives an empty result. Other columns are ignored by
``hits`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import text as tx
from webloom.llm.scratch import materialize


@dataclass(frozen=True)
class DecontaminationConfig:
    window: int = 10
    shingle: int = 3
    block_windows: int = 200_000


@dataclass
class Windows:
    """Distinct windows: word hashes one after another, where each begins, the items that hold it, and its rarest shingle."""

    words: np.ndarray
    begin: np.ndarray
    items: list[list[str]]
    rare: np.ndarray = None  # hash of the rarest shingle, sorted
    rare_at: np.ndarray = None  # its place in the window


def _item_windows(rows: list, config: DecontaminationConfig) -> Windows:
    block = next(tx.blocks(pa.array([r["text"] for r in rows], pa.string()), 1 << 62), None)
    found: dict[bytes, tuple[np.ndarray, set]] = {}
    if block is not None:
        w = tx.words(block, "alnum")
        for k, row in enumerate(rows):
            own = w.hashes[w.of_text[k] : w.of_text[k + 1]]
            for i in range(max(1, len(own) - config.window + 1) if len(own) else 0):
                part = own[i : i + config.window]
                found.setdefault(part.tobytes(), (part, set()))[1].add(row["item_id"])
    parts = [p for p, _ in found.values()]
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    return Windows(np.concatenate(parts) if parts else np.zeros(0, np.uint64), begin, [sorted(str(x) for x in s if x is not None) for _, s in found.values()])


def _window_shingles(windows: Windows, k: int, config: DecontaminationConfig) -> np.ndarray:
    """Shingle hashes of window k; a window of fewer words than a shingle is one shingle."""
    own = windows.words[windows.begin[k] : windows.begin[k + 1]]
    return tx.gram_hashes(own, min(config.shingle, len(own)))


def _shingle_sizes(windows: Windows, config: DecontaminationConfig) -> np.ndarray:
    return np.minimum(np.diff(windows.begin), config.shingle)


def _count_shingles(batches: Iterator[pa.RecordBatch], wanted: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    counts = {size: np.zeros(len(own), np.int64) for size, own in wanted.items()}
    for batch in batches:
        for block in tx.blocks(batch.column(0)):
            hashes = tx.words(block, "alnum").hashes
            for size, own in wanted.items():
                grams = tx.gram_hashes(hashes, size)
                if len(own) and len(grams):
                    at = np.searchsorted(own, grams)
                    at[at == len(own)] = 0
                    counts[size] += np.bincount(at[own[at] == grams], minlength=len(own))
    for size, own in wanted.items():
        some = counts[size] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(some.sum(), size), pa.int32()), pa.array(own[some].view(np.int64)), pa.array(counts[size][some])], ["size", "shingle", "n"]
        )


def _scan(batches: Iterator[pa.RecordBatch], windows: Windows, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document row: words, hit words and items of one block of windows."""
    length = np.diff(windows.begin)
    by_size = {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}
    order = {s: w[np.argsort(windows.rare[w], kind="stable")] for s, w in by_size.items()}
    for batch in batches:
        for block in tx.blocks(batch.column(1)):
            w = tx.words(block, "alnum")
            text_of = np.repeat(np.arange(len(block)), np.diff(w.of_text))
            covered = np.zeros(len(w.hashes) + 1, np.int64)
            items: dict[int, set] = {}
            for size, ranked in order.items():
                grams = tx.gram_hashes(w.hashes, size)
                if not len(grams) or not len(ranked):
                    continue
                keys = windows.rare[ranked]
                low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
                at = np.flatnonzero(high > low)
                # every pair of a place and a window with this rarest shingle
                n = (high - low)[at]
                place = np.repeat(at, n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                win = ranked[np.repeat(low[at], n) + inner]
                start = place - windows.rare_at[win]
                end = start + length[win]
                inside = (start >= 0) & (end <= len(w.hashes))
                start, end, win, place = start[inside], end[inside], win[inside], place[inside]
                whole = (start >= w.of_text[text_of[place]]) & (end <= w.of_text[text_of[place] + 1])
                start, end, win = start[whole], end[whole], win[whole]
                same = np.ones(len(win), bool)
                for k in range(int(length[win].max()) if len(win) else 0):
                    live = np.flatnonzero(same & (length[win] > k))
                    same[live] = w.hashes[start[live] + k] == windows.words[windows.begin[win[live]] + k]
                np.add.at(covered, start[same], 1)
                np.add.at(covered, end[same], -1)
                for t, x in set(zip(text_of[start[same]].tolist(), win[same].tolist(), strict=True)):
                    items.setdefault(t, set()).update(windows.items[x])
            hit = np.cumsum(covered[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[w.of_text[1:]] - total[w.of_text[:-1]]
            # the places of the hit words, as ranges, so that blocks of windows can be united
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            cut = np.setdiff1d(w.of_text[1:-1], edge)
            cut = cut[(cut > 0) & (cut < len(hit))]
            cut = cut[hit[cut]]
            edges = np.sort(np.concatenate([edge, cut, cut])).reshape(-1, 2)
            own = np.searchsorted(edges[:, 0], w.of_text)
            spans = [(edges[own[i] : own[i + 1]] - w.of_text[i]).ravel().tolist() for i in range(len(block))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, len(block)),
                    pa.array(np.diff(w.of_text), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([sorted(items.get(i, ())) for i in range(len(block))], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.int64())),
                ],
                ["row_id", "n_words", "n_hit", "items", "spans"],
            )


#: A word of either case, where lower-casing has yet to be done.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _pieces(text: str, config: DecontaminationConfig) -> Iterator[tuple[int, str]]:
    """Pieces of an item's text with their numbers of windows: ``block_windows`` each, the last one fewer; together they have the item's windows."""
    recent: deque[int] = deque(maxlen=config.window - 1)
    begin = end = n = 0
    for word in _WORD.finditer(text):
        if n == config.block_windows + config.window - 1:
            yield config.block_windows, text[begin:end]
            begin, n = (recent[0] if recent else word.start()), len(recent)
        recent.append(word.start())
        n, end = n + 1, word.end()
    if n:
        yield max(1, n - config.window + 1), text[begin:end]


def _item_blocks(benchmark: DataFrame, config: DecontaminationConfig) -> Iterator[list[dict]]:
    """Items, or pieces of long ones, as many at a time as make ``block_windows`` windows at most."""
    held, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        for count, piece in _pieces(row["text"] or "", config):
            if held and n + count > config.block_windows:
                yield held
                held, n = [], 0
            held.append({"item_id": row["item_id"], "text": piece})
            n += count
    if held:
        yield held


def _rank(documents: DataFrame, windows: Windows, config: DecontaminationConfig) -> np.ndarray:
    """Choose each window's rarest shingle by its count over all documents; gives the shingle sizes of the windows."""
    sizes = _shingle_sizes(windows, config)
    own = [_window_shingles(windows, k, config) for k in range(len(sizes))]
    wanted = {int(s): np.unique(np.concatenate([o for o, z in zip(own, sizes, strict=True) if z == s])) for s in np.unique(sizes)}
    counted = documents.select("text").mapInArrow(lambda it: _count_shingles(it, wanted), "size int, shingle long, n long")
    counts = {(r["size"], r["shingle"] % 2**64): r["n"] for r in counted.groupBy("size", "shingle").agg(F.sum("n").alias("n")).toLocalIterator()}
    rare, at = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64)
    for k, (shingles, size) in enumerate(zip(own, sizes, strict=True)):
        at[k] = min(range(len(shingles)), key=lambda i: (counts.get((int(size), int(shingles[i])), 0), i))
        rare[k] = shingles[at[k]]
    windows.rare, windows.rare_at = rare, at
    return sizes


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several blocks of windows found in each row, as one."""
    for batch in batches:
        n_hit, items = [], []
        for n_words, parts, own in zip(*[batch.column(c).to_pylist() for c in ("n_words", "parts", "own")], strict=True):
            edges = np.array([x for spans in parts for x in spans], np.int64).reshape(-1, 2)
            depth = np.bincount(edges[:, 0], minlength=n_words + 1) - np.bincount(edges[:, 1], minlength=n_words + 1)
            n_hit.append(int((np.cumsum(depth) > 0).sum()))
            items.append(sorted({x for some in own for x in some}))
        columns = [batch.column("row_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["row_id", "n_words", "n_hit", "items"])


def _found(documents: DataFrame, benchmark: DataFrame, config: DecontaminationConfig) -> DataFrame:
    """row_id, n_words, n_hit, items for every row of ``documents`` (row_id, text)."""
    found, n_blocks = None, 0
    for rows in _item_blocks(benchmark, config):
        windows = _item_windows(rows, config)
        if not windows.items:
            continue
        sizes = _rank(documents, windows, config)
        part = documents.select("row_id", "text").mapInArrow(
            lambda it, w=windows, z=sizes: _scan(it, w, z), "row_id long, n_words long, n_hit long, items array<string>, spans array<long>"
        )
        found, n_blocks = part if found is None else found.unionByName(part), n_blocks + 1
    if found is None:
        none = Windows(np.zeros(0, np.uint64), np.zeros(1, np.int64), [], np.zeros(0, np.uint64), np.zeros(0, np.int64))
        found = documents.select("row_id", "text").mapInArrow(
            lambda it: _scan(it, none, np.zeros(0, np.int64)), "row_id long, n_words long, n_hit long, items array<string>, spans array<long>"
        )
    if n_blocks > 1:
        # one entry a block of windows that met the row
        some = F.size("spans") > 0
        parts, own = (F.collect_list(F.when(some, F.col(c))).alias(name) for c, name in (("spans", "parts"), ("items", "own")))
        found = found.groupBy("row_id").agg(F.max("n_words").alias("n_words"), parts, own)
        found = found.mapInArrow(_unite, "row_id long, n_words long, n_hit long, items array<string>")
    return found.select("row_id", "n_words", "n_hit", "items")


def hits(documents: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``documents``; rows that share a doc_id are judged apart."""
    numbered = materialize(documents.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id()), "decontamination")
    found = _found(numbered.select("row_id", "text"), benchmark, config).join(numbered.select("row_id", "doc_id"), "row_id")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The rows of ``documents`` in which no benchmark window stands, with all their columns.

    Rows are numbered in a written table, so that rows that share a doc_id are judged apart.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    numbered = materialize(documents.select(row, F.col("text").alias("text")).withColumn("row_id", F.monotonically_increasing_id()), "decontamination").drop("text")
    found = _found(numbered.select("row_id", F.col("row.text").alias("text")), benchmark, config)
    dirty = found.where("n_hit > 0").select("row_id")
    return numbered.join(dirty, "row_id", "left_anti").select("row.*")


def items_digest(items: list[str]) -> str:
    """The digest that ``hits`` gives for these item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
