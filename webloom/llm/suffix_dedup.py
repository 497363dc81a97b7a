"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier in
the corpus (in a document of smaller doc_id, or before in the same one). For every
place this asks whether its longest previous factor, the longest string that also
starts earlier, has at least ``length`` bytes. In suffix order the previous and the
next entry with a smaller place give that factor; lengths beyond ``length`` make no
difference, so suffixes are ordered and compared by their first ``length`` bytes.

One suffix array of the whole corpus would not distribute. But strings that are
equal have the same lowest-hashed gram in them (their anchor), so the places of an
anchor are looked at together, and only there is a suffix array built:

1. Of equal texts the first is looked at; the others are later copies as wholes.
2. Of every text the maximal runs of starts with one anchor are found. Anchors are
   counted as packed blocks of codes, dealt by ranges of hashes; an anchor that
   several runs of one task have leaves it once. A run whose anchor occurs once in
   the corpus repeats nothing and is not looked at again.
3. Of the other runs the bytes they span meet by anchor, equal ones of a task once, at
   their first place. There the suffix array is built, the common prefixes of its
   neighbours, the previous and next smaller places, and from these the longest
   previous factors. The starts whose factor is too short are the first occurrences.
4. Starts in such runs that are no first occurrences are removed, text by text.

An anchor of very many runs (inside a common line shorter than ``length``) would make
a large group; its starts meet by the longest gram instead, their whole string, which
spreads them. Tasks know such anchors by a list, or by a bitmap where they are many.
A bitmap takes some other anchors for hot as well; all runs of those are split too, so
that only costs work.

Cases: a null text is empty. A text shorter than ``length`` bytes loses nothing. A null
doc_id comes before all others. Rows that share a doc_id follow one another in order of
a hash of their texts, each judged by itself; of equal texts with one doc_id either row
is the first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import text as tx
from webloom.llm.scratch import materialize


#: Bytes of text handled at once, with some twenty numbers of 64 bits for each.
_BLOCK = 1 << 18


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 100
    #: Bytes of the grams of which the lowest-hashed is a string's anchor.
    gram: int = 24
    #: Bytes of spans of which one suffix array is built (or those of one anchor).
    array_bytes: int = 1 << 18
    #: Anchors with more runs than this are split by whole strings, at every size of the corpus.
    hot_runs: int = 10_000
    #: Hot anchors that tasks know as a list; of more they know a bitmap of eight bits or more each, of 2**bitmap_bits bits at most.
    hot_listed: int = 1_000_000
    bitmap_bits: int = 30
    #: Runs that a task holds before it sends their anchors on, and bytes of text for each block of anchors.
    chunk_runs: int = 400_000
    block_bytes: int = 1 << 24


# suffix arrays


def rank_levels(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all places by the next 8, 16, 32, ... and at last ``length`` bytes (zero bytes after the end): equal strings, equal ranks."""
    n = len(data)
    padded = np.zeros(n + length + 8, np.uint64)
    padded[:n] = data
    packed = np.zeros(n + length, np.uint64)
    known = min(8, length)
    for k in range(known):
        packed = (packed << np.uint64(8)) | padded[k : k + n + length]
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    levels = [(known, rank)]
    while known < length:
        step = min(known, length - known)
        top = int(rank.max()) + 1
        pair = rank[: len(rank) - step] * top + rank[step:]
        rank, known = np.unique(pair, return_inverse=True)[1].astype(np.int64), known + step
        levels.append((known, rank))
    return levels


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], one: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of the strings of ``length`` bytes at the places ``one`` and ``other``."""
    found = np.where(levels[-1][1][one] == levels[-1][1][other], length, 0)
    differ = np.flatnonzero(found < length)
    a, b, got = one[differ], other[differ], np.zeros(len(differ), np.int64)
    for known, rank in reversed(levels[:-1]):
        same = rank[a + got] == rank[b + got]
        got[same] += known
    padded = np.concatenate([data, np.zeros(length + 8, data.dtype)])
    live = np.arange(len(differ))
    for _ in range(min(8, length)):
        live = live[padded[a[live] + got[live]] == padded[b[live] + got[live]]]
        got[live] += 1
    found[differ] = np.minimum(got, length)
    return found


def nearest_smaller(values: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """For each entry the least of ``prefixes`` between it and the nearest entry before it with a smaller value (0 if there is none).

    ``prefixes[i]`` stands between entries i-1 and i. All entries jump at once over what they know to be larger, so the way halves each time.
    """
    n = len(values)
    to, least = np.arange(-1, n - 1), prefixes.copy()
    padded = np.concatenate([values, [np.iinfo(np.int64).min]])  # entry -1: before all
    active = np.flatnonzero(padded[to] > values)
    while len(active):
        over = to[active]
        least[active] = np.minimum(least[active], least[over])
        to[active] = to[over]
        active = active[padded[to[active]] > values[active]]
    return np.where(to >= 0, least, 0)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of ``starts`` (ascending) the length, up to ``length``, of the longest string there that also begins at an earlier one of them."""
    levels = rank_levels(data, length)
    suffix = np.argsort(levels[-1][1][starts], kind="stable")  # the suffix array of the starts
    places = starts[suffix]
    prefixes = np.concatenate([[0], common_prefixes(data, levels, places[:-1], places[1:], length)])
    previous = nearest_smaller(places, prefixes)
    following = nearest_smaller(places[::-1], np.concatenate([[0], prefixes[:0:-1]]))[::-1]
    factors = np.zeros(len(starts), np.int64)
    factors[suffix] = np.maximum(previous, following)
    return factors


# anchors


@dataclass
class Runs:
    """Runs of starts with one anchor: text, anchor hash, first start, number of starts, whether the anchor stands at several places."""

    text: np.ndarray
    anchor: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    several: np.ndarray
    sums: np.ndarray

    def ordinal(self) -> np.ndarray:
        """The number of each run within its text."""
        return np.arange(len(self.text)) - np.searchsorted(self.text, self.text)


def runs(block: tx.Block, config: SuffixConfig) -> Runs:
    length, gram = config.length, config.gram
    data = block.data
    sums = tx.prefix_sums(data)
    n = len(data) - length + 1
    nothing = np.zeros(0, np.int64)
    if n <= 0:
        return Runs(nothing, np.zeros(0, np.uint64), nothing, nothing, nothing.astype(bool), sums)
    at = np.arange(len(data) - gram + 1)
    grams = tx.span_hashes(data, at, at + gram, sums)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    anchor = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text_of = np.repeat(np.arange(len(block)), np.diff(block.offsets))[:n]
    inside = np.flatnonzero(np.arange(n) + length <= block.offsets[1:][text_of])
    if not len(inside):
        return Runs(nothing, np.zeros(0, np.uint64), nothing, nothing, nothing.astype(bool), sums)
    hashes = grams[anchor[inside]]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    begin = inside[first]
    count = np.diff(np.concatenate([first, [len(inside)]]))
    return Runs(text_of[begin], hashes[first], begin, count, anchor[begin] != anchor[begin + count - 1], sums)


def _rows(names: str, columns: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names.split())


_SURVEY = "chunk long, ref int, h1 long, h2 long, block long, codes binary, refs binary, runs binary, others binary, times binary"
_SURVEY_NAMES = " ".join(c.split()[0] for c in _SURVEY.split(", "))
_SURVEY_KINDS = [pa.int64(), pa.int32()] + [pa.int64()] * 3 + [pa.binary()] * 5


def anchor_keys(anchors: np.ndarray, n_blocks: int) -> np.ndarray:
    """Block and code of each anchor in one number."""
    return (tx.column_block(anchors, n_blocks) << np.uint64(32)) | (anchors & np.uint64(0xFFFFFFFF))


def _survey(batches: Iterator[pa.RecordBatch], config: SuffixConfig, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, text). Of each chunk of different texts a row for each, and the codes of its anchors.

    Anchors of one run go by blocks, with the text (``refs``) and the run that has them;
    of those of several runs (``others``) the code goes with their number (``times``), and
    texts and runs in a row without a block.
    """
    task, n_chunks = TaskContext.get().partitionId(), 0
    number: dict[tuple, int] = {}
    members: list[tuple] = []
    parts: list[tuple] = []
    held = 0

    def chunk() -> Iterator[pa.RecordBatch]:
        name = (task << 32) | n_chunks
        nothing = [None] * len(members)
        yield _rows(_SURVEY_NAMES, [[name] * len(members), *zip(*members, strict=True), *[nothing] * 6], _SURVEY_KINDS)
        key, ref, run, several = (np.concatenate([x[i] for x in parts]) for i in range(4))
        order = np.argsort(key, kind="stable")
        key, ref, run, several = key[order], ref[order], run[order], several[order]
        if not len(key):
            return
        first = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(first) - 1
        times = np.bincount(group, weights=1 + several).astype(np.uint32)
        many = (times > 1)[group]
        a, b = key[~many], key[many & first]
        bounds = np.arange(n_blocks + 1, dtype=np.uint64) << np.uint64(32)
        at, bt = np.searchsorted(a, bounds), np.searchsorted(b, bounds)
        used = np.flatnonzero((np.diff(at) > 0) | (np.diff(bt) > 0))
        cut = lambda values, edge, kind: [tx.pack(values[edge[x] : edge[x + 1]].astype(kind)) for x in used]
        nothing = [None] * len(used)
        columns = [cut(a, at, np.uint32), cut(ref[~many], at, np.uint16), cut(run[~many], at, np.uint32), cut(b, bt, np.uint32), cut(times[times > 1], bt, np.uint32)]
        yield _rows(_SURVEY_NAMES, [[name] * len(used), *[nothing] * 3, used, *columns], _SURVEY_KINDS)
        yield _rows(_SURVEY_NAMES, [[name], *[[None]] * 5, [tx.pack(ref[many].astype(np.uint16))], [tx.pack(run[many].astype(np.uint32))], [None], [None]], _SURVEY_KINDS)

    for batch in batches:
        h1, h2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for block in tx.blocks(batch.column(2), _BLOCK):
            found = runs(block, config)
            ordinal = found.ordinal()
            ref = np.full(len(block), -1)
            for k in range(len(block)):
                sign = (h1[block.first + k], h2[block.first + k])
                if sign not in number:  # an equal text of this chunk was here
                    number[sign] = ref[k] = len(members)
                    members.append((len(members), *sign))
            new = np.flatnonzero(ref[found.text] >= 0)
            parts.append((anchor_keys(found.anchor[new], n_blocks), ref[found.text[new]], ordinal[new], found.several[new]))
            held += len(new)
            if held > config.chunk_runs or len(members) > 60_000:
                yield from chunk()
                number, members, parts, held, n_chunks = {}, [], [], 0, n_chunks + 1
    if members:
        yield from chunk()


def _again(batches: Iterator[pa.RecordBatch], hot_from: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, chunk, codes, refs, runs, others, times) sorted by block: texts and runs whose anchor others have, and hot anchors."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        codes = [tx.unpack(x[1], np.uint32) for x in held]
        others = [tx.unpack(x[4], np.uint32) for x in held]
        own = np.concatenate(codes)
        values, back = np.unique(np.concatenate([own, *others]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([np.ones(len(own)), *[tx.unpack(x[5], np.uint32) for x in held]]))
        hit = total[back[: len(own)]] > 1
        edge = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        pick = [hit[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        hot = values[total > hot_from].astype(np.int64) | (held[0][6] << 32)
        nothing = [None] * len(hot)
        columns = [
            [x[0] for x in held] + nothing,
            [tx.pack(tx.unpack(x[2], np.uint16)[p]) for x, p in zip(held, pick, strict=True)] + nothing,
            [tx.pack(tx.unpack(x[3], np.uint32)[p]) for x, p in zip(held, pick, strict=True)] + nothing,
            [None] * len(held) + hot.tolist(),
        ]
        return _rows("chunk refs runs hot", columns, [pa.int64(), pa.binary(), pa.binary(), pa.int64()])

    yield from tx.by_first(batches, solve)


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, chunk, refs, runs) sorted by chunk: the runs of each text."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        refs = np.concatenate([tx.unpack(x[1], np.uint16) for x in held]).astype(np.int64)
        own = np.concatenate([tx.unpack(x[2], np.uint32) for x in held])
        order = np.lexsort((own, refs))
        refs, own = refs[order], own[order]
        texts, first = np.unique(refs, return_index=True)
        packed = [tx.pack(own[a:b]) for a, b in zip(first, [*first[1:], len(own)], strict=True)]
        return _rows("chunk ref runs", [[held[0][0]] * len(texts), texts, packed], [pa.int64(), pa.int32(), pa.binary()])

    yield from tx.by_first(batches, solve)


# spans and factors

#: Spans a task holds before it sends them on.
_HELD_SPANS = 60_000

_SPANS = "key long, span binary, doc_id long, h1 long, start int, n int"


def _picked(batch: pa.RecordBatch, config: SuffixConfig) -> Iterator[tuple[tx.Block, Runs, np.ndarray]]:
    """Blocks of rows with the columns text and runs, their runs, and which of these are named there."""
    named = batch.column("runs").to_pylist()
    for block in tx.blocks(batch.column("text"), _BLOCK):
        found = runs(block, config)
        edge = np.searchsorted(found.text, np.arange(len(block) + 1))
        pick = np.concatenate([edge[k] + tx.unpack(named[block.first + k], np.uint32).astype(np.int64) for k in range(len(block))])
        yield block, found, pick


def _hot_test(hot: DataFrame, config: SuffixConfig) -> Callable[[np.ndarray], np.ndarray]:
    """Which of an array's anchor keys are in the written table ``hot`` of keys (as signed numbers), by a list or by a bitmap."""
    n = hot.count()
    if n <= config.hot_listed:
        listed = np.array([r[0] for r in hot.toLocalIterator()], np.int64).view(np.uint64)
        return lambda keys: np.isin(keys, listed)
    mask = (1 << min(config.bitmap_bits, max(6, (8 * n).bit_length()))) - 1
    place = F.col("hot").bitwiseAND(F.lit(mask))  # low bits of a hash
    words = hot.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(hot & {mask & 63} AS INT))")).alias("bits")).toArrow()
    bitmap = np.zeros((mask + 1) >> 6, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def test(keys: np.ndarray) -> np.ndarray:
        at = (keys & np.uint64(mask)).astype(np.int64)
        return (bitmap[at >> 6] >> (at & 63)) & 1 == 1

    return test


def _spans(batches: Iterator[pa.RecordBatch], config: SuffixConfig, hot: Callable[[np.ndarray], np.ndarray], n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Spans of the runs that are not alone, equal ones met in succession once; of hot anchors each start by itself, by its whole string."""
    best: dict[tuple[int, bytes], tuple] = {}

    def rows() -> pa.RecordBatch:
        columns = [[k for k, _ in best], [x for _, x in best], *zip(*best.values(), strict=True)]
        return _rows("key span doc_id h1 start n", columns, [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    for batch in batches:
        docs, h1 = batch.column("doc_id").to_numpy(), batch.column("h1").to_numpy()
        for block, found, pick in _picked(batch, config):
            is_hot = hot(anchor_keys(found.anchor[pick], n_blocks))
            cold, split = pick[~is_hot], pick[is_hot]
            m = found.count[split]
            place = np.repeat(found.begin[split], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            keys = np.concatenate([found.anchor[cold], tx.span_hashes(block.data, place, place + config.length, found.sums)]).view(np.int64)
            begin, count = np.concatenate([found.begin[cold], place]), np.concatenate([found.count[cold], np.ones(len(place), np.int64)])
            text = np.concatenate([found.text[cold], np.repeat(found.text[split], m)])
            where = zip(docs[block.first + text].tolist(), h1[block.first + text].tolist(), (begin - block.offsets[text]).tolist(), count.tolist(), strict=True)
            body, extra = block.data.tobytes(), config.length - 1
            for key, a, n, place_of in zip(keys.tolist(), begin.tolist(), count.tolist(), where, strict=True):
                name = (key, body[a : a + n + extra])
                if name not in best or place_of < best[name]:
                    best[name] = place_of
            if len(best) > _HELD_SPANS:
                yield rows()
                best = {}
    if best:
        yield rows()


def _first_occurrences(batches: Iterator[pa.RecordBatch], config: SuffixConfig) -> Iterator[pa.RecordBatch]:
    """Rows of spans sorted by key: the starts whose longest previous factor is too short, as ranges."""

    def solve(held: dict[bytes, tuple]) -> pa.RecordBatch:
        spans = sorted(held.items(), key=lambda x: x[1])
        sizes = np.array([len(x) for x, _ in spans], np.int64)
        data = np.frombuffer(b"".join(x for x, _ in spans), np.uint8)
        doc, h1, start, counts = (np.array(x, np.int64) for x in zip(*[x for _, x in spans], strict=True))
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(np.cumsum(sizes) - sizes, counts) + inner
        first = longest_previous_factors(data, starts, config.length) < config.length
        of_span = np.repeat(np.arange(len(spans)), counts)[first]
        place = (np.repeat(start, counts) + inner)[first]
        cut = np.flatnonzero(np.concatenate([[True], (of_span[1:] != of_span[:-1]) | (place[1:] != place[:-1] + 1)])) if len(place) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([cut, [len(place)]]))
        return _rows("doc_id h1 start n", [doc[of_span[cut]], h1[of_span[cut]], place[cut], n], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    held, size, last = {}, 0, None
    for batch in batches:
        for key, span, *place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != last and size > config.array_bytes:
                yield solve(held)
                held, size = {}, 0
            if span not in held:
                size += len(span)
                held[span] = tuple(place)
            else:
                held[span] = min(held[span], tuple(place))
            last = key
    if held:
        yield solve(held)


def _cut(batches: Iterator[pa.RecordBatch], config: SuffixConfig) -> Iterator[pa.RecordBatch]:
    """Remove what starts in looked-at runs without being a first occurrence."""
    for batch in batches:
        first, rows = batch.column("first").to_pylist(), []
        for block, found, pick in _picked(batch, config):
            change = np.zeros(len(block.data) + 1, np.int64)
            np.add.at(change, found.begin[pick], 1)
            np.add.at(change, found.begin[pick] + found.count[pick], -1)
            looked = np.cumsum(change)[:-1] > 0
            for k in range(len(block)):
                a, b = block.offsets[k], block.offsets[k + 1]
                gone = looked[a:b].copy()
                for x in first[block.first + k] or ():
                    gone[x["start"] : x["start"] + x["n"]] = False
                places = np.flatnonzero(gone)
                cover = np.zeros(b - a + 1, np.int64)
                cover[places] += 1
                cover[places + config.length] -= 1  # a start has ``length`` bytes after it
                removed = np.cumsum(cover)[:-1] > 0
                spans = np.count_nonzero(removed & ~np.concatenate([[False], removed[:-1]]))
                kept = block.data[a:b][~removed].tobytes()
                rows.append((int(removed.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("h1"), batch.column("h2"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))],
            ["h1", "h2", "n_removed", "n_spans", "kept_sha256"],
        )


_NULL_ID = -(2**63)


def dedup(documents: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), text)
    texts = texts.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    size = F.octet_length("text").cast("long")
    rows = materialize(texts.select("doc_id", "h1", "h2", size.alias("n_bytes"), F.sha2("text", 256).alias("whole")), "suffix-rows")
    same = rows.groupBy("h1", "h2", "n_bytes", "whole", "doc_id").agg(F.count("*").alias("m"))
    origin = materialize(same.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")), "suffix-origins")

    # runs whose anchor is not alone
    n_blocks = max(1, -(-(rows.agg(F.sum("n_bytes")).first()[0] or 0) // config.block_bytes))
    long = texts.where(size >= config.length)
    survey = materialize(long.select("h1", "h2", "text").mapInArrow(lambda it: _survey(it, config, n_blocks), _SURVEY), "suffix-survey")
    members = survey.where("ref IS NOT NULL").select("chunk", "ref", "h1", "h2")
    dealt = survey.where("block IS NOT NULL").select("block", "chunk", "codes", "refs", "runs", "others", "times", F.col("block").alias("own"))
    again = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _again(it, config.hot_runs), "chunk long, refs binary, runs binary, hot long")
    again = materialize(again, "suffix-again")
    hot = _hot_test(again.where("hot IS NOT NULL").select("hot"), config)
    shared = again.where("hot IS NULL").select("chunk", "refs", "runs").unionByName(survey.where("ref IS NULL AND block IS NULL").select("chunk", "refs", "runs"))
    by_chunk = shared.select("chunk", F.col("chunk").alias("own"), "refs", "runs").repartition("chunk").sortWithinPartitions("chunk")
    by_text = by_chunk.mapInArrow(_by_text, "chunk long, ref int, runs binary").join(members, ["chunk", "ref"]).select("h1", "h2", "runs")
    looked = materialize(by_text.dropDuplicates(["h1", "h2"]).join(origin, ["h1", "h2"]), "suffix-looked")

    # their first occurrences
    looked_texts = texts.where(tx.may_be_in(looked, "h1")).join(looked, ["h1", "h2", "doc_id"])
    spans = looked_texts.select("doc_id", "h1", "text", "runs").mapInArrow(lambda it: _spans(it, config, hot, n_blocks), _SPANS)
    firsts = spans.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _first_occurrences(it, config), "doc_id long, h1 long, start int, n int")
    first = materialize(firsts, "suffix-firsts").groupBy("doc_id", "h1").agg(F.collect_list(F.struct("start", "n")).alias("first"))

    # what is left
    marked = looked.join(first, ["doc_id", "h1"], "left")
    cut = texts.where(tx.may_be_in(looked, "h1")).join(marked, ["h1", "h2", "doc_id"]).select("h1", "h2", "text", "runs", "first")
    cut = cut.mapInArrow(lambda it: _cut(it, config), "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["h1", "h2"])
    placed = same.join(origin.withColumnRenamed("doc_id", "first_id"), ["h1", "h2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    is_first = (F.col("copy") == 1) & (F.col("doc_id") == F.col("first_id"))
    named = F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id")
    kept = placed.where(is_first).join(cut, ["h1", "h2"], "left")
    kept = kept.select(named, "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
    goes = F.col("n_bytes") >= config.length  # a later copy goes as a whole
    copies = placed.where(~is_first).select(
        named,
        "n_bytes",
        F.when(goes, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(goes, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(goes, F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
    )
    return kept.unionByName(copies)
