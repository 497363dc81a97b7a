"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

A document is the set of its distinct ``gram``-word shingles, held as 64-bit hashes.
Two link when ``100 * |A & B| >= percent * |A | B|``. The join is exact:

1. Documents with equal sets form a class; only classes are compared.
2. The incidence of documents by shingles is dealt out by columns, as packed blocks of
   shingle codes, and every column is counted. All that linked sets have in common is
   shared, so a set needs ``percent`` of its shingles shared to have a link at all.
   Sets with fewer are done. A shingle that several sets of one task hold is sent on
   once, without these, so a common one costs a task one code.
3. The shingles of what remains are counted among themselves, exactly, and each set is
   ordered by rarity. Linked sets share a shingle in their prefixes, the first
   ``n - least overlap + 1``. Sets with equal prefix shingles and sizes that can link
   are joined, in a star around the smallest, to candidate groups: first within a task,
   so that a shingle leaves it once however many sets have it, then among tasks.
4. A group's sets meet in one task, or in blocks of bounded size. There the sparse
   product of sets by shingles adds up overlaps; pairs are dropped by their sizes before
   that, and below the bound that follows from their sizes after it. Once sets are known
   to be connected they need no pairs among each other: a set that links to the group's
   main component is only compared with what lies outside that.
5. Of a group of several blocks, each block is worked on by itself first, with some sets
   of the group (pivots) in all of its blocks, which connect what is much the same. Then
   what lies outside the main component meets the blocks again, within bands of size.

Cases: a null or word-less text has an empty set, size 0, and links with nothing.
A text of fewer than ``gram`` words is one shingle. Rows that share a doc_id are one
document and thus linked. A null doc_id takes no part; its component is null. An
empty table gives an empty result. Other columns are ignored by ``join`` and kept by
``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import text as tx
from webloom.llm.graph import components
from webloom.llm.scratch import materialize, small


@dataclass(frozen=True)
class JaccardConfig:
    gram: int = 4
    percent: int = 85
    #: Shingles of all sets that meet in one task.
    block_shingles: int = 2_000_000
    #: Shingles that a task holds before it sends them on.
    chunk_shingles: int = 1_500_000
    #: Bytes of text for each block of columns.
    column_bytes: int = 1 << 24
    #: Sets of a group of several blocks that are in all of these, about.
    pivots: int = 16


def document_sets(block: tx.Block, gram: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a block."""
    w = tx.words(block, "visible")
    grams = tx.gram_hashes(w.hashes, gram)
    found = []
    for k in range(len(block)):
        a, b = w.of_text[k], w.of_text[k + 1]
        if b - a >= gram:
            found.append(np.unique(grams[a : b - gram + 1]))
        elif b > a:
            found.append(tx.gram_hashes(w.hashes[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _signature(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set, as signed numbers."""
    one, two = tx.mix(own).sum(dtype=np.uint64), tx.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _rows(names: str, columns: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names.split())


# 1 and 2: signatures, and the counts of all columns

_SURVEY = "chunk long, doc_id long, n long, s1 long, s2 long, ref int, together long, block long, codes binary, refs binary, others binary"
_SURVEY_KINDS = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 3
_SURVEY_NAMES = " ".join(c.split()[0] for c in _SURVEY.split(", "))


def _survey(batches: Iterator[pa.RecordBatch], config: JaccardConfig, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Of a chunk of documents a row each with its signature and, by blocks of columns, the codes of their shingles.

    ``codes`` are those that one set of the chunk has, with the number of that set in
    ``refs``; ``others`` are those of several sets, whose number a set has ``together``.
    """
    task, n_chunks = TaskContext.get().partitionId(), 0
    rows, sets, number, held = [], [], {}, 0

    def chunk() -> Iterator[pa.RecordBatch]:
        name = (task << 32) | n_chunks
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        ref = np.repeat(np.arange(len(sets)), sizes)
        key = (tx.column_block(flat, n_blocks) << np.uint64(32)) | (flat & np.uint64(0xFFFFFFFF))
        order = np.argsort(key)
        key, ref = key[order], ref[order]
        same = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
        single = ~same & ~np.concatenate([same[1:], [False]]) if len(key) else same
        together = np.bincount(ref[~single], minlength=max(1, len(sets)))
        ids, n, s1, s2, refs = zip(*rows, strict=True)
        nothing = [None] * len(rows)
        yield _rows(_SURVEY_NAMES, [[name] * len(rows), ids, n, s1, s2, refs, together[list(refs)], nothing, nothing, nothing, nothing], _SURVEY_KINDS)
        alone, alone_ref, shared = key[single], ref[single].astype(np.uint16), key[~single & ~same]
        bounds = np.arange(n_blocks + 1, dtype=np.uint64) << np.uint64(32)
        a, b = np.searchsorted(alone, bounds), np.searchsorted(shared, bounds)
        used = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
        nothing = [None] * len(used)
        yield _rows(
            _SURVEY_NAMES,
            [
                [name] * len(used), *[nothing] * 6, used,
                [tx.pack(alone[a[x] : a[x + 1]].astype(np.uint32)) for x in used],
                [tx.pack(alone_ref[a[x] : a[x + 1]]) for x in used],
                [tx.pack(shared[b[x] : b[x + 1]].astype(np.uint32)) for x in used],
            ],
            _SURVEY_KINDS,
        )

    for batch in batches:
        docs = batch.column(0).to_pylist()
        for block in tx.blocks(batch.column(1)):
            for k, own in enumerate(document_sets(block, config.gram)):
                sign = _signature(own)
                if sign not in number:
                    number[sign] = len(sets)
                    sets.append(own)
                    held += len(own)
                rows.append((docs[block.first + k], len(own), *sign, number[sign]))
                if held > config.chunk_shingles or len(sets) > 60_000 or len(rows) > 500_000:
                    yield from chunk()
                    n_chunks += 1
                    rows, sets, number, held = [], [], {}, 0
    if rows:
        yield from chunk()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, chunk, codes, refs, others) sorted by block: for each the refs, repeated, whose code others of the block have."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        codes = [tx.unpack(x[1], np.uint32) for x in held]
        own = np.concatenate(codes)
        every = np.sort(np.concatenate([own, *[tx.unpack(x[3], np.uint32) for x in held]]))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        # a code that several sets of one chunk have is shared as soon as another chunk has it at all, and comes twice then
        at = np.searchsorted(again, own)
        hit = again[np.minimum(at, len(again) - 1)] == own if len(again) else np.zeros(len(own), bool)
        edge = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        found = [tx.unpack(x[2], np.uint16)[hit[edge[i] : edge[i + 1]]] for i, x in enumerate(held)]
        return _rows("chunk refs", [[x[0] for x in held], [tx.pack(np.sort(f)) for f in found]], [pa.int64(), pa.binary()])

    yield from tx.by_first(batches, solve)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, refs) sorted by chunk: how often each ref comes."""
    last, total = None, np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        own = np.flatnonzero(total)
        return _rows("chunk ref shared", [np.full(len(own), last), own, total[own]], [pa.int64(), pa.int32(), pa.int64()])

    for batch in batches:
        for chunk, refs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if chunk != last:
                if last is not None:
                    yield rows()
                last, total = chunk, np.zeros(65_536, np.int64)
            total += np.bincount(tx.unpack(refs, np.uint16), minlength=65_536)
    if last is not None:
        yield rows()


def _n_blocks(texts: DataFrame, config: JaccardConfig) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // config.column_bytes))


def _dealt(rows: DataFrame, key: str, *then: Column | str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *then)


# 3: order by rarity

_MEMBERS = "chunk long, block long, class long, n long, grams binary, counts binary"
_MEMBER_NAMES = " ".join(c.split()[0] for c in _MEMBERS.split(", "))
_MEMBER_KINDS = [pa.int64()] * 4 + [pa.binary()] * 2


def _members(batches: Iterator[pa.RecordBatch], config: JaccardConfig, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (class, s1, s2, text): a row for each set, and by blocks of columns the shingles of a chunk of them with their counts there.

    A row counts if its text has the class's signature: rows of other texts may share the doc_id that names a class.
    """
    task, n_chunks, held, sets = TaskContext.get().partitionId(), 0, 0, {}

    def chunk() -> Iterator[pa.RecordBatch]:
        name = (task << 32) | n_chunks
        nothing = [None] * len(sets)
        yield _rows(_MEMBER_NAMES, [[name] * len(sets), nothing, list(sets), [len(s) for s in sets.values()], [tx.pack(s) for s in sets.values()], nothing], _MEMBER_KINDS)
        grams, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        block = tx.column_block(grams, n_blocks)
        begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        spans = list(zip(begin, [*begin[1:], len(grams)], strict=True))
        nothing = [None] * len(spans)
        packed = [[tx.pack(grams[a:b]) for a, b in spans], [tx.pack(counts[a:b].astype(np.uint32)) for a, b in spans]]
        yield _rows(_MEMBER_NAMES, [[name] * len(spans), block[begin].astype(np.int64), nothing, nothing, *packed], _MEMBER_KINDS)

    for batch in batches:
        classes, s1, s2 = (batch.column(i).to_pylist() for i in range(3))
        for block in tx.blocks(batch.column(3)):
            for k, own in enumerate(document_sets(block, config.gram)):
                i = block.first + k
                if len(own) and classes[i] not in sets and _signature(own) == (s1[i], s2[i]):
                    sets[classes[i]] = own
                    held += len(own)
                if held > config.chunk_shingles:
                    yield from chunk()
                    n_chunks, held, sets = n_chunks + 1, 0, {}
    if sets:
        yield from chunk()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, chunk, block, grams, counts) sorted by block: the counts of the same shingles among all chunks."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        grams = [tx.unpack(x[2], np.uint64) for x in held]
        _, back = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([tx.unpack(x[3], np.uint32) for x in held]))[back]
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        edge = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        packed = [tx.pack(total[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return _rows("chunk block counts", [[x[0] for x in held], [x[1] for x in held], packed], [pa.int64(), pa.int64(), pa.binary()])

    yield from tx.by_first(batches, solve)


def _order(batches: Iterator[pa.RecordBatch], config: JaccardConfig) -> Iterator[pa.RecordBatch]:
    """Rows of members and counts, sorted by chunk and block: each set that can have a link, its shared shingles by rarity."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        members = [x for x in held if x[0] is None]
        counts = np.concatenate([tx.unpack(x[4], np.uint32) for x in held if x[0] is not None])
        sets = [tx.unpack(x[3], np.uint64) for x in members]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        count = counts[np.unique(flat, return_inverse=True)[1]]
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(owner[count > 1], minlength=len(sets))
        kept = np.flatnonzero(100 * shared >= config.percent * sizes)
        pick = np.flatnonzero((count > 1) & np.isin(owner, kept))
        pick = pick[np.lexsort((flat[pick], count[pick], owner[pick]))]
        edge = np.searchsorted(owner[pick], np.arange(len(sets) + 1))
        packed = [flat[pick[edge[i] : edge[i + 1]]].tobytes() for i in kept]
        return _rows("class n grams", [[members[i][1] for i in kept], sizes[kept], packed], [pa.int64(), pa.int64(), pa.binary()])

    yield from tx.by_first(batches, solve)


def size_band(n: np.ndarray | int, percent: int) -> np.ndarray:
    """Linked sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(n) / math.log(100.0 / percent * 1.0001)).astype(np.int64)


def prefix_keys(n: int, grams: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set of n shingles, ``grams`` being the shared ones by rarity: linked sets have one in common."""
    least = -(-percent * n // 100)
    own = grams[: n - least + 1 - (n - len(grams))]  # what is not shared comes first of all
    band = size_band(n, percent)
    return np.concatenate([tx.mix(own ^ tx.mix(np.array([b + 1], np.uint64))) for b in (band, band + 1)])


def _star(keys: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the smallest sign of each, and (sign, smallest sign) of the others."""
    order = np.lexsort((signs, keys))
    keys, signs = keys[order], signs[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    leader = signs[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))] if len(keys) else signs
    other = signs != leader
    return keys[first], signs[first], signs[other], leader[other]


#: Keys a task holds before it sends them on.
_HELD_KEYS = 1_000_000


def _keys(batches: Iterator[pa.RecordBatch], config: JaccardConfig) -> Iterator[pa.RecordBatch]:
    """(key, class), and links (null key, class, smaller class) between sets of one task with an equal key."""

    def rows(keys: list[np.ndarray], signs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        k, s, a, b = _star(np.concatenate(keys), np.concatenate(signs))
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        names = ["key", "a", "b"]
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s), pa.nulls(len(k), pa.int64())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)

    keys, signs, held = [], [], 0
    for batch in batches:
        for name, n, grams in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            own = prefix_keys(n, np.frombuffer(grams, np.uint64), config.percent)
            keys.append(own)
            signs.append(np.full(len(own), name, np.int64))
            held += len(own)
            if held > _HELD_KEYS:
                yield from rows(keys, signs)
                keys, signs, held = [], [], 0
    yield from rows(keys, signs)


def _link_equal_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, a, b) sorted by key: those that came as links, and from each class to the first with the same key."""
    last, leader = None, None
    for batch in batches:
        linked = batch.filter(batch.column(2).is_valid())
        yield pa.RecordBatch.from_arrays([linked.column(1), linked.column(2)], ["a", "b"])
        rest = batch.filter(batch.column(2).is_null())
        keys, a = (rest.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(keys):
            continue
        first = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
        lead = np.where(at >= 0, a[np.maximum(at, 0)], leader if leader is not None else 0)
        other = lead != a
        pairs = np.unique(np.stack([np.maximum(a[other], lead[other]), np.minimum(a[other], lead[other])], axis=1), axis=0)
        last, leader = keys[-1], lead[-1]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


# 4 and 5: products


class Forest:
    """Union-find over 0 .. n-1, with sizes."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.up[y] = x
        self.size[x] += self.size[y]
        return True


class Incidence:
    """Sets by shingles, sets in ascending order of their sizes, and rows of its product with its transpose."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.percent, self.sizes, self.n = percent, sizes, len(sets)
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = codes.astype(np.int32)
        lengths = np.array([len(s) for s in sets], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(self.codes, kind="stable")
        self.holders = np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]  # the sets of each shingle, in order
        self.column = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=len(values)))])
        self.mark = np.zeros(len(values), bool)

    def own(self, i: int) -> np.ndarray:
        return self.codes[self.begin[i] : self.begin[i + 1]]

    def smallest(self, i: int) -> int:
        """The first set that is large enough to link with set i."""
        return int(np.searchsorted(self.sizes, -(-self.percent * self.sizes[i] // 100)))

    def linked(self, overlap: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * overlap >= self.percent * (self.sizes[i] + self.sizes[others])

    def partners(self, i: int, low: int, upto: int) -> np.ndarray:
        """Sets low .. upto-1 that link with set i: a row of the product."""
        if low >= upto:
            return np.zeros(0, np.int64)
        own = self.own(i)
        first, n = self.column[own], self.column[own + 1] - self.column[own]
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        met = self.holders[at]
        met = met[(met >= low) & (met < upto)]
        overlap = np.bincount(met - low, minlength=upto - low)
        others = np.flatnonzero(overlap)
        return others[self.linked(overlap[others], i, others + low)] + low

    def among(self, i: int, others: np.ndarray) -> np.ndarray:
        """The ones of a few given sets that link with set i."""
        own = self.own(i)
        self.mark[own] = True
        overlap = np.array([np.count_nonzero(self.mark[self.own(j)]) for j in others], np.int64)
        self.mark[own] = False
        return others[self.linked(overlap, i, others)]


def product_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int, guest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets, in ascending order of ``sizes``, as all their links do.

    A set may be given by those of its shingles that others have, too; its size is that
    of the whole. With ``guest`` only pairs that hold one of these sets count.
    """
    matrix, forest, links = Incidence(sets, sizes, percent), Forest(len(sets)), []

    def add(i: int, found: np.ndarray) -> None:
        links.extend((i, int(j)) for j in found if forest.join(i, int(j)))

    if guest is not None:
        for i in range(1, len(sets)):
            found = matrix.partners(i, matrix.smallest(i), i)
            add(i, found if guest[i] else found[guest[found]])
        return links
    main = 0  # a set of the largest component so far
    outside: list[int] = []  # sets not in it
    for i in range(1, len(sets)):
        low = matrix.smallest(i)
        if len(matrix.among(i, np.array([main]))):
            add(i, np.array([main]))
            others = np.array([j for j in outside if j >= low], np.int64)
            add(i, matrix.among(i, others) if len(others) <= 64 else np.intersect1d(others, matrix.partners(i, low, i)))
        else:
            add(i, matrix.partners(i, low, i))
            outside.append(i)
        root, here = forest.find(main), forest.find(i)
        if forest.size[here] > forest.size[root]:
            main = i
            outside = [j for j in range(i + 1) if forest.find(j) != here]
        elif here == root and outside:
            outside = [j for j in outside if forest.find(j) != root]
    return links


def _product(batches: Iterator[pa.RecordBatch], config: JaccardConfig) -> Iterator[pa.RecordBatch]:
    """Links within each task; rows are (task, guest, class, n, grams), sorted by task. In tasks with guests only their pairs count."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        held = sorted({x[1]: x for x in sorted(held, key=lambda x: x[0])}.values(), key=lambda x: (x[2], x[1]))  # a guest counts as one
        guest = np.array([x[0] for x in held])
        links = []
        if len(held) > 1:
            sets, sizes = [np.frombuffer(x[3], np.uint64) for x in held], np.array([x[2] for x in held], np.int64)
            links = product_links(sets, sizes, config.percent, guest if guest.any() else None)
        return _rows("a b", [[held[i][1] for i, _ in links], [held[j][1] for _, j in links]], [pa.int64(), pa.int64()])

    yield from tx.by_first(batches, solve)


def _work(tasks: DataFrame, ordered: DataFrame, config: JaccardConfig) -> DataFrame:
    """``tasks``: (task string, guest boolean, class)."""
    rows = ordered.join(small(tasks), "class").select("task", "guest", "class", "n", "grams")
    return materialize(_dealt(rows, "task").mapInArrow(lambda it: _product(it, config), "a long, b long"), "jaccard-links")


def _signed_and_candidates(named: DataFrame, config: JaccardConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, s1, s2) of every row; the classes (class, n, s1, s2, rep); and those of them with enough shared shingles to link."""
    n_blocks = _n_blocks(named, config)
    survey = materialize(named.mapInArrow(lambda it: _survey(it, config, n_blocks), _SURVEY), "jaccard-survey")
    rows = survey.where("block IS NULL").select("doc_id", "n", "s1", "s2", "chunk", "ref", "together")
    classes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")).withColumn("class", F.monotonically_increasing_id())
    classes = materialize(classes, "jaccard-classes")
    columns = _dealt(survey.where("block IS NOT NULL").select("block", "chunk", "codes", "refs", "others"), "block")
    shared = columns.mapInArrow(_shared, "chunk long, refs binary")
    tally = _dealt(shared, "chunk").mapInArrow(_tally, "chunk long, ref int, shared long")
    counted = rows.where("n > 0").join(tally, ["chunk", "ref"], "left").where(f"100 * (together + coalesce(shared, 0)) >= {config.percent} * n")
    enough = counted.select("n", "s1", "s2").distinct()
    candidates = materialize(classes.join(enough, ["n", "s1", "s2"]).select("class", F.col("rep").alias("doc_id"), "n", "s1", "s2"), "jaccard-candidates")
    return rows, classes, candidates


def _ordered(named: DataFrame, candidates: DataFrame, config: JaccardConfig) -> DataFrame:
    """(class, n, grams): the sets that can have a link, with their shared shingles by rarity."""
    n_blocks = max(1, -(-(candidates.agg(F.sum("n")).first()[0] or 0) // config.chunk_shingles))
    texts = named.where(tx.may_be_in(candidates, "doc_id")).join(small(candidates.drop("n")), "doc_id").select("class", "s1", "s2", "text")
    members = materialize(texts.mapInArrow(lambda it: _members(it, config, n_blocks), _MEMBERS), "jaccard-members")
    asked = members.where("block IS NOT NULL").select("block", "chunk", F.col("block").alias("own"), "grams", "counts")
    counts = _dealt(asked, "block").mapInArrow(_counts, "chunk long, block long, counts binary")
    both = members.where("block IS NULL").select("chunk", "block", "class", "n", "grams", "counts").unionByName(counts, allowMissingColumns=True)
    return materialize(_dealt(both, "chunk", "block").mapInArrow(lambda it: _order(it, config), "class long, n long, grams binary"), "jaccard-ordered")


def _second_round(placed: DataFrame, first: DataFrame, ordered: DataFrame, config: JaccardConfig) -> DataFrame:
    """Links of groups of several blocks between what is outside the main component and all else."""
    large = placed.where("parts > 1")
    labels = components(first.join(large.select(F.col("class").alias("a")), "a", "left_semi"))
    so_far = large.join(labels.withColumnRenamed("node", "class").withColumnRenamed("component", "found"), "class", "left").withColumn("found", F.coalesce("found", "class"))
    so_far = materialize(so_far.withColumn("band", F.floor(F.log("n") / math.log(100.0 / config.percent * 1.0001)).cast("long")), "jaccard-so-far")
    counts = so_far.groupBy("component", "found").agg(F.count("*").alias("m"))
    main = counts.groupBy("component").agg(F.max(F.struct("m", "found")).alias("x")).select("component", F.col("x.found").alias("main"))
    rest = so_far.join(main, "component").where("found <> main")
    n_rest = rest.groupBy("component", "band").agg(F.ceil(F.sum("size") / config.block_shingles).cast("int").alias("guest_blocks"))
    guests = rest.join(n_rest, ["component", "band"]).withColumn("g", F.expr("pmod(xxhash64(class, 7), guest_blocks)")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = so_far.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    hosts = near.join(n_rest, ["component", "band"]).withColumn("g", F.explode(F.expr("sequence(0, guest_blocks - 1)")))
    task = F.concat_ws(":", "component", "part", "band", "g").alias("task")
    both = guests.select(task, F.lit(True).alias("guest"), "class").unionByName(hosts.select(task, F.lit(False).alias("guest"), "class"))
    return _work(materialize(both, "jaccard-second"), ordered, config)  # guests of different blocks meet as hosts of their own parts


def links_and_classes(documents: DataFrame, config: JaccardConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) that connect classes as all links of the join do, the classes (class, n, s1, s2, rep), and (doc_id, n, class) of every row.

    A class is known by a number; rep is its smallest doc_id, which it may share with other classes.
    """
    named = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    signed, classes, candidates = _signed_and_candidates(named, config)
    ordered = _ordered(named, candidates, config)
    keyed = ordered.mapInArrow(lambda it: _keys(it, config), "key long, a long, b long")
    dealt = keyed.repartition(F.coalesce("key", F.xxhash64("a"))).sortWithinPartitions("key")
    groups = components(materialize(dealt.mapInArrow(_link_equal_keys, "a long, b long").distinct(), "jaccard-stars"))
    sized = ordered.select("class", "n", (F.octet_length("grams") / 8).cast("long").alias("size")).join(groups.withColumnRenamed("node", "class"), "class")
    sized = materialize(sized, "jaccard-groups")
    weight = sized.groupBy("component").agg(F.sum("size").alias("w"), F.count("*").alias("m"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("w") / config.block_shingles)).cast("int")
    placed = sized.join(weight, "component").withColumn("parts", parts).withColumn("part", F.expr("pmod(xxhash64(class), parts)").cast("int"))
    placed = materialize(placed, "jaccard-blocks")
    task = F.concat_ws(":", "component", "part").alias("task")
    pivots = placed.where("parts > 1").where(f"pmod(xxhash64(class, 3), greatest(1, m div {config.pivots})) = 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = placed.select(task, F.lit(False).alias("guest"), "class").unionByName(pivots.select(task, F.lit(False).alias("guest"), "class"))
    links = _work(materialize(tasks, "jaccard-tasks"), ordered, config)
    if not placed.where("parts > 1").isEmpty():
        links = links.unionByName(_second_round(placed, links, ordered, config))
    rows = signed.join(classes.select("n", "s1", "s2", "class"), ["n", "s1", "s2"], "left").select("doc_id", "n", "class")
    least = rows.where("n > 0").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("doc_id", "a")
    repeated = rows.join(least, "doc_id").where("class <> a").select("a", F.col("class").alias("b")).distinct()
    return links.unionByName(repeated), classes, rows


def _sizes(batches: Iterator[pa.RecordBatch], config: JaccardConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tx.blocks(batch.column(0)):
            yield _rows("n", [[len(s) for s in document_sets(block, config.gram)]], [pa.int64()])


def join(documents: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    links, classes, rows = links_and_classes(slim, config)
    found = classes.select("class", "rep").join(components(links).withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    found = materialize(found, "jaccard-found")
    named_by = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(named_by, "component").select("class", "component_id")
    named = rows.join(found, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    unnamed = slim.where("doc_id IS NULL").select("text").mapInArrow(lambda it: _sizes(it, config), "n long")
    return named.unionByName(unnamed.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_first(documents: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """The rows of ``documents`` with the smallest doc_id of their component, with all their columns, one row each.

    Of rows that share that doc_id the one with the smallest text stays (of equal texts, by
    a hash of the row); rows with a null doc_id all stay.
    """
    found = materialize(join(documents, config).where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-copies")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    firsts = documents.select(row, F.col("doc_id").cast("long").alias("doc_id")).join(small(found), "doc_id", "left_anti")
    once = firsts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by("row", F.struct("row.text", F.xxhash64(F.to_json("row")))).alias("row")).select("row.*")
    return once.unionByName(firsts.where("doc_id IS NULL").select("row.*"))
