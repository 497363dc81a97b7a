"""Language-model scores: a causal self-attention model in numpy on subword ids.

1. All training documents are counted: words (for the base score) and subword ids of
   a public tokenizer, which are also written, for training to read. The most frequent ids get vectors of their own and are dealt by
   frequency to groups of about equal cost; all other ids are one more group, in which
   they are spread by their counts. So the output layer covers the whole vocabulary:
   the probability of an id is that of its group times its own within the group.
2. A one-layer causal self-attention model predicts the next id. It is trained
   data-parallel: every task trains on windows of its own documents from the common
   weights, and the weights are averaged; several rounds of that. Every id of every
   training document is learned from: documents are dealt to the rounds by hash, and
   small tables are gone over in several rounds, or all. (``whole=False`` is for a
   quick model of windows that are drawn by hash; the query does not use it.)
3. Every text is scored whole. Context windows overlap; each token is scored once, in
   the first window that holds it, many windows in one batch of masked attention.

A text's score is the sum over its ids and its end. Words of the base score are looked
up in a table of the most frequent ones, bounded by ``frequent_words``; the others are
joined with their counts by a shuffle, in which none is frequent.

Subwords: a word with the space before it is encoded by itself, in pieces of at most
``piece`` characters, as the pattern of a tokenizer does; so a word of any length takes
time in proportion to it.

Cases: a null or blank text has the end as its only token. A null doc_id counts as an
empty text for the choice of held-out rows. Repeated rows are scored each by itself.
Without training rows every count is 0 and scores come from a uniform model. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import text as tx
from webloom.llm.scratch import materialize


@dataclass(frozen=True)
class LmConfig:
    #: Where the public tokenizers' files are, and the one used.
    tokenizer_dir: str = "/opt/tokenizers"
    tokenizer: str = "byte_bpe_multi_50k.tiktoken"
    piece: int = 200
    #: Ids with vectors of their own, with the two inputs for other ids and for the start of a text.
    inputs: int = 2048
    groups: int = 32
    width: int = 24
    hidden: int = 48
    window: int = 64
    stride: int = 48
    rounds: int = 4
    batch_windows: int = 32
    rate: float = 1e-2
    #: Whether training goes over every id of the texts.
    whole: bool = True
    #: Windows that all rounds of a small table together go over: ``min_windows`` a round, by going over texts in more than one.
    #: Without ``whole``, a round's windows: ``min_windows``, and one more for so many bytes of text, if the texts have as many.
    window_bytes: int = 8192
    min_windows: int = 12000
    frequent_words: int = 300_000
    modulus: int = 5
    held_out: int = 1


END_WORD = np.array([0x7E57_E4D0_F7E1_0001], np.uint64)


@functools.lru_cache(maxsize=2)
def _encoder(folder: str, name: str, piece: int):
    """The tokenizer, the number of its ids, and which of them begin with a space, as words do and nothing in them."""
    import tiktoken

    with open(f"{folder}/{name}", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    begins = np.zeros(max(ranks.values()) + 1, bool)
    begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    pattern = rf" [^ ]{{1,{piece}}}|[^ ]{{1,{piece}}}"
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(begins), begins


def vocabulary_size(config: LmConfig) -> int:
    """Ids of the tokenizer and one more, the end of a text."""
    return _encoder(config.tokenizer_dir, config.tokenizer, config.piece)[1] + 1


class Subwords:
    """Subword ids of words by their hashes; the words met lately are kept in a table with one place for each hash."""

    BITS, KEPT_IDS = 20, 1 << 23

    def __init__(self, config: LmConfig):
        self.encoder, _, self.begins = _encoder(config.tokenizer_dir, config.tokenizer, config.piece)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int64), np.zeros(1 << self.BITS, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words; where the ids of each begin among those kept, and their number."""
        made = np.array(self.encoder.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")), np.int32)
        begin = np.flatnonzero(self.begins[made])
        while len(self.ids) < self.used + len(made):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(made)] = made
        self.used += len(made)
        return self.used - len(made) + begin, np.diff(np.concatenate([begin, [len(made)]]))

    def of(self, block: tx.Block, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a block, and the place where each word's begin (one more than words)."""
        if not len(w.hashes):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        if self.used > self.KEPT_IDS:
            self.forget()
        slot = (w.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        missing = np.flatnonzero((self.keys[slot] != w.hashes) | (size == 0))
        if len(missing):
            hashes, where, back = np.unique(w.hashes[missing], return_index=True, return_inverse=True)
            body, first = tx.lower(block.data).tobytes(), missing[where]
            new_at, new_size = self._learn([body[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)])
            at[missing], size[missing] = new_at[back], new_size[back]
            place = slot[first]
            # where two new words have one place, all three tables get the same, last one
            self.keys[place], self.at[place], self.size[place] = hashes, new_at, new_size
        ends = np.cumsum(size)
        return self.ids[np.repeat(at - (ends - size), size) + np.arange(ends[-1])], np.concatenate([[0], ends])


@functools.lru_cache(maxsize=1)
def subwords_of(config: LmConfig) -> Subwords:
    """Those of this process: later tasks of a worker find the words that earlier ones met."""
    return Subwords(config)


def text_ids(block: tx.Block, subwords: Subwords, end_id: int) -> tuple[tx.Words, np.ndarray, np.ndarray]:
    """Words; the ids of every text with the end after each; and where each text begins in them."""
    w = tx.words(block, "visible")
    ids, begin = subwords.of(block, w)
    return w, np.insert(ids, begin[w.of_text[1:]], end_id), begin[w.of_text] + np.arange(len(block) + 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


#: Ids of a text as they are written: two bytes each, or four where the tokenizer has more of them.
def _stored(size: int) -> np.dtype:
    return np.dtype(np.uint16 if size <= 1 << 16 else np.int32)


def turn_of(docs: pa.Array, config: LmConfig) -> np.ndarray:
    """The round of training that a text has its turn in, by the hash of its doc_id."""
    return (tx.mix(docs.fill_null(0).to_numpy().view(np.uint64) ^ np.uint64(0x5EED)) % np.uint64(config.rounds)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], config: LmConfig) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text): counts of words (kind 0) and of subword ids (1) of a task, a bounded number of words at a time; and each text's doc_id as key, turn as n and ids (2)."""
    end_id = vocabulary_size(config) - 1
    subwords, stored = subwords_of(config), _stored(end_id + 1)
    ids_seen, parts, held = np.zeros(end_id + 1, np.int64), [], 0

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n), pa.nulls(len(keys), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "key", "n", "ids"])

    for batch in batches:
        for block in tx.blocks(batch.column(1)):
            w, ids, begin = text_ids(block, subwords, end_id)
            docs = batch.column(0).slice(block.first, len(block))
            bounds, body = pa.py_buffer((begin * stored.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(stored))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(block), 2), pa.int32()), docs, pa.array(turn_of(docs, config)), pa.Array.from_buffers(pa.binary(), len(block), [None, bounds, body])],
                ["kind", "key", "n", "ids"],
            )
            ids_seen += np.bincount(ids, minlength=end_id + 1)
            keys, n = np.unique(w.hashes, return_counts=True)
            parts += [(keys, n), (END_WORD, np.array([len(block)]))]
            held += len(keys)
            if held > 1_000_000:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > 700_000:
                    yield rows(0, *parts[0])
                    parts, held = [], 0
    if parts:
        yield rows(0, *_merge(parts))
    some = np.flatnonzero(ids_seen)
    yield rows(1, some, ids_seen[some])


@dataclass
class Vocabulary:
    """Of each id its input, its group and its place among the vectors of its group (other ids: the natural logarithm of its share of them)."""

    input_of: np.ndarray
    group_of: np.ndarray
    slot_of: np.ndarray
    log_share: np.ndarray
    bounds: np.ndarray  # of the groups among the output vectors; the last group, of other ids, has none
    log_group: np.ndarray
    log_slot: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, config: LmConfig) -> Vocabulary:
        n, smooth = len(counts), counts + 0.5
        order = np.argsort(-counts, kind="stable")
        own = order[: min(config.inputs - 2, n - 1)]
        groups = config.groups
        # equal sums of the roots of counts make groups of about equal cost: frequent ids are in small ones
        root = np.cumsum(np.sqrt(smooth[own]))
        group = np.minimum((root - root[0] / 2) / root[-1] * (groups - 1), groups - 2).astype(np.int64)
        group = np.unique(group, return_inverse=True)[1]
        group_of, slot_of, input_of = np.full(n, groups - 1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        group_of[own] = group
        bounds = np.searchsorted(group, np.arange(groups))
        slot_of[own] = np.arange(len(own)) - bounds[group]
        input_of[own] = np.arange(2, len(own) + 2)  # 0: other ids, 1: before the text
        total = np.bincount(group_of, weights=smooth, minlength=groups)
        log_share = np.zeros(n)
        other = group_of == groups - 1
        log_share[other] = np.log(smooth[other] / total[-1])
        log_slot = np.zeros(config.inputs)
        log_slot[: len(own)] = np.log(smooth[own] / total[group])
        return Vocabulary(input_of, group_of, slot_of, log_share, np.concatenate([bounds, bounds[-1:]]), np.log(np.maximum(total, 1e-9) / smooth.sum()), log_slot)


def shapes(config: LmConfig) -> dict[str, tuple[int, ...]]:
    d = config.width
    return {
        "embed": (config.inputs, d), "place": (config.window, d), "qkv": (d, 3 * d), "o": (d, d),
        "up": (d, config.hidden), "up_bias": (config.hidden,), "down": (config.hidden, d),
        "group": (d, config.groups), "group_bias": (config.groups,), "slot": (config.inputs, d), "slot_bias": (config.inputs,),
    }


def unpack(flat: np.ndarray, config: LmConfig) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for name, shape in shapes(config).items():
        n = math.prod(shape)
        found[name] = flat[at : at + n].reshape(shape)
        at += n
    return found


def initial(vocabulary: Vocabulary, config: LmConfig) -> np.ndarray:
    """Small random weights; the output biases make it the unigram model."""
    rng = np.random.default_rng(11)
    given = {"group_bias": vocabulary.log_group, "slot_bias": vocabulary.log_slot, "up_bias": np.zeros(config.hidden)}
    scale = {"embed": 0.3, "place": 0.02, "group": 0.3 * config.width**-0.5, "slot": 0.3 * config.width**-0.5}
    parts = [given[name] if name in given else rng.normal(0, scale.get(name, shape[0] ** -0.5), shape) for name, shape in shapes(config).items()]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


#: Bounds of logarithms before they are raised, which keep sums finite in 32 bits.
_MOST = np.float32(40)
#: Tokens that are sorted by group at once; their vectors and logits stay in the processor's cache.
_SORTED = 1 << 13


def _exp(logits: np.ndarray) -> np.ndarray:
    """Raised in place."""
    logits.clip(-_MOST, _MOST, out=logits)
    return np.exp(logits, out=logits)


def folded(p: dict[str, np.ndarray]) -> np.ndarray:
    """Weights from an input and 1 to its query, its value and 1: a query meets inputs by q k' and a value goes out by v o, so both products stand for themselves."""
    d = p["o"].shape[0]
    out = np.zeros((d + 1, 2 * d + 1), p["o"].dtype)
    out[:d, :d] = (p["qkv"][:, :d] * np.float32(d**-0.5)) @ p["qkv"][:, d : 2 * d].T
    out[:d, d : 2 * d] = p["qkv"][:, 2 * d :] @ p["o"]
    out[d, 2 * d] = 1
    return out


@functools.lru_cache(maxsize=8)
def _causal(length: int, fresh: int) -> np.ndarray:
    return np.tri(length, dtype=np.float32)[fresh:]


def attend(q: np.ndarray, x: np.ndarray, v1: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last vectors of ``x`` and the weighted values of the places up to each one's go to ``out``; the weights, their sums and the weighted values. The last value of ``v1`` is 1."""
    length, d = x.shape[1], x.shape[2]
    a = _exp(np.matmul(q, x.transpose(0, 2, 1)))
    a *= _causal(length, length - q.shape[1])
    mixed = a @ v1
    total = mixed[..., d:]
    mixed = np.divide(mixed[..., :d], total)
    np.add(x[:, length - q.shape[1] :], mixed, out=out)
    return a, total, mixed


def hidden(p: dict[str, np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors before the output layer, with 1 and 0 behind them, of rows of the same kind; and the hidden ones."""
    d, h = p["up"].shape
    f = y @ np.concatenate([p["up"], p["up_bias"][None], np.zeros((1, h), y.dtype)])
    np.maximum(f, 0, out=f)
    z = f @ np.concatenate([p["down"], np.zeros((h, 2), y.dtype)], axis=1)
    z += y
    return z, f


def forward(p: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The vector before the output layer at each place of each window, and what the gradient needs."""
    d, (n, length) = p["o"].shape[0], inputs.shape
    x = np.ones((n, length, d + 1), p["o"].dtype)
    np.add(p["embed"].take(inputs.ravel(), axis=0).reshape(n, length, d), p["place"][:length], out=x[..., :d])
    w = folded(p)
    qv = (x.reshape(-1, d + 1) @ w).reshape(n, length, 2 * d + 1)
    y = np.empty((n, length, d + 2), x.dtype)
    y[..., d], y[..., d + 1] = 1, 0
    attention = attend(qv[..., :d], x[..., :d], qv[..., d:], y[..., :d])
    y = y.reshape(-1, d + 2)
    z, f = hidden(p, y)
    return z[:, :d].reshape(n, length, d), (x, w, qv, *attention, y, z, f)


def group_bounds(groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts tokens by their groups, and where each group begins in it."""
    order = np.argsort(groups.astype(np.int16), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=n))])


def output_weights(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of groups and those within them as rows, each with its bias and 1 behind it; these meet the 1 and 0 behind the vectors before the output layer."""
    one = lambda m: np.ones((len(m), 1), m.dtype)
    group = p["group"].T
    return tuple(np.concatenate([m, b[:, None], one(m)], axis=1) for m, b in ((group, p["group_bias"]), (p["slot"], p["slot_bias"])))


def _within(z: np.ndarray, weights: np.ndarray, begin: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, list[tuple[np.ndarray, int, int, int, int]]]:
    """Raised logits within the groups of tokens that are sorted by them, group after group in one array; and of each group these, its tokens' and its vectors' bounds."""
    sizes = np.diff(vocabulary.bounds)
    at = np.concatenate([[0], np.cumsum(np.diff(begin) * sizes)]).tolist()
    made, parts = np.empty(at[-1], z.dtype), []
    begin, bounds = begin.tolist(), vocabulary.bounds.tolist()
    for n in range(len(sizes)):
        (i, j), (first, last) = begin[n : n + 2], bounds[n : n + 2]
        if j > i and last > first:
            own = made[at[n] : at[n + 1]].reshape(j - i, last - first)
            np.dot(z[i:j], weights[first:last].T, out=own)
            parts.append((own, i, j, first, last))
    _exp(made)
    return made, parts


def log_probabilities(p: dict[str, np.ndarray], z: np.ndarray, ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Natural log probability of each of ``ids`` given the vector before it."""
    weights = output_weights(p)
    if z.shape[1] == p["o"].shape[0]:
        z = np.concatenate([z, np.ones((len(z), 1), z.dtype), np.zeros((len(z), 1), z.dtype)], axis=1)
    out = np.empty(len(ids))
    for k in range(0, len(ids), _SORTED):
        out[k : k + _SORTED] = _log_probabilities(weights, z[k : k + _SORTED], ids[k : k + _SORTED], vocabulary)
    return out


def _log_probabilities(weights: tuple[np.ndarray, np.ndarray], z: np.ndarray, ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    (group, slot), n_groups = weights, len(weights[0])
    groups = vocabulary.group_of[ids]
    order, begin = group_bounds(groups, n_groups)
    own, z, groups = ids[order], z.take(order, axis=0), groups[order]
    n_own = begin[-2]  # tokens of the last group have no vectors
    total = _exp(z @ group.T) @ np.ones(n_groups, z.dtype)
    found = np.einsum("ij,ij->i", z, group.take(groups, axis=0)).clip(-_MOST, _MOST)
    _, parts = _within(z, slot, begin, vocabulary)
    within, ones = np.ones(n_own, z.dtype), np.ones(len(slot), z.dtype)
    for e, i, j, first, last in parts:
        np.dot(e, ones[: last - first], out=within[i:j])
    place = vocabulary.bounds[groups[:n_own]] + vocabulary.slot_of[own[:n_own]]
    found[:n_own] += np.einsum("ij,ij->i", z[:n_own], slot.take(place, axis=0)).clip(-_MOST, _MOST)
    found -= np.log(total)
    found[:n_own] -= np.log(within)
    out = np.empty(len(ids))
    out[order] = found + vocabulary.log_share[own]
    return out


def gradient(p: dict[str, np.ndarray], inputs: np.ndarray, ids: np.ndarray, live: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log probability of the live ``ids``."""
    _, (x, w, qv, a, total, mixed, y, z, f) = forward(p, inputs)
    (n, length, d), share = mixed.shape, np.float32(1 / max(1, live.sum()))
    places = np.flatnonzero(live)
    target = ids.ravel()[places]
    groups = vocabulary.group_of[target]
    group, slot = output_weights(p)
    order, begin = group_bounds(groups, len(group))
    places, target, groups = places[order], target[order], groups[order]  # tokens of a group are a slice
    n_own = begin[-2]  # tokens of the last group have no vectors
    zl = z.take(places, axis=0)
    # with e the raised logits of a token and s their sum, the gradient of its logits is e / s less 1 at the target: rows are scaled where they are short
    e = _exp(zl @ group.T)
    dzl = e @ group
    s = dzl[:, -1].copy()
    e[np.arange(len(e)), groups] -= s
    s = (share / s)[:, None]
    gg = e.T @ (zl * s)
    dzl *= s
    dzl -= group.take(groups, axis=0) * share
    dw, dz_own, zl = np.zeros_like(slot), np.empty_like(zl[:n_own]), zl[:n_own]
    made, parts = _within(zl, slot, begin, vocabulary)
    for e, i, j, first, last in parts:
        np.dot(e, slot[first:last], out=dz_own[i:j])
    sizes, slots = np.diff(vocabulary.bounds)[groups[:n_own]], vocabulary.slot_of[target[:n_own]]
    s = dz_own[:, -1].copy()
    made[np.cumsum(sizes) - sizes + slots] -= s
    s = (share / s)[:, None]
    zl *= s
    for e, i, j, first, last in parts:
        np.dot(e.T, zl[i:j], out=dw[first:last])
    dz_own *= s
    dz_own -= slot.take(vocabulary.bounds[groups[:n_own]] + slots, axis=0) * share
    dzl[:n_own] += dz_own
    g = {"group": gg[:, :d].T, "group_bias": gg[:, d], "slot": dw[:, :d], "slot_bias": dw[:, d]}
    dz = np.zeros((n * length, d), z.dtype)
    dz[places] = dzl[:, :d]
    g["down"] = f.T @ dz
    df = dz @ p["down"].T
    df *= f > 0
    gu = y.T @ df
    g["up"], g["up_bias"] = gu[:d], gu[d]
    dx = df @ p["up"].T
    dx += dz
    dx = dx.reshape(n, length, d)
    dm = np.empty((n, length, d + 1), z.dtype)
    np.divide(dx, total, out=dm[..., :d])
    np.negative(np.einsum("nld,nld->nl", dm[..., :d], mixed), out=dm[..., d])
    da = dm @ qv[..., d:].transpose(0, 2, 1)
    da *= a
    dqv = np.empty((n, length, 2 * d), z.dtype)
    np.matmul(da, x[..., :d], out=dqv[..., :d])
    np.matmul(a.transpose(0, 2, 1), dm[..., :d], out=dqv[..., d:])
    dx += da.transpose(0, 2, 1) @ qv[..., :d]
    dqv, dx = dqv.reshape(-1, 2 * d), dx.reshape(-1, d)
    dx += dqv @ w[:d, : 2 * d].T
    gw = (x.reshape(-1, d + 1).T @ dqv)[:d]
    q, k, v = (p["qkv"][:, i * d : (i + 1) * d] for i in range(3))
    scale = np.float32(d**-0.5)
    g["qkv"] = np.concatenate([gw[:, :d] @ k * scale, gw[:, :d].T @ q * scale, gw[:, d:] @ p["o"].T], axis=1)
    g["o"] = v.T @ gw[:, d:]
    g["place"] = np.zeros_like(p["place"])
    g["place"][:length] = dx.reshape(n, length, d).sum(0)
    seen = inputs.ravel().astype(np.int16)
    order = np.argsort(seen, kind="stable")
    seen = seen[order]
    first = np.concatenate([[0], np.flatnonzero(seen[1:] != seen[:-1]) + 1])
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][seen[first]] = np.add.reduceat(dx.take(order, axis=0), first)
    return g


class Trainer:
    """Adam on batches of windows, from given weights. ``m`` and ``v`` are the running sums without the factors 0.1 and 0.01, which the rate takes."""

    #: Weights of one part of a step, which stay in the processor's cache.
    PART = 1 << 14

    def __init__(self, flat: np.ndarray, vocabulary: Vocabulary, config: LmConfig, rate: float):
        self.flat, self.vocabulary, self.config, self.rate = flat.astype(np.float32).copy(), vocabulary, config, rate
        self.m, self.v, self.steps, self.windows = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0
        self.grad = np.empty_like(self.flat)

    def step(self, inputs: np.ndarray, ids: np.ndarray, live: np.ndarray) -> None:
        g = gradient(unpack(self.flat, self.config), inputs, ids, live, self.vocabulary)
        for name, part in unpack(self.grad, self.config).items():
            part[...] = g[name]
        norm = math.sqrt(float(self.grad @ self.grad)) + 1e-9
        self.steps += 1
        self.windows += len(inputs)
        root = (0.01 / (1 - 0.99**self.steps)) ** 0.5
        rate, least = np.float32(0.1 * self.rate / (1 - 0.9**self.steps) / root), np.float32(1e-8 / root)
        for k in range(0, len(self.flat), self.PART):
            flat, m, v, grad = (x[k : k + self.PART] for x in (self.flat, self.m, self.v, self.grad))
            if norm > 1:
                grad *= np.float32(1 / norm)
            m *= np.float32(0.9)
            m += grad
            v *= np.float32(0.99)
            grad *= grad
            v += grad
            np.sqrt(v, out=grad)
            grad += least
            np.divide(m, grad, out=grad)
            grad *= rate
            flat -= grad


def windows_per_byte(n_bytes: int, n_texts: int, config: LmConfig) -> float:
    """Training windows of a round for each byte; a text counts as a window longer than it is."""
    span = config.window * 5
    return min(1 / config.window_bytes + config.min_windows / max(1, n_bytes + n_texts * span), 1 / span)


def _pieces(batch: pa.RecordBatch, config: LmConfig, per_byte: float, turn: int) -> Iterator[tuple[bytes, bool, bool]]:
    """The drawn places of a batch of (doc_id, text): bytes that hold a window, and whether they begin and whether they end the text."""
    span = config.window * 5  # bytes of text that surely hold about a window
    docs = batch.column(0).fill_null(0).to_numpy().view(np.uint64)
    seeds = tx.mix(tx.mix(docs + np.uint64(turn + 1)) ^ np.uint64(0x5EED))
    for seed, text in zip(seeds.tolist(), batch.column(1).to_pylist(), strict=True):
        data = (text or "").encode()
        wanted = (len(data) + span) * per_byte
        n = int(wanted) + ((seed & 0xFFFFF) / 0x100000 < wanted - int(wanted))
        for _ in range(n):
            seed = (seed * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
            at = (seed >> 20) % max(1, len(data))
            at = 0 if at < span // 2 else data.find(b" ", at) + 1 or len(data)  # a text's start is a place of its own
            piece = data[at : at + 2 * span]
            last = at + len(piece) >= len(data)
            yield piece if last else piece[: max(piece.rfind(b" "), 0)], at == 0, last


def _train(batches: Iterator[pa.RecordBatch], flat: np.ndarray, vocabulary: Vocabulary, config: LmConfig, per_byte: float, turn: int) -> Iterator[pa.RecordBatch]:
    """Weights after one pass over a task's training windows, times the number of these, in pieces."""
    end_id, size = vocabulary_size(config) - 1, config.window
    subwords, trainer = subwords_of(config), Trainer(flat, vocabulary, config, config.rate * 0.5**turn)
    held: list[tuple] = []

    def learn() -> None:
        texts = pa.array([p.decode("utf-8", "ignore") for p, _, _ in held], pa.string())
        from_start, to_end = (np.array([x[i] for x in held]) for i in (1, 2))
        for block in tx.blocks(texts):
            _, ids, begin = text_ids(block, subwords, end_id)
            start, stop = from_start[block.first : block.last], to_end[block.first : block.last]
            length = np.minimum(np.diff(begin) - ~stop, size)  # the end counts where the text ends
            place = begin[:-1, None] + np.arange(size)
            live = np.arange(size) < length[:, None]
            safe = np.where(live, place, 0)
            inputs = np.where(live, vocabulary.input_of[ids[np.maximum(safe - 1, 0)]], 0)
            inputs[:, 0] = start  # the id before a place in the middle is not known
            live[:, 0] &= start
            used = np.flatnonzero(live.any(axis=1))
            np.random.default_rng([turn, len(held)]).shuffle(used)
            for k in range(0, len(used), config.batch_windows):
                own = used[k : k + config.batch_windows]
                trainer.step(inputs[own], ids[safe[own]], live[own])

    for batch in batches:
        for piece in _pieces(batch, config, per_byte, turn):
            held.append(piece)
            if len(held) >= 4096:
                learn()
                held = []
    if held:
        learn()
    yield from _weights(trainer)


def rounds_of_a_text(n_bytes: int, n_texts: int, config: LmConfig) -> int:
    """In how many rounds each text is gone over: one, or more where the texts have few windows."""
    windows = n_bytes / (config.window * 5) + n_texts
    return min(config.rounds, max(1, math.ceil(config.rounds * config.min_windows / max(1, windows))))


def training_windows(ids: np.ndarray, begin: np.ndarray, vocabulary: Vocabulary, config: LmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that hold every id of the texts of a block once: the places of their ids, which are live, and the id before each place."""
    size = config.window
    lengths = np.diff(begin)
    count = -(-lengths // size)
    first = np.repeat(begin[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * size
    used = np.minimum(size, np.repeat(begin[1:], count) - first)
    live = np.arange(size) < used[:, None]
    place = np.where(live, first[:, None] + np.arange(size), 0)
    before = np.concatenate([[0], vocabulary.input_of[ids[:-1]]])
    before[begin[:-1]] = 1  # the start of a text
    return place, live, before


def ids_of(column: pa.Array, subwords: Subwords, config: LmConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of blocks of texts, and where each text begins in them: of texts, or of ids that were written."""
    size = vocabulary_size(config)
    if not pa.types.is_binary(column.type):
        for block in tx.blocks(column, 1 << 20):
            yield text_ids(block, subwords, size - 1)[1:]
    else:
        stored = _stored(size)
        for block in tx.blocks(column, stored.itemsize << 18):
            yield block.data.view(stored), block.offsets // stored.itemsize


def _train_whole(batches: Iterator[pa.RecordBatch], flat: np.ndarray, vocabulary: Vocabulary, config: LmConfig, n_rounds: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Weights after all windows of those of a task's texts whose turn it is, times the number of these windows, in pieces."""
    subwords, trainer = subwords_of(config), Trainer(flat, vocabulary, config, config.rate * 0.5**turn)
    for batch in batches:
        own = (turn_of(batch.column(0), config) + turn) % config.rounds < n_rounds
        for ids, begin in ids_of(batch.column(1).filter(pa.array(own)), subwords, config):
            place, live, before = training_windows(ids, begin, vocabulary, config)
            order = np.random.default_rng([turn, len(place)]).permutation(len(place))
            for k in range(0, len(order), config.batch_windows):
                some = order[k : k + config.batch_windows]
                trainer.step(before[place[some]], ids[place[some]], live[some])
    yield from _weights(trainer)


def _weights(trainer: Trainer) -> Iterator[pa.RecordBatch]:
    """Weights times the number of windows they were trained on, in pieces."""
    if trainer.windows:
        for k in range(0, len(trainer.flat), 4096):
            part = trainer.flat[k : k + 4096].astype(np.float64) * trainer.windows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k, k + len(part)), pa.int32()), pa.array(part), pa.array(np.full(len(part), trainer.windows), pa.int64())], ["i", "v", "w"]
            )


def windows_of(begin: np.ndarray, config: LmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over the texts of a block: the place of the first id of each, how many of its ids it has, and the first of them that is scored there."""
    size, stride = config.window, config.stride
    lengths = np.diff(begin)
    count = np.where(lengths <= size, 1, 1 + -(-(lengths - size) // stride))
    text = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = begin[text] + k * stride
    return first, np.minimum(size, begin[text + 1] - first), np.where(k == 0, 0, size - stride)


#: Windows of one batch of attention, whose scores stay in the processor's cache.
_BATCH = 32


def token_scores(ids: np.ndarray, begin: np.ndarray, p: dict[str, np.ndarray], vocabulary: Vocabulary, config: LmConfig) -> np.ndarray:
    """Natural log probability of every token of the texts of a block, each scored once."""
    d, size = config.width, config.window
    out = np.zeros(len(ids))
    first, used, fresh = windows_of(begin, config)
    before = np.concatenate([[0], vocabulary.input_of[ids[:-1]]])
    before[begin[:-1]] = 1  # the start of a text
    step = np.arange(size)
    # all that follows from an input or a place alone, once for each: query, value, 1, the vector itself
    w = folded(p)
    one = np.ones((config.inputs, 1), w.dtype)
    of_input = np.concatenate([np.concatenate([p["embed"], one], axis=1) @ w, p["embed"]], axis=1)
    of_place = np.concatenate([p["place"] @ w[:d], p["place"]], axis=1)
    vectors, places, held = [], [], 0

    def finish() -> None:
        at = np.concatenate(places)
        out[at] = log_probabilities(p, np.concatenate(vectors), ids[at], vocabulary)

    def end_vectors(inputs: np.ndarray, skip: int) -> np.ndarray:
        n, length = inputs.shape
        made = of_input.take(inputs.ravel(), axis=0).reshape(n, length, 3 * d + 1)
        made += of_place[:length]
        y = np.empty((n, length - skip, d + 2), made.dtype)
        y[..., d], y[..., d + 1] = 1, 0
        attend(made[:, skip:, :d], made[..., 2 * d + 1 :], made[..., d : 2 * d + 1], y[..., :d])
        return hidden(p, y.reshape(-1, d + 2))[0]

    for skip in (0, size - config.stride):
        those = np.flatnonzero(fresh == skip)
        order = those[np.argsort(used[those].astype(np.int16), kind="stable")]  # short windows together, so that they can be cut
        for a in range(0, len(order), _BATCH):
            own = order[a : a + _BATCH]
            longest, shortest = int(used[own[-1]]), int(used[own[0]])
            place = first[own, None] + step[:longest]
            if shortest == longest:
                vectors.append(end_vectors(before[place], skip))
                places.append(place[:, skip:].ravel())
            else:
                inside = step[:longest] < used[own, None]
                scored = inside[:, skip:]
                vectors.append(end_vectors(before[np.where(inside, place, 0)], skip)[scored.ravel()])
                places.append(place[:, skip:][scored])
            held += len(places[-1])
            if held >= _SORTED:
                finish()
                vectors, places, held = [], [], 0
    if held:
        finish()
    return out


def _score(batches: Iterator[pa.RecordBatch], flat: np.ndarray, vocabulary: Vocabulary, config: LmConfig, words: np.ndarray, counts: np.ndarray, total: float) -> Iterator[pa.RecordBatch]:
    """Per row: tokens, the model's log10 probability, what the frequent words give to the base score, and the hashes of the other words."""
    end_id = vocabulary_size(config) - 1
    p, subwords = unpack(flat, config), subwords_of(config)
    for batch in batches:
        for block in tx.blocks(batch.column(1), 1 << 19):
            w, ids, begin = text_ids(block, subwords, end_id)
            model = np.concatenate([[0], np.cumsum(token_scores(ids, begin, p, vocabulary, config))])[begin] / math.log(10)
            hashes = np.insert(w.hashes, w.of_text[1:], END_WORD[0])
            bounds = w.of_text + np.arange(len(block) + 1)
            distinct, back = np.unique(hashes, return_inverse=True)
            at = np.minimum(np.searchsorted(words, distinct), max(0, len(words) - 1))
            hit = (words[at] == distinct) if len(words) else np.zeros(len(distinct), bool)
            base = np.where(hit, np.log10((counts[at] + 0.5) / total), 0.0) if len(words) else np.zeros(len(distinct))
            hit, base = hit[back], base[back]
            n_hit, base_sum, rest = (np.concatenate([[0], np.cumsum(x)])[bounds] for x in (hit, base, ~hit))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, len(block)),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(np.diff(n_hit), pa.int64()),
                    pa.array(np.diff(base_sum), pa.float64()),
                    pa.array(np.diff(model), pa.float64()),
                    tx.list_array(hashes[~hit].view(np.int64), rest, pa.int64()),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
            )


@dataclass
class Model:
    """What training leaves: weights, classes, the table of word counts and their sums."""

    weights: np.ndarray
    vocabulary: Vocabulary
    word_counts: DataFrame
    tokens: int
    distinct: int


def train(documents: DataFrame, config: LmConfig = LmConfig()) -> Model:
    """Learn from every row of ``documents`` (doc_id, text)."""
    schema = "kind int, key long, n long, ids binary"
    read = materialize(documents.select("doc_id", "text").mapInArrow(lambda it: _count(it, config), schema), "lm-ids")
    counts = materialize(read.where("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where("kind = 0").select("key", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    by_id = counts.where("kind = 1").select("key", "n").toArrow()  # no more rows than the tokenizer has ids
    ids = np.zeros(vocabulary_size(config), np.int64)
    ids[by_id.column("key").to_numpy()] = by_id.column("n").to_numpy()
    vocabulary = Vocabulary.of(ids, config)
    flat = initial(vocabulary, config)
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    learn, how = (_train_whole, rounds_of_a_text(*size, config)) if config.whole else (_train, windows_per_byte(*size, config))
    for turn in range(config.rounds):
        texts = documents.select("doc_id", "text")
        if config.whole:  # of the written texts those whose turn it is
            texts = read.where((F.col("kind") == 2) & (F.pmod(F.col("n") + turn, F.lit(config.rounds)) < how)).select("key", "ids")
        trained = texts.mapInArrow(lambda it, f=flat, t=turn: learn(it, f, vocabulary, config, how, t), "i int, v double, w long")
        mean = trained.groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).toArrow()
        if mean.num_rows:
            flat = flat.copy()
            flat[mean.column("i").to_numpy()] = mean.column("v").to_numpy().astype(np.float32)
    return Model(flat, vocabulary, words, int(tokens), int(distinct))


def _frequent(model: Model, config: LmConfig) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count of the words that are sent to every task, at most ``frequent_words`` of them, with their hashes and counts."""
    steps = model.word_counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).limit(20_000).toArrow()
    n, m = steps.column("n").to_numpy(), steps.column("m").to_numpy()
    fits = np.flatnonzero(np.cumsum(m) <= config.frequent_words)
    least = int(n[fits[-1]]) if len(fits) else (int(n[0]) + 1 if len(n) else 1)
    table = model.word_counts.where(F.col("n") >= least).toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return least, keys[order], table.column("n").to_numpy()[order]


def score(documents: DataFrame, model: Model, config: LmConfig = LmConfig()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    least, keys, n = _frequent(model, config)
    total = model.tokens + 0.5 * (model.distinct + 1)
    weights, vocabulary = model.weights, model.vocabulary
    scored = documents.select("doc_id", "text").mapInArrow(
        lambda it: _score(it, weights, vocabulary, config, keys, n, total), "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    )
    scored = materialize(scored.withColumn("row_id", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row_id", F.explode("rare").alias("key")).groupBy("row_id", "key").agg(F.count("*").alias("times"))
    counted = rare.join(model.word_counts.where(F.col("n") < least), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parts = counted.groupBy("row_id").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(float(total)))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more_known")
    )
    joined = scored.drop("rare").join(parts, "row_id", "left")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def held_out(config: LmConfig = LmConfig()):
    """Whether a row is kept out of training: by the checksum of its doc_id as text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % config.modulus == config.held_out


def score_held_out(documents: DataFrame, config: LmConfig = LmConfig()) -> DataFrame:
    """Train on the rows that are not held out, and score all."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(slim.where(~held_out(config)), config)
    return score(slim, model, config).withColumn("held_out", held_out(config)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
