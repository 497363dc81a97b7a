r"""Conversations as a prefix tree of tokens: shared first turns once, depth first.

1. Turns of a conversation are read in order by one task, which holds a hash of 16 bytes
   for each turn so far and no text. A turn becomes a node, named by the hashes of all
   turns up to it, with its tokens; the hashes in a row are the conversation's path.
2. Equal nodes and equal paths are kept once, found by a shuffle that combines before.
3. Distinct paths are sorted over sampled ranges. In that order the tree is walked depth
   first: a path owns the nodes in which it differs from the path before, its chain, and
   the chains above it are a stack, cut where paths part. Each range does so by itself as
   if it came first; the driver then has a stack and a number of tokens for each range,
   from which starts and stacks of all ranges follow.
4. A node of the tree has the place of its first token in the whole stream, position ids
   that count from the conversation's start, and the intervals of the stream that its
   tokens may attend to: a piece of each chain above, and its own up to itself.

``read`` turns the tree into conversations again: one pass over the stream, range by
range, decodes each node once and keeps the state of every turn on the current path.

The template writes ``[INST]text[/INST]`` for a user, ``[SYS]text[/SYS]`` for a system,
``[OUT]text</s>`` for an assistant and ``[ROLE]role[TEXT]text[/ROLE]`` for any other role,
after ``<s>``. Marks are ids of their own. In texts and roles a backslash comes after the
first character of every mark, and one more where some stand there already, which is
undone on reading. Texts of assistants, without marks, are under the loss mask.

Cases: a null role or text counts as empty. Turns with equal or null numbers are ordered
by role and text, null numbers first; repeated rows are turns each. Rows of a null
conv_id are one conversation. An empty table gives an empty result. Other columns are
ignored. A text is handled whole in one task, and a conversation's digests must be taken
in order, so one task reads a conversation, in batches; its path has 16 bytes a turn.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.hot import attach
from webloom.llm.scratch import materialize, small

#: Marks of the template; opening and closing ones by role.
BEGIN = "<s>"
ROLES = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[OUT]", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
MARKS = (BEGIN, *(m for pair in ROLES.values() for m in pair), *OTHER)
_RESTS = {first: "|".join(re.escape(m[1:]) for m in MARKS if m[0] == first) for first in "<["}
#: A first character of a mark before backslashes, maybe none, and the rest of the mark; and the first of such backslashes.
_ESCAPE = re.compile("|".join(rf"{re.escape(first)}(?=\\*(?:{rest}))" for first, rest in _RESTS.items()))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(first)})\\(?=\\*(?:{rest}))" for first, rest in _RESTS.items()))
#: Bytes of a turn in a path.
STEP = 16


@dataclass(frozen=True)
class ChatConfig:
    #: A public tokenizer's ranks, read by the driver and sent to the tasks; with None the bytes of UTF-8 are the ids.
    tokenizer_file: str | None = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    #: Characters of a piece at most, so that a text of any shape takes time in proportion to it.
    piece: int = 200
    #: Tokens of a range of the stream (about), and ranges at most; a range is walked by one task, and the driver has some numbers of each.
    range_tokens: int = 1_000_000
    ranges: int = 10_000


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def render(role: str, text: str) -> list[str]:
    """A turn as marks and escaped strings, in turns: mark, string, mark[, string, mark]."""
    if role in ROLES:
        return [ROLES[role][0], escape(text), ROLES[role][1]]
    return [OTHER[0], escape(role), OTHER[1], escape(text), OTHER[2]]


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, (opens, closes) in ROLES.items():
        if turn.startswith(opens) and turn.endswith(closes):
            return role, unescape(turn[len(opens) : -len(closes)])
    role, _, text = turn.removeprefix(OTHER[0]).removesuffix(OTHER[2]).partition(OTHER[1])
    return unescape(role), unescape(text)


# Tokens


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, piece: int):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("chat", pat_str=rf" ?[^\s]{{1,{piece}}}|\s", mergeable_ranks=known, special_tokens={}), max(known.values()) + 1


class Tokens:
    """Ids of formatted turns. Marks have the ids that follow those of the tokenizer."""

    def __init__(self, ranks: bytes | None, piece: int):
        self.encoding, self.base = (None, 256) if ranks is None else _encoding(ranks, piece)
        self.marks = {mark: self.base + k for k, mark in enumerate(MARKS)}

    def _string(self, text: str) -> list[int]:
        return list(text.encode()) if self.encoding is None else self.encoding.encode_ordinary(text)

    def encode(self, role: str, text: str, first: bool) -> tuple[list[int], int, int]:
        """Ids of a turn, and the first and the end of those under the loss mask."""
        ids = [self.marks[BEGIN]] if first else []
        begin = end = 0
        for k, part in enumerate(render(role, text)):
            if k % 2 == 0:
                ids.append(self.marks[part])
            else:
                begin = len(ids)
                ids += self._string(part)
                end = len(ids)
        return (ids, begin, end) if role == "assistant" else (ids, 0, 0)

    def decode(self, ids: np.ndarray) -> str:
        out, at = [], 0
        for k in [*np.flatnonzero(ids >= self.base).tolist(), len(ids)]:
            part = ids[at:k].tolist()
            out.append((bytes(part) if self.encoding is None else self.encoding.decode_bytes(part)).decode())
            if k < len(ids):
                out.append(MARKS[int(ids[k]) - self.base])
            at = k + 1
        return "".join(out)


def _sent(df: DataFrame, config: ChatConfig):
    """A function that gives a task its ``Tokens``; the tokenizer travels with the job."""
    if config.tokenizer_file is None:
        return lambda: Tokens(None, config.piece)
    with open(config.tokenizer_file, "rb") as file:
        ranks = df.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary, of a megabyte or so
    return lambda: Tokens(ranks.value, config.piece)


# Turns and paths


_TURNS = "conv_id long, turns int, node binary, ids array<int>, loss_from int, loss_to int, path binary, sizes array<int>"


def turns(conversations: DataFrame, config: ChatConfig) -> DataFrame:
    """A written table of all turns (node, ids, loss_from, loss_to), and for each conversation a row more with its last node, path and token counts."""
    tokens = _sent(conversations, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokens()
        own, node, path, sizes = (), b"", bytearray(), []
        out: list[tuple] = []
        for batch in batches:
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != (conv,):
                    if own:
                        out.append((own[0], len(sizes), node, None, None, None, bytes(path), sizes))
                    own, node, path, sizes = (conv,), b"", bytearray(), []
                role, text = role or "", text or ""
                step = hashlib.blake2b(f"{len(role)} {role}{text}".encode(), digest_size=STEP).digest()
                node = hashlib.blake2b(node + step, digest_size=STEP).digest()
                ids, begin, end = made.encode(role, text, not sizes)
                path += step
                sizes.append(len(ids))
                out.append((own[0], len(sizes), node, ids, begin, end, None, None))
            yield _batch(out)
            out = []
        if own:
            yield _batch([(own[0], len(sizes), node, None, None, None, bytes(path), sizes)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        names = [c.split()[0] for c in _TURNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    return materialize(ordered.select("conv_id", "role", "text").mapInArrow(run, _TURNS), "chat-turns")


# The tree's order


Piece = tuple[int, int, int]


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from their start."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // STEP
    x, y = (np.frombuffer(v, np.uint8, size) for v in (a, b))
    return int(np.argmax(x != y)) // STEP


def cut(stack: list[Piece], depth: int) -> list[Piece]:
    """A stack of chains (turns from, to, first token) down to a depth."""
    return [(low, min(high, depth), start) for low, high, start in stack if low < depth]


_WALKED = "range int, seq long, node binary, copies long, path binary, sizes array<int>, stack array<struct<low:int,high:int,start:long>>, total long"


def walk(paths: DataFrame, config: ChatConfig) -> DataFrame:
    """Distinct paths in order, with the stack of chains of each, its own last; a written table.

    Places count from the range's start, as if its first path shared nothing with the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq, total = TaskContext.get().partitionId(), 0, 0
        before, stack = b"", []
        for batch in batches:
            stacks, totals = [], []
            for path, sizes in zip(batch.column("path").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                shared = common(before, path)
                stack = [*cut(stack, shared), (shared, len(sizes), total)]
                total += sum(sizes[shared:])
                before = path
                stacks.append([{"low": a, "high": b, "start": c} for a, b, c in stack])
                totals.append(total)
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("start", pa.int64())]))
            n = batch.num_rows
            columns = [pa.array(np.full(n, own, np.int32)), pa.array(np.arange(seq, seq + n)), *[batch.column(c) for c in ("node", "copies", "path", "sizes")], pa.array(stacks, kind), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ("range", "seq", "node", "copies", "path", "sizes", "stack", "total")])
            seq += n

    tokens = paths.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    ranged = paths.select("node", "copies", "path", "sizes").repartitionByRange(max(1, min(config.ranges, -(-tokens // config.range_tokens))), "path").sortWithinPartitions("path")
    return materialize(ranged.mapInArrow(run, _WALKED), "chat-walk")


def _joints(walked: DataFrame) -> dict[int, tuple[int, int, int, list[Piece]]]:
    """For each range its first token, the turns its first path shares with the path before, their tokens, and the stack there.

    The driver takes a row of numbers and a stack a range; paths stay with the tasks.
    """
    last = walked.groupBy("range").agg(F.max_by(F.struct("path", "stack", "total"), "seq").alias("x")).select("range", "x.*")
    ends = {r.range: (r.total, [tuple(p) for p in r.stack]) for r in last.select("range", "total", "stack").collect()}
    order = sorted(ends)
    spark = walked.sparkSession
    pairs = spark.createDataFrame(list(zip(order[1:], order[:-1], strict=True)), "range int, before int")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, a, b, sizes = (c.to_pylist() for c in batch.columns)
            n = [common(x, y) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(n, pa.int32()), pa.array([sum(s[:k]) for s, k in zip(sizes, n, strict=True)], pa.int64())], ["range", "n", "tokens"])

    met = walked.where("seq = 0").select("range", F.col("path").alias("own"), "sizes").join(pairs, "range")
    met = met.join(last.select(F.col("range").alias("before"), "path"), "before").select("range", "path", "own", "sizes")
    found = {r.range: (r.n, r.tokens) for r in met.mapInArrow(shared, "range int, n int, tokens long").collect()}
    joints, first, stack = {}, 0, []
    for k in order:
        n, tokens = found.get(k, (0, 0))
        above = cut(stack, n)
        joints[k] = (first, n, tokens, above)
        total, own = ends[k]
        stack = _placed(own, joints[k])
        first += total - tokens
    return joints


def _placed(stack: list[Piece], joint: tuple[int, int, int, list[Piece]]) -> list[Piece]:
    """A stack of a range with places in the whole stream: what its first path owned of shared turns goes back to the chains before."""
    first, n, tokens, above = joint
    out: list[Piece] = []
    for low, high, start in stack:
        if start == 0:
            out += cut(above, high)
            if high > n:
                out.append((n, high, first))
        else:
            out.append((low, high, first + start - tokens))
    return out


_NODES = "range int, chain long, depth int, start long, position long, node binary, copies long, attend array<struct<start:long,stop:long>>"


def _nodes(walked: DataFrame, joints: dict) -> DataFrame:
    """A row for each node of the tree, from the paths that own them; ``copies`` counts the conversations that end there."""
    sent = walked.sparkSession.sparkContext.broadcast(joints)  # some numbers a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), kind]
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                stack = _placed([(p["low"], p["high"], p["start"]) for p in r["stack"]], sent.value[r["range"]])
                places = np.concatenate([[0], np.cumsum(r["sizes"], dtype=np.int64)]).tolist()
                above = [{"start": s, "stop": s + places[h] - places[lo]} for lo, h, s in stack[:-1]]
                low, high, chain = stack[-1]
                node = b""
                for d in range(high):
                    node = hashlib.blake2b(node + r["path"][d * STEP : (d + 1) * STEP], digest_size=STEP).digest()
                    if d >= low:
                        start, stop = (chain + places[k] - places[low] for k in (d, d + 1))
                        out.append((r["range"], chain, d + 1, start, places[d], node, r["copies"] if d + 1 == high else 0, [*above, {"start": chain, "stop": stop}]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in ("range", "chain", "depth", "start", "position", "node", "copies", "attend")])

    return walked.select("range", "path", "sizes", "stack", "copies").mapInArrow(run, _NODES)


def build(conversations: DataFrame, config: ChatConfig = ChatConfig()) -> tuple[DataFrame, DataFrame]:
    """The tree, and (conv_id, node) of every conversation's last turn; written tables.

    A row of the tree: node, range, start (of its first token in the stream), chain (start of
    the chain it is in), depth (turns from the conversation's start), ids, position_ids (and
    position, the first of them), loss_from and loss_to (within ids), attend (intervals of the stream, in order, the last
    up to the node's end, within which its tokens see those up to themselves), copies.
    """
    told = turns(conversations, config)
    ends = told.where("path IS NOT NULL")
    paths = materialize(ends.groupBy("node").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("copies")), "chat-paths")
    walked = walk(paths, config)
    placed = _nodes(walked, _joints(walked))
    # of equal nodes any will do
    ids = told.where("path IS NULL").groupBy("node").agg(F.first(F.struct("ids", "loss_from", "loss_to")).alias("t")).select("node", "t.*")
    tree = materialize(placed.join(ids, "node"), "chat-tree")
    return tree.withColumn("position_ids", F.sequence("position", F.col("position") + F.size("ids") - 1)), ends.select("conv_id", "node")


# Reading


_READ = "node binary, copies long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read(tree: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """What the tree's tokens say of each distinct conversation: number and digest of its turns, length and digest of the text under its loss mask, length when formatted.

    Each range is decoded in the stream's order. The nodes above its first one, which stand in
    ranges before, come along; they are found by the intervals of that first node.
    """
    first = tree.groupBy("range").agg(F.min_by("attend", "start").alias("attend"))
    needed = first.select("range", F.posexplode(F.slice("attend", 1, F.size("attend") - 1)).alias("at", "piece")).select(F.col("range").alias("_range"), F.col("piece.start").alias("_chain"), F.col("piece.stop").alias("_stop"))
    columns = ["range", "start", "depth", "node", "copies", "ids", "loss_from", "loss_to"]
    above = tree.join(small(materialize(needed, "chat-above")), (F.col("chain") == F.col("_chain")) & (F.col("start") < F.col("_stop")))
    context = above.select(F.col("_range").alias("range"), "start", "depth", "node", F.lit(0).cast("long").alias("copies"), "ids", "loss_from", "loss_to")
    ranges = (tree.agg(F.max("range")).first()[0] or 0) + 1
    rows = tree.select(columns).unionByName(context).repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "start")
    tokens = _sent(tree, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, current, path = tokens(), None, []
        for batch in batches:
            out = []
            offsets, ids = batch.column("ids").offsets.to_numpy(), batch.column("ids").values.to_numpy()
            names = ("range", "depth", "node", "copies", "loss_from", "loss_to")
            for k, (of, depth, node, copies, begin, end) in enumerate(zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
                if of != current:
                    current, path = of, [(0, hashlib.sha256(), 0, hashlib.sha256(), 0)]
                del path[depth:]
                n, digest, loss, loss_digest, chars = path[-1]
                own = ids[offsets[k] : offsets[k + 1]]
                turn = made.decode(own)
                role, text = parse(turn.removeprefix(BEGIN) if depth == 1 else turn)
                digest, masked = digest.copy(), unescape(made.decode(own[begin:end]))
                digest.update(f"{role}\n{text}\n".encode())
                if masked:
                    loss_digest = loss_digest.copy()
                    loss_digest.update(masked.encode())
                path.append((n + 1, digest, loss + len(masked), loss_digest, chars + len(turn)))
                if copies:
                    out.append((node, copies, n + 1, digest.hexdigest(), loss + len(masked), loss_digest.hexdigest(), chars + len(turn)))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _READ.split(", ")])

    return rows.select(columns).mapInArrow(run, _READ)


def digests(conversations: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, read back from the tree."""
    tree, ends = build(conversations, config)
    found = materialize(read(tree, config), "chat-read")
    return attach(ends, found, "node", "copies").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: A conversation that says control strings, added by the query.
ODD_ID = -7
ODD_TEXT = "</s>[INST] ok [/INST]"


def with_odd(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) and one of a user and an assistant who both say marks of templates."""
    odd = conversations.sparkSession.createDataFrame([(ODD_ID, 0, "user", ODD_TEXT), (ODD_ID, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(odd)
