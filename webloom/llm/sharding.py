"""Sharding by sampled splitters (law ``bytes``: sizes near equal).

Rows are ordered by the checksum of their text, then doc_id, then a row number, so
equal texts stand together. A sample drawn with probability in proportion to size
gives keys whose quantiles cut the order into small ranges of near-equal bytes; the
exact bytes of every range are counted. A range that is overfull, or in which a
shard's bound falls, is subdivided by a sample of its own, and again while that
helps. Shard bounds then go to the range edges next to the ideal ones, by
preference to one between two different texts, so a group of equal texts is split
only where it would unbalance shards by more than ``slack`` of a shard. One large
group is thus dealt over as many shards as it fills.

Slots number a shard's rows without gaps: the rows of the ranges before, plus the
place in the own range, so no task sees a whole shard.

Cases: a null text has size 8 and checksum 0. Null doc_ids come first. Repeated rows
each get a slot of their own. An empty table gives an empty result. With fewer rows
than shards some shards are empty. Extra columns are ignored by ``assign`` and kept
by ``shard_rows``, where columns named ``shard`` or ``slot`` give way to the new ones.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.scratch import materialize

LAW = "bytes"


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 24
    #: Ranges a shard at least, and rows a range at most (about).
    ranges_per_shard: int = 16
    rows_per_range: int = 500_000
    #: Sampled keys a range (about), and rounds of subdivision.
    oversample: int = 8
    rounds: int = 3
    #: Part of a shard by which its bound may move to keep a group of equal texts whole.
    slack: float = 0.01


Key = tuple[int, int, int]


def sizes(documents: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Key and size of each row, with a row number; with ``keep_rows`` the whole row as ``row`` besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in ("shard", "slot")]).alias("row")] if keep_rows else []
    return documents.select(
        *row,
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("uid", F.monotonically_increasing_id())


def _packed(crc: np.ndarray, doc: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """Keys as 24 bytes each that compare as the keys do."""
    signed = [np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in (crc, doc, uid)]
    return np.stack(signed, axis=1).astype(">u8").view("S24").ravel()


def _range_of(splitters: list[Key]):
    """A function of (text_crc32, doc_id, uid) columns that gives the range: the number of splitters at or before the key."""
    bounds = _packed(*zip(*splitters, strict=True)) if splitters else np.zeros(0, "S24")

    def search(crc: pa.Array, doc: pa.Array, uid: pa.Array) -> pa.Array:
        keys = _packed(crc.to_numpy(False), doc.fill_null(_low).to_numpy(False), uid.to_numpy(False))
        return pa.array(np.searchsorted(bounds, keys, side="right"), pa.int32())

    return F.arrow_udf(search, "int")


_low = -(2**63)


def _with_range(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    udf = _range_of(splitters)
    return rows.withColumn("range", udf("text_crc32", "doc_id", "uid"))


def _uniform() -> Column:
    """A number from 0 to 1 that depends on the row's key only."""
    return (F.xxhash64("text_crc32", "doc_id", "uid").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def _sample(rows: DataFrame, rate: Column) -> list[tuple[int | None, Key]]:
    """Keys drawn with probability size * rate, in order; their expected number is bounded by the caller."""
    drawn = rows.where(_uniform() < F.col("size") * rate).select("text_crc32", F.coalesce("doc_id", F.lit(_low)).alias("doc_id"), "uid")
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _quantiles(keys: list[Key], parts: int) -> list[Key]:
    if parts < 2 or not keys:
        return []
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)})


def _counts(rows: DataFrame, splitters: list[Key]) -> list[tuple[int, int]]:
    """(bytes, rows) of every range."""
    got = {r["range"]: (r["b"], r["n"]) for r in _with_range(rows, splitters).groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    return [got.get(i, (0, 0)) for i in range(len(splitters) + 1)]


def _between(position: list[int], total: int, shards: int) -> set[int]:
    """Ranges in which an ideal bound falls."""
    return {max(0, bisect_right(position, total * k // shards) - 1) for k in range(1, shards)}


def plan(rows: DataFrame, config: ShardConfig) -> tuple[list[Key], list[int], list[int]]:
    """Splitters, and for every range its shard and the slot of its first row. ``rows`` must be a written table."""
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return [], [0], [0]
    parts = max(config.shards * config.ranges_per_shard, -(-n // config.rows_per_range))
    keys = _sample(rows, F.lit(parts * config.oversample / total))
    splitters = _quantiles(keys, parts)
    counts = _counts(rows, splitters)
    ideal = total / parts
    for _ in range(config.rounds):
        position = [0]
        for b, _n in counts:
            position.append(position[-1] + b)
        wanted = {i for i in _between(position, total, config.shards) if counts[i][0] > config.slack * total / config.shards}
        overfull = {i for i, (b, m) in enumerate(counts) if m > 1 and b > 2 * ideal} | {i for i in wanted if counts[i][1] > 1}
        if not overfull:
            break
        ranged = _with_range(rows, splitters)
        into = {i: max(8, int(2 * counts[i][0] / ideal)) for i in overfull}
        rates = rows.sparkSession.createDataFrame([(i, into[i] * config.oversample / counts[i][0]) for i in sorted(overfull)], "range int, rate double")
        drawn = _sample(ranged.join(F.broadcast(rates) if len(overfull) < 1_000_000 else rates, "range"), F.col("rate"))
        more: set[Key] = set()
        for i in overfull:
            low = splitters[i - 1] if i else (-1, 0, 0)
            high = splitters[i] if i < len(splitters) else (1 << 40, 0, 0)
            own = [k for k in drawn if low < k < high]
            more |= set(_quantiles(own, min(into[i], len(own))) or own[len(own) // 2 :][:1])
            if i in wanted:  # edges between the texts nearest to the bound
                more |= {(c, _low, -1) for k in own for c in (k[0], k[0] + 1) if low < (c, _low, -1) < high}
        if not more - set(splitters):
            break
        splitters = sorted(set(splitters) | more)
        counts = _counts(rows, splitters)
    return splitters, *_deal(splitters, counts, total, config)


def _deal(splitters: list[Key], counts: list[tuple[int, int]], total: int, config: ShardConfig) -> tuple[list[int], list[int]]:
    """Shard and first slot of every range."""
    position = [0]
    for b, _ in counts:
        position.append(position[-1] + b)
    bounds = []
    for k in range(1, config.shards):
        ideal, near = total * k / config.shards, config.slack * total / config.shards
        i = min(range(1, len(position)), key=lambda j: abs(position[j] - ideal))
        whole = [j for j in range(1, len(position) - 1) if abs(position[j] - ideal) <= max(near, abs(position[i] - ideal)) and splitters[j - 1][2] == -1]
        bounds.append(min(whole, key=lambda j: abs(position[j] - ideal)) if whole else i)
    shards, slots, used = [], [], {}
    for i, (_, n) in enumerate(counts):
        shard = bisect_right(bounds, i)
        shards.append(shard)
        slots.append(used.get(shard, 0))
        used[shard] = slots[-1] + n
    return shards, slots


def _placed(rows: DataFrame, config: ShardConfig) -> DataFrame:
    splitters, shards, slots = plan(rows, config)
    spark = rows.sparkSession
    table = spark.createDataFrame(list(zip(range(len(shards)), shards, slots, strict=True)), "range int, shard int, first_slot long")
    order = Window.partitionBy("range").orderBy("text_crc32", F.col("doc_id").asc_nulls_first(), "uid")
    numbered = _with_range(rows, splitters).withColumn("in_range", F.row_number().over(order))
    joined = numbered.join(F.broadcast(table) if len(shards) < 1_000_000 else table, "range")
    return joined.withColumn("slot", F.col("first_slot") + F.col("in_range") - 1)


def assign(documents: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    return _placed(materialize(sizes(documents), "shard-sizes"), config).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_rows(documents: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """The rows of ``documents`` with their shard and slot."""
    placed = _placed(materialize(sizes(documents, keep_rows=True), "shard-rows"), config)
    return placed.select("row.*", "shard", "slot")
