"""A positional inverted table for keyword search: a query reads the postings of its own words.

``build`` writes three tables below a path. ``postings`` has a row for each word and
chunk, with the word's places and their fields; it is cut into parts at sampled splitters
of (word, hash of the chunk), so a rare word stands in one part and a frequent one fills
as many as it needs, each a range of hashes: no task or file holds more than a part. ``words``
counts the chunks of each word; ``parts`` has the bounds of each part.

A search takes the query's words from the rarest on. Of each it reads the parts whose
bounds may hold it (others are pruned as folders, and rows within a part by the files'
statistics); once the chunks left are few, of a frequent word only the parts their hashes
fall in. What is left by then is sent to the next word's postings, if it is small, so
those of frequent words are not shuffled. Places are read with the postings, so relevance
needs no text.

Cases: a chunk without words has no postings. A null title, content or URL has no words.
Chunk ids are taken as they are and must be unique. A query without words, or with a word
that no chunk has, finds nothing. Texts of any length keep all their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.functions.lexemes import lexemes, query_lexemes
from webloom.operators.crawl import cut_lineage
from webloom.operators.search import WEIGHTS, cover_density

FIELDS = tuple(WEIGHTS)
#: Postings that may be broadcast, and chunks whose hashes the driver looks up among the parts.
BROADCAST_ROWS, LOOKED_UP = 1_000_000, 10_000


@dataclass(frozen=True)
class IndexConfig:
    #: Postings of a part (about).
    part_rows: int = 2_000_000


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, hash, word lists of the fields) to a row for each word of a chunk, by one sort of a batch's words."""
    for batch in batches:
        names = batch.schema.names
        counts = [np.asarray(batch.column(f).value_lengths().fill_null(0)) for f in FIELDS]
        before = np.cumsum([np.zeros(batch.num_rows, np.int64), *counts[:-1]], axis=0)
        words, rows, places, fields = [], [], [], []
        for k, (f, n) in enumerate(zip(FIELDS, counts, strict=True)):
            words.append(batch.column(f).flatten())
            owner = np.repeat(np.arange(batch.num_rows), n)
            first = np.repeat(np.cumsum(n) - n, n)
            rows.append(owner)
            places.append(np.arange(len(owner)) - first + 1 + before[k][owner])
            fields.append(np.full(len(owner), k, np.int8))
        coded = pa.concat_arrays(words).dictionary_encode()
        row, place, field = (np.concatenate(x) for x in (rows, places, fields))
        key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        order = np.lexsort((place, key))
        begin = np.flatnonzero(np.diff(key[order], prepend=-1)) if len(key) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
        head = order[begin]
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(coded.indices.take(pa.array(head))), *[batch.column(c).take(pa.array(row[head])) for c in names[:2]],
             pa.ListArray.from_arrays(offsets, pa.array(place[order].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(field[order]))],
            ["word", "chunk_id", "hash", "places", "fields"],
        )


def postings(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(word, chunk_id, hash, places, fields) of every word of every chunk; places go on from title to content to URL."""
    about = documents.select(F.col("id").alias("document_id"), "url", "title")
    joined = chunks.select(F.col("id").alias("chunk_id"), "document_id", "content").join(about, "document_id")
    listed = joined.select("chunk_id", F.xxhash64("chunk_id").alias("hash"), *[lexemes(F.col(f)).alias(f) for f in FIELDS])
    kind = dict(listed.dtypes)["chunk_id"]
    return listed.mapInArrow(_posted, f"word string, chunk_id {kind}, hash long, places array<int>, fields array<tinyint>")


def build(chunks: DataFrame, documents: DataFrame, path: str, config: IndexConfig = IndexConfig()) -> None:
    """Write the tables of an index below ``path``, which all executors must see."""
    spark = chunks.sparkSession
    made = cut_lineage(postings(chunks, documents), "postings")
    parts = max(1, -(-made.count() // config.part_rows))
    ordered = made.repartitionByRange(parts, "word", "hash").withColumn("part", F.spark_partition_id()).sortWithinPartitions("word", "hash")
    ordered.write.partitionBy("part").parquet(f"{path}/postings")
    ordered.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    written = spark.read.schema(f"{_schema(made)}, part int").parquet(f"{path}/postings")
    held = cut_lineage(extents(written), "extents")
    first, last = F.min(F.struct("word", F.col("low").alias("hash"))), F.max(F.struct("word", F.col("high").alias("hash")))
    bounds = held.groupBy("part").agg(first.alias("low"), last.alias("high"), F.sum("n").alias("n"))
    bounds.select("part", F.col("low.word").alias("low"), F.col("low.hash").alias("low_hash"), F.col("high.word").alias("high"), F.col("high.hash").alias("high_hash"), "n").coalesce(1).write.parquet(f"{path}/parts")  # a row a part
    held.groupBy("word").agg(F.sum("n").alias("chunks")).repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/words")


def extents(written: DataFrame) -> DataFrame:
    """(part, word, low, high, n): hashes and number of the postings of each word in each part. Least and greatest words of parts, taken from the postings, would have all of these sorted."""
    return written.groupBy("part", "word").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count("*").alias("n"))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


class Index:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.postings = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).option("basePath", f"{path}/postings").parquet(f"{path}/postings")
        self.words, self.parts = (spark.read.parquet(f"{path}/{name}") for name in ("words", "parts"))

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """In how many chunks each of the words stands, for those that do."""
        return {r.word: r.chunks for r in self.words.where(F.col("word").isin(words)).collect()}

    def bounds(self, words: list[str]) -> dict[str, list[tuple[int, int, int]]]:
        """For each word the parts that may hold it: (part, smallest hash, largest hash) of it there."""
        near = F.lit(False)
        for w in words:
            near = near | ((F.col("low") <= w) & (F.col("high") >= w))
        found: dict[str, list[tuple[int, int, int]]] = {w: [] for w in words}
        for r in self.parts.where(near).collect():  # parts of the query's words
            for w in words:
                if r.low <= w <= r.high:
                    found[w].append((r.part, r.low_hash if r.low == w else -(1 << 63), r.high_hash if r.high == w else (1 << 63) - 1))
        return found

    def read(self, word: str, parts: list[int]) -> DataFrame:
        """Postings of a word in some parts."""
        return self.postings.where(F.col("part").isin(parts) & (F.col("word") == word)).select("chunk_id", "hash", "places", "fields")

    def matches(self, query: str) -> DataFrame:
        """(chunk_id, relevance) of all chunks that hold every word of the query."""
        wanted = query_lexemes(self.spark, query)
        counts = self.frequencies(wanted) if wanted else {}
        if not wanted or len(counts) < len(wanted):
            return self.postings.where("false").select("chunk_id", F.lit(0.0).alias("relevance"))
        order = sorted(wanted, key=lambda w: (counts[w], w))
        bounds = self.bounds(order)
        found, hashes = None, None
        for k, word in enumerate(order):
            parts = [p for p, low, high in bounds[word] if hashes is None or _any_within(hashes, low, high)]
            own = self.read(word, parts).select("chunk_id", "hash", self._occurrences(wanted.index(word) + 1).alias(f"o{k}"))
            if found is None:
                found = own
                if counts[word] <= LOOKED_UP and any(len(bounds[w]) > 1 for w in order[1:]):
                    hashes = np.sort(np.array([r.hash for r in found.select("hash").collect()], np.int64))  # few
            else:
                found = (F.broadcast(found) if counts[order[0]] <= BROADCAST_ROWS else found).join(own.drop("hash"), "chunk_id")
        if len(order) == 1:
            relevance = F.aggregate("o0", F.lit(0.0), lambda s, x: s + x["weight"])
        else:
            relevance = cover_density(F.array_sort(F.concat(*[F.col(f"o{k}") for k in range(len(order))])), len(order))
        return found.select("chunk_id", relevance.alias("relevance"))

    def _occurrences(self, term: int):
        weights = F.array(*[F.lit(WEIGHTS[f]) for f in FIELDS])
        return F.zip_with("places", "fields", lambda p, f: F.struct(p.alias("place"), F.lit(term).alias("term"), F.get(weights, f.cast("int")).alias("weight")))

    def search(self, chunks: DataFrame, documents: DataFrame, query: str, limit: int = 5) -> DataFrame:
        """The best chunks for a query, as ``search.keyword_search`` gives them; only theirs are read of the chunks and documents."""
        best = self.matches(query).orderBy(F.desc("relevance"), "chunk_id").limit(limit)
        held = chunks.join(F.broadcast(best), F.col("id") == F.col("chunk_id")).select("chunk_id", "document_id", "chunk_index", text.excerpt(F.col("content")).alias("excerpt"), "relevance")
        about = documents.select(F.col("id").alias("_id"), "url", "title").join(F.broadcast(held), F.col("_id") == F.col("document_id"))
        return about.select("chunk_id", "document_id", "url", "title", "chunk_index", "excerpt", "relevance").orderBy(F.desc("relevance"), "chunk_id")


def _any_within(hashes: np.ndarray, low: int, high: int) -> bool:
    at = np.searchsorted(hashes, low)
    return bool(at < len(hashes) and hashes[at] <= high)
