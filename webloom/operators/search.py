"""Semantic and keyword search over chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import text, vectors
from webloom.functions.lexemes import lexemes, query_lexemes

#: Weights of title, content and URL in keyword relevance.
WEIGHTS = {"title": 1.0, "content": 0.4, "url": 0.2}
#: Where words may be other than bare runs of letters and digits.
_COMPOUND = r"[\p{L}\p{N}][.@:/-]+[\p{L}\p{N}/]|[+-]\d|_"


def current_embedding(model: str, version: str) -> Column:
    """Whether a chunk's vector was made by this model from the content it has now."""
    return F.coalesce(
        F.col("embedding").isNotNull()
        & (F.col("embedding_model") == model)
        & (F.col("embedding_version") == version)
        & (F.col("embedded_content_hash") == F.col("content_hash")),
        F.lit(False),
    )


def stale_embedding(model: str, version: str) -> Column:
    return ~current_embedding(model, version)


def nearest(rows: DataFrame, vector_column: str, id_column: str, query: list[float], limit: int) -> DataFrame:
    """The rows nearest to a vector by cosine similarity, ties by id: one partial top-k per task, no full sort."""
    similarity = vectors.cosine_similarity(F.col(vector_column), vectors.vector_column(query))
    return rows.withColumn("similarity", similarity).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), id_column).limit(limit)


def nearest_batch(rows: DataFrame, queries: DataFrame, vector_column: str, id_column: str, limit: int, block: int = 512) -> DataFrame:
    """(query_id, id, similarity, rank) for every query (the same id and vector columns), against all rows.

    Queries go out in blocks of bounded size. A task multiplies its rows with a block
    and passes on no more than the best of each query, which meet in one window a query.
    """
    found, held = None, []
    schema = "query_id long, id long, similarity double"

    def search_block(block_rows: list) -> DataFrame:
        ids = np.array([r[0] for r in block_rows], np.int64)
        matrix = np.array([r[1] for r in block_rows], np.float64)
        return rows.select(id_column, vector_column).mapInArrow(lambda it: _block_top(it, ids, matrix, limit), schema)

    for row in queries.select(id_column, vector_column).where(F.col(vector_column).isNotNull()).toLocalIterator():
        held.append(row)
        if len(held) == block:
            part, held = search_block(held), []
            found = part if found is None else found.unionByName(part)
    if held or found is None:
        part = search_block(held) if held else rows.sparkSession.createDataFrame([], schema)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _block_top(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    sizes = np.sqrt((queries * queries).sum(axis=1))
    best_ids, best = np.zeros((len(query_ids), 0), np.int64), np.zeros((len(query_ids), 0))
    for batch in batches:
        keep = pa.compute.and_(pa.compute.is_valid(batch.column(1)), pa.compute.equal(pa.compute.list_value_length(batch.column(1)), queries.shape[1]))
        batch = batch.filter(keep)
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            vectors_ = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(part), -1)
            own = np.sqrt((vectors_ * vectors_).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                found = (queries @ vectors_.T) / (sizes[:, None] * own)
            found[~np.isfinite(found)] = -np.inf
            ids = np.broadcast_to(part.column(0).to_numpy(), found.shape)
            best, best_ids = np.concatenate([best, found], axis=1), np.concatenate([best_ids, ids], axis=1)
            order = np.lexsort((best_ids, -best), axis=1)[:, :limit]
            best, best_ids = np.take_along_axis(best, order, 1), np.take_along_axis(best_ids, order, 1)
    good = np.isfinite(best)
    owner = np.broadcast_to(query_ids[:, None], best.shape)
    yield pa.RecordBatch.from_arrays([pa.array(owner[good]), pa.array(best_ids[good]), pa.array(best[good])], ["query_id", "id", "similarity"])


def semantic_search(chunks: DataFrame, documents: DataFrame, query: list[float], model: str, version: str, limit: int = 5, latest_only: bool = False) -> DataFrame:
    """chunk_id, document_id, url, title, chunk_index, excerpt and similarity of the best chunks with current vectors, over all versions of documents."""
    if latest_only:
        from webloom.operators.versions import latest

        documents = latest(documents)
    # the top chunks' documents are looked up after the top is known, so vectors never meet document rows
    found = nearest(chunks.where(current_embedding(model, version)).join(documents.select("id"), F.col("document_id") == documents.id, "left_semi"), "embedding", "id", query, limit)
    return _hits(found, documents, "similarity")


def _hits(found: DataFrame, documents: DataFrame, score: str) -> DataFrame:
    about = documents.select(F.col("id").alias("document_id"), "url", "title")
    return (
        found.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", text.excerpt(F.col("content")).alias("excerpt"), score)
        .join(about, "document_id")
        .select("chunk_id", "document_id", "url", "title", "chunk_index", "excerpt", score)
        .orderBy(F.desc(score), "chunk_id")
    )


def terms(value: Column) -> Column:
    """The words of a text; taken apart by pattern alone where no two runs touch a point, hyphen or slash between them."""
    plain = F.lower(F.coalesce(value, F.lit("")))
    return F.when(F.rlike(plain, F.lit(_COMPOUND)), lexemes(value)).otherwise(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)")))


def _occurrences(fields: dict[str, Column], wanted: list[str]) -> Column:
    """array<struct<place, term, weight>> of the query's terms in the fields one after another, in order of place."""
    known = F.array(*map(F.lit, wanted))

    def listed(words: Column, shift: Column, weight: float) -> Column:
        marked = F.transform(words, lambda w, i: F.struct((i + 1 + shift).alias("place"), F.array_position(known, w).cast("int").alias("term"), F.lit(weight).alias("weight")))
        return F.filter(marked, lambda x: x["term"] > 0)

    parts, shift = [], F.lit(0)
    for name, words in fields.items():
        parts.append(listed(words, shift, WEIGHTS[name]))
        shift = shift + F.size(words)
    return F.concat(*parts)


def cover_density(found: Column, n_terms: int) -> Column:
    """Relevance from the minimal covers of all terms: each gives its terms' mean weight over one more than the words between.

    A cover ends at a place if the latest places of all terms before it begin later
    than those of the cover before. With one term every place is a cover.
    """
    if n_terms == 1:
        return F.aggregate(found, F.lit(0.0), lambda s, x: s + x["weight"])
    state = F.struct(
        F.transform(F.sequence(F.lit(1), F.lit(n_terms)), lambda _: F.struct(F.lit(0).alias("place"), F.lit(0.0).alias("weight"))).alias("seen"),
        F.lit(0).alias("begin"),
        F.lit(0.0).alias("score"),
    )

    def step(s: Column, x: Column) -> Column:
        seen = F.transform(s["seen"], lambda old, i: F.when(i + 1 == x["term"], F.struct(x["place"].alias("place"), x["weight"].alias("weight"))).otherwise(old))
        return F.transform(
            F.array(seen),
            lambda now: F.transform(
                F.array(F.array_min(F.transform(now, lambda e: e["place"]))),
                lambda low: F.struct(
                    now.alias("seen"),
                    F.when(low > s["begin"], low).otherwise(s["begin"]).alias("begin"),
                    (
                        s["score"]
                        + F.when(
                            (low > 0) & (low > s["begin"]),
                            n_terms / F.aggregate(now, F.lit(0.0), lambda t, e: t + 1 / e["weight"]) / (1 + (x["place"] - low) - (n_terms - 1)),
                        ).otherwise(0.0)
                    ).alias("score"),
                ),
            )[0],
        )[0]

    return F.aggregate(found, state, step, lambda s: s["score"])


def _times(field: Column, word: str) -> Column:
    """How often a word stands in a lower-case text."""
    bare = F.regexp_count(field, F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])"))
    return F.when(F.rlike(field, F.lit(_COMPOUND)), F.size(F.filter(lexemes(field), lambda w: w == word))).otherwise(bare)


def keyword_matches(chunks: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """Chunks that hold all words of the query in title, content or URL, with their relevance, in no order; an empty query finds nothing.

    All texts are read; ``inverted`` answers from a table of words.
    """
    wanted = query_lexemes(chunks.sparkSession, query)
    joined = chunks.join(documents.select(F.col("id").alias("document_id"), "url", "title"), "document_id")
    about = [F.col("id").alias("chunk_id"), "document_id", "url", "title", "chunk_index", text.excerpt(F.col("content")).alias("excerpt")]
    if not wanted:
        return joined.where("false").select(*about, F.lit(0.0).alias("relevance"))
    fields = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in WEIGHTS}
    for word in wanted:  # only texts with all words are cut into words
        joined = joined.where(F.greatest(*[F.contains(field, F.lit(word)) for field in fields.values()]))
    if len(wanted) == 1:  # every place counts for itself
        counted = joined.withColumns({f"_{f}": _times(field, wanted[0]) for f, field in fields.items()}).where(" + ".join(f"_{f}" for f in WEIGHTS) + " > 0")
        return counted.select(*about, sum((F.col(f"_{f}") * weight for f, weight in WEIGHTS.items()), F.lit(0.0)).alias("relevance"))
    cut = joined.withColumns({f"_{f}": terms(F.col(f)) for f in WEIGHTS})
    for word in wanted:
        cut = cut.where(F.greatest(*[F.array_contains(f"_{f}", word) for f in WEIGHTS]))
    relevance = cover_density(_occurrences({f: F.col(f"_{f}") for f in WEIGHTS}, wanted), len(wanted))
    return cut.select(*about, relevance.alias("relevance"))


def keyword_search(chunks: DataFrame, documents: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The best of ``keyword_matches`` by relevance."""
    return keyword_matches(chunks, documents, query).orderBy(F.desc("relevance"), "chunk_id").limit(limit)


def search(chunks: DataFrame, documents: DataFrame, mode: str = "semantic", **options) -> DataFrame:
    if mode == "semantic":
        return semantic_search(chunks, documents, **options)
    if mode == "keyword":
        return keyword_search(chunks, documents, **options)
    raise ValueError(f"mode {mode!r}")
