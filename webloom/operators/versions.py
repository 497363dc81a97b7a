"""Document versions, chunk synchronisation, and backfills."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions.chunking import chunk_documents
from webloom.operators.crawl import cut_lineage
from webloom.operators.search import stale_embedding


def latest(documents: DataFrame, key: str = "url") -> DataFrame:
    """The newest version of each document: latest fetch, then largest id."""
    fields = [c for c in documents.columns if c != key]
    return documents.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("fetched_at", "id")).alias("d")).select(key, "d.*")


def previous_version(fetched: DataFrame, documents: DataFrame) -> DataFrame:
    """For each fetch (page_id, normalized_url) the newest stored document of the same URL from another page, in any crawl or render mode.

    Of a URL only the newest document of its newest page, and the newest of any other page, can be one.
    """
    fields = ["document_id", "content_hash", "etag", "last_modified", "fetched_at"]
    known = documents.select(F.col("normalized_url").alias("_url"), F.col("crawl_page_id").alias("_page"), "fetched_at", F.col("id").alias("document_id"), "content_hash", "etag", "last_modified")
    newest = F.struct("fetched_at", "document_id")
    pages = known.where("_page IS NOT NULL").groupBy("_url", "_page").agg(F.max_by(F.struct("_page", *fields), newest).alias("d"))
    order = F.struct("d.fetched_at", "d.document_id")
    first = pages.groupBy("_url").agg(F.max_by("d", order).alias("first"))
    rest = pages.join(first.select("_url", F.col("first._page").alias("_first")), "_url").where(F.col("_page") != F.col("_first"))
    second = rest.groupBy("_url").agg(F.max_by("d", order).alias("second"))
    two = first.join(second, "_url", "left")
    joined = fetched.join(two, F.col("normalized_url") == F.col("_url")).withColumn("d", F.when(F.col("page_id") != F.col("first._page"), F.col("first")).otherwise(F.col("second")))
    return joined.where("d IS NOT NULL").select("page_id", *[F.col(f"d.{f}").alias(f) for f in fields])


def resolve_fetch(fetched: DataFrame, previous: DataFrame) -> DataFrame:
    """Whether a fetch is a new document, a reuse of the previous one, or fails: (page_id, decision, reused_document_id, previous_version_id, not_modified).

    ``fetched``: (page_id, http_status, content_hash).
    """
    old = previous.select("page_id", F.col("document_id").alias("_old"), F.col("content_hash").alias("_hash"))
    joined = fetched.join(old, "page_id", "left")
    unchanged = (F.col("http_status") == 304) | (F.col("content_hash") == F.col("_hash"))
    decision = F.when((F.col("http_status") == 304) & F.col("_old").isNull(), "FAILED").when(F.col("_old").isNotNull() & unchanged, "REUSED").otherwise("NEW")
    return joined.withColumn("decision", decision).select(
        "page_id", "decision", F.when(F.col("decision") == "REUSED", F.col("_old")).alias("reused_document_id"), F.when(F.col("decision") == "NEW", F.col("_old")).alias("previous_version_id"),
        ((F.col("http_status") == 304) & (F.col("decision") == "REUSED")).alias("not_modified"),
    )


def version_history(documents: DataFrame, key: str, time: str, id_column: str, hash_column: str) -> DataFrame:
    """Every document with its predecessor, version number and whether its content is new."""
    order = Window.partitionBy(key).orderBy(time, id_column)
    before = F.lag(id_column).over(order)
    return (
        documents.withColumn("previous_version_id", before)
        .withColumn("version", F.row_number().over(order))
        .withColumn("unchanged", F.coalesce(F.lag(hash_column).over(order) == F.col(hash_column), F.lit(False)))
    )


def version_chain(documents: DataFrame) -> DataFrame:
    """(root_id, id, ordinal): chains of previous_version_id followed from their first document.

    Each document points to its previous one; pointers are doubled, so a chain of n
    versions takes log n rounds, each written. A document whose chain has no first one, as
    where its previous version is missing or versions go round, is in no chain.
    """
    linked = documents.select("id", "previous_version_id")
    pointers = cut_lineage(linked.select("id", F.coalesce("previous_version_id", "id").alias("at"), F.col("previous_version_id").isNotNull().cast("long").alias("steps"), F.col("previous_version_id").isNull().alias("ended")), "versions")
    done, active, most = pointers.where("ended"), pointers.where("NOT ended"), pointers.count()
    reach = 1
    while reach <= 2 * most and not active.isEmpty():
        known = done.unionByName(active).select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("ended").alias("_ended"))
        moved = active.join(known, "at").select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended"))
        moved = cut_lineage(moved, "versions")
        done, active = done.unionByName(moved.where("ended")), moved.where("NOT ended")
        reach *= 2
    return done.select(F.col("at").alias("root_id"), "id", (F.col("steps") + 1).cast("int").alias("ordinal"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming``, and those of ``existing`` with other keys."""
    return existing.join(incoming.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of ``existing``, and the first of ``incoming`` for each key that it has not."""
    fields = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def synchronize_chunks(existing: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks after synchronisation, and per document how many were kept, made and replaced.

    A document whose chunks are equal in index, content, hash and offsets keeps its
    rows, vectors included; any other gets the wanted rows instead.
    """
    fields = ["chunk_index", "content_hash", "start_offset", "end_offset"]
    sign = F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*fields, F.sha2("content", 256).alias("own"))))), 256)
    old = existing.groupBy("document_id").agg(sign.alias("_old"), F.count("*").alias("n_old"))
    new = wanted.groupBy("document_id").agg(sign.alias("_new"), F.count("*").alias("n_new"))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    zero = F.lit(0).cast("long")
    report = old.join(new, "document_id", "full").select(
        "document_id", same.alias("equal"), F.when(same, F.col("n_old")).otherwise(zero).alias("retained"),
        F.when(same, zero).otherwise(F.coalesce("n_new", zero)).alias("created"), F.when(same, zero).otherwise(F.coalesce("n_old", zero)).alias("replaced"),
    )
    equal = report.where("equal").select("document_id")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in existing.schema if f.name not in wanted.columns]
    made = wanted.join(equal, "document_id", "left_anti").select("*", *missing).select(*existing.columns)
    touched = new.select("document_id").union(old.select("document_id")).distinct()
    kept = existing.join(equal, "document_id", "left_semi").unionByName(existing.join(touched, "document_id", "left_anti"))
    return kept.unionByName(made), report.drop("equal")


def backfill_chunks(documents: DataFrame, existing: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of all documents (id, content) brought up to date, and a summary."""
    chosen = documents.orderBy("id").limit(limit) if limit is not None else documents
    chunks = chunk_documents(chosen, "id", "content").withColumnRenamed("id", "document_id")
    wanted = chunks.withColumn("id", F.sha2(F.concat_ws("|", "document_id", "chunk_index", "content_hash"), 256))
    scope = existing.join(chosen.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    rest = existing.join(chosen.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    after, report = synchronize_chunks(scope, wanted)
    summary = report.agg(F.count("*").alias("processed"), F.sum("created").alias("created"), F.sum("retained").alias("retained"), F.sum("replaced").alias("replaced"))
    return rest.unionByName(after), summary


def embed_stale(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, version: str, dimension: int, batch_size: int = 16, tries: int = 3) -> DataFrame:
    """(id, content_hash, embedding, error) of the chunks without a current vector.

    A batch is tried a few times, then its texts one by one, so one bad text costs
    only itself. ``embed`` is loaded once a task.
    """
    if not 1 <= batch_size <= 64:
        raise ValueError("batch_size from 1 to 64")

    def attempt(texts: list[str]) -> list[list[float]] | None:
        for _ in range(tries):
            try:
                found = embed(texts)
                if len(found) == len(texts) and all(len(v) == dimension for v in found):
                    return found
            except Exception:  # noqa: BLE001, PERF203 - a provider may raise anything
                continue
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                texts = ["passage: " + t for t in part["content"]]
                found = attempt(texts) or [(attempt([t]) or [None])[0] for t in texts]
                rows += [(i, h, v, None if v is not None else "EMBEDDING_FAILED") for i, h, v in zip(part["id"], part["content_hash"], found, strict=True)]
            yield pd.DataFrame(rows, columns=["id", "content_hash", "embedding", "error"])

    stale = chunks.where(stale_embedding(model, version)).select("id", "content", "content_hash")
    return stale.mapInPandas(run, "id string, content_hash string, embedding array<float>, error string")


def apply_embeddings(chunks: DataFrame, made: DataFrame, model: str, version: str, now: Column) -> DataFrame:
    """Chunks with the new vectors, where the content is still the one that was embedded."""
    good = made.where("embedding IS NOT NULL").select(F.col("id").alias("_id"), F.col("content_hash").alias("_hash"), F.col("embedding").alias("_vector"))
    joined = chunks.join(good, (F.col("id") == F.col("_id")) & (F.col("content_hash") == F.col("_hash")), "left")
    new = F.col("_id").isNotNull()
    values = {"embedding": F.col("_vector"), "embedding_model": F.lit(model), "embedding_version": F.lit(version), "embedded_content_hash": F.col("_hash"), "embedded_at": now}
    return joined.withColumns({c: F.when(new, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_id", "_hash", "_vector")


def embedding_summary(chunks: DataFrame, made: DataFrame, model: str, version: str, batch_size: int = 16) -> DataFrame:
    stale = F.count_if(stale_embedding(model, version))
    seen = chunks.agg(F.count("*").alias("inspected"), stale.alias("stale"))
    return seen.crossJoin(made.agg(F.count("embedding").alias("embedded"), F.count("error").alias("failed"))).select(
        "inspected", "embedded", (F.col("inspected") - F.col("stale")).alias("skipped"), "failed", F.ceil(F.col("stale") / batch_size).cast("long").alias("batches")
    )


def backfill_embeddings(
    chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, version: str, dimension: int, now: Column, batch_size: int = 16
) -> tuple[DataFrame, DataFrame]:
    """Chunks with current vectors, and the summary of what was done; each stale text goes through the model once.

    What the model gives is written, and the counts are observed as it is.
    """
    spark, seen, made = chunks.sparkSession, Observation(), Observation()
    inspected = chunks.observe(seen, F.count(F.lit(1)).alias("inspected"), F.count_if(stale_embedding(model, version)).alias("stale"))
    vectors = embed_stale(inspected, embed, model, version, dimension, batch_size)
    vectors = cut_lineage(vectors.observe(made, F.count("embedding").alias("embedded"), F.count("error").alias("failed")), "embedded")
    n = seen.get | made.get
    row = (n["inspected"], n["embedded"], n["inspected"] - n["stale"], n["failed"], -(-n["stale"] // batch_size))
    summary = spark.createDataFrame([row], "inspected long, embedded long, skipped long, failed long, batches long")
    return apply_embeddings(chunks, vectors, model, version, now), summary
