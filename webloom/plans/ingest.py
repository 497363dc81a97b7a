"""End-to-end plans: fetched pages to documents and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.chunking import chunk_documents
from webloom.functions.html import discover_links
from webloom.functions.urls import normalize_url, url_origin
from webloom.sources.fetches import judge, process_pages


@dataclass(frozen=True)
class CrawlerConfig:
    """Bounds are checked; times in milliseconds."""

    request_interval_ms: int = 1000
    navigation_timeout_ms: int = 30_000
    settle_ms: int = 1000
    browser_contexts: int = 2
    max_pages: int = 25
    max_depth: int = 2

    def __post_init__(self):
        for name, low, high in (("request_interval_ms", 1, 60_000), ("browser_contexts", 1, 10), ("max_pages", 1, 500), ("max_depth", 0, 10)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie from {low} to {high}")


def documents_from_fetches(fetches: DataFrame) -> DataFrame:
    """(id, crawl_page_id, url, title, raw_html, content, tables, content_hash, http_status, content_type) of pages with text."""
    processed = process_pages(judge(fetches)).where("failure_category IS NULL")
    return processed.select(
        F.sha2(F.concat_ws("|", "page_id", "content_hash"), 256).alias("id"), F.col("page_id").alias("crawl_page_id"), "url", "title", F.col("body").alias("raw_html"), "content", "tables", "content_hash", "http_status", "content_type",
    )


def chunks_from_documents(documents: DataFrame) -> DataFrame:
    chunks = chunk_documents(documents, "id", "content").withColumnRenamed("id", "document_id")
    return chunks.withColumn("id", F.sha2(F.concat_ws("|", "document_id", "chunk_index", "content_hash"), 256))


def links_from_documents(documents: DataFrame) -> DataFrame:
    """(source, target, position) of the links on each page within its own origin."""
    found = documents.withColumn("origin", url_origin(F.col("url"))).withColumn("source", normalize_url(F.col("url"), reject_downloadable=False)["url"])
    listed = found.select("source", F.posexplode(discover_links(F.col("raw_html"), F.col("url"), F.col("origin"))).alias("position", "target"))
    return listed.select("source", "target", F.col("position").cast("long").alias("position"))
