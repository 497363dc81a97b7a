"""Schemas of the engine's tables and the rules that their rows keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRAWLS = "id string, seed_url string, normalized_origin string, render_mode string, status string, max_pages int, max_depth int, discovered_count long, completed_count long, skipped_count long, failed_count long, completed_at timestamp_ntz, created_at timestamp_ntz"
PAGES = "id string, crawl_id string, url string, normalized_url string, depth int, parent_page_id string, status string, attempts int, error string, failure_category string, not_modified boolean, reused_document_id string, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz"
TABLES = "array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>"
DOCUMENTS = f"id string, crawl_page_id string, url string, title string, raw_html string, content string, structured_data struct<tables:{TABLES}>, content_hash string, http_status int, content_type string, etag string, last_modified string, previous_version_id string, fetched_at timestamp_ntz"
CHUNKS = "id string, document_id string, chunk_index int, content string, content_hash string, start_offset int, end_offset int, embedding array<float>, embedding_model string, embedding_version string, embedded_content_hash string, embedded_at timestamp_ntz"
DEAD_LETTERS = "id string, crawl_id string, crawl_page_id string, job_id string, url string, job_payload string, failure_category string, error_message string, attempt_count int, failed_at timestamp_ntz"
FETCH_LOG = "url string, render_mode string, http_status int, content_type string, etag string, last_modified string, retry_after string, error_code string, error_message string, body string, fetched_at timestamp_ntz"

#: Rule name and the SQL condition that every row must meet.
RULES = {
    "crawls": {
        "max_pages": "max_pages BETWEEN 1 AND 500",
        "max_depth": "max_depth BETWEEN 0 AND 10",
        "counters": "discovered_count >= 0 AND completed_count >= 0 AND skipped_count >= 0 AND failed_count >= 0",
        "capacity": "discovered_count <= max_pages",
    },
    "pages": {"depth": "depth BETWEEN 0 AND 10", "attempts": "attempts >= 0"},
    "dead_letters": {"attempt_count": "attempt_count >= 1", "job_payload": "length(job_payload) <= 8192", "error_message": "length(error_message) <= 2000"},
    "chunks": {
        "chunk_index": "chunk_index >= 0",
        "offsets": "start_offset >= 0 AND end_offset > start_offset",
        "content": "length(content) > 0",
        "embedding": "(embedding IS NULL AND embedding_model IS NULL AND embedding_version IS NULL AND embedded_content_hash IS NULL AND embedded_at IS NULL)"
        " OR (embedding IS NOT NULL AND embedding_model IS NOT NULL AND embedding_version IS NOT NULL AND embedded_content_hash IS NOT NULL AND embedded_at IS NOT NULL)",
    },
}
UNIQUE = {"pages": ["crawl_id", "normalized_url"], "documents": ["crawl_page_id"], "chunks": ["document_id", "chunk_index"], "dead_letters": ["crawl_page_id"]}


def violations(rows: DataFrame, table: str) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name)) for name, rule in RULES[table].items()]))
    return rows.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def duplicates(rows: DataFrame, table: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*UNIQUE[table]).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference leads nowhere."""
    known = parents.select(F.col(key).alias("_known"))
    return rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")


def cascade(rows: DataFrame, column: str, kept: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose parent is still there."""
    return rows.join(kept.select(F.col(key).alias("_kept")), F.col(column) == F.col("_kept"), "left_semi")


def set_null(rows: DataFrame, column: str, kept: DataFrame, key: str = "id") -> DataFrame:
    """All rows, references to what is gone made null."""
    known = kept.select(F.col(key).alias("_kept")).distinct()
    joined = rows.join(known, F.col(column) == F.col("_kept"), "left")
    return joined.withColumn(column, F.col("_kept")).select(*rows.columns)
