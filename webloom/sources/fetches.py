"""The fetch log as a source of pages: what a fetcher wrote, judged and processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import html, policy, text


def read_fetch_log(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:  # noqa: A002
    return spark.read.schema(schemas.FETCH_LOG).format(format).load(path)


def fetch_log_from_pages(pages: DataFrame) -> DataFrame:
    """A fetch log from plain pages (page_id, url, html), each a good response."""
    return pages.select(
        F.col("page_id").cast("string").alias("page_id"), "url", F.lit("STATIC").alias("render_mode"), F.lit(200).alias("http_status"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.lit(None).cast("string").alias("retry_after"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.col("html").alias("body"),
    )


def judge(fetches: DataFrame) -> DataFrame:
    """The log with failure_category, retryable and retry_after_ms; order of tests: no response, status, content type, size."""
    responded = F.col("http_status").isNotNull()
    network = F.when(F.col("render_mode") == "JAVASCRIPT", policy.classify_browser(F.col("error_code"), F.col("error_message"))).otherwise(
        policy.classify_network(F.col("error_code"), F.col("error_message"))
    )
    category = F.when(responded, policy.classify_http(F.col("http_status"), F.col("content_type"), F.octet_length("body"))).otherwise(network)
    judged = fetches.withColumn("failure_category", category).withColumn("not_modified", F.coalesce(F.col("http_status") == 304, F.lit(False)))
    return judged.withColumn("retryable", F.col("failure_category").isNotNull() & policy.is_retryable(F.col("failure_category"))).withColumn(
        "retry_after_ms", policy.retry_after_ms(F.col("retry_after"), F.current_timestamp())
    )


def process_pages(fetches: DataFrame) -> DataFrame:
    """Title, content, tables and hash of the good pages of a judged log; a page without text fails with EMPTY_CONTENT."""
    good = fetches.where("failure_category IS NULL AND NOT not_modified")
    cleaned = good.withColumn("_clean", html.read_page(F.col("body"))).withColumn("tables", F.col("_clean.tables"))
    serialized = html.serialize_tables(F.col("tables"))
    content = F.concat(F.col("_clean.content"), F.when(serialized != "", F.concat(F.lit("\n\n"), serialized)).otherwise(""))
    empty = F.col("_clean.content") == ""
    return (
        cleaned.withColumn("title", F.col("_clean.title"))
        .withColumn("failure_category", F.when(empty, F.lit("EMPTY_CONTENT")))
        .withColumn("content", F.when(~empty, content))
        .withColumn("content_hash", text.content_hash(F.col("content")))
        .drop("_clean")
    )
