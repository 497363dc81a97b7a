"""The service's operations as functions on tables, with the checks of their arguments."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import crawl, search
from webloom.sources.providers import EmbeddingProvider


class RequestError(ValueError):
    """A refused request: ``status`` as an HTTP service would give it."""

    def __init__(self, status: int, code: str, message: str = ""):
        super().__init__(message or code)
        self.status, self.code = status, code


def _bounded(name: str, value, low: int, high: int) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise RequestError(422, "VALIDATION_ERROR", f"{name} must be a whole number") from None
    if not low <= number <= high or str(value).strip() != str(number):
        raise RequestError(422, "VALIDATION_ERROR", f"{name} must lie from {low} to {high}")
    return number


def check_search(q: str, limit=5, mode: str = "semantic") -> tuple[str, int, str]:
    q = (q or "").strip()
    if not 1 <= len(q) <= 512:
        raise RequestError(422, "VALIDATION_ERROR", "q must have 1 to 512 characters")
    if mode not in ("semantic", "keyword"):
        raise RequestError(422, "VALIDATION_ERROR", "mode must be semantic or keyword")
    return q, _bounded("limit", limit, 1, 20), mode


def check_question(question: str, limit=5) -> tuple[str, int]:
    question = (question or "").strip()
    if not 1 <= len(question) <= 2000:
        raise RequestError(422, "VALIDATION_ERROR", "question must have 1 to 2000 characters")
    return question, _bounded("limit", limit, 1, 10)


def check_page(page=1, page_size=25) -> tuple[int, int]:
    return _bounded("page", page, 1, 2**31 - 1), _bounded("page_size", page_size, 1, 100)


def run_search(chunks: DataFrame, documents: DataFrame, provider: EmbeddingProvider, q: str, limit=5, mode: str = "semantic", dimension: int = 384) -> DataFrame:
    q, limit, mode = check_search(q, limit, mode)
    if mode == "keyword":
        return search.keyword_search(chunks, documents, q, limit)
    if provider.dimension != dimension:
        raise RequestError(503, "EMBEDDING_DIMENSION_MISMATCH")
    vector = provider.embed([f"query: {q}"])[0]
    return search.semantic_search(chunks, documents, vector, provider.model, provider.version, limit)


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; 404 if there is none."""
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise RequestError(404, "NOT_FOUND")
    return found


def list_pages(pages: DataFrame, crawl_id: str, page=1, page_size=25) -> DataFrame:
    page, page_size = check_page(page, page_size)
    return crawl.paginate(pages.where(F.col("crawl_id") == crawl_id).drop("raw_html"), [F.col("created_at").asc(), F.col("id").asc()], page, page_size)


def list_dead_letters(letters: DataFrame, page=1, page_size=25) -> DataFrame:
    page, page_size = check_page(page, page_size)
    parsed = letters.withColumn("payload", F.coalesce(F.to_json(F.try_parse_json("job_payload")), F.col("job_payload")))
    return crawl.paginate(parsed, [F.col("failed_at").desc(), F.col("id").asc()], page, page_size)


def backfill_arguments(argv: list[str]) -> argparse.Namespace:
    """``--batch-size`` 1 to 500 (default 25) and ``--limit`` 1 to 1000000, with a space or an equals sign."""

    def within(low: int, high: int):
        def read(value: str) -> int:
            if not value.isdigit() or not low <= int(value) <= high:
                raise argparse.ArgumentTypeError(f"must lie from {low} to {high}")
            return int(value)

        return read

    parser = argparse.ArgumentParser(allow_abbrev=False)
    parser.add_argument("--batch-size", type=within(1, 500), default=25)
    parser.add_argument("--limit", type=within(1, 1_000_000), default=None)
    return parser.parse_args(argv)
