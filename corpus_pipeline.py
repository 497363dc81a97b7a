"""The corpus pipeline: quality rules, near-duplicate join, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the next stage's docs. All stages but the last return
the columns of documents. As a stage begins, the intermediate tables of the stage before
it in the same run are deleted, so that one's result must have been written by then. The
first stage begins a run; tables of other runs and queries stay.

Cases: rows with nulls in any column, repeated rows and columns of clashing names pass
through the stages as their operators state it. Without language or source a row counts
as of a language or source of its own kind. A null text fails the quality rules. An
empty table gives an empty result. The subpackage webloom.llm is needed to import this;
__spark_entry__.py leaves the pipeline out where it is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import decontamination, jaccard, mixing, quality, scratch, sharding
from webloom.session import ship


#: Intermediate tables of the stage that this run took last; threads have runs of their own.
_held: ContextVar[list[str]] = ContextVar("tables of the last stage")


def _stage(spark: SparkSession, rows: Callable[[], DataFrame]) -> DataFrame:
    """What ``rows`` gives; the tables of the stage before are deleted first, its own are noted."""
    ship(spark)
    scratch.sweep(_held.get([]))
    before = set(scratch.written())
    found = rows()
    _held.set([path for path in scratch.written() if path not in before])
    return found


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    _held.set([])
    return _stage(spark, lambda: quality.keep(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; five words and 0.8 link, the query's four and 0.85 are its own."""
    return _stage(spark, lambda: jaccard.keep_first(docs, jaccard.JaccardConfig(gram=5, percent=80)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _stage(spark, lambda: decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by the token budgets of their domain, language and source, some in two epochs."""
    return _stage(spark, lambda: mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the shard and the slot of each row."""
    return _stage(spark, lambda: sharding.shard_rows(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", shard),
]

#: Connected components, and shard bounds from samples, are not expressed in SQL; tests/llm holds the stages against plain forms of their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.materialize(docs, f"stage-{k + 1}")
    return docs
