"""A join of many rows with a table that counts the rows of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.scratch import BROADCAST_ROWS

#: A key with more than this part of all rows is hot, so there are no more hot keys than that.
HOT_SHARE = 1000


def attach(rows: DataFrame, table: DataFrame, key: str, n: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, a written table with one narrow row for each key of ``rows``; null keys meet.

    ``n`` counts the rows of a key. A table of up to ``limit`` rows is broadcast. Of a larger
    one the hot keys are, and the rows of all others meet it by a shuffle, in which no key is hot.
    """
    held = table.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(held), same).drop("_key")
    least = table.agg(F.sum(n)).first()[0] // HOT_SHARE
    hot, rest = held.where(F.col(n) > least), held.where(F.col(n) <= least)
    cold = rows.join(F.broadcast(hot.select("_key")), same, "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(cold.join(rest, same)).drop("_key")
