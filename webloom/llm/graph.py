"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.scratch import materialize

#: Links a task holds when it replaces them by a forest.
_HELD_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the smallest node of its component, for the links a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while True:
            jumped = after[after]
            if (jumped == after).all():
                break
            after = jumped
        if (after == root).all():
            break
        root = after
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size > _HELD_LINKS:
            a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held, size = [(a, b)], len(a)
            if size > _HELD_LINKS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held, size = [], 0
    if held:
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); the component is its smallest node.

    Each task first replaces its links by a forest, so a node has few links however
    many it had. Then every node takes the smallest label among its neighbours' and
    the label of its label, so paths shrink to half in each round. Labels are written
    each round; nothing is gathered on the driver but whether a node changed.
    """
    links = links.where("a <> b").select("a", "b").mapInArrow(_shrink, "a long, b long")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"))
    labels = materialize(labels, "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "near").alias("next"), "component")
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("jumped"))
        after = lower.join(jump, "next", "left").select("node", F.least("next", "jumped").alias("next"), "component")
        after = materialize(after, "labels")
        labels = after.select("node", F.col("next").alias("component"))
        if after.where("next <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
