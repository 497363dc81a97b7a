"""What a task holds of a batch, and what an index is built with."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.functions import chunking, html
from webloom.operators import inverted


def test_chunks_go_out_by_runs():
    texts = [("word " * 9000 + str(k)) if k % 3 else None for k in range(150)]
    taken = []

    def columns():
        for part in (texts[:100], texts[100:]):
            taken.append(len(part))
            yield pa.array(part, pa.string())

    made = chunking.chunk_lists(columns())
    first = next(made)
    assert len(first) < 100 and taken == [100]
    lists = first.to_pylist() + [c for a in made for c in a.to_pylist()]
    assert [[tuple(c.values()) for c in chunks] for chunks in lists] == [chunking.chunk(t or "") for t in texts]


def test_pages_go_out_by_runs():
    pages = [f"<title>t{k}</title><p>p{k}" for k in range(200)]
    made = list(html.read_pages(iter([pa.array(pages)])))
    assert len(made) > 1 and [(p["title"], p["content"]) for a in made for p in a.to_pylist()] == [(f"t{k}", f"p{k}") for k in range(200)]


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_extents_of_words_give_bounds_and_counts(spark, tmp_path, part_rows):
    """Parts and words are told from one table of words in parts, and are those of the postings themselves."""
    chunks = spark.createDataFrame([(k, k, f"common w{k % 5} own{k}") for k in range(40)], "id long, document_id long, content string")
    documents = chunks.select("id", F.lit("").alias("url"), F.lit("").alias("title"))
    inverted.build(chunks, documents, str(tmp_path / "index"), inverted.IndexConfig(part_rows))
    index = inverted.Index(spark, str(tmp_path / "index"))
    held = {}
    for r in index.postings.collect():
        held.setdefault(r.part, []).append((r.word, r.hash))
    assert sorted(map(tuple, index.parts.select("part", "low", "low_hash", "high", "high_hash", "n").collect())) == sorted((p, *min(v), *max(v), len(v)) for p, v in held.items())
    assert {r.word: r.chunks for r in index.words.collect()} == {w: sum(x == w for v in held.values() for x, _ in v) for w in {x for v in held.values() for x, _ in v}}
    plan = inverted.extents(index.postings)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
