"""Batches that are given again, buckets that are not touched, and a model that sees each text once."""

import glob
import os

from pyspark.sql import functions as F

from webloom.operators import versions
from webloom.sources.sinks import KeyedTable

SCHEMA = "id long, at long, value string"


def batches():
    return [[(k, b * 10 + k % 3, f"v{b}-{k}") for k in range(b * 7, b * 7 + 20)] + [(3, b, f"tie{b}")] for b in range(4)]


def plain(parts, keep):
    held = {}
    for part in parts:
        own = {}
        for row in sorted(part, key=lambda r: (r[1], r[2]), reverse=keep):
            own[row[0]] = row
        for key, row in own.items():
            if not keep or key not in held:
                held[key] = row
    return sorted(held.values())


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_batches_given_again_change_nothing(spark, tmp_path):
    for keep in (False, True):
        table = KeyedTable(spark, f"file://{tmp_path}/{keep}", SCHEMA, ("id",), ("at", "value"), keep, buckets=8)
        assert table.rows().count() == 0
        for k, rows in enumerate(batches()):
            table.apply(spark.createDataFrame(rows, SCHEMA), k)
            first = sorted(map(tuple, table.rows().collect()))
            assert first == plain(batches()[: k + 1], keep)
            table.apply(spark.createDataFrame(rows, SCHEMA).repartition(3), k)
            assert sorted(map(tuple, table.rows().collect())) == first


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("id",), ("at",), buckets=16)
    table.apply(spark.createDataFrame([(k, 0, "a") for k in range(500)], SCHEMA), 0)
    before = files(tmp_path / "t")
    table.apply(spark.createDataFrame([(7, 1, "b")], SCHEMA), 1)
    after = files(tmp_path / "t")
    assert all(after[f] == t for f, t in before.items()) and len(after) - len(before) == 1
    assert table.rows().where("id = 7").first().value == "b" and table.rows().count() == 500
    # a batch that was cut short before its manifest leaves the table as it was, and may come again
    other = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("id",), ("at",), buckets=16)
    spark.createDataFrame([(9, 5, "half", 0)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"file://{tmp_path}/t/data/batch=2")
    assert other.rows().count() == 500 and other.rows().where("value = 'half'").count() == 0
    other.apply(spark.createDataFrame([(9, 5, "whole")], SCHEMA), 2)
    assert other.rows().where("id = 9").first().value == "whole" and other.rows().count() == 500


def test_a_stream_into_a_keyed_table(spark, tmp_path):
    for k, rows in enumerate(batches()):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("id",), ("at", "value"), buckets=4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    got = sorted(map(tuple, table.run(stream).collect()))
    expected = {}
    for row in sorted((r for part in batches() for r in part), key=lambda r: (r[1], r[2])):
        expected[row[0]] = row
    assert {r[0] for r in got} == set(expected) and len(got) == len(expected)
    assert sorted(map(tuple, table.run(stream).collect())) == got


def test_each_text_is_embedded_once(spark, tmp_path):
    folder = str(tmp_path)

    def embed(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write("\n".join(texts))
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(f"c{k}", f"text {k}" if k != 5 else "bad", f"h{k}", [1.0, 0.0] if k % 4 == 0 else None, "m", "v", f"h{k}", None) for k in range(40)]
    chunks = spark.createDataFrame(rows, "id string, content string, content_hash string, embedding array<float>, embedding_model string, embedding_version string, embedded_content_hash string, embedded_at timestamp")
    after, summary = versions.backfill_embeddings(chunks, embed, "m", "v", 2, F.current_timestamp(), batch_size=8)
    assert tuple(summary.first()) == (40, 29, 10, 1, 4)
    assert after.where("embedding IS NOT NULL").count() == 39 and after.count() == 40
    said = [line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split("\n") if "bad" not in line]
    tried = {line: said.count(line) for line in said}
    together = [name for name in os.listdir(folder) if "bad" in open(f"{folder}/{name}").read()]
    again = {line for name in together for line in open(f"{folder}/{name}").read().split("\n")}
    assert len(tried) == 29 and all(n == 1 for line, n in tried.items() if line not in again)
