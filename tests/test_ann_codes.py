"""The index of cells and codes: every row indexed, recall against the exact search, few cells on grouped vectors."""

import os
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom import catalog
from webloom.operators import ann, ann_codes, search

SCHEMA = "id long, vector array<double>"


def grouped(n=3000, size=32, groups=40):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(groups, size))
    return [(i, (centres[i % groups] + 0.3 * rng.normal(size=size)).tolist()) for i in range(n)]


def test_recall_and_share_of_rows_read(spark):
    data = grouped()
    rows = spark.createDataFrame(data, SCHEMA).repartition(5)
    queries = rows.where("id % 20 = 0")
    config = ann_codes.CodeIndexConfig(part_rows=40, block=7)
    codes = ann_codes.train(rows, "vector", "id", config)
    assert len(codes.centres) == round(3000**0.5)
    index = ann_codes.build(rows, "vector", "id", codes, config).persist()
    assert sorted(r.id for r in index.select("id").collect()) == [i for i, _ in data]
    assert index.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 120
    exact = search.nearest_batch(rows, queries, "vector", "id", 10)
    found = ann_codes.search(index, rows, queries, "vector", "id", codes, 10, probes=3, keep=100, config=config)
    assert ann.recall(found, exact).first()[0] >= 0.9
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    asked = ann._unit(np.array([v for i, v in data if i % 20 == 0]))
    near = np.argsort(-(asked @ codes.centres.T), axis=1)[:, :3]
    assert np.mean([sum(sizes.get(int(c), 0) for c in own) for own in near]) <= 0.1 * 3000
    chosen = ann_codes.candidates(index, queries, "vector", "id", codes, 3, 100, config)
    assert chosen.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 100
    by_query = {(r.query_id, r.rank): (r.id, r.similarity) for r in found.collect()}
    whole = np.array([v for _, v in data])
    for (q, _), (i, s) in list(by_query.items())[:200]:
        assert s == pytest.approx(whole[q] @ whole[i] / np.linalg.norm(whole[q]) / np.linalg.norm(whole[i]))


def shuffled_records(spark, run):
    """Records that the stages of ``run`` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    group = f"shuffled-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    time.sleep(1)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_what_a_search_shuffles_grows_with_the_rows_and_not_with_the_cells_asked(spark):
    rng = np.random.default_rng(4)
    config, shuffled = ann_codes.CodeIndexConfig(part_rows=500, block=64), []
    for n in (1500, 6000):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(n, 8)).tolist())], SCHEMA).repartition(4).persist()
        codes = ann_codes.train(rows, "vector", "id", config)
        index = ann_codes.build(rows, "vector", "id", codes, config).persist()
        asked = rows.where("id % 20 = 0").persist()
        assert index.count() == n and asked.count() == n // 20
        found = []
        shuffled.append(shuffled_records(spark, lambda: found.extend(ann_codes.candidates(index, asked, "vector", "id", codes, len(codes.centres), 5, config).collect())))
        vectors = {r.id: np.array(r.vector) / np.linalg.norm(r.vector) for r in rows.collect()}
        coded = {r.id: codes.decode(np.frombuffer(r.code, np.uint8)[None])[0] + codes.centres[r.cell] for r in index.collect()}
        ids, held = np.array(list(coded)), np.array(list(coded.values()))
        best = {(q, int(i)) for q in range(0, n, 20) for i in ids[np.lexsort((ids, -(held @ vectors[q])))[:5]]}
        assert {tuple(r) for r in found} == best and len(found) == len(best)
    assert shuffled[1] <= 4.5 * shuffled[0]


def test_two_levels_mostly_find_the_nearest_cell(spark):
    rows = spark.createDataFrame(grouped(), SCHEMA)
    codes = ann_codes.train(rows, "vector", "id")
    points = ann._unit(np.array([v for _, v in grouped()]))
    assert (codes.cells(points, 4) == (points @ codes.centres.T).argmax(axis=1)).mean() > 0.95


def test_odd_vectors(spark):
    odd = [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [1.0] * 5), (9004, [float("nan")] * 32), (9005, [1.0, None] * 16)]
    rows = spark.createDataFrame(grouped(200) + odd, SCHEMA)
    codes = ann_codes.train(rows.where("id < 9000"), "vector", "id")
    index = ann_codes.build(rows, "vector", "id", codes)
    assert sorted(r.id for r in index.collect()) == list(range(200))
    assert ann_codes.search(index, rows, rows.where("id >= 9000"), "vector", "id", codes).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert ann_codes.train(none, "vector", "id") is None
    assert ann_codes.search(ann_codes.build(none, "vector", "id", None), none, none, "vector", "id", None).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    exact = catalog.queries()["semantic_topk_batch"](spark, f"/root/testdata/{sf}").select("query_id", F.col("vec_id").alias("id"))
    found = catalog.queries()["ann_codes_search"](spark, f"/root/testdata/{sf}")
    assert ann.recall(found, exact).first()[0] >= 0.9
