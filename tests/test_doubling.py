"""Chains by doubled pointers, ranks by ranges, and previous versions, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl, versions


def test_long_and_odd_version_chains(spark):
    n = 100_000
    long = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("previous_version_id"))
    odd = [(200_000, None), (200_001, 200_000), (200_002, 200_000), (200_003, 200_002), (300_000, 299_999), (300_001, 300_000), (400_000, 400_001), (400_001, 400_000), (500_000, 500_000)]
    rows = long.unionByName(spark.createDataFrame(odd, "id long, previous_version_id long"))
    got = {r.id: (r.root_id, r.ordinal) for r in versions.version_chain(rows).collect()}
    expected = {k: (0, k + 1) for k in range(n)} | {200_000: (200_000, 1), 200_001: (200_000, 2), 200_002: (200_000, 2), 200_003: (200_000, 3)}
    assert got == expected
    assert versions.version_chain(rows.limit(0)).count() == 0


def test_previous_versions_of_a_busy_url(spark):
    rng = random.Random(3)
    stored = [(f"d{k}", f"p{rng.randrange(6)}" if k % 7 else None, f"u{rng.randrange(4)}", f"h{k}", rng.randrange(20)) for k in range(120)]
    documents = spark.createDataFrame([(i, p, u, h, t, None, None) for i, p, u, h, t in stored], "id string, crawl_page_id string, normalized_url string, content_hash string, fetched_at long, etag string, last_modified string")
    wanted = [(f"p{k % 9}", f"u{k % 5}") for k in range(45)]
    fetched = spark.createDataFrame([(f"{p}", u) for p, u in wanted], "page_id string, normalized_url string")
    got = sorted((r.page_id, r.document_id) for r in versions.previous_version(fetched, documents).collect())
    plain = []
    for p, u in wanted:
        own = [(t, i) for i, page, url, _, t in stored if url == u and page is not None and page != p]
        plain += [(p, max(own)[1])] if own else []
    assert got == sorted(plain)


@pytest.mark.parametrize("at_once", [1_000_000, 50])
def test_ranks_and_reservations(spark, at_once):
    rng = random.Random(5)
    rows = [(f"c{rng.choice([0, 0, 0, 1, 2])}", k, rng.randrange(40), f"p{k % 11}", 0, f"u{rng.randrange(400)}") for k in range(900)]
    candidates = spark.createDataFrame(rows, "crawl_id string, parent_order long, position long, parent_page_id string, parent_depth int, normalized_url string")
    pages = spark.createDataFrame([("c0", f"u{k}") for k in range(30)] + [("c1", "u1")], "crawl_id string, normalized_url string")
    limits = spark.createDataFrame([("c0", 250, 2), ("c1", 40, 2), ("c2", 5000, 2)], "crawl_id string, max_pages int, max_depth int")
    got = sorted((r.crawl_id, r.rank, r.normalized_url, r.parent_page_id) for r in crawl.reserve(candidates, pages, limits, at_once).collect())
    plain = []
    for c, cap, used in (("c0", 250, {f"u{k}" for k in range(30)}), ("c1", 40, {"u1"}), ("c2", 5000, set())):
        first = {}
        for own, order, position, parent, _, url in sorted(rows, key=lambda r: (r[1], r[2])):
            if own == c and url not in used:
                first.setdefault(url, (order, position, url, parent))
        taken = sorted(first.values())[: max(0, cap - len(used))]
        plain += [(c, k + 1, url, parent) for k, (_, _, url, parent) in enumerate(taken)]
    assert got == sorted(plain)


@pytest.mark.parametrize("hours", [1, 24])
def test_kept_rules_of_a_long_log(spark, hours):
    rng = random.Random(7)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(k, "busy", begin + datetime.timedelta(hours=hours * rng.randrange(400) + rng.choice([0, 0.25, 0.999])), "x") for k in range(1500)]
    rows += [(2000 + k, "exact", begin + datetime.timedelta(hours=hours * k), "x") for k in range(70)]
    rows += [(3000, "once", begin, "x"), (3001, "far", begin, "x"), (3002, "far", begin + datetime.timedelta(days=900), "x"), (3003, None, begin, "x"), (3004, "null", None, "x")]
    requests = spark.createDataFrame(rows, "id long, origin string, requested_at timestamp, fetched_by string")
    got = {r.id: (r.fetched_at, r.is_fetch) for r in crawl.robots_lookups(requests, hours).collect()}
    plain, kept = {}, {}
    for k, origin, at, _ in sorted(rows, key=lambda r: (r[1] or "", r[2] or begin)):
        if origin is None or at is None:
            plain[k] = (None, None)
            continue
        if origin not in kept or at >= kept[origin] + datetime.timedelta(hours=hours):
            kept[origin] = at
        plain[k] = (kept[origin], kept[origin] == at)
    assert got == plain


def test_next_fetches_are_found_in_one_pass(spark):
    """No window is open at its end, for which Spark reads all rows that follow again for each row."""
    times = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1))], "origin string, at timestamp")
    plan = crawl._next_fetches(times, F.expr("INTERVAL 24 HOURS"), 24)._jdf.queryExecution().toString()
    assert "specifiedwindowframe" in plan and "unboundedfollowing" not in plan
