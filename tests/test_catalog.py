"""Every registered query of the engine against its SQL on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from webloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = sorted(repr([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())


def test_redirects_of_every_page(spark, tmp_path):
    rows = [(k, f"https://example.com/{k // 2 if k % 5 == 0 else k}", "") for k in range(1, 60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    first = {}
    for k, url, _ in rows:
        first.setdefault(url, k)
    chain = sorted(first, key=first.get)
    goes = {a: b for a, b in zip(chain, chain[1:]) if first[a] % 9}
    expected = set()
    for _, url, _ in rows:
        at, n = url, 0
        while n < 5 and at in goes:
            at, n = goes[at], n + 1
        expected.add((url, at, n))
    got = [tuple(r) for r in catalog.queries()["redirect_targets"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and {r[0] for r in got} == {url for _, url, _ in rows}


def counts(spark, name, column):
    return {r[column]: r["count"] for r in catalog.queries()[name](spark, SF).groupBy(column).count().collect()}


def test_queries_meet_every_branch(spark):
    assert counts(spark, "unchanged_reuse", "decision").keys() == {"NEW", "REUSED", "FAILED"}
    reuse = catalog.queries()["unchanged_reuse"](spark, SF)
    assert reuse.where("previous_version_id IS NOT NULL").count() and reuse.where("not_modified").count() and reuse.where("decision = 'REUSED' AND NOT not_modified").count()
    assert max(counts(spark, "url_dedupe", "n")) == 3
    assert counts(spark, "version_chain", "unchanged").keys() == {True, False}
    cited = catalog.queries()["citation_validate"](spark, SF)
    assert {len(r.citations.split(",")) for r in cited.collect() if r.citations} >= {1, 2} and cited.where("n_markers = 5").count() == cited.count()
    assert counts(spark, "bfs_crawl", "depth").keys() == {0, 1, 2, 3}
    assert counts(spark, "page_states", "status").keys() == {"COMPLETED", "FAILED", "RETRYING", "SKIPPED_ROBOTS"}
    assert counts(spark, "judged_fetches", "failure_category").keys() >= {None, "BROWSER_NAVIGATION", "DNS_FAILURE", "UNSUPPORTED_CONTENT_TYPE", "RESPONSE_TOO_LARGE", "HTTP_PERMANENT", "HTTP_429", "HTTP_503"}
    hops = catalog.queries()["redirect_hops"](spark, SF)
    assert {r.outcome for r in hops.collect()} == {"RESPONSE", "FAILED", "SKIPPED_ROBOTS"} and hops.where("n_hops >= 2").count()
    larger = SF.replace("sf0.001", "sf0.01")
    assert {r.allowed for r in catalog.queries()["robots_table"](spark, larger).collect()} == {True, False, None}
