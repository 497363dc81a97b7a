"""Queries whose results depend on all of a text, on texts that begin alike."""

import hashlib

import duckdb
import pytest

from webloom import catalog


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, "same beginning, one", "s", "en"), (2, "same beginning, two", "s", "en"), (3, "same beginning, two", "s", "en"), (4, "same", "s", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_latest_version_hashes_the_whole_text(spark, folder):
    got = {r.doc_id: r.content_hash for r in catalog.queries()["latest_version"](spark, folder).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((3, "same beginning, two"), (4, "same"))}


def test_version_chain_compares_whole_texts(spark, folder):
    got = {r.doc_id: (r.previous_version_id, r.version, r.unchanged) for r in catalog.queries()["version_chain"](spark, folder).collect()}
    assert got == {1: (None, 1, False), 2: (1, 2, False), 3: (2, 3, True), 4: (None, 1, False)}


def test_sql_of_versions_reads_whole_texts(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    sql = catalog.oracle_sql()
    got = {r[0]: r[1:] for r in con.sql(sql["version_chain"]).fetchall()}
    assert got == {1: (None, 1, False), 2: (1, 2, False), 3: (2, 3, True), 4: (None, 1, False)}
    assert {r[2] for r in con.sql(sql["latest_version"]).fetchall()} == {hashlib.sha256(t.encode()).hexdigest() for t in ("same beginning, two", "same")}
