"""The inverted table against a plain reading of every text, and words as a store's parser takes them."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.functions.lexemes import lexemes
from webloom.operators import inverted, search

WEIGHTS = {"title": 1.0, "content": 0.4, "url": 0.2}


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Up-to-date guides. Next", ["up-to-date", "up", "to", "date", "guides", "next"]),
        ("see https://Docs.Example.com/a/b?c=1 now", ["see", "docs.example.com/a/b?c=1", "docs.example.com", "/a/b?c=1", "now"]),
        ("(example.org) and my-host.net:8080/x", ["example.org", "and", "my-host.net/x", "my-host.net", "/x"]),
        ("mail jo.do@mail5.example.com###", ["mail", "jo.do@mail5.example.com"]),
        ("1.5 and 1.2.3 and -2.5, 42 3rd", ["1.5", "and", "1.2.3", "and", "-2.5", "42", "3rd"]),
        ("snake_case it's e.g. x- a--b", ["snake", "case", "it", "s", "e", "g", "x", "a", "b"]),
        ("ünï-cödé 漢字", ["ünï-cödé", "ünï", "cödé", "漢字"]),
        ("\u0001odd\u0002 marks", ["odd", "marks"]),
        (" ,. ", []),
        (None, []),
    ],
)
def test_lexemes(spark, value, expected):
    assert spark.createDataFrame([(value,)], "t string").select(lexemes(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("run", ["a", "a-", "a.", "1.", "a@", "a_", "ab.cd/", "-"])
def test_lexemes_of_long_runs_take_time_in_proportion(spark, run):
    import time

    began = time.time()
    spark.range(1).select(F.repeat(F.lit(run), 300_000).alias("t")).select(F.size(lexemes(F.col("t")))).collect()
    assert time.time() - began < 30


def plain_words(value):
    """Words of texts whose compounds are hyphenated words and hosts only."""
    out = []
    for token in re.findall(r"[a-z0-9.-]+", (value or "").lower()):
        token = token.strip(".-")
        parts = re.split(r"[.-]", token)
        out += ([token] if len(parts) > 1 else []) + (parts if "." not in token else [])
    return out


def plain_matches(chunks, documents, query):
    about = {d: (url, title) for d, url, title in documents}
    wanted = list(dict.fromkeys(plain_words(query)))
    found = {}
    for chunk, document, _, content in chunks:
        url, title = about[document]
        words = [(w, WEIGHTS[f]) for f, v in (("title", title), ("content", content), ("url", url)) for w in plain_words(v)]
        places = [(k, w, weight) for k, (w, weight) in enumerate(words) if w in wanted]
        if not wanted or {w for _, w, _ in places} != set(wanted):
            continue
        if len(wanted) == 1:
            found[chunk] = sum(weight for _, _, weight in places)
            continue
        seen, begin, total = {}, -1, 0.0
        for k, w, weight in places:
            seen[w] = (k, weight)
            if len(seen) == len(wanted) and min(p for p, _ in seen.values()) > begin:
                begin = min(p for p, _ in seen.values())
                total += len(wanted) / sum(1 / x for _, x in seen.values()) / (1 + k - begin - (len(wanted) - 1))
        found[chunk] = total
    return found


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    common, rare = ["the", "of", "and"], ["up-to-date", "docs.example.com", "zebra", "quartz", "re-use"]
    documents = [(d, rng.choice(["docs.example.com", "www.example.org"]), rng.choice([None, "", "the zebra guide", "notes"])) for d in range(40)]
    chunks = []
    for c in range(400):
        words = [rng.choice(common) if rng.random() < 0.7 else rng.choice([*rare, f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(30))]
        chunks.append((c, c % 40, c // 40, rng.choice([" ".join(words), None, ""]) if c % 9 == 0 else " ".join(words)))
    tables = spark.createDataFrame(chunks, "id long, document_id long, chunk_index int, content string"), spark.createDataFrame(documents, "id long, url string, title string")
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    inverted.build(*tables, path, inverted.IndexConfig(part_rows=150))
    return chunks, documents, *tables, inverted.Index(spark, path)


@pytest.mark.parametrize("query", ["the", "zebra", "the of", "Zebra the", "up-to-date", "to", "docs.example.com the", "docs", "quartz zebra the", "and of the", "w7", "absent the", "", "re-use quartz"])
def test_inverted_table_and_scan_against_plain(corpus, query):
    chunks, documents, chunk_table, document_table, index = corpus
    plain = plain_matches(chunks, documents, query)
    assert {r.chunk_id: r.relevance for r in index.matches(query).collect()} == pytest.approx(plain)
    assert {r.chunk_id: r.relevance for r in search.keyword_matches(chunk_table, document_table, query).collect()} == pytest.approx(plain)
    top, scanned = index.search(chunk_table, document_table, query, 400).collect(), search.keyword_search(chunk_table, document_table, query, 400).collect()
    assert sorted(tuple(r)[:6] for r in top) == sorted(tuple(r)[:6] for r in scanned) and len(top) == len(plain)
    assert [r.relevance for r in index.search(chunk_table, document_table, query, 7).collect()] == pytest.approx(sorted(plain.values(), reverse=True)[:7])


def test_frequent_words_fill_parts_and_rare_ones_do_not(corpus):
    *_, index = corpus
    words = collections.Counter(r.word for r in index.postings.select("word").collect())
    assert index.frequencies(["the", "zebra", "absent"]) == {w: words[w] for w in ("the", "zebra")}
    bounds = index.bounds(["the", "zebra", "w7"])
    assert len(bounds["the"]) > 2 and len(bounds["w7"]) <= 2
    rows = [r.n for r in index.parts.collect()]
    assert sum(rows) == sum(words.values()) and max(rows) < 3 * 150
    # parts of a frequent word are ranges of hashes that do not meet
    spans = sorted((low, high) for _, low, high in bounds["the"])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_a_search_reads_the_parts_of_its_words_only(corpus):
    *_, index = corpus
    assert 0 < len(index.bounds(["w7"])["w7"]) <= 2 < 10 < index.parts.count()
    before = index.spark.conf.get("spark.sql.maxMetadataStringLength")
    index.spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = index.matches("w7 the")._jdf.queryExecution().executedPlan().toString()
    index.spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and "EqualTo(word,w7)" in plan


def test_inverted_table_of_nothing(spark, tmp_path):
    chunks, documents = spark.createDataFrame([], "id long, document_id long, chunk_index int, content string"), spark.createDataFrame([], "id long, url string, title string")
    inverted.build(chunks, documents, f"file://{tmp_path}/i")
    index = inverted.Index(spark, f"file://{tmp_path}/i")
    assert index.matches("a b").count() == 0 and index.search(chunks, documents, "a").count() == 0
