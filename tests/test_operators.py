import datetime
import http.server
import json
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom import api, catalog, schemas
from webloom.operators import ann, crawl, rag, search, versions
from webloom.plans import ingest
from webloom.sources import fetches, paged_files, providers
from webloom.streaming import politeness

NOW = datetime.datetime(2026, 7, 1)


def unit(*values, size=384):
    return [float(v) for v in values] + [0.0] * (size - len(values))


@pytest.fixture(scope="module")
def store(spark):
    documents = spark.createDataFrame([("d1", "https://example.com/a", "Title one"), ("d2", "https://example.com/b", None)], "id string, url string, title string")
    rows = [("c0", "d1", 0, "alpha beta", "h0", unit(1), "m", "v", "h0"), ("c1", "d1", 1, "beta gamma alpha", "h1", unit(0.8, 0.6), "m", "v", "h1"), ("c2", "d2", 0, "alpha", "h2", unit(1), "m", "v", "old"), ("c3", "d2", 1, "delta", "h3", None, None, None, None)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, chunk_index int, content string, content_hash string, embedding array<double>, embedding_model string, embedding_version string, embedded_content_hash string")
    return chunks, documents


def test_semantic_search(store):
    chunks, documents = store
    got = search.semantic_search(chunks, documents, unit(1), "m", "v", 5).collect()
    assert [(r.chunk_index, round(r.similarity, 6)) for r in got] == [(0, 1.0), (1, 0.8)]
    stale = [r.id for r in chunks.where(search.stale_embedding("m", "v")).orderBy("id").collect()]
    assert stale == ["c2", "c3"]


def test_keyword_search(store):
    chunks, documents = store
    got = search.keyword_search(chunks, documents, "ALPHA beta", 5).collect()
    assert [r.chunk_id for r in got] == ["c0", "c1"]
    assert got[0].relevance == pytest.approx(0.4) and got[1].relevance == pytest.approx(0.4 / 2)
    assert search.keyword_search(chunks, documents, " ,. ", 5).count() == 0
    title = search.keyword_search(chunks, documents, "one", 5).collect()
    assert [(r.chunk_id, r.relevance) for r in title] == [("c0", 1.0), ("c1", 1.0)]


def test_cover_density_against_plain(spark):
    import random

    def plain(words, wanted):
        places = [(i + 1, w) for i, w in enumerate(words) if w in wanted]
        seen, begin, total = {}, 0, 0.0
        for place, word in places:
            seen[word] = place
            if len(seen) == len(wanted) and min(seen.values()) > begin:
                begin = min(seen.values())
                total += 0.4 / (1 + place - begin - (len(wanted) - 1))
        return total

    rng = random.Random(2)
    samples = [[rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(120)]
    chunks = spark.createDataFrame([(i, i, 0, " ".join(s)) for i, s in enumerate(samples)], "id int, document_id int, chunk_index int, content string")
    documents = spark.createDataFrame([(i, "", "") for i in range(len(samples))], "id int, url string, title string")
    got = {r.chunk_id: r.relevance for r in search.keyword_search(chunks, documents, "a b", 1000).collect()}
    assert got == pytest.approx({i: plain(s, {"a", "b"}) for i, s in enumerate(samples) if {"a", "b"} <= set(s)})


def units(value):
    return len(value.encode("utf-16-le")) // 2


def test_bounded_sources(spark):
    import random

    rng, least, per_source, in_all = random.Random(5), 0.75, 100, 500
    kind = "array<struct<chunk_id:string,document_id:string,chunk_index:int,url:string,title:string,excerpt:string,similarity:double>>"
    letters = ["x", "\U0001f30a", "é", " y"]
    cases = []
    for _ in range(80):
        texts = [" " * rng.randrange(3) + rng.choice(letters) * rng.randrange(300) for _ in range(rng.randrange(8))]
        cases.append([{"chunk_id": "c", "document_id": "d", "chunk_index": i, "url": "u", "title": rng.choice([None, "T"]), "excerpt": t, "similarity": rng.choice([0.7, 0.75, 0.9, None, float("nan")])} for i, t in enumerate(texts)])
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, h {kind}")
    for row in df.select("i", "h", rag.bounded_sources(F.col("h"), least, per_source, in_all).alias("s")).select("i", "s", rag.context(F.col("s")).alias("context")).collect():
        usable = [h for h in cases[row.i] if h["similarity"] is not None and h["similarity"] >= least and h["excerpt"].strip()]
        assert units(row.context) <= in_all
        # sources are the first usable hits in order, numbered from one, each the start of its text
        assert [(s.number, s.chunk_index) for s in row.s] == [(k + 1, h["chunk_index"]) for k, h in enumerate(usable[: len(row.s)])]
        whole = True
        for s, h in zip(row.s, usable):
            own = h["excerpt"].strip()
            assert s.excerpt and own.startswith(s.excerpt) and units(s.excerpt) <= per_source
            full = units(s.excerpt) >= min(units(own), per_source) - 1
            assert whole or not full or units(s.excerpt) < per_source  # nothing but the last may be cut for want of room
            whole = whole and full
        # a hit is left out only if not even the head of its block and a character have room, or little does after one was cut
        if len(row.s) < len(usable):
            assert in_all - units(row.context) < 2 + units("SOURCE [9]\nTitle: Untitled\nURL: u\nChunk: 9\nContent:\n") + 3 or not whole


@pytest.mark.parametrize(
    ("answer", "n"),
    [("Waves [3] break [1]; again [3], never [7] .", 3), ("No citation", 2), ("[0][01][2]x  y .", 1), ("", 3), ("[99999999999999999999] a [1]", 1), ("tail [3]", 3)],
)
def test_citations(spark, answer, n):
    got = spark.createDataFrame([(answer, n)], "a string, n int").select(rag.validated(F.col("a"), F.col("n")).alias("v")).first().v
    assert (got.answer, got.citations) == rag.validate_answer(answer, n)
    if answer.startswith("Waves"):
        assert (got.answer, got.citations) == ("Waves [3] break [1]; again [3], never.", [3, 1])


def test_ask(spark):
    questions = spark.createDataFrame([(i, "Q?") for i in range(5)], "question_id int, question string")
    hits = spark.createDataFrame([(i, 1, "c", "d", 0, "u", None, "Evidence text.", 0.9) for i in (0, 1, 2, 3)], "question_id int, rank int, chunk_id string, document_id string, chunk_index int, url string, title string, excerpt string, similarity double")
    answers = spark.createDataFrame([(0, "Yes [1].", None), (1, "No citation", None), (2, None, "TIMEOUT"), (3, None, "PROVIDER")], "question_id int, answer string, error string")
    got = {r.question_id: r for r in rag.ask(questions, hits, answers).collect()}
    assert [got[i].status for i in range(5)] == [200, 502, 504, 502, 200]
    assert got[0].answer == "Yes [1]." and got[0].citations[0].excerpt == "Evidence text." and got[4].answer == rag.INSUFFICIENT
    assert "MANDATORY OUTPUT RULES:\\n- Return" in got[0].prompt


GRAPH = [("/g", "/a", 0), ("/g", "/b", 1), ("/g", "/a", 2), ("/a", "/c", 0), ("/b", "/c", 0)]


@pytest.mark.parametrize(("cap", "depth", "expected"), [(10, 2, 4), (10, 0, 1), (10, 1, 3), (2, 2, 2)])
def test_traverse(spark, cap, depth, expected):
    links = spark.createDataFrame(GRAPH, "source string, target string, position long")
    crawls = spark.createDataFrame([("x", "/g", cap, depth)], "crawl_id string, seed_url string, max_pages int, max_depth int")
    found = crawl.traverse(crawls, links).collect()
    assert len(found) == expected and sorted(r.position for r in found) == list(range(expected))


def test_reserve_capacity_and_retry(spark):
    crawls = spark.createDataFrame([("x", 5, 2)], "crawl_id string, max_pages int, max_depth int")
    pages = spark.createDataFrame([("x", "/p1"), ("x", "/p2")], "crawl_id string, normalized_url string")
    rows = [("x", p, i, f"/p{p}", 0, f"/{p}-{i}") for p in (1, 2) for i in range(5)]
    candidates = spark.createDataFrame(rows, "crawl_id string, parent_order long, position long, parent_page_id string, parent_depth int, normalized_url string")
    new = crawl.reserve(candidates, pages, crawls)
    assert [r.normalized_url for r in new.orderBy("rank").collect()] == ["/1-0", "/1-1", "/1-2"]
    after = pages.unionByName(new.select("crawl_id", "normalized_url"))
    assert crawl.reserve(candidates, after, crawls).count() == 0


def test_states_and_dead_letters(spark):
    attempts = spark.createDataFrame(
        [("a", 1, "FAILED", "HTTP_503", "e", None), ("a", 2, "FAILED", "HTTP_503", "e", None), ("a", 3, "FAILED", "HTTP_503", "e", None), ("b", 1, "FAILED", "HTTP_PERMANENT", "e", None), ("c", 1, "FAILED", "HTTP_429", "e", 7000), ("d", 1, "SKIPPED_ROBOTS", None, None, None), ("e", 1, "FAILED", None, "e", None), ("e", 2, "COMPLETED", None, None, None)],
        "page_id string, attempt int, outcome string, failure_category string, error string, retry_after_ms long",
    )
    got = {r.page_id: (r.status, r.attempts, r.delay_ms) for r in crawl.page_outcomes(attempts).collect()}
    assert got == {"a": ("FAILED", 3, None), "b": ("FAILED", 1, None), "c": ("RETRYING", 1, 7000), "d": ("SKIPPED_ROBOTS", 1, None), "e": ("COMPLETED", 2, None)}
    pages = spark.createDataFrame([("1", "x", None, "FAILED"), ("2", "x", "1", "DISCOVERED"), ("3", "x", "1", "COMPLETED")], "id string, crawl_id string, parent_page_id string, status string")
    skipped = crawl.skip_children(pages)
    assert {r.id: r.status for r in skipped.collect()} == {"1": "FAILED", "2": "SKIPPED", "3": "COMPLETED"}
    state = crawl.fold_state(skipped, F.lit(NOW)).first()
    assert (state.status, state.failed_count, state.skipped_count, state.completed_with_failures) == ("COMPLETED", 1, 1, True)


def test_versions(spark):
    stored = spark.createDataFrame([("o1", "p1", "u", "h1", 1), ("o2", "p2", "u", "h2", 2)], "id string, crawl_page_id string, normalized_url string, content_hash string, fetched_at int").withColumns({"etag": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("string")})
    fetched = spark.createDataFrame([("p3", "u", 304, None), ("p4", "u", 200, "h2"), ("p5", "u", 200, "h9"), ("p6", "v", 304, None), ("p2", "u", 200, "h1")], "page_id string, normalized_url string, http_status int, content_hash string")
    got = {r.page_id: (r.decision, r.reused_document_id, r.previous_version_id, r.not_modified) for r in versions.resolve_fetch(fetched, versions.previous_version(fetched.select("page_id", "normalized_url"), stored)).collect()}
    assert got == {"p3": ("REUSED", "o2", None, True), "p4": ("REUSED", "o2", None, False), "p5": ("NEW", None, "o2", False), "p6": ("FAILED", None, None, False), "p2": ("REUSED", "o1", None, False)}
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, previous_version_id string")
    assert [(r.id, r.ordinal) for r in versions.version_chain(chain).orderBy("ordinal").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_chunk_backfill_and_embeddings(spark):
    documents = spark.createDataFrame([("1", "one two three"), ("2", "bad text")], "id string, content string")
    none = spark.createDataFrame([], schemas.CHUNKS)
    chunks, summary = versions.backfill_chunks(documents, none)
    assert summary.first().asDict() == {"processed": 2, "created": 2, "retained": 0, "replaced": 0}
    provider = providers.HashingEmbedding(8)

    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return provider.embed(texts)

    made = versions.embed_stale(chunks, embed, "hashing", "1", 8).cache()
    stored = versions.apply_embeddings(chunks, made, "hashing", "1", F.lit(NOW)).cache()
    assert versions.embedding_summary(chunks, made, "hashing", "1").first().asDict() == {"inspected": 2, "embedded": 1, "skipped": 0, "failed": 1, "batches": 1}
    assert schemas.violations(stored, "chunks").count() == 0
    again, summary = versions.backfill_chunks(documents.withColumn("content", F.when(F.col("id") == "2", "new").otherwise(F.col("content"))), stored)
    assert summary.first().asDict() == {"processed": 2, "created": 1, "retained": 1, "replaced": 1}
    assert again.where("embedding IS NOT NULL").count() == 1


def test_ingest_and_integrity(spark):
    pages = spark.createDataFrame([(1, "http://example.com/", "<title>T</title><p>Hello</p><table><tr><td>x</td></tr></table><a href='/b'>b</a>"), (2, "http://example.com/e", "<nav>menu</nav>")], "page_id long, url string, html string")
    processed = fetches.process_pages(fetches.judge(fetches.fetch_log_from_pages(pages)))
    assert {r.page_id: r.failure_category for r in processed.collect()} == {"1": None, "2": "EMPTY_CONTENT"}
    documents = ingest.documents_from_fetches(fetches.fetch_log_from_pages(pages))
    assert documents.first().content == "Hello\nx\nb\n\nStructured tables:\nTable 1\nx"
    assert ingest.links_from_documents(documents).collect() == [("http://example.com/", "http://example.com/b", 0)]
    broken = spark.createDataFrame([("a", 0, 11), ("b", 501, 2)], "id string, max_pages int, max_depth int").withColumns({c: F.lit(1) for c in ("discovered_count", "completed_count", "skipped_count", "failed_count")})
    assert {r.id: r.broken_rules for r in schemas.violations(broken, "crawls").collect()} == {"a": ["max_pages", "max_depth", "capacity"], "b": ["max_pages"]}
    with pytest.raises(ValueError):
        ingest.CrawlerConfig(max_pages=501)


def test_redirects_and_spacing(spark):
    edges = spark.createDataFrame([(f"/{i}", f"/{i + 1}") for i in range(8)], "from_url string, to_url string")
    got = {r.request_url: (r.final_url, r.n_hops, r.too_many) for r in crawl.follow_redirects(spark.createDataFrame([("/0",), ("/5",)], "url string"), edges).collect()}
    assert got == {"/0": ("/5", 5, True), "/5": ("/8", 3, False)}
    requests = spark.createDataFrame([("a", "h", 0), ("b", "h", 10), ("c", "h", 5000), ("d", "i", 7)], "request_id string, host_port string, arrival_ms long")
    assert {r.request_id: r.start_ms for r in crawl.spacing(requests).collect()} == {"a": 0, "b": 1000, "c": 5000, "d": 7}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "h", 0), ("b", "h", 10), ("d", "i", 7)], "request_id string, host_port string, arrival_ms long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("request_id string, host_port string, arrival_ms long").parquet(source)
    running = politeness.spaced_requests(stream).writeStream.format("memory").queryName("spaced").outputMode("append").trigger(availableNow=True).start()
    try:
        assert running.awaitTermination(120)
    finally:
        running.stop()
    assert {r.request_id: r.start_ms for r in spark.table("spaced").collect()} == {"a": 0, "b": 1000, "d": 7}


def stream_of(spark, tmp_path, batches, schema):
    """A stream that gives each list of rows as a batch of its own, in order."""
    for i, rows in enumerate(batches):
        path = tmp_path / "in" / f"{i}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def clock(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).isoformat(timespec="milliseconds")


def cut(rows, rng, n):
    marks = sorted(rng.randrange(len(rows) + 1) for _ in range(n - 1))
    return [rows[a:b] for a, b in zip([0, *marks], [*marks, len(rows)], strict=True)]


def test_spaced_stream_in_batches(spark, tmp_path):
    """The same starts as one sequential pass, however the requests fall into batches and though free hosts are forgotten."""
    rng = random.Random(8)
    rows, now = [], 1_700_000_000_000
    for i in range(120):
        now += rng.choice([1, 300, 900, 60_000])
        rows.append({"request_id": f"{i:03d}", "host_port": rng.choice(["a:80", "b:443", None]), "at": clock(now), "ms": now, "crawl_delay_ms": rng.choice([None, 10, 5000])})
    free, expected = {}, {}
    for r in rows:
        start = max(r["ms"], free.get(r["host_port"], 0))
        expected[r["request_id"]] = start
        free[r["host_port"]] = start + max(1000, r["crawl_delay_ms"] or 0)
    late = {"request_id": "none", "host_port": "a:80", "at": None, "crawl_delay_ms": None}
    stream = stream_of(spark, tmp_path, [*cut(rows, rng, 5), [late]], "request_id string, host_port string, at timestamp, crawl_delay_ms long")
    got = crawl.run_stream(politeness.spaced_requests(stream, time="at", delay="0 seconds"), "spaced").collect()
    assert {r.request_id: r.start_ms for r in got} == expected and len(got) == len(rows)


def test_page_transitions_in_batches(spark, tmp_path):
    """Attempts and timers as one sequential pass over the times gives them, pages forgotten and taken up again included."""
    rng, keep = random.Random(9), 50_000
    rows, now = [], 1_700_000_000_000
    for i in range(200):
        now += rng.choice([1, 400, 1500, 4000])
        outcome = rng.choice(["FAILED", "FAILED", "FAILED", "REUSED", "COMPLETED", "SKIPPED_ROBOTS"])
        category = rng.choice(["NETWORK_TIMEOUT", "HTTP_429", "HTTP_PERMANENT", None])
        rows.append({"page_id": rng.randrange(12), "attempt_id": i, "at": clock(now), "ms": now, "outcome": outcome, "failure_category": category, "retry_after_ms": 9000 if category == "HTTP_429" else None})
    rows.append({**rows[-1], "page_id": 99, "attempt_id": 999, "at": clock(now + 300_000), "ms": now + 300_000, "outcome": "COMPLETED"})
    expected, pages = [], {}

    def timers(until):
        for page, (made, due, gone, ended) in list(pages.items()):
            if due is not None and due <= until:
                expected.append((page, made + 1, "QUEUED", due))
                due, gone = None, due + keep
            pages[page] = (made, due, gone, ended)
            if gone is not None and gone <= until:
                del pages[page]

    for r in rows:
        timers(r["ms"])
        made, due, gone, ended = pages.get(r["page_id"], (0, None, None, False))
        if ended:
            continue
        made += 1
        if r["outcome"] == "FAILED" and r["failure_category"] != "HTTP_PERMANENT" and made < 3:
            expected.append((r["page_id"], made, "RETRYING", r["ms"]))
            pages[r["page_id"]] = (made, r["ms"] + (r["retry_after_ms"] or 1000 * 2 ** (made - 1)), None, False)
        else:
            expected.append((r["page_id"], made, "COMPLETED" if r["outcome"] == "REUSED" else r["outcome"], r["ms"]))
            pages[r["page_id"]] = (made, None, r["ms"] + keep, True)
    stream = stream_of(spark, tmp_path, cut(rows, rng, 6), "page_id long, attempt_id long, at timestamp, outcome string, failure_category string, retry_after_ms long")
    got = crawl.run_stream(politeness.page_transitions(stream, delay="0 seconds", keep_ms=keep), "transitions").collect()
    assert sorted((r.page_id, r.attempt, r.status, r.at_ms) for r in got) == sorted(expected)
    assert {r.status for r in got} == {"QUEUED", "RETRYING", "COMPLETED", "FAILED", "SKIPPED_ROBOTS"} and all((r.delay_ms is not None) == (r.status == "RETRYING") for r in got)


def test_page_states_are_held_by_buckets(spark, tmp_path):
    """Pages share rows of state and calls, ids beyond a float's exactness and a null one keep apart."""
    ids = [None, 2**62, 2**62 + 1, *range(300)]
    rows = [{"page_id": p, "attempt_id": 2 * i + n, "at": clock(1_700_000_000_000 + 60_000 * n), "outcome": "FAILED" if n == 0 else "COMPLETED"} for i, p in enumerate(ids) for n in range(2)]
    end = {"page_id": -1, "attempt_id": -1, "at": clock(1_700_000_900_000), "outcome": "COMPLETED"}
    kinds = "page_id long, attempt_id long, at timestamp, outcome string, failure_category string, retry_after_ms long"
    stream = stream_of(spark, tmp_path, [rows[::2], rows[1::2], [end]], kinds)
    running = politeness.page_transitions(stream, delay="0 seconds", buckets=8).writeStream.format("memory").queryName("bucketed").trigger(availableNow=True).start()
    try:
        assert running.awaitTermination(120)
        held = max(p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"])
    finally:
        running.stop()
    assert 0 < held <= 8
    got = sorted(((r.page_id, r.attempt, r.status) for r in spark.table("bucketed").collect()), key=repr)
    assert got == sorted([(p, n, s) for p in ids for n, s in ((1, "RETRYING"), (2, "QUEUED"), (2, "COMPLETED"))] + [(-1, 1, "COMPLETED")], key=repr)


def test_saved_pages(spark, tmp_path):
    (tmp_path / "x.html").write_text("<p>x</p>")
    (tmp_path / "y.html").write_text("<p>y</p>")
    spark.dataSource.register(paged_files.SavedPages)
    got = spark.read.format("saved_pages").option("path", str(tmp_path)).load()
    assert sorted(r.url for r in got.collect()) == ["http://localhost/x.html", "http://localhost/y.html"]


def test_api(spark, store):
    chunks, documents = store
    provider = providers.HashingEmbedding(384)
    assert api.run_search(chunks, documents, provider, "alpha", 2, "keyword").count() == 2
    for call in (lambda: api.check_search("", 5), lambda: api.check_search("x", 21), lambda: api.check_search("x", 5, "other"), lambda: api.check_question("x" * 2001)):
        with pytest.raises(api.RequestError) as caught:
            call()
        assert caught.value.status == 422
    with pytest.raises(api.RequestError):
        api.one(documents, "id", "nope")
    assert api.backfill_arguments(["--batch-size=50", "--limit", "7"]).limit == 7
    with pytest.raises(SystemExit):
        api.backfill_arguments(["--limit", "0"])


def test_cells_find_the_nearest(spark):
    """Recall against the exact search, many small parts, and rows without a usable vector."""
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(1500, 16)))]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (5003, rows[0][1]), (5004, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0")
    exact = search.nearest_batch(table.where("vec_id < 1500 OR vec_id > 5002"), queries.where("vec_id < 1500"), "embedding", "vec_id", 10)
    centres = ann.train_cells(table, "embedding", "vec_id")
    index = crawl.cut_lineage(ann.build_index(table, "embedding", "vec_id", centres, part_rows=9), "cells")
    assert index.count() == index.select("id").distinct().count() == 1502
    assert index.groupBy("cell").agg(F.max("part").alias("p")).where("p > 0").count() > 0
    few = ann.search_index(index, queries, "embedding", "vec_id", centres, block=2)
    assert ann.recall(few, exact).first()[0] >= 0.9
    all_cells = ann.search_index(index, queries, "embedding", "vec_id", centres, probes=64)
    assert ann.recall(all_cells, exact).first()[0] == 1.0
    assert [r.id for r in all_cells.where("query_id = 0").orderBy("rank").limit(3).collect()] == [0, 5003, 5004]


def test_cells_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    centres = ann.train_cells(empty, "embedding", "vec_id")
    index = ann.build_index(empty, "embedding", "vec_id", centres)
    assert index.count() == 0 and ann.search_index(index, empty, "embedding", "vec_id", centres).count() == 0


def test_cells_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    exact = search.nearest_batch(rows, rows.where("vec_id % 20 = 0"), "embedding", "vec_id", 10)
    assert ann.recall(catalog.queries()["ann_search"](spark, sf_dir), exact).first()[0] >= 0.9


def test_robots_lookups(spark):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    rows = [("a", at(h)) for h in (0, 5, 23.9, 24, 24, 47, 49, 200)] + [("b", at(3))]
    got = crawl.robots_lookups(spark.createDataFrame(rows, "origin string, requested_at timestamp_ntz")).collect()
    fetched = sorted((r.origin, (r.requested_at - start).total_seconds() / 3600, (r.fetched_at - start).total_seconds() / 3600) for r in got)
    assert fetched == [("a", 0, 0), ("a", 5, 0), ("a", 23.9, 0), ("a", 24, 24), ("a", 24, 24), ("a", 47, 24), ("a", 49, 49), ("a", 200, 200), ("b", 3, 3)]
    with pytest.raises(ValueError):
        crawl.robots_lookups(spark.createDataFrame(rows, "origin string, requested_at timestamp_ntz"), 0)
    none = crawl.robots_lookups(spark.createDataFrame([(None, at(0))], "origin string, requested_at timestamp_ntz")).collect()
    assert len(none) == 1 and none[0].is_fetch is None


class _Chat(http.server.BaseHTTPRequestHandler):
    """Answers with the number of the prompt's characters; some prompts break."""

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = asked["messages"][1]["content"]
        body = b"no json" if "broken" in prompt else json.dumps({"choices": [{"message": {"content": f" {len(prompt)} [1]. "}}]}).encode()
        self.send_response(500 if "refused" in prompt else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_answers_from_a_chat_endpoint(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        prompts = spark.createDataFrame([(1, "hello"), (2, "broken"), (3, "refused"), (4, None)], "question_id long, prompt string")
        provider = providers.ChatGeneration(f"http://127.0.0.1:{server.server_port}/v1/", "any", timeout=10)
        got = {r.question_id: (r.answer, r.error) for r in rag.answers_from(prompts, provider).collect()}
    finally:
        server.shutdown()
        server.server_close()
    assert got == {1: ("5 [1].", None), 2: (None, "INVALID_RESPONSE"), 3: (None, "UNAVAILABLE")}


def test_migrated_crawls(spark):
    none = [F.lit(None).cast("timestamp").alias(c) for c in ("created_at", "started_at", "completed_at")]
    rows = spark.createDataFrame([(1, "https://a.example.com/x", "FAILED"), (2, "nowhere", "OTHER"), (3, None, None)], "id long, url string, status string")
    moved, roots = crawl.migrate_single_page(rows.select("*", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error_message"), *none))
    assert [(r.normalized_origin, r.completed_count, r.failed_count) for r in moved.orderBy("id").collect()] == [("https://a.example.com", 0, 1), (None, 0, 0), (None, 0, 0)]
    assert [(r.crawl_id, r.status) for r in roots.orderBy("id").collect()] == [(1, "FAILED"), (2, None), (3, None)]
