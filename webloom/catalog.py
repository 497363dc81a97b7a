"""Registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import chunking, html, policy, text, urls, vectors
from webloom.operators import ann, ann_codes, crawl, inverted, rag, redirects, robots, search, versions
from webloom.plans import ingest
from webloom.sources import fetches, providers, sinks
from webloom.streaming import politeness

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# vectors

_COSINE = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


@query(f"""
SELECT e.vec_id, e.label, {_COSINE.format(a='e.embedding', b='q.embedding')} AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 20""")
def semantic_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    wanted = rows.where("vec_id = 0").select("embedding").first()[0]
    found = search.nearest(rows, "embedding", "vec_id", wanted, 20)
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""
SELECT query_id, vec_id, similarity, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_COSINE.format(a='e.embedding', b='q.embedding')} AS similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id)::INT AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 10""")
def semantic_topk_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = search.nearest_batch(rows, rows.where("vec_id % 20 = 0"), "embedding", "vec_id", 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query("""
SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'DIMENSION_MISMATCH' WHEN list_sum(list_transform(embedding, lambda x: x * x)) = 0 THEN 'ZERO_MAGNITUDE' END AS error,
       abs(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) - 1) <= 1e-5 AS is_unit, len(embedding)::INT AS dimension FROM embeddings""")
def embedding_normalize_check(spark, sf_dir):
    checked = table(spark, sf_dir, "embeddings").withColumn("n", vectors.normalized(F.col("embedding"), 64))
    return checked.select("vec_id", F.col("n.error").alias("error"), vectors.is_unit(F.col("embedding")).alias("is_unit"), F.size("embedding").alias("dimension"))


def _embedded(spark, sf_dir) -> DataFrame:
    """Vectors with the metadata of a store: every seventh is of another model, every fifth of another version, every eleventh of older content."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, "other").otherwise("hashing").alias("embedding_model"), F.when(F.col("vec_id") % 5 == 0, "0").otherwise("1").alias("embedding_version"),
        F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"), F.sha2(F.when(F.col("vec_id") % 11 == 0, F.lit("old")).otherwise(F.col("vec_id").cast("string")), 256).alias("embedded_content_hash"),
    )


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0 AND vec_id % 11 <> 0")
def current_embeddings(spark, sf_dir):
    return _embedded(spark, sf_dir).where(search.current_embedding("hashing", "1")).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 11 = 0")
def stale_embeddings(spark, sf_dir):
    return _embedded(spark, sf_dir).where(search.stale_embedding("hashing", "1")).select("vec_id")


# text

_NORMALIZED = "list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda l: trim(regexp_replace(l, '[\\t\\x0B\\f\\r \\x{A0}]+', ' ', 'g'))), lambda l: l <> '')"


@query("SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS n_bytes, strlen(text) <= 2097152 AS within_limit, left(text, 500) AS excerpt FROM documents")
def content_hash(spark, sf_dir):
    docs, t = table(spark, sf_dir, "documents"), F.col("text")
    return docs.select("doc_id", text.content_hash(t).alias("content_hash"), F.octet_length(t).cast("long").alias("n_bytes"), text.within_byte_limit(t).alias("within_limit"), text.excerpt(t).alias("excerpt"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"SELECT doc_id, array_to_string({_NORMALIZED}, chr(10)) AS content FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("content"))


@query("SELECT item_id, 'passage: ' || trim(text) AS passage, 'query: ' || trim(text) AS question FROM benchmark")
def model_inputs(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", text.passage_text(F.concat(F.lit(" passage: "), "text")).alias("passage"), text.query_text(F.col("text")).alias("question"))



_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NO_SPACE = _SPACE.replace("[", "[^", 1)


def _blank(value: str) -> str:
    """SQL for the number of white-space characters at the beginning of a value."""
    return f"length(regexp_extract({value}, '^{_SPACE}*'))"


def _last_mark(mark: str, n: int) -> str:
    """SQL for the place of the last mark of n characters that begins from ``least_`` on and before ``hard``."""
    held = f"substr(t, least_ + 1, hard - 1 + {n} - least_)"
    return f"CASE WHEN contains({held}, {mark}) THEN least_ + length({held}) - instr(reverse({held}), {mark}) + 1 - {n} END"


def _nearest(test: str) -> str:
    """SQL for the place next to ``ideal`` where a test of ``w`` holds (later ones first), as twice the distance and one more before it."""
    return f"list_min(list_transform(list_filter(range(low, high + 1), lambda x: {test}), lambda x: abs(x - ideal) * 2 + (x < ideal)::INT))"


def _chunk_sql(source: str) -> str:
    """SQL for the chunks of ``source`` (id, t), a chunk for each step of a recursion; characters count as UTF-16 units, so texts must have none of two."""
    breaks = ("substr(w, x - low + 1, 2) = chr(10) || chr(10)", "substr(w, x - low + 2, 1) = chr(10)", f"regexp_matches(substr(w, x - low + 2, 1), '{_SPACE}')")
    near = ", ".join(f"{_nearest(test)} AS k{i}" for i, test in enumerate(breaks))
    places = ", ".join(f"ideal + CASE WHEN k{i} % 2 = 1 THEN -(k{i} // 2) ELSE k{i} // 2 END" for i in range(3))
    tail = "substr(t, least_ + 1, hard - least_)"
    return f"""
WITH RECURSIVE d AS (SELECT id, coalesce(t, '') AS t, length(coalesce(t, '')) AS n FROM ({source})),
c AS (
  SELECT id, -1 AS k, NULL::BIGINT AS s, NULL::BIGINT AS e, {_blank('t')} AS cursor FROM d
  UNION ALL
  SELECT id, k + 1, s, e, CASE WHEN raw >= n THEN n WHEN following > cursor THEN following ELSE least(raw, cursor + 850) END FROM (
    SELECT *, nxt + {_blank('substr(t, nxt + 1)')} AS following FROM (
      SELECT *, coalesce({places}, ideal) AS nxt FROM (
        SELECT *, {near} FROM (
          SELECT *, substr(t, low - 1, high - low + 2) AS w FROM (
            SELECT *, greatest(s + 1, ideal - 50) AS low, least(e - 1, ideal + 50) AS high FROM (
              SELECT *, greatest(s + 1, e - 150) AS ideal FROM (
                SELECT *, cursor + {_blank('substr(t, cursor + 1, raw - cursor)')} AS s, raw - {_blank('reverse(substr(t, cursor + 1, raw - cursor))')} AS e FROM (
                  SELECT *, CASE WHEN hard = n THEN hard ELSE coalesce({_last_mark("chr(10) || chr(10)", 2)}, {_last_mark("chr(10)", 1)},
                    CASE WHEN regexp_matches({tail}, '{_SPACE}') THEN hard - 1 - length(regexp_extract(reverse({tail}), '^{_NO_SPACE}*')) END, hard) END AS raw FROM (
                    SELECT c.id, k, c.cursor, d.t, d.n, least(n, cursor + 1000) AS hard, least(least(n, cursor + 1000) - 1, cursor + 700) AS least_ FROM c JOIN d USING (id) WHERE cursor < n))))))))))
SELECT id, k AS chunk_index, substr(t, s + 1, e - s) AS content, sha256(substr(t, s + 1, e - s)) AS content_hash, s::INT AS start_offset, e::INT AS end_offset FROM c JOIN d USING (id) WHERE k >= 0 AND e > s"""


_CHUNKS = _chunk_sql("SELECT doc_id AS id, text AS t FROM documents")


@query(f"SELECT id AS doc_id, chunk_index, content, content_hash, start_offset, end_offset FROM ({_CHUNKS})")
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT id AS doc_id, count(*) AS n_chunks, max(end_offset - start_offset)::INT AS longest FROM ({_CHUNKS}) GROUP BY id")
def chunk_counts(spark, sf_dir):
    return chunk_documents(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.col("end_offset") - F.col("start_offset")).alias("longest"))


@query(f"SELECT overlap, count(*) AS n FROM (SELECT lag(end_offset) OVER (PARTITION BY id ORDER BY chunk_index) - start_offset AS overlap FROM ({_CHUNKS})) WHERE overlap IS NOT NULL GROUP BY overlap")
def chunk_overlap_audit(spark, sf_dir):
    audited = chunking.overlaps(chunk_documents(spark, sf_dir), "doc_id").where("overlap IS NOT NULL")
    return audited.groupBy("overlap").agg(F.count("*").alias("n"))


# pages

_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_ENTITIES = "regexp_replace(regexp_replace({}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query(
    f"""
WITH a AS (SELECT page_id, regexp_replace({_ARTICLE}, '[\\s]+', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, {_ENTITIES.format("regexp_replace(regexp_replace(t, '<br>|<p>|</p>|</h1>', chr(10), 'g'), '<[^>]*>', '', 'g')")} AS text FROM a)
SELECT page_id, array_to_string({_NORMALIZED}, chr(10)) AS content, sha256(array_to_string({_NORMALIZED}, chr(10))) AS content_hash FROM b"""
)
def clean_pages(spark, sf_dir):
    found = fetches.process_pages(fetches.judge(fetches.fetch_log_from_pages(table(spark, sf_dir, "pages"))))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "content", "content_hash")


@query(f"SELECT page_id, trim(regexp_replace({_ENTITIES.format('''regexp_extract(html, '(?s)<title>(.*?)</title>', 1)''')}, '\\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.clean_html(F.col("html"))["title"].alias("title"))


_ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"
_LINKS = f"""
SELECT page_id, {_ORIGIN} || replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%25', '%') AS target, i
FROM (SELECT page_id, url, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS i
      FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))"""


@query(f"SELECT page_id, target, (row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1)::INT AS position FROM ({_LINKS}) GROUP BY page_id, target")
def page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(html.discover_links(F.col("html"), F.col("url"), urls.url_origin(F.col("url")))).alias("position", "target"))


@query(f"SELECT page_id, count(DISTINCT target) AS n_links FROM ({_LINKS}) GROUP BY page_id")
def link_counts(spark, sf_dir):
    return page_links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n_links"))


@query(f"SELECT page_id, {_ORIGIN} AS origin, regexp_extract(url, '^https?://([^/?#]+)', 1) || CASE WHEN url LIKE 'https%' THEN ':443' ELSE ':80' END AS limiter_key FROM pages")
def page_origins(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_origin(F.col("url")).alias("origin"), crawl.limiter_key(F.col("url")).alias("limiter_key"))


@query(f"SELECT {_ORIGIN} AS origin, count(*) AS n_pages FROM pages GROUP BY 1")
def pages_per_origin(spark, sf_dir):
    return page_origins(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("n_pages"))


@query("""
SELECT regexp_replace(url, '#.*$', '') AS normalized_url, min(page_id) AS first_page, count(*) AS n
FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id + 2000000, url FROM pages WHERE page_id % 3 = 0) GROUP BY 1""")
def url_dedupe(spark, sf_dir):
    """Addresses of pages, some also written with another fragment, and some in capitals up to the path with the default port."""
    pages, url = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url")
    marked = pages.where("page_id % 2 = 0").select(F.col("page_id") + 1_000_000, F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#part")))
    site = F.regexp_extract(url, "^[a-z]+://[^/]+", 0)
    port = F.when(url.startswith("https"), ":443").otherwise(":80")
    loud = pages.where("page_id % 3 = 0").select(F.col("page_id") + 2_000_000, F.concat(F.upper(site), port, F.substring(url, F.length(site) + 1, F.lit(4096))))
    found = pages.union(marked).union(loud).select("page_id", urls.normalize_url(F.col("url"))["url"].alias("normalized_url"))
    return found.groupBy("normalized_url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query("""
SELECT kind, code, count(*) AS n FROM (
  SELECT kind, CASE kind WHEN 0 THEN 'EMPTY_URL' WHEN 1 THEN 'INVALID_URL' WHEN 2 THEN 'UNSUPPORTED_PROTOCOL' WHEN 3 THEN 'CREDENTIALS_NOT_ALLOWED' WHEN 4 THEN 'EXTERNAL_ORIGIN'
         WHEN 5 THEN 'DOWNLOADABLE_URL' WHEN 6 THEN 'URL_TOO_LONG' END AS code FROM (SELECT (page_id % 8)::INT AS kind FROM pages)) GROUP BY kind, code""")
def link_rejects(spark, sf_dir):
    """Every page's URL, made unfit in one of seven ways or left as it is."""
    rows = table(spark, sf_dir, "pages").withColumn("kind", (F.col("page_id") % 8).cast("int"))
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    made = (
        F.when(F.col("kind") == 0, "  ").when(F.col("kind") == 1, "http://").when(F.col("kind") == 2, F.concat(F.lit("mailto:a@"), host)).when(F.col("kind") == 3, F.concat(F.lit("http://u:p@"), host))
        .when(F.col("kind") == 4, F.lit("http://other.example/")).when(F.col("kind") == 5, F.lit("/file.PDF?x=1")).when(F.col("kind") == 6, F.concat(F.lit("/"), F.repeat(F.lit("a"), 2048))).otherwise(F.col("url"))
    )
    found = rows.select("kind", urls.normalize_url(made, F.col("url"), urls.url_origin(F.col("url")))["error_code"].alias("code"))
    return found.groupBy("kind", "code").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, 1 AS n_tables, least(len(l), 200)::INT AS n_rows, sha256(array_to_string(list_concat(['Structured tables:', 'Table 1: Orders', 'key | priority'], l[1:200]), chr(10))) AS serialized_hash
FROM (SELECT o_orderkey % 997 AS page_id, list(o_orderkey || ' | ' || o_orderpriority ORDER BY '<tr><td>' || o_orderkey || '</td><td>' || o_orderpriority) AS l FROM orders GROUP BY 1)""")
def structured_tables(spark, sf_dir):
    """Orders laid out as an HTML table for each customer segment and status, read back."""
    cells = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td>"), F.col("o_orderpriority"), F.lit("</td></tr>"))
    made = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 997).alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(cells)), "").alias("rows"))
    page = F.concat(F.lit("<body><table><caption>Orders</caption><thead><tr><th>key</th><th>priority</th></tr></thead>"), F.col("rows"), F.lit("</table></body>"))
    found = made.select("page_id", html.extract_tables(page).alias("tables"))
    return found.select("page_id", F.size("tables").alias("n_tables"), F.size(F.col("tables")[0]["rows"]).alias("n_rows"), text.content_hash(html.serialize_tables(F.col("tables"))).alias("serialized_hash"))


_PLAIN = "trim(regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g'))"


@query(f"""
SELECT doc_id, sha256(rtrim(CASE doc_id % 4 WHEN 0 THEN lang || t || source || chr(10) || doc_id WHEN 1 THEN t || source || doc_id || chr(10) || lang
       WHEN 2 THEN source || doc_id || chr(10) || t ELSE source || lang || t || chr(10) || doc_id END, chr(10))) AS content_hash,
       CASE WHEN doc_id % 4 IN (1, 2) THEN doc_id::VARCHAR END AS first_cell, CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 0 END AS n_links
FROM (SELECT doc_id, lang, source, {_PLAIN} AS t FROM documents)""")
def misnested_pages(spark, sf_dir):
    """Documents laid out as pages whose formatting crosses blocks or whose text stands between the parts of a table."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\\s+", " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("doc_id").cast("string").alias("id"), F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("t"))
    kind = F.col("doc_id") % 4
    page = (
        F.when(kind == 0, F.format_string("<b>%s<p>%s</b>%s</p>%s", "lang", "t", "source", "id")).when(kind == 1, F.format_string("<table>%s<tr>%s<td>%s</table>%s", "t", "source", "id", "lang"))
        .when(kind == 2, F.format_string("<table><b><tr><td>%s</td></tr>%s</table>%s", "id", "source", "t")).otherwise(F.format_string('<ul><li><a href="/%s">%s<a href="/x%s">%s<div>%s</ul>%s', "id", "source", "id", "lang", "t", "id"))
    )
    site = F.lit("https://site.example")
    read = rows.select("doc_id", html.read_page(page).alias("p"), html.discover_links(page, site, site).alias("links"))
    return read.select("doc_id", text.content_hash(F.col("p.content")).alias("content_hash"), F.get(F.get(F.get(F.col("p.tables"), 0)["rows"], 0), 0).alias("first_cell"), F.size("links").alias("n_links"))


# versions

_VERSIONED = "SELECT doc_id, source || ':' || lang AS url, sha256(text) AS content_hash, doc_id AS fetched_at FROM documents"


def _versioned(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(":", "source", "lang").alias("url"), text.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("fetched_at"))


@query(f"SELECT url, doc_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, doc_id DESC) AS r FROM ({_VERSIONED})) WHERE r = 1")
def latest_version(spark, sf_dir):
    return versions.latest(_versioned(spark, sf_dir)).select("url", F.col("id").alias("doc_id"), "content_hash")


@query(f"""
SELECT doc_id, lag(doc_id) OVER w AS previous_version_id, (row_number() OVER w)::INT AS version, coalesce(lag(content_hash) OVER w = content_hash, false) AS unchanged
FROM ({_VERSIONED}) WINDOW w AS (PARTITION BY url ORDER BY fetched_at, doc_id)""")
def version_chain(spark, sf_dir):
    found = versions.version_history(_versioned(spark, sf_dir), "url", "fetched_at", "id", "content_hash")
    return found.select(F.col("id").alias("doc_id"), "previous_version_id", "version", "unchanged")


#: Documents of earlier crawls: up to two a page, of its own content or other, and the page's own, which is none before it.
_STORED = """
SELECT p.page_id, p.page_id * 10 + j AS id, p.page_id + 1000000 * (j + 1) AS owner, j AS fetched_at, CASE WHEN (p.page_id + j) % 3 = 0 THEN sha256('old') ELSE sha256(html) END AS h
FROM pages p, (SELECT unnest([0, 1]) AS j) WHERE p.page_id % 4 <> j AND p.page_id % 6 <> 2
UNION ALL SELECT page_id, page_id * 10 + 5, page_id, 9, sha256(html) FROM pages WHERE page_id % 5 = 0"""


@query(f"""
WITH f AS (SELECT page_id, sha256(html) AS h, CASE WHEN page_id % 7 = 3 THEN 304 ELSE 200 END AS http_status FROM pages),
p AS (SELECT page_id, arg_max(id, fetched_at) AS old_id, arg_max(h, fetched_at) AS old_hash FROM ({_STORED}) WHERE owner <> page_id GROUP BY page_id)
SELECT f.page_id, CASE WHEN http_status = 304 AND old_id IS NULL THEN 'FAILED' WHEN old_id IS NOT NULL AND (http_status = 304 OR h = old_hash) THEN 'REUSED' ELSE 'NEW' END AS decision,
       CASE WHEN old_id IS NOT NULL AND (http_status = 304 OR h = old_hash) THEN old_id END AS reused_document_id,
       CASE WHEN NOT (http_status = 304 OR h = old_hash) THEN old_id END AS previous_version_id,
       http_status = 304 AND old_id IS NOT NULL AS not_modified
FROM f LEFT JOIN p USING (page_id)""")
def unchanged_reuse(spark, sf_dir):
    """Fetches of all pages against the documents of earlier crawls of the same addresses."""
    pages = table(spark, sf_dir, "pages")
    own = text.content_hash(F.col("html"))
    rows = pages.select("page_id", F.regexp_replace("url", "#.*$", "").alias("address"), own.alias("content_hash"), F.when(F.col("page_id") % 7 == 3, 304).otherwise(200).alias("http_status"))
    rows = rows.withColumn("normalized_url", F.concat("address", F.lit("|"), F.col("page_id").cast("string"))).drop("address")
    earlier = rows.where("page_id % 6 <> 2").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).where("page_id % 4 <> j")
    old = earlier.select(
        (F.col("page_id") * 10 + F.col("j")).alias("id"), (F.col("page_id") + 1_000_000 * (F.col("j") + 1)).alias("crawl_page_id"), "normalized_url",
        F.when((F.col("page_id") + F.col("j")) % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("content_hash")).alias("content_hash"), F.col("j").cast("long").alias("fetched_at"),
    )
    itself = rows.where("page_id % 5 = 0").select((F.col("page_id") * 10 + 5).alias("id"), F.col("page_id").alias("crawl_page_id"), "normalized_url", "content_hash", F.lit(9).cast("long").alias("fetched_at"))
    stored = old.unionByName(itself).withColumns({c: F.lit(None).cast("string") for c in ("etag", "last_modified")})
    return versions.resolve_fetch(rows, versions.previous_version(rows.select("page_id", "normalized_url"), stored))


_OLD_CHUNKS = _chunk_sql("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Old. ' || text ELSE text END AS t FROM documents")


@query(f"""
WITH n AS (SELECT id, count(*) AS n, list((chunk_index, content_hash, start_offset, end_offset) ORDER BY chunk_index) AS l FROM ({_CHUNKS}) GROUP BY id),
o AS (SELECT id, count(*) AS n, list((chunk_index, content_hash, start_offset, end_offset) ORDER BY chunk_index) AS l FROM ({_OLD_CHUNKS}) GROUP BY id)
SELECT id AS document_id, CASE WHEN same THEN old_n ELSE 0 END AS retained, CASE WHEN same THEN 0 ELSE new_n END AS created, CASE WHEN same THEN 0 ELSE old_n END AS replaced
FROM (SELECT coalesce(n.id, o.id) AS id, coalesce(n.l = o.l, false) AS same, coalesce(n.n, 0) AS new_n, coalesce(o.n, 0) AS old_n FROM n FULL JOIN o ON n.id = o.id)""")
def chunk_sync(spark, sf_dir):
    """Chunks of all documents against stored ones of which every third document's are of another text: kept, made and replaced."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "text")
    wanted = chunking.chunk_documents(docs, "document_id", "text")
    old = chunking.chunk_documents(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Old. "), "text")).otherwise(F.col("text"))), "document_id", "text")
    after, report = versions.synchronize_chunks(old, wanted)
    return report.select(F.col("document_id").cast("long").alias("document_id"), "retained", "created", "replaced")


# crawls

_STATUS = "CASE event_type WHEN 'view' THEN 'COMPLETED' WHEN 'click' THEN 'SKIPPED' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SKIPPED_ROBOTS' ELSE 'COMPLETED' END"


def _event_pages(spark, sf_dir) -> DataFrame:
    kinds = {"view": "COMPLETED", "click": "SKIPPED", "error": "FAILED", "purchase": "SKIPPED_ROBOTS"}
    status = F.lit("COMPLETED")
    for kind, name in kinds.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("page_id"), F.col("user_id").alias("crawl_id"), F.when(F.col("event_id") % 401 == 0, "QUEUED").otherwise(status).alias("status"), F.col("ts").alias("created_at"))


_EVENT_PAGES = f"SELECT event_id AS page_id, user_id AS crawl_id, CASE WHEN event_id % 401 = 0 THEN 'QUEUED' ELSE {_STATUS} END AS status, ts AS created_at FROM events"


@query(f"SELECT crawl_id, status, count(*) AS n FROM ({_EVENT_PAGES}) GROUP BY ALL")
def status_counts(spark, sf_dir):
    return crawl.status_counts(_event_pages(spark, sf_dir))


@query(f"""
SELECT *, CASE WHEN active_count = 0 THEN 'COMPLETED' ELSE 'PROCESSING' END AS status, CASE WHEN active_count = 0 THEN TIMESTAMP '2024-02-01' END AS completed_at, active_count = 0 AND failed_count > 0 AS completed_with_failures
FROM (SELECT crawl_id, count(*) AS discovered_count, count(*) FILTER (status = 'COMPLETED') AS completed_count, count(*) FILTER (status IN ('SKIPPED', 'SKIPPED_ROBOTS')) AS skipped_count,
             count(*) FILTER (status = 'FAILED') AS failed_count, count(*) FILTER (status = 'QUEUED') AS active_count FROM ({_EVENT_PAGES}) GROUP BY crawl_id)""")
def crawl_state_fold(spark, sf_dir):
    return crawl.fold_state(_event_pages(spark, sf_dir), F.lit("2024-02-01").cast("timestamp_ntz"))


@query(f"SELECT page_id, crawl_id, status FROM ({_EVENT_PAGES}) ORDER BY created_at, page_id LIMIT 25 OFFSET 50")
def pages_paginated(spark, sf_dir):
    return crawl.paginate(_event_pages(spark, sf_dir), ["created_at", "page_id"], 3, 25).select("page_id", "crawl_id", "status")


@query("SELECT count(*) AS total, ceil(count(*) / 25)::BIGINT AS total_pages FROM events")
def pages_total(spark, sf_dir):
    return crawl.page_count(table(spark, sf_dir, "events"), 25)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25")
def dead_letters_paginated(spark, sf_dir):
    return crawl.paginate(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 2, 25)


_STATUSES = "[429, 502, 503, 504, 404, 500, 408, 304, 200, 204]"
_FAILURES = f"SELECT event_id, user_id, {_STATUSES}[event_id % 10 + 1] AS http_status, CASE WHEN event_id % 3 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type, event_id % 5 + 1 AS attempt FROM events"
_CATEGORY = """CASE WHEN http_status = 304 THEN NULL WHEN http_status IN (429, 502, 503, 504) THEN 'HTTP_' || http_status WHEN http_status NOT BETWEEN 200 AND 299 THEN 'HTTP_PERMANENT'
 WHEN content_type NOT LIKE 'text/html%' THEN 'UNSUPPORTED_CONTENT_TYPE' END"""


def _failures(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    statuses = F.array(*[F.lit(x) for x in (429, 502, 503, 504, 404, 500, 408, 304, 200, 204)])
    return rows.select(
        "event_id", "user_id", F.element_at(statuses, (F.col("event_id") % 10 + 1).cast("int")).alias("http_status"), F.when(F.col("event_id") % 3 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), (F.col("event_id") % 5 + 1).alias("attempt"),
    ).withColumn("category", policy.classify_http(F.col("http_status"), F.col("content_type"), F.lit(10)))


@query(f"SELECT event_id, {_CATEGORY} AS category, ({_CATEGORY} IS NULL OR {_CATEGORY} NOT IN ('HTTP_PERMANENT', 'UNSUPPORTED_CONTENT_TYPE')) AS retryable FROM ({_FAILURES})")
def failure_classification(spark, sf_dir):
    return _failures(spark, sf_dir).select("event_id", "category", policy.is_retryable(F.col("category")).alias("retryable"))


@query(f"""
SELECT event_id, delay_ms, coalesce(CASE WHEN http_status = 429 THEN CASE event_id % 3 WHEN 0 THEN 1000 * (event_id % 90) WHEN 1 THEN (epoch_us(date_trunc('second', ts + INTERVAL 37 SECOND)) - epoch_us(date_trunc('millisecond', ts))) // 1000 END END, delay_ms)::BIGINT AS with_header
FROM (SELECT event_id, http_status, least(60000, 1000 * power(2, attempt - 1))::BIGINT AS delay_ms FROM ({_FAILURES})) JOIN events USING (event_id)""")
def backoff_schedule(spark, sf_dir):
    """Delays with Retry-After headers of seconds, of dates, and of neither."""
    rows = _failures(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("now")), "event_id")
    date = F.concat(F.date_format(F.col("now") + F.expr("INTERVAL 37 SECONDS"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    header = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("string")).when(F.col("event_id") % 3 == 1, date).otherwise("soon")
    asked = policy.retry_after_ms(F.when(F.col("http_status") == 429, header), F.col("now"))
    return rows.select("event_id", policy.backoff_ms(F.col("attempt")).alias("delay_ms"), policy.backoff_ms(F.col("attempt"), asked).alias("with_header"))


@query(f"""
SELECT crawl_page_id, failure_category, attempt_count FROM (
  SELECT user_id AS crawl_page_id, {_CATEGORY} AS failure_category, attempt AS attempt_count, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r
  FROM ({_FAILURES}) WHERE {_CATEGORY} IS NOT NULL AND (({_CATEGORY}) IN ('HTTP_PERMANENT', 'UNSUPPORTED_CONTENT_TYPE') OR attempt >= 3)) WHERE r = 1""")
def dead_letters(spark, sf_dir):
    ended = _failures(spark, sf_dir).where(F.col("category").isNotNull() & policy.is_terminal(policy.is_retryable(F.col("category")), F.col("attempt") - 1))
    pages = ended.select(F.lit(0).alias("crawl_id"), F.col("user_id").alias("page_id"), F.lit("http://example.com/").alias("url"), F.col("category").alias("failure_category"), F.lit("failed").alias("error"), F.col("attempt").alias("attempts"), F.col("event_id").alias("failed_at"))
    return crawl.dead_letters(pages).select("crawl_page_id", "failure_category", "attempt_count")


_EDGES = """
SELECT unnest(['s' || l_suppkey, 'p' || l_partkey]) AS source, unnest(['p' || l_partkey, 's' || l_suppkey]) AS target, min(l_orderkey * 8 + l_linenumber) AS position
FROM lineitem GROUP BY l_suppkey, l_partkey"""


def _links(spark, sf_dir) -> DataFrame:
    """Links of every supplier's page to the parts it delivers, and back."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"))
    supplier, part = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    ends = F.array(F.struct(supplier.alias("source"), part.alias("target")), F.struct(part.alias("source"), supplier.alias("target")))
    return pairs.select(F.explode(ends).alias("e"), "position").select("e.source", "e.target", "position")


#: Seeds, pages and depths of crawls over the links of suppliers and parts: one cut short on each level, one of a depth of three.
_CRAWLS = [("a", "s1", 40, 2), ("b", "s7", 150, 2), ("c", "s9", 10, 0), ("d", "s3", 1200, 3), ("e", "p5", 60, 3)]


def _crawl_sql(levels: int = 3) -> str:
    """SQL for a crawl level by level."""
    parts = [f"WITH e AS ({_EDGES}), c(crawl_id, seed, cap, deep) AS (VALUES {', '.join(map(str, _CRAWLS))})", "l0 AS (SELECT crawl_id, seed AS url, 0 AS depth, NULL::VARCHAR AS parent, 0::BIGINT AS position FROM c)"]
    for n in range(1, levels + 1):
        before = " UNION ALL ".join(f"FROM l{i}" for i in range(n))
        parts.append(f"""k{n} AS (SELECT crawl_id, target AS url, min({{'a': l{n - 1}.position, 'b': e.position, 'p': l{n - 1}.url}}) AS o FROM l{n - 1} JOIN c USING (crawl_id) JOIN e ON source = url WHERE deep >= {n} GROUP BY crawl_id, target),
n{n} AS (SELECT k{n}.*, row_number() OVER (PARTITION BY crawl_id ORDER BY o.a, o.b, url) AS r FROM k{n} WHERE NOT EXISTS (SELECT 1 FROM ({before}) x WHERE x.crawl_id = k{n}.crawl_id AND x.url = k{n}.url)),
u{n} AS (SELECT crawl_id, count(*) AS used, max(position) AS last FROM ({before}) GROUP BY crawl_id),
l{n} AS (SELECT n{n}.crawl_id, url, {n} AS depth, o.p AS parent, last + r AS position FROM n{n} JOIN c USING (crawl_id) JOIN u{n} USING (crawl_id) WHERE r <= cap - used)""")
    return ",\n".join(parts) + f"\nSELECT crawl_id, url AS normalized_url, depth, parent AS parent_url, position FROM ({' UNION ALL '.join(f'FROM l{i}' for i in range(levels + 1))})"


@query(_crawl_sql())
def bfs_crawl(spark, sf_dir):
    crawls = spark.createDataFrame(_CRAWLS, "crawl_id string, seed_url string, max_pages int, max_depth int")
    return crawl.traverse(crawls, _links(spark, sf_dir))


@query("""
WITH e AS (SELECT l_suppkey AS parent, 's' || l_suppkey AS source, 'p' || l_partkey AS target, min(l_orderkey * 8 + l_linenumber) AS position FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT source AS url FROM e),
k AS (SELECT target AS url, min({'a': parent, 'b': position, 'p': source}) AS o FROM e GROUP BY target),
n AS (SELECT *, row_number() OVER (ORDER BY o.a, o.b, url) AS r FROM k WHERE url NOT IN (SELECT url FROM p))
SELECT 'a' AS crawl_id, url AS normalized_url, 1 AS depth, o.p AS parent_page_id FROM n WHERE r <= 1500 - (SELECT count(*) FROM p)""")
def frontier_reserve(spark, sf_dir):
    """Links from every supplier's page to the parts it delivers, as many as the crawl has room for."""
    source, target = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem")
    links = rows.groupBy(F.col("l_suppkey").alias("parent"), source.alias("source"), target.alias("target")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"))
    pages = links.select(F.lit("a").alias("crawl_id"), F.col("source").alias("normalized_url")).distinct()
    candidates = links.select(F.lit("a").alias("crawl_id"), F.col("parent").cast("long").alias("parent_order"), "position", F.col("source").alias("parent_page_id"), F.lit(0).alias("parent_depth"), F.col("target").alias("normalized_url"))
    limits = spark.createDataFrame([("a", 1500, 2)], "crawl_id string, max_pages int, max_depth int")
    return crawl.reserve(candidates, pages, limits).select("crawl_id", "normalized_url", "depth", "parent_page_id")


_ARRIVALS = "SELECT event_id AS request_id, (user_id % 40)::VARCHAR AS host_port, (event_id * 977) % 100000 AS arrival_ms FROM events"


@query(f"""
WITH r AS (SELECT *, 1000 * (row_number() OVER w - 1) AS b FROM ({_ARRIVALS}) WINDOW w AS (PARTITION BY host_port ORDER BY arrival_ms, request_id))
SELECT request_id, host_port, arrival_ms, (max(arrival_ms - b) OVER (PARTITION BY host_port ORDER BY arrival_ms, request_id) + b)::BIGINT AS start_ms FROM r""")
def limiter_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 40).cast("string").alias("host_port"), ((F.col("event_id") * 977) % 100000).alias("arrival_ms"))
    return crawl.spacing(rows).select("request_id", "host_port", "arrival_ms", F.col("start_ms").cast("long").alias("start_ms"))


@query("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n_requests, greatest(count(*) - 2, 0) AS n_rejected FROM events GROUP BY ALL")
def api_rate_window(spark, sf_dir):
    return politeness.rate_windows(table(spark, sf_dir, "events"), "ts", "user_id", 2, "6 hours").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_IP = "(event_id * 7919 % 256)::VARCHAR || '.' || (event_id * 31 % 256) || '.' || (event_id * 17 % 256) || '.' || (event_id % 256)"
_N = "(event_id * 7919 % 256) * 16777216 + (event_id * 31 % 256) * 65536 + (event_id * 17 % 256) * 256 + event_id % 256"


@query(f"""
SELECT event_id, address, (n >> 24) IN (0, 10, 127) OR (n >> 22) = 401 OR (n >> 16) IN (43518, 49320) OR (n >> 20) = 2753 OR (n >> 8) IN (12582912, 12582914, 12977764, 13303921)
       OR (n >> 17) = 25353 OR (n >> 29) = 7 AS unsafe FROM (SELECT event_id, {_IP} AS address, ({_N})::BIGINT AS n FROM events)""")
def ip_safety(spark, sf_dir):
    parts = [F.col("event_id") * 7919 % 256, F.col("event_id") * 31 % 256, F.col("event_id") * 17 % 256, F.col("event_id") % 256]
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws(".", *[p.cast("string") for p in parts]).alias("address"))
    return rows.withColumn("unsafe", policy.unsafe_v4(F.col("address")))


@query("SELECT page_id, NOT (page_id % 3 = 0 AND regexp_matches(url, '^https?://[^/]+/en/')) AS allowed, CASE WHEN page_id % 3 = 0 THEN 2500 END::BIGINT AS crawl_delay_ms FROM pages")
def robots_decisions(spark, sf_dir):
    body = F.when(F.col("page_id") % 3 == 0, "User-agent: *\nDisallow: /en/\nCrawl-delay: 2.5\n").otherwise("")
    status = F.when(F.col("page_id") % 3 == 1, 404).otherwise(200)
    found = table(spark, sf_dir, "pages").select("page_id", policy.robots(body, status, F.col("url"), "webloom").alias("r"))
    return found.select("page_id", "r.allowed", "r.crawl_delay_ms")


@query("""
WITH RECURSIVE r AS (SELECT url AS from_url, lead(url) OVER (ORDER BY page_id) AS to_url, page_id FROM (SELECT DISTINCT ON (url) page_id, url FROM pages ORDER BY url, page_id)),
e AS (SELECT from_url, to_url FROM r WHERE page_id % 9 <> 0 AND to_url IS NOT NULL),
w AS (SELECT url AS request_url, url AS final_url, 0 AS n_hops FROM pages UNION ALL SELECT request_url, to_url, n_hops + 1 FROM w JOIN e ON final_url = from_url WHERE n_hops < 5)
SELECT request_url, arg_max(final_url, n_hops) AS final_url, max(n_hops)::INT AS n_hops FROM w GROUP BY request_url""")
def redirect_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return _redirected(pages, pages)


def _redirected(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Where requests end if each URL of ``pages`` but every ninth redirects to the next by page_id."""
    from pyspark.sql.window import Window

    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    chained = first.withColumn("to_url", F.lead("url").over(Window.partitionBy(F.lit(1)).orderBy("page_id")))  # test data: one chain of all URLs
    edges = chained.where("page_id % 9 <> 0 AND to_url IS NOT NULL").select(F.col("url").alias("from_url"), "to_url")
    found = crawl.follow_redirects(requests, edges)
    return found.select("request_url", "final_url", "n_hops").distinct()


# search and answers


def _chunk_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents and one chunk of each, the whole text, so that SQL can tell the relevance."""
    docs = table(spark, sf_dir, "documents")
    documents = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("https://example.com/"), "source").alias("url"), F.concat_ws(" ", "lang", "source").alias("title"))
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    return chunks, documents




def _tf(word: str) -> str:
    """SQL for how often a word stands in a text."""
    return f"len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x = '{word}'))"




@query(f"""
SELECT doc_id AS chunk_id, left(text, 500) AS excerpt, round({_tf('the')} * CAST(0.4 AS DOUBLE), 6) AS relevance FROM documents WHERE {_tf('the')} > 0
ORDER BY relevance DESC, chunk_id LIMIT 20""")
def keyword_single_term(spark, sf_dir):
    chunks, documents = _chunk_tables(spark, sf_dir)
    return search.keyword_search(chunks, documents, "The", 20).select("chunk_id", "excerpt", F.round("relevance", 6).alias("relevance"))


@query(f"SELECT count(*) AS n FROM documents WHERE {_tf('the')} > 0 AND {_tf('license')} > 0")
def keyword_and_match(spark, sf_dir):
    chunks, documents = _chunk_tables(spark, sf_dir)
    return search.keyword_matches(chunks, documents, "license THE").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)),
k AS (SELECT doc_id, p, word, lag(p) OVER x AS q, lag(word) OVER x AS before FROM o WHERE word IN ('the', 'license') WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id AS chunk_id, sum(CAST(0.4 AS DOUBLE) / (p - q)) FILTER (word <> before) AS relevance FROM k GROUP BY doc_id HAVING count(DISTINCT word) = 2)
SELECT chunk_id, round(relevance, 9) AS relevance FROM r ORDER BY r.relevance DESC, chunk_id LIMIT 20""")
def keyword_cover_density(spark, sf_dir):
    chunks, documents = _chunk_tables(spark, sf_dir)
    return search.keyword_search(chunks, documents, "the license", 20).select("chunk_id", F.round("relevance", 9).alias("relevance"))


def _index(chunks: DataFrame, documents: DataFrame) -> inverted.Index:
    """An inverted table of the chunks, beside the intermediate tables."""
    path = crawl.new_path(chunks.sparkSession, "inverted")
    inverted.build(chunks, documents, path, inverted.IndexConfig(part_rows=100_000))
    return inverted.Index(chunks.sparkSession, path)


@query(_SQL["keyword_cover_density"])
def keyword_indexed(spark, sf_dir):
    """The search of ``keyword_cover_density``, answered by the postings of its two words."""
    chunks, documents = _chunk_tables(spark, sf_dir)
    return _index(chunks, documents).search(chunks, documents, "the license", 20).select("chunk_id", F.round("relevance", 9).alias("relevance"))


@query("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)
SELECT page_id AS chunk_id, host, CAST(0.2 AS DOUBLE) AS relevance FROM p WHERE host = (SELECT host FROM p ORDER BY page_id LIMIT 1)""")
def keyword_host(spark, sf_dir):
    """Pages of the first page's host, found by the host as a word of their URLs."""
    pages = table(spark, sf_dir, "pages")
    documents = pages.select(F.col("page_id").alias("id"), "url", F.lit(None).cast("string").alias("title"))
    chunks = pages.select(F.col("page_id").alias("id"), F.col("page_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("a page").alias("content"))
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    wanted = pages.orderBy("page_id").select(host).first()[0]
    return _index(chunks, documents).matches(wanted).select("chunk_id", F.lit(wanted).alias("host"), "relevance")


def _ranked_hits(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    score = 1 - (F.col("turn") % 7) / 20
    return rows.select(
        F.col("conv_id").alias("question_id"), F.col("turn").cast("int").alias("rank"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("chunk_index"),
        F.concat(F.lit("https://example.com/"), F.col("conv_id").cast("string")).alias("url"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("title"), text.excerpt(F.col("text")).alias("excerpt"), score.alias("similarity"),
    )



def _sources_sql(least: float, per_source: int, in_all: int) -> str:
    """SQL for the sources that fit, hit after hit: (id, n_sources, context) in ``done``."""
    strip = lambda x: f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"
    block = lambda x: f"'SOURCE [' || (n + 1) || ']' || chr(10) || 'Title: ' || coalesce(title, 'Untitled') || chr(10) || 'URL: https://example.com/' || id || chr(10) || 'Chunk: ' || turn || chr(10) || 'Content:' || chr(10) || {x}"
    return f"""
WITH RECURSIVE hit AS (
  SELECT conv_id AS id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || '-' || turn, title NULLS FIRST, excerpt) AS r, title, excerpt FROM (
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN nullif(left({strip('role')}, 200), '') END AS title, left({strip('left(text, 500)')}, {per_source}) AS excerpt
    FROM conversations WHERE 1 - (turn % 7) / 20.0 >= {least}) WHERE excerpt <> ''),
w AS (
  SELECT DISTINCT conv_id AS id, 0 AS r, 0 AS used, false AS done, 0 AS n, '' AS context FROM conversations
  UNION ALL
  SELECT id, r, CASE WHEN stop THEN used ELSE used + gap + length({block('cut')}) END, stop, CASE WHEN stop THEN n ELSE n + 1 END, CASE WHEN stop THEN context WHEN n = 0 THEN {block('cut')} ELSE context || chr(10) || chr(10) || {block('cut')} END
  FROM (SELECT *, done OR {in_all} - used <= 0 OR cut = '' AS stop FROM (
    SELECT *, CASE WHEN size > {in_all} - used THEN {strip(f'left(excerpt, greatest(0, length(excerpt) - (size - ({in_all} - used))))')} ELSE excerpt END AS cut FROM (
      SELECT *, gap + length({block('excerpt')}) AS size FROM (
        SELECT w.id, w.used, w.done, w.n, w.context, h.r, h.turn, h.title, h.excerpt, CASE WHEN w.n = 0 THEN 0 ELSE 2 END AS gap FROM w JOIN hit h ON h.id = w.id AND h.r = w.r + 1))))),
ended AS (SELECT id, arg_max(n, r) AS n_sources, arg_max(context, r) AS context FROM w GROUP BY id)"""


@query(f"{_sources_sql(0.75, 400, 1500)} SELECT id AS question_id, n_sources, length(context)::INT AS context_length, sha256(context) AS context_hash FROM ended")
def bounded_context(spark, sf_dir):
    hits = _ranked_hits(spark, sf_dir)
    grouped = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in hits.columns if c != "question_id"]))).alias("h"))
    found = grouped.withColumn("s", rag.bounded_sources(F.col("h"), 0.75, 400, 1500))
    return found.select("question_id", F.size("s").alias("n_sources"), F.length(rag.context(F.col("s"))).alias("context_length"), text.content_hash(rag.context(F.col("s"))).alias("context_hash"))


@query("""
WITH m AS (SELECT conv_id, turn, 1 + turn % 4 AS n_sources, list_transform([(turn % 5 + 1)::VARCHAR, '0' || length(text) % 7, (turn % 5 + 1)::VARCHAR, '99999999999999999999', '2'], lambda x: TRY_CAST(x AS BIGINT)) AS numbers FROM conversations),
k AS (SELECT *, list_filter(numbers, lambda x: x BETWEEN 1 AND n_sources) AS good FROM m)
SELECT conv_id, turn, len(numbers)::INT AS n_markers, array_to_string(list_transform(list_filter(range(1, len(good) + 1), lambda i: list_position(good, good[i]) = i), lambda i: good[i]), ',') AS citations,
  trim(regexp_replace(concat('See', array_to_string(list_transform(numbers, lambda x: CASE WHEN x BETWEEN 1 AND n_sources THEN concat(' [', x, ']') ELSE '' END), ''), '.'), ' +\\.', '.')) AS answer FROM k""")
def citation_validate(spark, sf_dir):
    """Answers with markers of a turn's number and its text's length: good, repeated, padded, beyond the sources and beyond all numbers; bad ones go."""
    rows = table(spark, sf_dir, "conversations")
    own = (F.col("turn") % 5 + 1).cast("string")
    numbers = F.array(own, F.concat(F.lit("0"), (F.length("text") % 7).cast("string")), own, F.lit("99999999999999999999"), F.lit("2"))
    answer = F.concat(F.lit("See"), F.array_join(F.transform(numbers, lambda x: F.concat(F.lit("  ["), x, F.lit("]"))), ""), F.lit(" ."))
    found = rows.select("conv_id", "turn", F.size(numbers).alias("n_markers"), rag.validated(answer, 1 + F.col("turn") % 4).alias("v"))
    return found.select("conv_id", "turn", "n_markers", F.array_join(F.col("v.citations").cast("array<string>"), ",").alias("citations"), F.col("v.answer").alias("answer"))


@query(f"""
{_sources_sql(0.75, 1500, 8000)}, a AS (SELECT *, CASE WHEN n_sources = 0 THEN 200 WHEN id % 7 = 0 THEN 504 WHEN id % 5 = 0 THEN 502 ELSE 200 END AS status FROM ended)
SELECT id AS question_id, status, n_sources AS result_count,
  CASE WHEN n_sources = 0 THEN '{rag.INSUFFICIENT}' WHEN status = 200 THEN CASE WHEN n_sources < 9 THEN 'So it is [1].' ELSE 'So it is [1][9].' END END AS answer,
  CASE WHEN n_sources = 0 OR status <> 200 THEN 0 WHEN n_sources < 9 THEN 1 ELSE 2 END AS n_citations FROM a""")
def ask_answers(spark, sf_dir):
    hits = _ranked_hits(spark, sf_dir)
    questions = hits.select("question_id").distinct().withColumn("question", F.concat(F.lit("What about "), F.col("question_id").cast("string"), F.lit("?")))
    answers = questions.select("question_id", F.when(F.col("question_id") % 5 != 0, "So it is [1][9].").otherwise("No citation").alias("answer"), F.when(F.col("question_id") % 7 == 0, "TIMEOUT").alias("error"))
    found = rag.ask(questions, hits, answers)
    return found.select("question_id", "status", "answer", F.size("citations").alias("n_citations"), "result_count")


# whole-store reports


@query("SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM labels) AS labels")
def smoke_counts(spark, sf_dir):
    return sinks.counts(**{n: table(spark, sf_dir, n) for n in ("pages", "documents", "embeddings", "labels")})


@query("""
SELECT round_, discovered, completed, round(seconds, 6) AS seconds, round(completed / seconds, 9) AS pages_per_second FROM (
  SELECT (user_id % 3)::INT AS round_, count(*) AS discovered, count(*) FILTER (event_type <> 'error') AS completed, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds FROM events GROUP BY 1)""")
def run_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    crawls = rows.groupBy("user_id").agg(F.count("*").alias("discovered_count"), F.count_if(F.col("event_type") != "error").alias("completed_count"), F.lit(0).alias("skipped_count"), F.count_if(F.col("event_type") == "error").alias("failed_count"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    found = crawl.run_summary(crawls.withColumn("round", (F.col("user_id") % 3).cast("int")))
    return found.select(F.col("round").alias("round_"), "discovered", "completed", F.round("seconds", 6).alias("seconds"), F.round("pages_per_second", 9).alias("pages_per_second"))


@query("SELECT doc_id, 'chunk_index' AS rule FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT doc_id, 'offsets' FROM documents WHERE doc_id % 75 = 0 UNION ALL SELECT doc_id, 'embedding' FROM documents WHERE doc_id % 60 = 0")
def integrity_violations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    none = {c: F.lit(None).cast("string") for c in ("embedding", "embedding_version", "embedded_content_hash", "embedded_at")}
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 50 == 0, -1).otherwise(0).alias("chunk_index"), F.lit(0).alias("start_offset"), F.when(F.col("doc_id") % 75 == 0, 0).otherwise(10).alias("end_offset"), F.lit("x").alias("content"), F.when(F.col("doc_id") % 60 == 0, "m").alias("embedding_model")).withColumns(none)
    return schemas.violations(rows, "chunks").select("doc_id", F.explode("broken_rules").alias("rule"))


@query("SELECT l.doc_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0) d ON l.doc_id = d.doc_id")
def orphaned_labels(spark, sf_dir):
    return schemas.orphans(table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents").where("doc_id % 9 <> 0"), "doc_id").select("doc_id")


@query(f"""
WITH p AS ({_SQL['clean_pages']}) SELECT sha256(page_id || '|' || p.content_hash) AS document_id, chunk_index, start_offset, end_offset, c.content_hash
FROM ({_chunk_sql(f"SELECT page_id AS id, content AS t FROM ({_SQL['clean_pages']})")}) c JOIN p ON p.page_id = c.id""")
def ingest_chunks(spark, sf_dir):
    """Pages to documents to chunks, the whole plan."""
    documents = ingest.documents_from_fetches(fetches.fetch_log_from_pages(table(spark, sf_dir, "pages")))
    return ingest.chunks_from_documents(documents).select("document_id", "chunk_index", "start_offset", "end_offset", "content_hash")


# more of the store's operations


def _search_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    chunks = _embedded(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("Vector "), F.col("vec_id").cast("string")).alias("content"), "embedding", "embedding_model", "embedding_version", "content_hash", "embedded_content_hash")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"))
    return chunks, documents


@query(f"""
SELECT e.vec_id AS chunk_id, e.vec_id AS document_id, 'https://example.com/' || e.vec_id AS url, d.source AS title, 0 AS chunk_index, 'Vector ' || e.vec_id AS excerpt, {_COSINE.format(a='e.embedding', b='q.embedding')} AS similarity
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 3) q
WHERE e.vec_id % 7 <> 0 AND e.vec_id % 5 <> 0 AND e.vec_id % 11 <> 0 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, chunk_id LIMIT 15""")
def semantic_search(spark, sf_dir):
    chunks, documents = _search_tables(spark, sf_dir)
    wanted = table(spark, sf_dir, "embeddings").where("vec_id = 3").select("embedding").first()[0]
    found = search.search(chunks, documents, "semantic", query=wanted, model="hashing", version="1", limit=15)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""
SELECT count(*) AS inspected, count(*) FILTER (stale) AS embedded, count(*) FILTER (NOT stale) AS skipped, 0::BIGINT AS failed, ceil(count(*) FILTER (stale) / 16.0)::BIGINT AS batches
FROM (SELECT vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 11 = 0 AS stale FROM embeddings)""")
def embedding_backfill(spark, sf_dir):
    chunks = _search_tables(spark, sf_dir)[0].withColumn("id", F.col("id").cast("string"))
    provider = providers.HashingEmbedding(16)
    made = versions.embed_stale(chunks, provider.embed, provider.model, provider.version, provider.dimension)
    return versions.embedding_summary(chunks, made, provider.model, provider.version)


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN stale THEN 4 ELSE len(embedding) END::INT AS dimension, 'hashing' AS embedding_model, true AS current FROM (SELECT *, vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 11 = 0 AS stale FROM embeddings)")
def embedding_update(spark, sf_dir):
    """Stale vectors made anew and stored where the content is still the same."""
    chunks = _search_tables(spark, sf_dir)[0].withColumn("id", F.col("id").cast("string")).withColumn("embedded_at", F.lit(None).cast("timestamp"))
    provider = providers.HashingEmbedding(4)
    made = versions.embed_stale(chunks, provider.embed, provider.model, provider.version, provider.dimension)
    after = versions.apply_embeddings(chunks, made, provider.model, provider.version, F.current_timestamp())
    return after.select("id", F.size("embedding").alias("dimension"), "embedding_model", search.current_embedding(provider.model, provider.version).alias("current"))


@query(f"SELECT count(*) AS processed, sum(created)::BIGINT AS created, sum(retained)::BIGINT AS retained, sum(replaced)::BIGINT AS replaced FROM ({_SQL['chunk_sync']})")
def chunk_backfill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "doc_id")
    old = chunking.chunk_documents(docs.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Old. "), "content")).otherwise(F.col("content"))), "id", "content")
    stored = old.withColumnRenamed("id", "document_id").withColumn("id", F.concat_ws("-", "document_id", "chunk_index"))
    return versions.backfill_chunks(docs.drop("doc_id"), stored)[1]


_ATTEMPTS = """
SELECT event_id // 2 AS page_id, row_number() OVER (PARTITION BY event_id // 2 ORDER BY ts, event_id) AS n,
  CASE WHEN event_type = 'purchase' AND value > 50 THEN 'COMPLETED' WHEN event_type = 'purchase' THEN 'REUSED' WHEN event_type = 'signup' THEN 'SKIPPED_ROBOTS' ELSE 'FAILED' END AS outcome,
  CASE event_type WHEN 'click' THEN 'HTTP_429' WHEN 'error' THEN 'HTTP_PERMANENT' ELSE 'NETWORK_TIMEOUT' END AS category FROM events"""


@query(f"""
WITH t AS (SELECT *, outcome <> 'FAILED' OR category = 'HTTP_PERMANENT' OR n >= 3 AS ended FROM ({_ATTEMPTS})),
l AS (SELECT page_id, coalesce(min(n) FILTER (ended), max(n)) AS n FROM t GROUP BY page_id)
SELECT page_id, CASE WHEN outcome = 'REUSED' THEN 'COMPLETED' WHEN outcome <> 'FAILED' THEN outcome WHEN ended THEN 'FAILED' ELSE 'RETRYING' END AS status, n::INT AS attempts,
  CASE WHEN outcome = 'FAILED' THEN category END AS failure_category, CASE WHEN outcome = 'FAILED' AND NOT ended THEN 1000 * 2 ** (n - 1) END::BIGINT AS delay_ms FROM l JOIN t USING (page_id, n)""")
def page_states(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "events")
    rows = rows.withColumn("page_id", F.floor(F.col("event_id") / 2))
    kind, order = F.col("event_type"), Window.partitionBy("page_id").orderBy("ts", "event_id")
    outcome = F.when((kind == "purchase") & (F.col("value") > 50), "COMPLETED").when(kind == "purchase", "REUSED").when(kind == "signup", "SKIPPED_ROBOTS").otherwise("FAILED")
    category = F.when(kind == "click", "HTTP_429").when(kind == "error", "HTTP_PERMANENT").otherwise("NETWORK_TIMEOUT")
    attempts = rows.select("page_id", F.row_number().over(order).alias("attempt"), outcome.alias("outcome"), category.alias("failure_category"), F.lit("failed").alias("error"), F.lit(None).cast("long").alias("retry_after_ms"))
    return crawl.page_outcomes(attempts).select("page_id", "status", "attempts", "failure_category", F.col("delay_ms").cast("long").alias("delay_ms"))


_TREE = "SELECT event_id AS id, event_id // 3 AS parent, user_id AS crawl_id, ts, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'click' THEN 'DISCOVERED' ELSE 'COMPLETED' END AS status FROM events"


def _page_tree(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "DISCOVERED").otherwise("COMPLETED")
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 3).alias("parent_page_id"), F.col("user_id").alias("crawl_id"), F.col("ts").alias("created_at"), status.alias("status"), (F.col("event_type") != "view").cast("int").alias("depth"))


@query(f"SELECT a.id, CASE WHEN b.status = 'FAILED' AND a.status = 'DISCOVERED' THEN 'SKIPPED' ELSE a.status END AS status FROM ({_TREE}) a LEFT JOIN ({_TREE}) b ON a.parent = b.id")
def failure_cascade(spark, sf_dir):
    return crawl.skip_children(_page_tree(spark, sf_dir)).select("id", "status")


@query("SELECT user_id AS crawl_id, arg_min(event_id, (ts, event_id)) AS id, min(ts) AS created_at FROM events WHERE event_type = 'view' GROUP BY user_id")
def root_pages(spark, sf_dir):
    return crawl.root_pages(_page_tree(spark, sf_dir)).select("crawl_id", "id", "created_at")


@query("""
SELECT e.event_id AS id, coalesce('d' || d.doc_id, CASE WHEN e.value > 90 THEN 'reused-' || e.user_id END) AS document_id, CASE WHEN e.event_type = 'error' THEN 'HTTP_429' END AS dead_letter_category
FROM events e LEFT JOIN documents d ON d.doc_id * 2 = e.event_id""")
def pages_with_documents(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pages = events.select(F.col("event_id").alias("id"), F.when(F.col("value") > 90, F.concat(F.lit("reused-"), F.col("user_id").cast("string"))).alias("reused_document_id"))
    documents = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("crawl_page_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    letters = events.where("event_type = 'error'").select(F.col("event_id").alias("crawl_page_id"), F.lit("HTTP_429").alias("failure_category"))
    return crawl.with_related(pages, documents, letters).select("id", "document_id", "dead_letter_category")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id > 40 ORDER BY doc_id LIMIT 60")
def keyset_page(spark, sf_dir):
    return crawl.scan_after(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 40, 60)


@query("SELECT d.doc_id, coalesce('label ' || l.quality, d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, 'label ' || quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def document_upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select("doc_id", "lang")
    incoming = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("lang"))
    return versions.upsert(stored, incoming, ["doc_id"])


@query("SELECT doc_id AS id, 'stored' AS origin FROM labels UNION ALL SELECT user_id, arg_min(event_type, (ts, event_id)) FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels) GROUP BY user_id")
def insert_if_missing(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("stored").alias("origin"))
    incoming = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("origin"), "ts", "event_id")
    return versions.insert_missing(stored, incoming, ["id"], ["ts", "event_id"])


@query("""
SELECT job_id FROM (SELECT event_id AS job_id, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id % 3, event_type = 'error' ORDER BY ts DESC, event_id) AS r FROM events)
WHERE failed OR (r <= 700 AND ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 24 HOUR)""")
def retained_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    jobs = rows.select(F.col("event_id").alias("job_id"), (F.col("user_id") % 3).alias("queue"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("state"), F.col("ts").alias("finished_at"))
    return crawl.retained_jobs(jobs, F.lit("2024-01-25 12:00:00").cast("timestamp_ntz"), keep=700).select("job_id")


@query("""
SELECT user_id AS crawl_id, 'https://example.com/' || user_id AS normalized_url, 'PENDING' AS status, coalesce(CASE WHEN user_id % 2 = 0 THEN user_id % 50 + 1 END, 25)::INT AS max_pages, 2 AS max_depth, 'QUEUED' AS page_status, 0 AS depth, 1::BIGINT AS discovered_count FROM (SELECT DISTINCT user_id FROM events)""")
def crawl_creation(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    url = F.concat(F.lit("https://example.com/"), F.col("user_id").cast("string"))
    seeds = users.select(F.col("user_id").alias("crawl_id"), url.alias("seed_url"), url.alias("normalized_url"), F.lit("https://example.com").alias("origin"), F.lit("STATIC").alias("render_mode"), F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 50 + 1).alias("max_pages"), F.lit(None).cast("int").alias("max_depth"), F.current_timestamp().alias("created_at"))
    crawls, roots = crawl.create_crawls(seeds)
    joined = crawls.join(roots.select(F.col("crawl_id").alias("id"), "normalized_url", F.col("status").alias("page_status"), "depth"), "id")
    return joined.select(F.col("id").alias("crawl_id"), "normalized_url", "status", "max_pages", "max_depth", "page_status", "depth", "discovered_count")


@query("SELECT min(doc_id) OVER w AS root_id, doc_id AS id, (row_number() OVER w)::INT AS ordinal FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)")
def version_traversal(spark, sf_dir):
    """Chains of versions, those of a source and language one after another, followed from their first."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("source", "lang").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lag("doc_id").over(order).alias("previous_version_id"))
    return versions.version_chain(docs)


# what a crawl meets: failures, guards, kept rules, redelivered jobs


_NETWORK = "['ECONNABORTED', 'ETIMEDOUT', 'ECONNRESET', 'EAI_AGAIN', 'ENOTFOUND', 'EPIPE', NULL]"
_MESSAGES = "['Navigation timeout of 15000 ms', 'Page crash', 'target closed', 'body is too large', 'no route', NULL]"


@query(f"""
SELECT *, network IN ('NETWORK_TIMEOUT', 'CONNECTION_RESET', 'DNS_TEMPORARY', 'UNKNOWN') AS retryable FROM (
  SELECT event_id, CASE WHEN message = 'body is too large' THEN 'RESPONSE_TOO_LARGE' WHEN code IN ('ECONNABORTED', 'ETIMEDOUT') THEN 'NETWORK_TIMEOUT' WHEN code = 'ECONNRESET' THEN 'CONNECTION_RESET'
           WHEN code = 'EAI_AGAIN' THEN 'DNS_TEMPORARY' WHEN code = 'ENOTFOUND' THEN 'DNS_FAILURE' ELSE 'UNKNOWN' END AS network,
         CASE WHEN event_type = 'click' OR message LIKE '%timeout%' THEN 'BROWSER_TIMEOUT' WHEN message IN ('Page crash', 'target closed') THEN 'BROWSER_CRASH' ELSE 'BROWSER_NAVIGATION' END AS browser
  FROM (SELECT event_id, event_type, {_NETWORK}[user_id % 7 + 1] AS code, {_MESSAGES}[event_id % 6 + 1] AS message FROM events))""")
def unanswered_requests(spark, sf_dir):
    """Categories of requests without a response, by a client's codes and by a browser's messages."""
    codes = F.array(*map(F.lit, ("ECONNABORTED", "ETIMEDOUT", "ECONNRESET", "EAI_AGAIN", "ENOTFOUND", "EPIPE", None)))
    messages = F.array(*map(F.lit, ("Navigation timeout of 15000 ms", "Page crash", "target closed", "body is too large", "no route", None)))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", codes[(F.col("user_id") % 7).cast("int")].alias("code"), messages[(F.col("event_id") % 6).cast("int")].alias("message"))
    name = F.when(F.col("event_type") == "click", "TimeoutError").otherwise("Error")
    network = policy.classify_network(F.col("code"), F.col("message"))
    return rows.select("event_id", network.alias("network"), policy.classify_browser(name, F.col("message")).alias("browser"), policy.is_retryable(network).alias("retryable"))


@query("""
SELECT page_id, category AS failure_category, not_modified, coalesce(category NOT IN ('HTTP_PERMANENT', 'UNSUPPORTED_CONTENT_TYPE', 'RESPONSE_TOO_LARGE', 'DNS_FAILURE'), false) AS retryable FROM (
  SELECT page_id::VARCHAR AS page_id, coalesce(status = 304, false) AS not_modified,
    CASE WHEN status IS NULL THEN CASE WHEN page_id // 8 % 2 = 0 THEN 'BROWSER_NAVIGATION' ELSE 'DNS_FAILURE' END WHEN status = 304 THEN NULL WHEN status IN (429, 503) THEN 'HTTP_' || status
         WHEN status <> 200 THEN 'HTTP_PERMANENT' WHEN page_id % 5 = 1 THEN 'UNSUPPORTED_CONTENT_TYPE' WHEN page_id % 100 = 7 AND strlen(html) > 0 THEN 'RESPONSE_TOO_LARGE' END AS category
  FROM (SELECT *, [200, 304, 404, 429, 503, NULL, 200, 200][page_id % 8 + 1] AS status FROM pages))""")
def judged_fetches(spark, sf_dir):
    """A log with kept, refused, failing and rendered pages, judged."""
    statuses = F.array(*map(F.lit, (200, 304, 404, 429, 503, None, 200, 200)))
    pages = table(spark, sf_dir, "pages")
    log = fetches.fetch_log_from_pages(pages).withColumns(
        {
            "http_status": statuses[(F.col("page_id").cast("long") % 8).cast("int")],
            "render_mode": F.when(F.floor(F.col("page_id").cast("long") / 8) % 2 == 0, "JAVASCRIPT").otherwise("STATIC"),
            "content_type": F.when(F.col("page_id").cast("long") % 5 == 1, "text/csv").otherwise("text/html; charset=utf-8"),
            "body": F.when(F.col("page_id").cast("long") % 100 == 7, F.expr("repeat(body, CAST(2097152 DIV greatest(octet_length(body), 1) + 1 AS INT))")).otherwise(F.col("body")),
        }
    )
    log = log.withColumn("error_code", F.when(F.col("http_status").isNull(), "ENOTFOUND"))
    return fetches.judge(log).select("page_id", "failure_category", "not_modified", "retryable")


_V6 = "['2001:db8::', 'fe80::', 'fc00::', 'ff02::', '2002::', '2001::', '64:ff9b::', '::ffff:10.0.0.', '::ffff:93.184.216.', '2a00:1450::', '2606:4700::', '::']"


@query(f"""
SELECT event_id, address, NOT starts_with(address, '2a00') AND NOT starts_with(address, '2606') AND NOT starts_with(address, '::ffff:93') AS unsafe
FROM (SELECT event_id, {_V6}[event_id % 12 + 1] || (user_id % 100 + 1) AS address FROM events)""")
def ip_safety_v6(spark, sf_dir):
    prefixes = F.array(*map(F.lit, ("2001:db8::", "fe80::", "fc00::", "ff02::", "2002::", "2001::", "64:ff9b::", "::ffff:10.0.0.", "::ffff:93.184.216.", "2a00:1450::", "2606:4700::", "::")))
    address = F.concat(prefixes[(F.col("event_id") % 12).cast("int")], (F.col("user_id") % 100 + 1).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", address.alias("address"))
    return rows.select("event_id", "address", policy.unsafe_addresses(F.array("address")).alias("unsafe"))


@query(f"""
SELECT page_id, CASE WHEN error IS NULL THEN regexp_replace(url, '#.*$', '') || '.pdf' END AS url, error AS error_code FROM (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, CASE WHEN page_id % 4 = 0 THEN 'EXTERNAL_ORIGIN' WHEN page_id % 4 = 1 THEN 'UNSAFE_TARGET' END AS error FROM pages)""")
def navigation_guard(spark, sf_dir):
    """Downloads beside each page, opened by the page itself, by one of another origin, and at a private address."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(bare, F.lit(".pdf")).alias("wanted"), "url")
    addresses = F.when(F.col("page_id") % 4 == 1, F.array(F.lit("93.184.216.34"), F.lit("10.0.0.8"))).otherwise(F.array(F.lit("93.184.216.34")))
    allowed = F.when(F.col("page_id") % 4 == 0, "https://other.example.org").otherwise(F.col("url"))
    found = pages.select("page_id", policy.navigation(F.col("wanted"), F.col("url"), allowed, addresses).alias("n"))
    return found.select("page_id", "n.url", "n.error_code")


@query("""
WITH RECURSIVE r AS (SELECT event_id, 'h' || user_id % 30 AS origin, ts FROM events),
f AS (SELECT origin, min(ts) AS at FROM r GROUP BY origin UNION ALL SELECT f.origin, min(r.ts) FROM f JOIN r ON r.origin = f.origin AND r.ts >= f.at + INTERVAL 24 HOUR GROUP BY f.origin)
SELECT event_id, r.origin, f.at AS fetched_at, f.at = r.ts AS is_fetch FROM r ASOF JOIN f ON r.origin = f.origin AND r.ts >= f.at""")
def robots_cache(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("h"), (F.col("user_id") % 30).cast("string")).alias("origin"), F.col("ts").alias("requested_at"))
    return crawl.robots_lookups(rows).select("event_id", "origin", "fetched_at", "is_fetch")


@query("""
SELECT o_orderkey AS id, regexp_extract(url, '^[a-z]+://[^/]+') AS normalized_origin, (s = 'COMPLETED')::INT AS completed_count, (s = 'FAILED')::INT AS failed_count, s AS page_status, 0 AS depth, 25 AS max_pages
FROM (SELECT o_orderkey, 'https://c' || o_custkey || '.example.com/' || o_orderkey AS url, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'QUEUED' ELSE 'FAILED' END AS s FROM orders)""")
def single_page_migration(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("FAILED")
    url = F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example.com/"), F.col("o_orderkey").cast("string"))
    none = [F.lit(None).cast("timestamp").alias(c) for c in ("created_at", "started_at", "completed_at")]
    crawls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), url.alias("url"), status.alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error_message"), *none)
    moved, roots = crawl.migrate_single_page(crawls)
    return moved.join(roots.select("id", F.col("status").alias("page_status"), "depth"), "id").select("id", "normalized_origin", "completed_count", "failed_count", "page_status", "depth", "max_pages")


@query(f"SELECT depth, count(*) AS n FROM ({_SQL['bfs_crawl']}) GROUP BY depth")
def pages_by_depth(spark, sf_dir):
    return crawl.pages_by_depth(bfs_crawl(spark, sf_dir))


@query("SELECT DISTINCT user_id AS job_id, (event_id % 3)::BIGINT AS attempt FROM events")
def job_deliveries(spark, sf_dir):
    """A stream of deliveries, some of the same job and attempt more than once."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    jobs = stream.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("attempt"), F.col("ts").cast("timestamp").alias("enqueued_at"))
    return crawl.run_stream(politeness.first_deliveries(jobs, delay="3650 days"), "deliveries").select("job_id", "attempt")


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream, their times with a zone."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))


@query("""
WITH r AS (SELECT event_id::VARCHAR AS request_id, (user_id % 40)::VARCHAR AS host_port, (epoch_us(ts) // 1000) AS arrival_ms, greatest(1000, CASE WHEN event_id % 4 > 0 THEN 3600000 * (event_id % 7) END) AS rest FROM events),
b AS (SELECT *, coalesce(sum(rest) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM r WINDOW w AS (PARTITION BY host_port ORDER BY arrival_ms, request_id))
SELECT request_id, host_port, arrival_ms, (max(arrival_ms - before) OVER (PARTITION BY host_port ORDER BY arrival_ms, request_id ROWS UNBOUNDED PRECEDING) + before)::BIGINT AS start_ms FROM b""")
def spaced_stream(spark, sf_dir):
    """Requests of a stream to hosts some of whose rules ask for a delay of hours."""
    rest = F.when(F.col("event_id") % 4 > 0, 3_600_000 * (F.col("event_id") % 7))
    requests = _event_stream(spark, sf_dir).select(F.col("event_id").cast("string").alias("request_id"), (F.col("user_id") % 40).cast("string").alias("host_port"), "at", rest.alias("crawl_delay_ms"))
    return crawl.run_stream(politeness.spaced_requests(requests, time="at", delay="3650 days"), "spaced")


@query("""
WITH a AS (SELECT event_id // 4 AS page_id, (epoch_us(ts) // 1000) AS at_ms, row_number() OVER w AS n, lead((epoch_us(ts) // 1000)) OVER w AS next_ms,
  CASE event_type WHEN 'purchase' THEN 'REUSED' WHEN 'signup' THEN 'SKIPPED_ROBOTS' ELSE 'FAILED' END AS outcome,
  CASE event_type WHEN 'click' THEN 'HTTP_429' WHEN 'error' THEN 'HTTP_PERMANENT' ELSE 'NETWORK_TIMEOUT' END AS category,
  CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 36000000 END AS asked FROM events WINDOW w AS (PARTITION BY event_id // 4 ORDER BY ts, event_id)),
t AS (SELECT *, outcome <> 'FAILED' OR category = 'HTTP_PERMANENT' OR n >= 3 AS ended FROM a),
c AS (SELECT *, CASE WHEN NOT ended THEN coalesce(asked, 1000 * 2 ** (n - 1)) END::BIGINT AS delay_ms FROM t
  QUALIFY NOT coalesce(bool_or(ended) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false))
SELECT page_id, n::INT AS attempt, CASE WHEN outcome = 'REUSED' THEN 'COMPLETED' WHEN outcome <> 'FAILED' THEN outcome WHEN ended THEN 'FAILED' ELSE 'RETRYING' END AS status,
  CASE WHEN outcome = 'FAILED' THEN category END AS failure_category, at_ms, delay_ms FROM c
UNION ALL SELECT page_id, (n + 1)::INT, 'QUEUED', NULL, at_ms + delay_ms, NULL FROM c WHERE delay_ms IS NOT NULL AND coalesce(next_ms >= at_ms + delay_ms, at_ms + delay_ms < (SELECT max((epoch_us(ts) // 1000)) FROM events))""")
def page_transitions(spark, sf_dir):
    """A stream of attempts and the timers of their retries, some of which a next attempt comes before."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "REUSED").when(kind == "signup", "SKIPPED_ROBOTS").otherwise("FAILED")
    category = F.when(kind == "click", "HTTP_429").when(kind == "error", "HTTP_PERMANENT").otherwise("NETWORK_TIMEOUT")
    asked = F.when((kind == "click") & (F.col("event_id") % 2 == 0), F.lit(36_000_000).cast("long"))
    attempts = _event_stream(spark, sf_dir).select(F.floor(F.col("event_id") / 4).alias("page_id"), F.col("event_id").alias("attempt_id"), "at", outcome.alias("outcome"), category.alias("failure_category"), asked.alias("retry_after_ms"))
    return crawl.run_stream(politeness.page_transitions(attempts, delay="0 seconds", keep_ms=3650 * policy.DAY_MS), "transitions")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 2000)")
def cascaded_labels(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").where("n_chars > 2000")
    return schemas.cascade(table(spark, sf_dir, "labels"), "doc_id", kept, "doc_id").select("doc_id", "quality")


@query("SELECT l.quality, d.doc_id, count(*) AS n FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 2000) d USING (doc_id) GROUP BY ALL")
def detached_labels(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").where("n_chars > 2000")
    found = schemas.set_null(table(spark, sf_dir, "labels"), "doc_id", kept, "doc_id")
    return found.groupBy("quality", "doc_id").agg(F.count("*").alias("n"))


@query()
def ann_search(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 20, by cells; tests hold its recall against the exact search."""
    rows = table(spark, sf_dir, "embeddings")
    centres = ann.train_cells(rows, "embedding", "vec_id")
    index = crawl.cut_lineage(ann.build_index(rows, "embedding", "vec_id", centres), "cells")
    return ann.search_index(index, rows.where("vec_id % 20 = 0"), "embedding", "vec_id", centres)


@query()
def ann_codes_search(spark, sf_dir):
    """As ``ann_search``, by an index whose cells grow with the table: codes are scanned, and whole vectors read of 200 rows a query."""
    rows = table(spark, sf_dir, "embeddings")
    codes = ann_codes.train(rows, "embedding", "vec_id")
    index = crawl.cut_lineage(ann_codes.build(rows, "embedding", "vec_id", codes), "codes")
    return ann_codes.search(index, rows, rows.where("vec_id % 20 = 0"), "embedding", "vec_id", codes)


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
#: What sites of each kind forbid and allow, as their files say it, and as SQL takes it: (kind, allowed, length of the rule, pattern).
_ROBOTS = (
    "User-agent: *\nDisallow: /en/\nAllow: /en/1\nAllow: /en/\nCrawl-delay: 2.5\n",
    "User-agent: other\nDisallow: /\n\nUser-agent: webloom\nUser-agent: second\nDisallow: /*?page=\nAllow: /fr/*?page=2\nDisallow: /*5$\n",
    "# of all\nUser-agent: *\nDisallow: /d\nDisallow: /fr/7\nAllow: /de/*1\n\nUser-agent: *\nCrawl-delay: 1\nDisallow: *top\n",
    None,
    "User-agent: *\nDisallow: /\n",
)
_RULES = """(VALUES (0, false, 4, '^/en/'), (0, true, 5, '^/en/1'), (0, true, 4, '^/en/'), (1, false, 8, '^/.*\\?page='), (1, true, 12, '^/fr/.*\\?page=2'), (1, false, 4, '^/.*5$'),
  (2, false, 2, '^/d'), (2, false, 5, '^/fr/7'), (2, true, 6, '^/de/.*1'), (2, false, 4, '^.*top')) AS rules(kind, allow, n, pattern)"""


def _site_files(pages: DataFrame) -> DataFrame:
    """A robots.txt for each origin of ``pages``, of a kind that the length of its host tells; of the last kind it can't be had."""
    origin = urls.url_origin(F.col("url"))
    kind = (F.length(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)) % 5).alias("kind")
    bodies, statuses = F.array(*map(F.lit, _ROBOTS)), F.array(*map(F.lit, (200, 200, 200, 404, 503)))
    return pages.select(origin.alias("origin"), kind).distinct().select("origin", statuses[F.col("kind")].alias("status"), bodies[F.col("kind")].alias("body"))


@query(f"""
WITH p AS (SELECT page_id, length({_HOST}) % 5 AS kind, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, max((n, allow)) AS best FROM p JOIN {_RULES} ON p.kind = rules.kind AND regexp_matches(path, pattern) GROUP BY page_id)
SELECT page_id, CASE WHEN kind <> 4 THEN coalesce(best[2], true) END AS allowed, CASE kind WHEN 0 THEN 2500 WHEN 2 THEN 1000 END::BIGINT AS crawl_delay_ms, CASE WHEN kind = 4 THEN 'ROBOTS_UNREACHABLE' END AS failure
FROM p LEFT JOIN m USING (page_id)""")
def robots_table(spark, sf_dir):
    """Every page under its origin's rules, which are read once an origin and met by their prefixes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = crawl.cut_lineage(robots.rules(_site_files(pages), "webloom/1.0"), "rules")
    return robots.decide(pages, rules).select("page_id", "allowed", "crawl_delay_ms", "failure")



_SITES = """c AS (SELECT c_custkey AS k, 'https://s' || c_custkey % 40 || '.example.com' AS origin, (SELECT max(c_custkey) FROM customer) AS n FROM customer),
a AS (SELECT k, origin, origin || '/' || k AS url, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 7 < 4 THEN 302 WHEN k % 7 = 4 THEN 404 ELSE 200 END END AS status,
  CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN 'https://other.example.com/' || k WHEN k % 19 = 0 THEN 'ftp://x.example.com/' || k WHEN k % 23 = 0 THEN origin || '/' || k
       WHEN k + 40 <= n THEN '/' || (k + 40) ELSE 'none' END AS location, CASE WHEN k % 29 = 0 THEN 3000000 ELSE 100 END AS n_bytes FROM c)"""


@query(f"""
WITH RECURSIVE {_SITES},
h AS (SELECT *, CASE WHEN location LIKE '/%' THEN origin || location WHEN location = 'none' THEN origin || '/none' ELSE location END AS target,
  CASE WHEN origin LIKE '%//s3.%' THEN 'DNS_FAILURE' WHEN origin LIKE '%//s5.%' THEN 'UNSAFE_TARGET' WHEN status IS NULL THEN 'NETWORK_TIMEOUT' WHEN n_bytes > 2097152 THEN 'RESPONSE_TOO_LARGE'
       WHEN status = 302 AND location = '' THEN 'INVALID_REDIRECT' WHEN status = 302 AND location LIKE 'https://other%' THEN 'SAME_ORIGIN_VIOLATION' WHEN status = 302 AND location LIKE 'ftp%' THEN 'INVALID_URL' END AS category FROM a),
w AS (
  SELECT k, url, 0 AS hop, false AS barred, false AS ended, NULL::VARCHAR AS category FROM a
  UNION ALL
  SELECT w.k, CASE WHEN going THEN target ELSE w.url END, hop + going::INT, going AND contains(target, '77'), NOT going OR contains(target, '77'), CASE WHEN NOT going THEN why END
  FROM (SELECT w.k, w.url, w.hop, h.target, CASE WHEN h.url IS NULL THEN 'UNKNOWN' WHEN h.category IS NULL AND h.status = 302 AND w.hop = 5 THEN 'INVALID_REDIRECT' ELSE h.category END AS why,
               coalesce(h.status = 302, false) AND why IS NULL AS going FROM w LEFT JOIN h ON h.url = w.url WHERE NOT w.ended) w
)
SELECT k, url AS final_url, hop AS n_hops, CASE WHEN barred THEN 'SKIPPED_ROBOTS' WHEN category IS NULL THEN 'RESPONSE' ELSE 'FAILED' END AS outcome, category FROM w WHERE ended""")
def redirect_hops(spark, sf_dir):
    """Pages of forty sites, many of which redirect, some of those badly, followed with addresses, answers and rules judged at every hop."""
    k, origin = F.col("k"), F.concat(F.lit("https://s"), (F.col("k") % 40).cast("string"), F.lit(".example.com"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    last = customers.agg(F.max("k")).first()[0] or 0
    pages = customers.withColumn("origin", origin).withColumn("url", F.concat("origin", F.lit("/"), k.cast("string")))
    location = (
        F.when(k % 13 == 0, "").when(k % 17 == 0, F.concat(F.lit("https://other.example.com/"), k.cast("string"))).when(k % 19 == 0, F.concat(F.lit("ftp://x.example.com/"), k.cast("string")))
        .when(k % 23 == 0, F.col("url")).when(k + 40 <= last, F.concat(F.lit("/"), (k + 40).cast("string"))).otherwise("none")
    )
    status = F.when(k % 11 != 0, F.when(k % 7 < 4, 302).when(k % 7 == 4, 404).otherwise(200))
    size = F.when(k % 29 == 0, 3_000_000).otherwise(100).cast("long")
    answers = pages.select("url", status.alias("status"), location.alias("location"), F.lit("ETIMEDOUT").alias("error_code"), F.lit(None).cast("string").alias("error_message"), size.alias("n_bytes"))
    sites = pages.select("origin").distinct()
    host = F.regexp_extract("origin", "//(.*)", 1)
    hosts = sites.select(host.alias("host"), F.when(host.startswith("s3."), F.array().cast("array<string>")).when(host.startswith("s5."), F.array(F.lit("10.0.0.7"))).otherwise(F.array(F.lit("93.184.216.34"))).alias("addresses"))
    rules = crawl.cut_lineage(robots.rules(sites.select("origin", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /*77\n").alias("body")), "webloom/1.0"), "rules")
    found = redirects.resolve(pages.select("k", "url", F.col("origin").alias("allowed_origin")), answers, hosts, rules)
    return found.select("k", "final_url", "n_hops", "outcome", "category")


@query("""
SELECT user_id, count(*) OVER () AS n_users, arg_max(event_id, (ts, event_id)) AS event_id, max((ts, event_id))[1] AS ts FROM events GROUP BY user_id""")
def stream_upsert(spark, sf_dir):
    """The newest event of each user, kept by a stream that changes only the buckets its batches fall in."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    kinds = ", ".join(f"{name} {kind}" for name, kind in events.dtypes)
    held = sinks.KeyedTable(spark, crawl.new_path(spark, "keyed"), kinds, ("user_id",), ("ts", "event_id"))
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "ts")
    found = held.run(stream)
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("n_users")))).select("user_id", "n_users", "event_id", "ts")  # one row
