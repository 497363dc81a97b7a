"""Bounded crawling: frontier, breadth-first traversal, states, failures."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import policy, text

ACTIVE = ("DISCOVERED", "QUEUED", "PROCESSING", "RETRYING")
FINISHED = ("COMPLETED", "FAILED", "SKIPPED", "SKIPPED_ROBOTS")
MAX_DEPTH = 10


_written: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder of ``spark.checkpoint.dir`` and read it again; the table goes when the driver ends, or with ``sweep``."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of ``spark.checkpoint.dir``, removed as those of ``cut_lineage``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/webloom-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def run_stream(rows: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all input that is there now, as a table beside those of ``cut_lineage``."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    sink = rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append")
    running = sink.start(f"{path}/rows")
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def sweep() -> None:
    """Delete the tables of ``cut_lineage``. Call it only when no DataFrame over them is still needed."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may have ended already; the others go all the same
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


atexit.register(sweep)


def create_crawls(seeds: DataFrame, queued: bool = True) -> tuple[DataFrame, DataFrame]:
    """Crawls and their pages of depth 0, from (crawl_id, seed_url, normalized_url, origin, render_mode, max_pages, max_depth, created_at). If the queue did not take them both are FAILED."""
    crawls = seeds.select(
        F.col("crawl_id").alias("id"), "seed_url", F.col("origin").alias("normalized_origin"), "render_mode", F.lit("PENDING" if queued else "FAILED").alias("status"),
        F.coalesce("max_pages", F.lit(25)).cast("int").alias("max_pages"), F.coalesce("max_depth", F.lit(2)).cast("int").alias("max_depth"),
        F.lit(1).cast("long").alias("discovered_count"), F.lit(0).cast("long").alias("completed_count"), F.lit(0).cast("long").alias("skipped_count"), F.lit(0 if queued else 1).cast("long").alias("failed_count"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"), "created_at",
    )
    roots = seeds.select(
        F.sha2(F.concat_ws("|", "crawl_id", "normalized_url"), 256).alias("id"), "crawl_id", F.col("seed_url").alias("url"), "normalized_url", F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_page_id"), F.lit("QUEUED" if queued else "FAILED").alias("status"), "created_at",
    )
    return crawls, roots


#: Rows that are ranked by a plain window, in which one task has all rows of a key.
ONE_TASK_ROWS = 1_000_000


def ranked(rows: DataFrame, key: str, order: list[str], one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``rows`` with ``rank``, from 1 in the order of each key, which must have no ties.

    More than ``one_task_rows`` are cut at sampled splitters of key and order; a row's rank is
    its place in its range and the number of the key's rows in the ranges before, so no task
    sees all rows of a key.
    """
    held = cut_lineage(rows, "ranked")
    if held.count() <= one_task_rows:
        return held.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    parts = max(2, -(-held.count() // one_task_rows))
    ranged = cut_lineage(held.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a key stands in
    sizes = ranged.groupBy(key, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(sizes, [key, "_part"]).withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def reserve(candidates: DataFrame, pages: DataFrame, crawls: DataFrame, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """New pages for candidate links, in order, as far as the crawl's capacity goes.

    ``candidates``: (crawl_id, parent_order, position, parent_page_id, parent_depth, normalized_url);
    ``pages``: what the crawls have; ``crawls``: (crawl_id, max_pages, max_depth).
    """
    used = pages.groupBy("crawl_id").agg(F.count("*").alias("used"))
    within = candidates.join(crawls, "crawl_id").where(F.col("parent_depth") < F.col("max_depth"))
    order = ["parent_order", "position"]
    first = within.groupBy("crawl_id", "normalized_url").agg(F.min(F.struct(*order, "parent_page_id", "parent_depth", "max_pages")).alias("f")).select("crawl_id", "normalized_url", "f.*")
    fresh = first.join(pages.select("crawl_id", "normalized_url"), ["crawl_id", "normalized_url"], "left_anti").join(used, "crawl_id", "left")
    taken = ranked(fresh, "crawl_id", [*order, "normalized_url"], one_task_rows).where(F.col("rank") <= F.col("max_pages") - F.coalesce("used", F.lit(0)))
    return taken.select("crawl_id", "normalized_url", (F.col("parent_depth") + 1).alias("depth"), "parent_page_id", F.col("rank").cast("long").alias("rank"))


def still_discovered(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates that are waiting to be queued, whether new or from an attempt before."""
    waiting = pages.where("status = 'DISCOVERED'").select("crawl_id", "normalized_url")
    return candidates.join(waiting, ["crawl_id", "normalized_url"], "left_semi").select("crawl_id", "normalized_url").distinct()


def traverse(crawls: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that a bounded breadth-first crawl discovers: (crawl_id, normalized_url, depth, parent_url, position).

    ``crawls``: (crawl_id, seed_url, max_pages, max_depth); ``links``: (source, target, position).
    The order is that of depth, then of the parents, then of links on the page. One
    round a level, at most ten, each written so that plans stay short.
    """
    limits = crawls.select("crawl_id", "max_pages", "max_depth")
    found = crawls.select("crawl_id", F.col("seed_url").alias("normalized_url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.lit(0).cast("long").alias("position"))
    level = found = cut_lineage(found, "crawl-level")
    deepest = crawls.agg(F.max("max_depth")).first()[0] or 0
    for _ in range(min(deepest, MAX_DEPTH)):
        candidates = level.join(links, level.normalized_url == links.source).select(
            "crawl_id", level.position.alias("parent_order"), links.position.alias("position"), level.normalized_url.alias("parent_page_id"), level.depth.alias("parent_depth"), links.target.alias("normalized_url")
        )
        base = found.groupBy("crawl_id").agg(F.max("position").alias("last"))
        new = reserve(candidates, found, limits).join(base, "crawl_id")
        level = new.select("crawl_id", "normalized_url", "depth", F.col("parent_page_id").alias("parent_url"), (F.col("last") + F.col("rank")).alias("position"))
        level = cut_lineage(level, "crawl-level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id", "status").agg(F.count("*").alias("n"))


def fold_state(pages: DataFrame, now: Column, before: DataFrame | None = None) -> DataFrame:
    """Counters and status of each crawl. ``before``: (crawl_id, completed_at), which stays while the crawl is complete."""
    state = pages.groupBy("crawl_id").agg(
        F.count("*").alias("discovered_count"),
        F.count_if(F.col("status") == "COMPLETED").alias("completed_count"),
        F.count_if(F.col("status").isin("SKIPPED", "SKIPPED_ROBOTS")).alias("skipped_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active_count"),
    )
    done = F.col("active_count") == 0
    known = state.join(before.select("crawl_id", F.col("completed_at").alias("_at")), "crawl_id", "left") if before is not None else state.withColumn("_at", F.lit(None).cast("timestamp_ntz"))
    return (
        known.withColumn("status", F.when(done, "COMPLETED").otherwise("PROCESSING"))
        .withColumn("completed_at", F.when(done, F.coalesce("_at", now)))
        .withColumn("completed_with_failures", done & (F.col("failed_count") > 0))
        .drop("_at")
    )


def page_outcomes(attempts: DataFrame) -> DataFrame:
    """State of each page after its attempts: (page_id, status, attempts, failure_category, error, delay_ms).

    ``attempts``: (page_id, attempt, outcome, failure_category, error, retry_after_ms), outcome being
    COMPLETED, REUSED, SKIPPED_ROBOTS or FAILED. Attempts after one that finished the page are ignored.
    """
    order = Window.partitionBy("page_id").orderBy("attempt")
    ranked = attempts.withColumn("_made", F.row_number().over(order) - 1)
    terminal = (F.col("outcome") != "FAILED") | policy.is_terminal(policy.is_retryable(F.col("failure_category")), F.col("_made"))
    marked = ranked.withColumn("_end", terminal).withColumn("_ended", F.coalesce(F.max(F.col("_end").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = marked.where("_ended = 0").groupBy("page_id").agg(F.max_by(F.struct("_made", "outcome", "_end", "failure_category", "error", "retry_after_ms"), "_made").alias("x")).select("page_id", "x.*")
    failed = F.col("outcome") == "FAILED"
    return last.select(
        "page_id",
        F.when(~failed, F.when(F.col("outcome") == "REUSED", "COMPLETED").otherwise(F.col("outcome"))).when(F.col("_end"), "FAILED").otherwise("RETRYING").alias("status"),
        (F.col("_made") + 1).cast("int").alias("attempts"),
        F.when(failed, F.coalesce("failure_category", F.lit("UNKNOWN"))).alias("failure_category"),
        F.when(F.col("outcome") == "SKIPPED_ROBOTS", "Blocked by robots.txt").when(failed, text.bounded_message(F.col("error"))).alias("error"),
        F.when(failed & ~F.col("_end"), policy.backoff_ms(F.col("_made") + 1, F.col("retry_after_ms"))).alias("delay_ms"),
    )


def dead_letters(failed_pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each page that failed for good, the first kept; pages that have one already get none.

    ``failed_pages``: (crawl_id, page_id, url, failure_category, error, attempts, failed_at).
    """
    payload = F.to_json(F.struct(F.col("page_id").alias("crawlPageId")))
    made = failed_pages.select(
        "crawl_id", F.col("page_id").alias("crawl_page_id"), F.col("page_id").alias("job_id"), "url", text.bounded_payload(payload).alias("job_payload"),
        F.coalesce("failure_category", F.lit("UNKNOWN")).alias("failure_category"), text.bounded_message(F.col("error")).alias("error_message"), F.greatest(F.col("attempts"), F.lit(1)).alias("attempt_count"), "failed_at",
    )
    fields = [c for c in made.columns if c not in ("crawl_page_id", "failed_at")]
    first = made.groupBy("crawl_page_id").agg(F.min(F.struct("failed_at", *fields)).alias("f")).select("crawl_page_id", "f.*")
    return first if existing is None else first.join(existing.select("crawl_page_id"), "crawl_page_id", "left_anti")


def skip_children(pages: DataFrame) -> DataFrame:
    """Pages, with the waiting children of failed pages skipped."""
    failed = pages.where("status = 'FAILED'").select(F.col("id").alias("_failed"))
    joined = pages.join(failed, F.col("parent_page_id") == F.col("_failed"), "left")
    return joined.withColumn("status", F.when(F.col("_failed").isNotNull() & (F.col("status") == "DISCOVERED"), "SKIPPED").otherwise(F.col("status"))).drop("_failed")


def root_pages(pages: DataFrame) -> DataFrame:
    return pages.where("depth = 0").groupBy("crawl_id").agg(F.min_by(F.struct(*[c for c in pages.columns if c != "crawl_id"]), F.struct("created_at", "id")).alias("p")).select("crawl_id", "p.*")


def with_related(pages: DataFrame, documents: DataFrame, letters: DataFrame | None = None) -> DataFrame:
    """Pages with the id of their document, own or reused, and of their dead letter."""
    own = documents.select(F.col("crawl_page_id").alias("_page"), F.col("id").alias("own_document_id"))
    joined = pages.join(own, F.col("id") == F.col("_page"), "left").drop("_page").withColumn("document_id", F.coalesce("own_document_id", "reused_document_id"))
    if letters is not None:
        joined = joined.join(letters.select(F.col("crawl_page_id").alias("_page"), F.col("failure_category").alias("dead_letter_category")), F.col("id") == F.col("_page"), "left").drop("_page")
    return joined


def paginate(rows: DataFrame, order: list, page: int = 1, page_size: int = 25) -> DataFrame:
    """One page of the rows in order."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page from 1, page_size from 1 to 100")
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_count(rows: DataFrame, page_size: int = 25) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / page_size).cast("long").alias("total_pages"))


def scan_after(rows: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """Keyset scan: the next rows after a key."""
    return (rows if cursor is None else rows.where(F.col(key) > cursor)).orderBy(key).limit(limit)


def follow_redirects(requests: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """Where requests end: (request_url, final_url, n_hops, too_many). ``redirects``: (from_url, to_url), one row a URL."""
    step = requests.select(F.col("url").alias("request_url"), F.col("url").alias("final_url"), F.lit(0).alias("n_hops"))
    edges = redirects.select(F.col("from_url").alias("_from"), F.col("to_url").alias("_to"))
    for _ in range(hops):
        step = step.join(edges, F.col("final_url") == F.col("_from"), "left").select(
            "request_url", F.coalesce("_to", "final_url").alias("final_url"), (F.col("n_hops") + F.col("_to").isNotNull().cast("int")).alias("n_hops")
        )
    return step.join(edges.select("_from"), F.col("final_url") == F.col("_from"), "left").withColumn("too_many", F.col("_from").isNotNull()).drop("_from")


def spacing(requests: DataFrame, interval_ms: int = 1000) -> DataFrame:
    """When each request may start: one at a time for each host and port, an interval after the one before.

    ``requests``: (request_id, host_port, arrival_ms[, interval_ms]). A start is the
    later of arrival and the start before plus its interval; that fold is a running
    maximum of arrivals less the intervals so far, so it is one window.
    """
    own = requests if "interval_ms" in requests.columns else requests.withColumn("interval_ms", F.lit(interval_ms))
    order = Window.partitionBy("host_port").orderBy("arrival_ms", "request_id")
    own = own.withColumn("_before", F.coalesce(F.sum("interval_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("start_ms", F.max(F.col("arrival_ms") - F.col("_before")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    return own.withColumn("wait_ms", F.col("start_ms") - F.col("arrival_ms")).drop("_before")


def robots_lookups(requests: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """Requests with ``fetched_at``, when the rules that answer them were fetched, and ``is_fetch``, whether they caused that.

    ``requests``: (origin, requested_at, ...). The first request of an origin fetches its
    rules, and so does the first one once those are ``ttl_hours`` old; the rest are answered
    from what is kept. Every request points to the one that would fetch next after it;
    pointers are doubled, and the fetches known so far follow them, so a log of n lifetimes
    takes log n rounds, each written. Times of an origin are looked up by lifetimes of the
    clock, so no task has all requests of one.
    """
    if ttl_hours < 1:
        raise ValueError("ttl_hours from 1")
    lifetime = F.expr(f"INTERVAL {int(ttl_hours)} HOURS")
    times = requests.where(F.col("origin").isNotNull() & F.col("requested_at").isNotNull()).select("origin", F.col("requested_at").alias("at")).distinct()
    times = cut_lineage(times, "robots-times")
    points = cut_lineage(_next_fetches(times, lifetime, ttl_hours), "robots-next")
    found = times.groupBy("origin").agg(F.min("at").alias("at"))
    while True:
        found = cut_lineage(found, "robots-fetches")
        if points.isEmpty():
            break
        found = found.unionByName(found.join(points, ["origin", "at"]).select("origin", F.col("to").alias("at")))
        onward = points.select("origin", F.col("at").alias("to"), F.col("to").alias("_to"))
        points = cut_lineage(points.join(onward, ["origin", "to"]).select("origin", "at", F.col("_to").alias("to")), "robots-next")
    span = found.select(F.col("origin").alias("_origin"), F.col("at").alias("fetched_at"), (F.col("at") + lifetime).alias("expires_at"), F.explode(F.array(*[_lifetime_of(t, ttl_hours) for t in (F.col("at"), F.col("at") + lifetime)])).alias("_life")).distinct()
    # a fetch's lifetime falls in two of the clock's, and where it expires the next may begin, so at most one holds a request
    own = requests.withColumn("_own", _lifetime_of(F.col("requested_at"), ttl_hours))
    within = (F.col("requested_at") >= F.col("fetched_at")) & (F.col("requested_at") < F.col("expires_at"))
    joined = own.join(span, (F.col("origin") == F.col("_origin")) & (F.col("_own") == F.col("_life")) & within, "left")
    return joined.withColumn("is_fetch", F.col("requested_at") == F.col("fetched_at")).drop("_origin", "expires_at", "_own", "_life")


def _lifetime_of(time: Column, ttl_hours: int) -> Column:
    return F.floor(F.unix_seconds(time.cast("timestamp")) / (3600 * ttl_hours))


def _next_fetches(times: DataFrame, lifetime: Column, ttl_hours: int) -> DataFrame:
    """(origin, at, to): for each time the first one of its origin that comes a lifetime or more after it, where there is one."""
    held = times.select("origin", F.col("at").alias("x"), F.lit(None).cast(times.schema["at"].dataType).alias("at"))
    asked = times.select("origin", (F.col("at") + lifetime).alias("x"), "at")
    both = held.unionByName(asked).withColumn("life", _lifetime_of(F.col("x"), ttl_hours))
    event = F.when(F.col("at").isNull(), F.col("x"))
    # latest first, as Spark goes over all rows that follow again for each row of a frame that is open at its end
    later = Window.partitionBy("origin", "life").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lives = both.groupBy("origin", "life").agg(F.min(event).alias("_least"))  # a row for each lifetime of the clock
    following = Window.partitionBy("origin").orderBy(F.desc("life")).rowsBetween(Window.unboundedPreceding, -1)
    lives = lives.withColumn("_beyond", F.min("_least").over(following)).drop("_least")
    found = both.withColumn("_here", F.min(event).over(later)).where("at IS NOT NULL").join(lives, ["origin", "life"])
    return found.select("origin", "at", F.coalesce("_here", "_beyond").alias("to")).where("to IS NOT NULL")


def pages_by_depth(pages: DataFrame) -> DataFrame:
    return pages.groupBy("depth").agg(F.count("*").alias("n"))


def migrate_single_page(crawls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crawls of one page each, brought to the form of crawls of many: (crawls with limits and counts, their root pages of the same ids).

    ``crawls``: (id, url, status, attempts, error_message, created_at, started_at, completed_at).
    """
    known = F.col("status").isin("QUEUED", "PROCESSING", "RETRYING", "COMPLETED", "FAILED")
    moved = crawls.withColumns(
        {
            "seed_url": F.col("url"),
            "normalized_origin": F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]+", 0), F.lit("")),
            "max_pages": F.lit(25),
            "max_depth": F.lit(2),
            "discovered_count": F.lit(1),
            "completed_count": F.coalesce((F.col("status") == "COMPLETED").cast("int"), F.lit(0)),
            "skipped_count": F.lit(0),
            "failed_count": F.coalesce((F.col("status") == "FAILED").cast("int"), F.lit(0)),
        }
    )
    roots = crawls.select(
        "id", F.col("id").alias("crawl_id"), "url", F.col("url").alias("normalized_url"), F.lit(0).alias("depth"), F.when(known, F.col("status")).alias("status"),
        "attempts", F.col("error_message").alias("error"), "created_at", "started_at", "completed_at",
    )
    return moved, roots


def limiter_key(url: Column) -> Column:
    """Host and effective port, whatever the scheme."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)", 1)
    return F.concat_ws(":", host, F.when(port != "", port).when(scheme == "https", "443").otherwise("80"))


def retained_jobs(jobs: DataFrame, now: Column, keep: int = 1000, hours: int = 24) -> DataFrame:
    """Finished jobs that are kept: failed ones, and the newest completed ones of the last day."""
    rank = F.row_number().over(Window.partitionBy("queue", "state").orderBy(F.desc("finished_at"), "job_id"))
    fresh = F.col("finished_at") >= now - F.expr(f"INTERVAL {hours} HOURS")
    return jobs.withColumn("_rank", rank).where((F.col("state") == "failed") | ((F.col("_rank") <= keep) & fresh)).drop("_rank")


def run_summary(crawls: DataFrame) -> DataFrame:
    """Sums over crawls, pages a second, and the speed-up of each round against the first: (round, started_at, ended_at, counts)."""
    seconds = (F.unix_micros(F.max("ended_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp"))) / 1000000
    per = crawls.groupBy("round").agg(
        F.sum("discovered_count").alias("discovered"), F.sum("completed_count").alias("completed"), F.sum("skipped_count").alias("skipped"), F.sum("failed_count").alias("failed"), seconds.alias("seconds")
    )
    per = per.withColumn("pages_per_second", F.col("completed") / F.col("seconds"))
    base = F.first("pages_per_second").over(Window.partitionBy(F.lit(1)).orderBy("round").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row a round
    return per.withColumn("speed_up", F.col("pages_per_second") / base).withColumn("gain_percent", (F.col("speed_up") - 1) * 100)


