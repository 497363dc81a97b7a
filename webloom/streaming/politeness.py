"""Streams: request spacing, attempts, API rate limits.

Requests and attempts without a time are left out; those of no host or page go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import policy

RATE_LIMIT, RATE_WINDOW = 120, "60 seconds"
_NEVER = 2**62


def spaced_requests(requests: DataFrame, interval_ms: int = 1000, time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """When each request of a stream may start: state is one number for each host and port.

    ``requests``: (request_id string, host_port string, arrival_ms long[, crawl_delay_ms long]). After a
    request its host rests for ``interval_ms``, or for the crawl delay of its rules where that is longer.
    With ``time``, a timestamp in place of ``arrival_ms``, a host is forgotten once the watermark has
    passed the time at which it is free, when its number would make no difference; requests that are
    later than ``delay`` are left out, as by every stream with a watermark. Requests of a host in one
    batch are taken in order of arrival and id.
    """
    if time is not None:
        requests = requests.where(F.col(time).isNotNull()).withWatermark(time, delay).withColumn("arrival_ms", F.unix_millis(time))
    own = F.col("crawl_delay_ms") if "crawl_delay_ms" in requests.columns else F.lit(None).cast("long")
    requests = requests.withColumn("interval_ms", F.greatest(F.lit(interval_ms).cast("long"), F.coalesce(own, F.lit(0))))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["arrival_ms", "request_id"])
        arrivals, rests = rows["arrival_ms"].to_numpy("int64", copy=True), rows["interval_ms"].to_numpy("int64")
        if state.exists:
            arrivals[0] = max(arrivals[0], state.get[0])
        before = np.cumsum(rests) - rests
        starts = np.maximum.accumulate(arrivals - before) + before
        free = int(starts[-1] + rests[-1])
        state.update((free,))
        if time is not None:
            state.setTimeoutTimestamp(max(free, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(host_port=key[0], start_ms=starts)[["request_id", "host_port", "arrival_ms", "start_ms"]]

    return requests.groupBy("host_port").applyInPandasWithState(
        run, "request_id string, host_port string, arrival_ms long, start_ms long", "free_ms long", "append", "NoTimeout" if time is None else "EventTimeTimeout"
    )


def page_transitions(attempts: DataFrame, time: str = "at", delay: str = "10 minutes", keep_ms: int = policy.DAY_MS, buckets: int = 1024) -> DataFrame:
    """Changes of state of each page of a stream of attempts: (page_id, attempt, status, failure_category, at_ms, delay_ms).

    ``attempts``: (page_id, attempt_id, a timestamp, outcome, failure_category, retry_after_ms), outcome
    being COMPLETED, REUSED, SKIPPED_ROBOTS or FAILED. Each attempt gives the state that it leads to, as
    ``crawl.page_outcomes`` has it; one of a finished page gives nothing. A page to be retried has a timer:
    when its delay is over, a row QUEUED with the number of the next attempt. State is three numbers a page.
    A page is forgotten ``keep_ms`` after it was finished, or after its retry was due and nothing came;
    an attempt after that is a first one. Neither this nor the timers depend on how rows fall into batches;
    rows that are later than ``delay`` are left out.

    Pages are held together in ``buckets`` by their hash, each with the state of its pages and one timer, the
    earliest of theirs, as a call of Python for each page and timer would take most of the time. A batch reads
    and writes the buckets it falls in; a stream keeps the number of buckets it began with.
    """
    again = (F.col("outcome") == "FAILED") & policy.is_retryable(F.col("failure_category"))
    waits = [f"delay_{n}" for n in range(policy.MAX_ATTEMPTS)]
    rows = attempts.where(F.col(time).isNotNull()).withWatermark(time, delay).select(
        F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int").alias("bucket"),
        F.col("page_id").cast("string").alias("page_id"),  # numbers beside nulls would become floats
        "attempt_id",
        time,
        F.unix_micros(time).alias("at_us"),
        F.when(F.col("outcome") == "REUSED", "COMPLETED").otherwise(F.col("outcome")).alias("status"),
        F.when(F.col("outcome") == "FAILED", F.coalesce("failure_category", F.lit("UNKNOWN"))).alias("failure_category"),
        # the delay after each number of attempts, -1 where there is no other
        *[F.when(again & ~policy.is_terminal(F.lit(True), F.lit(n)), policy.backoff_ms(F.lit(n + 1), F.col("retry_after_ms"))).otherwise(F.lit(-1)).cast("long").alias(w) for n, w in enumerate(waits)],
    )
    names = ["page_id", "attempt", "status", "failure_category", "at_ms", "delay_ms"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        pages = {page: (made, due, forget) for page, made, due, forget in zip(*state.get, strict=True)} if state.exists else {}
        out: list[tuple] = []

        def meet(page: Any, at: int) -> tuple[int, int, int]:
            """A page's numbers after its timers up to a time."""
            made, due, forget = pages.get(page, (0, _NEVER, _NEVER))
            if due <= at:  # the timer of a retry
                out.append((page, made + 1, "QUEUED", None, due, None))
                due, forget = _NEVER, due + keep_ms
            return (0, _NEVER, _NEVER) if forget <= at else (made, due, forget)

        # timers the watermark has passed; no attempt that is still to come is as early
        for page in [page for page, (_, due, forget) in pages.items() if min(due, forget) < now]:
            pages[page] = meet(page, now - 1)
            if not pages[page][0]:
                del pages[page]
        if not state.hasTimedOut:
            arrived = pd.concat(list(frames)).sort_values(["at_us", "attempt_id"])
            columns = [arrived["page_id"], arrived["at_us"] // 1000, arrived["status"], arrived["failure_category"], *[arrived[w] for w in waits]]
            for page, at, status, category, *delays in zip(*[c.tolist() for c in columns], strict=True):
                made, due, forget = meet(page, at)
                if made >= 0:
                    wait = delays[made]
                    out.append((page, made + 1, status if wait < 0 else "RETRYING", category, at, None if wait < 0 else wait))
                    # a finished page is kept with a number below zero
                    made, due, forget = (-1, _NEVER, at + keep_ms) if wait < 0 else (made + 1, at + wait, _NEVER)
                pages[page] = (made, due, forget)
        if pages:
            state.update((list(pages), *map(list, zip(*pages.values(), strict=True))))
            state.setTimeoutTimestamp(max(min(min(due, forget) for _, due, forget in pages.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            columns = dict(zip(names, zip(*out, strict=True), strict=True))
            kinds = {"attempt": "int32", "at_ms": "int64", "delay_ms": "Int64"}
            yield pd.DataFrame({c: pd.array(v, dtype=kinds[c]) if c in kinds else pd.Series(v, dtype="object") for c, v in columns.items()})

    returned = "page_id string, attempt int, status string, failure_category string, at_ms long, delay_ms long"
    held = "pages array<string>, made array<int>, due_ms array<long>, forget_ms array<long>"
    made = rows.groupBy("bucket").applyInPandasWithState(run, returned, held, "append", "EventTimeTimeout")
    return made.withColumn("page_id", F.col("page_id").cast(attempts.schema["page_id"].dataType))


def rate_windows(requests: DataFrame, time: str, client: str, limit: int = RATE_LIMIT, window: str = RATE_WINDOW) -> DataFrame:
    """Requests of each client and window, and how many were over the limit; for tables and streams with a watermark."""
    counted = requests.groupBy(F.window(time, window).alias("w"), client).agg(F.count("*").alias("n_requests"))
    return counted.select(client, F.col("w.start").alias("window_start"), "n_requests", F.greatest(F.col("n_requests") - limit, F.lit(0)).alias("n_rejected"))


def first_deliveries(jobs: DataFrame, time: str = "enqueued_at", delay: str = "24 hours", keys: tuple[str, ...] = ("job_id", "attempt")) -> DataFrame:
    """Jobs of a stream, each delivery that repeats another dropped."""
    return jobs.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def crawl_progress(transitions: DataFrame, time: str = "at", delay: str = "10 minutes") -> DataFrame:
    """Status changes a minute and crawl, late ones within the delay included."""
    return transitions.withWatermark(time, delay).groupBy("crawl_id", F.window(time, "1 minute").alias("w"), "status").agg(F.count("*").alias("n"))
