"""Redirects followed hop by hop, each hop judged as a client judges it.

Each round takes the requests that still go on: the host's addresses, the answer, the
Location in its normal form and origin, the rules of robots.txt for it. Those that end are
set aside with their reason, and the others are written, so the next round reads fewer
rows and a plan stays short. Requests of the same URL and origin are followed once.

Cases: a request whose URL is no good ends before the first hop. A URL without an answer
has failed in a way that is not known; a host without addresses can't be resolved. An
answer without a status has the category of its error code; ``status`` is that of the last
answer had. A redirect without a Location,
and a sixth one, is invalid; a loop is followed to there, and told by ``loop``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import policy, urls
from webloom.operators import robots
from webloom.operators.crawl import cut_lineage

#: Statuses that redirect, and redirects at most.
REDIRECTS, MAX_REDIRECTS = (301, 302, 303, 307, 308), 5
_DONE = ["_start", "_origin", "final_url", "status", "n_hops", "outcome", "category", "crawl_delay_ms", "loop"]


def _judged(code, invalid: str):
    return F.when(code == "EXTERNAL_ORIGIN", "SAME_ORIGIN_VIOLATION").when(code == "INVALID_URL", invalid).when(code.isNotNull(), "INVALID_URL")


def resolve(requests: DataFrame, responses: DataFrame, hosts: DataFrame, rules: DataFrame | None = None, max_bytes: int = 2_097_152) -> DataFrame:
    """Where each request ends: ``requests`` with final_url, status, n_hops, outcome (RESPONSE, FAILED, SKIPPED_ROBOTS), category, crawl_delay_ms and loop.

    ``requests``: (url, allowed_origin, ...); ``responses``: one row a URL (url, status,
    location, error_code, error_message, n_bytes); ``hosts``: (host, addresses); ``rules``: a
    table of ``robots.rules`` that redirects must keep.
    """
    starts = requests.select(F.col("url").alias("_start"), F.col("allowed_origin").alias("_origin")).distinct()
    first = urls.normalize_url(F.col("_start"), allowed_origin=F.col("_origin"), reject_downloadable=False)
    begun = starts.withColumn("_n", first).select(
        "_start", "_origin", F.col("_n.url").alias("final_url"), F.lit(None).cast("int").alias("status"), F.lit(0).alias("n_hops"), F.lit(None).cast("string").alias("outcome"),
        _judged(F.col("_n.error_code"), "INVALID_URL").alias("category"), F.lit(None).cast("long").alias("crawl_delay_ms"), F.lit(False).alias("loop"), F.array(F.col("_n.url")).alias("seen"),
    )
    answers = responses.select(F.col("url").alias("_url"), F.col("status").alias("_status"), "location", "error_code", "error_message", "n_bytes")
    places = hosts.select(F.col("host").alias("_host"), "addresses")
    active = cut_lineage(begun, "hops")
    done = [_ended(active.where("category IS NOT NULL"))]
    active = active.where("category IS NULL")
    for hop in range(MAX_REDIRECTS + 1):
        if active.isEmpty():
            break
        host = F.lower(F.regexp_replace(F.regexp_extract("final_url", r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"[\[\]]", ""))
        asked = active.withColumn("_host", host).join(places, "_host", "left").join(answers, F.col("final_url") == F.col("_url"), "left")
        redirected = F.col("_status").isin(*REDIRECTS)
        asked = asked.withColumn("_place", F.when(F.coalesce(F.size("addresses"), F.lit(0)) <= 0, "DNS_FAILURE").when(policy.unsafe_addresses(F.col("addresses")), "UNSAFE_TARGET"))
        category = (
            F.when(F.col("_place").isNotNull(), F.col("_place"))
            .when(F.col("_status").isNull(), policy.classify_network(F.col("error_code"), F.col("error_message")))
            .when(F.col("n_bytes") > max_bytes, "RESPONSE_TOO_LARGE")
            .when(redirected & (F.coalesce("location", F.lit("")) == ""), "INVALID_REDIRECT")
        )
        if hop == MAX_REDIRECTS:
            category = F.coalesce(category, F.when(redirected, "INVALID_REDIRECT"))
        judged = asked.withColumn("category", category).withColumn("_on", redirected & F.col("category").isNull())
        judged = judged.withColumn("status", F.when(F.col("_place").isNull(), F.col("_status")).otherwise(F.col("status"))).withColumn("_next", F.when(F.col("_on"), urls.normalize_url(F.col("location"), F.col("final_url"), F.col("_origin"), reject_downloadable=False)))
        judged = judged.withColumn("category", F.coalesce("category", F.when(F.col("_on"), _judged(F.col("_next.error_code"), "INVALID_REDIRECT"))))
        judged = judged.withColumn("_on", F.col("_on") & F.col("category").isNull()).select(*_DONE, "seen", "_on", F.col("_next.url").alias("url"))
        judged = cut_lineage(judged, "hops")
        done.append(_ended(judged.where("NOT _on")))
        going = judged.where("_on")
        if rules is not None:
            going = robots.decide(going.drop("crawl_delay_ms"), rules)
            category, delay = F.col("failure"), F.col("crawl_delay_ms")
            barred = F.col("allowed") == F.lit(False)
        else:
            category, delay, barred = F.lit(None).cast("string"), F.col("crawl_delay_ms"), F.lit(False)
        going = going.withColumns({"category": category, "outcome": F.when(barred, "SKIPPED_ROBOTS"), "crawl_delay_ms": delay})
        moved = going.withColumns({"loop": F.col("loop") | F.array_contains("seen", F.col("url")), "seen": F.concat("seen", F.array("url")), "n_hops": F.col("n_hops") + 1, "final_url": F.col("url")})
        moved = cut_lineage(moved.select(*_DONE, "seen"), "hops")
        done.append(_ended(moved.where("category IS NOT NULL OR outcome IS NOT NULL")))
        active = moved.where("category IS NULL AND outcome IS NULL")
    found = reduce(DataFrame.unionByName, done)
    same = F.col("url").eqNullSafe(F.col("_start")) & F.col("allowed_origin").eqNullSafe(F.col("_origin"))
    return requests.join(found, same).drop("_start", "_origin")


def _ended(rows: DataFrame) -> DataFrame:
    outcome = F.coalesce("outcome", F.when(F.col("category").isNotNull(), "FAILED").otherwise("RESPONSE"))
    return rows.withColumn("outcome", outcome).select(*_DONE)
