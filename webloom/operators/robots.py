"""Rules of robots.txt as a table, and the longest rule that fits a URL by a join.

``rules`` reads each origin's body once and gives a row for each rule that holds for an
agent. A rule's literal beginning, up to its first wildcard, is its prefix. ``decide`` cuts
from a URL's path only the prefixes of lengths that its origin's rules have, joins on
(origin, prefix), holds what is left of a rule with wildcards against the path, and keeps
the longest rule, an allowing one where two are as long. So a URL meets the rules that may
fit it and not all of its origin's, whose number a site chooses.

Cases: an origin whose file was missing or refused (4xx) allows everything; one that could
not be reached, or is not in the table, decides nothing and has a failure. A null body is
empty. A URL that no rule fits is allowed. Repeated URLs each get a row. Bodies of repeated
origins must be one: the first by status and body counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import policy, urls

_RULES = "origin string, failure string, crawl_delay_ms long, allow boolean, prefix string, pattern string, length int"


def rules(files: DataFrame, agent: str) -> DataFrame:
    """The rules that hold for an agent: ``files`` (origin, status, body) to (origin, failure, crawl_delay_ms, allow, prefix, pattern, length).

    An origin without rules has one row, whose prefix is null. ``pattern`` is null where the
    prefix is the whole rule.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for origin, status, body in zip(frame["origin"], frame["status"], frame["body"], strict=True):
                status = None if pd.isna(status) else int(status)
                if status is None or not (200 <= status < 300 or 400 <= status < 500):
                    out.append((origin, "ROBOTS_UNREACHABLE", None, None, None, None, None))
                    continue
                groups = policy._own_groups(policy.parse_robots(body or ""), agent) if status < 400 else []
                delay = policy.crawl_delay_ms(groups)
                own = [r for g in groups for r in g["rules"]]
                out += [(origin, None, delay, allow, *_taken_apart(rule)) for allow, rule in own] or [(origin, None, delay, None, None, None, None)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RULES.split(", ")]).astype({"crawl_delay_ms": "Int64", "allow": "boolean", "length": "Int32"})

    first = files.groupBy("origin").agg(F.min(F.struct("status", "body")).alias("f")).select("origin", "f.*")
    return first.mapInPandas(run, _RULES)


def _taken_apart(rule: str) -> tuple[str, str | None, int]:
    """Literal beginning, pattern of the whole path where there is more to it, and length of a rule."""
    anchored = rule.endswith("$")
    parts = [unquote(p) for p in (rule[:-1] if anchored else rule).split("*")]
    quoted = [r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" if p else "" for p in parts]
    whole = len(parts) == 1 and not anchored
    return parts[0], None if whole else r"(?s)\A" + ".*".join(quoted) + (r"\z" if anchored else ""), len(rule)


def path_of(url: Column) -> Column:
    """Decoded path and query of a URL."""
    bare = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
    bare = F.regexp_replace(bare, r"^([^?]*)\?$", "$1")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def decide(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """``wanted`` (url, ...) with allowed, crawl_delay_ms and failure by the ``rules`` of each URL's origin."""
    keyed = wanted.withColumn("_row", F.monotonically_increasing_id()).withColumn("_origin", urls.url_origin(F.col("url")))
    origins = table.groupBy("origin").agg(F.max("failure").alias("failure"), F.max("crawl_delay_ms").alias("crawl_delay_ms"), F.array_sort(F.collect_set(F.length("prefix"))).alias("_lengths"))
    known = keyed.join(origins.withColumnRenamed("origin", "_origin").withColumn("_known", F.lit(True)), "_origin", "left").withColumn("_path", path_of(F.col("url")))
    lengths = F.filter("_lengths", lambda n: n <= F.length("_path"))
    asked = known.where(F.size(lengths) > 0).select("_row", "_origin", "_path", F.explode(lengths).alias("_n")).withColumn("_prefix", F.expr("left(_path, _n)"))
    ruled = table.where("prefix IS NOT NULL").select(F.col("origin").alias("_origin"), F.col("prefix").alias("_prefix"), "allow", "pattern", "length")
    met = asked.join(ruled, ["_origin", "_prefix"]).where(F.col("pattern").isNull() | F.expr("_path RLIKE pattern"))
    best = met.groupBy("_row").agg(F.max(F.struct("length", "allow")).alias("_best"))
    failure = F.when(F.col("_known").isNull(), "ROBOTS_UNREACHABLE").otherwise(F.col("failure"))
    joined = known.join(best, "_row", "left").withColumn("failure", failure)
    allowed = F.when(F.col("failure").isNull(), F.coalesce(F.col("_best.allow"), F.lit(True)))
    return joined.select(*[f"`{c}`" for c in wanted.columns], allowed.alias("allowed"), "crawl_delay_ms", "failure")
