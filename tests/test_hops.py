"""Rules of robots.txt by a join and redirects hop by hop, against plain readings of one URL at a time."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import policy, urls
from webloom.operators import redirects, robots

BODIES = {
    "https://a.example": (200, "User-agent: *\nDisallow: /x\nAllow: /x/y\nDisallow: /*.pdf$\nAllow: /x*z\nCrawl-delay: 2.5"),
    "https://b.example": (200, "User-agent: other\nDisallow: /\n\nUser-agent: Webloom\nUser-agent: second\nDisallow: /a%20b\nDisallow: /p?q=\nAllow: /p\nDisallow: /p\n"),
    "https://c.example": (404, None),
    "https://d.example": (503, "User-agent: *\nDisallow: /"),
    "https://e.example": (200, ""),
    "https://f.example": (200, "User-agent: *\nDisallow: *\nAllow: /$\nAllow: /\\E.*[x]\n"),
    "https://g.example": (None, None),
    "https://h.example:8080": (200, "User-agent: *\nDisallow: /\nCrawl-delay: -1"),
}


@pytest.fixture(scope="module")
def table(spark):
    files = spark.createDataFrame([(o, s, b) for o, (s, b) in BODIES.items()], "origin string, status int, body string")
    return robots.rules(files, "webloom/1.0").persist()


def test_rules_by_a_join_and_one_by_one(spark, table):
    rng = random.Random(6)
    paths = ["", "/", "/x", "/x/y", "/x/yz", "/xz.pdf", "/q.pdf", "/q.pdfs", "/a b", "/a%20b/c", "/p", "/p?q=1", "/pq", "/\\E.*[x]", "/%zz", "/a+b", "/é", "/x?y#/z"]
    wanted = [(f"{o}{p}",) for o in BODIES for p in paths] + [("https://none.example/x",)]
    wanted += [(f"{rng.choice(list(BODIES))}/{''.join(rng.choice('xyzp./?') for _ in range(rng.randrange(6)))}",) for _ in range(200)]
    rows = spark.createDataFrame(wanted, "url string").withColumn("failure_before", F.lit(1))
    got = sorted((r.url, r.allowed, r.crawl_delay_ms, r.failure) for r in robots.decide(rows, table).collect())
    plain = []
    for (url,) in wanted:
        status, body = BODIES.get("/".join(url.split("/")[:3]).split("?")[0], (None, None))
        plain.append((url, *policy.robots_decision(body, status, url, "webloom/1.0")))
    assert got == sorted(plain)


def test_rules_are_read_once_an_origin(table):
    by = {r["origin"]: r["count"] for r in table.groupBy("origin").count().collect()}
    assert by == {"https://a.example": 4, "https://b.example": 4, "https://f.example": 3, "https://h.example:8080": 1, **{f"https://{x}.example": 1 for x in "cdeg"}}


def plain_resolve(url, origin, answers, hosts, max_bytes):
    """(final_url, status, n_hops, outcome, category, delay, loop), as one request meets its hops."""

    def judged(value, base, invalid):
        found, code = urls.try_normalize(value, base_url=base, allowed_origin=origin, reject_downloadable=False)
        return found, {None: None, "EXTERNAL_ORIGIN": "SAME_ORIGIN_VIOLATION", "INVALID_URL": invalid}.get(code, "INVALID_URL")

    at, category = judged(url, None, "INVALID_URL")
    if category:
        return at, None, 0, "FAILED", category, None, False
    seen, delay, loop, status = [at], None, False, None
    for hop in range(6):
        host = at.split("/")[2].rsplit(":", 1)[0]
        if not hosts.get(host):
            return at, status, hop, "FAILED", "DNS_FAILURE", delay, loop
        if any(policy.is_unsafe(a) for a in hosts[host]):
            return at, status, hop, "FAILED", "UNSAFE_TARGET", delay, loop
        status, location, code, size = answers.get(at, (None, None, None, None))
        if status is None:
            kinds = {"ETIMEDOUT": "NETWORK_TIMEOUT", "ENOTFOUND": "DNS_FAILURE"}
            return at, None, hop, "FAILED", kinds.get(code, "UNKNOWN"), delay, loop
        if size and size > max_bytes:
            return at, status, hop, "FAILED", "RESPONSE_TOO_LARGE", delay, loop
        if status not in (301, 302, 303, 307, 308):
            return at, status, hop, "RESPONSE", None, delay, loop
        if not location or hop == 5:
            return at, status, hop, "FAILED", "INVALID_REDIRECT", delay, loop
        following, category = judged(location, at, "INVALID_REDIRECT")
        if category:
            return at, status, hop, "FAILED", category, delay, loop
        loop, at = loop or following in seen, following
        seen.append(at)
        own = "/".join(at.split("/")[:3])
        allowed, delay, failure = policy.robots_decision(BODIES.get(own, (None, None))[1], BODIES.get(own, (None, None))[0], at, "webloom/1.0")
        if failure:
            return at, status, hop + 1, "FAILED", failure, delay, loop
        if not allowed:
            return at, status, hop + 1, "SKIPPED_ROBOTS", None, delay, loop


def test_hops_against_one_request_at_a_time(spark, table):
    rng = random.Random(8)
    origins = ["https://a.example", "https://e.example", "https://d.example", "https://c.example"]
    pages = [f"{o}/{k}" for o in origins for k in range(12)]
    answers = {}
    for p in pages:
        own = "/".join(p.split("/")[:3])
        location = rng.choice([f"/{rng.randrange(12)}", f"{rng.choice(origins)}/{rng.randrange(12)}", "x/secret", "", None, "ftp://a.example/1", "https://u:p@a.example/", "http://[bad", p, f"{own}/x/y"])
        answers[p] = rng.choice([(200, None, None, 10), (rng.choice([301, 302, 303, 307, 308]), location, None, 0), (302, f"/{rng.randrange(12)}", None, 0), (302, f"/{rng.randrange(12)}", None, 0), (404, None, None, 5), (200, None, None, 10**7), (None, None, "ETIMEDOUT", None), (None, None, "E", None)])
    for k in range(8):  # a chain longer than redirects may be, and a loop of two
        answers[f"https://a.example/long{k}"] = (301, f"long{k + 1}", None, 0)
    answers |= {"https://e.example/one": (302, "/two", None, 0), "https://e.example/two": (302, "/one", None, 0)}
    hosts = {"a.example": ["93.184.216.34"], "e.example": ["93.184.216.35", "2a00:1450::1"], "c.example": ["93.184.216.36", "10.0.0.1"], "none.example": []}
    wanted = [(p, "/".join(p.split("/")[:3])) for p in [*answers, "https://a.example/unknown", "https://none.example/", "https://d.example/3", "not a url", "https://e.example/long"]]
    wanted += [("https://a.example/1", "https://e.example"), ("https://a.example/1", "https://a.example"), (None, "https://a.example")]
    requests = spark.createDataFrame(wanted, "url string, allowed_origin string")
    responses = spark.createDataFrame([(u, s, loc, e, None, n) for u, (s, loc, e, n) in answers.items()], "url string, status int, location string, error_code string, error_message string, n_bytes long")
    places = spark.createDataFrame(list(hosts.items()), "host string, addresses array<string>")
    got = [tuple(r) for r in redirects.resolve(requests, responses, places, table).collect()]
    plain = [(u, o, *plain_resolve(u or "", o, answers, hosts, 2_097_152)) for u, o in wanted]
    assert sorted(map(repr, got)) == sorted(map(repr, plain))
    assert {r[6] for r in got} >= {None, "DNS_FAILURE", "UNSAFE_TARGET", "NETWORK_TIMEOUT", "UNKNOWN", "RESPONSE_TOO_LARGE", "INVALID_REDIRECT", "SAME_ORIGIN_VIOLATION", "INVALID_URL"}
    assert {r[5] for r in got} == {"RESPONSE", "FAILED", "SKIPPED_ROBOTS"} and any(r[8] for r in got)
    assert redirects.resolve(requests.limit(0), responses, places).count() == 0
