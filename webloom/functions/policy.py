"""Crawl policy: failures, retries, robots rules, safe addresses."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls

#: Whether a failure of each category may be tried again.
RETRYABLE = {
    "HTTP_429": True, "HTTP_502": True, "HTTP_503": True, "HTTP_504": True, "NETWORK_TIMEOUT": True, "CONNECTION_RESET": True, "DNS_TEMPORARY": True,
    "UNKNOWN": True, "BROWSER_TIMEOUT": True, "BROWSER_CRASH": True, "BROWSER_NAVIGATION": True, "ROBOTS_UNREACHABLE": True, "RATE_LIMIT_UNAVAILABLE": True,
    "DNS_FAILURE": False, "RESPONSE_TOO_LARGE": False, "SAME_ORIGIN_VIOLATION": False, "INVALID_URL": False, "INVALID_REDIRECT": False,
    "UNSAFE_TARGET": False, "HTTP_PERMANENT": False, "UNSUPPORTED_CONTENT_TYPE": False, "EMPTY_CONTENT": False,
}
RETRYABLE_STATUSES = (429, 502, 503, 504)
_ERROR_CODES = {"ECONNABORTED": "NETWORK_TIMEOUT", "ETIMEDOUT": "NETWORK_TIMEOUT", "ECONNRESET": "CONNECTION_RESET", "EAI_AGAIN": "DNS_TEMPORARY", "ENOTFOUND": "DNS_FAILURE"}
#: Failures of a robots.txt fetch that stay what they are; all others become ROBOTS_UNREACHABLE.
_ROBOTS_KEPT = ("UNSAFE_TARGET", "SAME_ORIGIN_VIOLATION", "INVALID_REDIRECT", "INVALID_URL")
BASE_DELAY_MS, MAX_DELAY_MS, DAY_MS, MAX_ATTEMPTS = 1000, 60_000, 24 * 60 * 60 * 1000, 3
HTML_TYPES = ("text/html", "application/xhtml+xml")


def retryability(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(RETRYABLE.items()), "category string, retryable boolean")


def is_retryable(category: Column) -> Column:
    """What is not known may be tried again."""
    permanent = [c for c, again in RETRYABLE.items() if not again]
    return ~F.coalesce(category.isin(permanent), F.lit(False))


def classify_http(status: Column, content_type: Column, octets: Column, max_octets: int = 2 * 1024 * 1024) -> Column:
    """Failure category of a response, null for a page (or 304, which is judged elsewhere)."""
    media = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return (
        F.when(status == 304, F.lit(None).cast("string"))
        .when(status.isin(*RETRYABLE_STATUSES), F.concat(F.lit("HTTP_"), status.cast("string")))
        .when((status < 200) | (status >= 300), "HTTP_PERMANENT")
        .when(~media.isin(*HTML_TYPES), "UNSUPPORTED_CONTENT_TYPE")
        .when(octets > max_octets, "RESPONSE_TOO_LARGE")
    )


def classify_network(code: Column, message: Column) -> Column:
    """Failure category of a request that brought no response."""
    found = F.when(F.coalesce(message, F.lit("")).rlike("(?i)maxContentLength|size limit|too large"), "RESPONSE_TOO_LARGE")
    for name, category in _ERROR_CODES.items():
        found = found.when(code == name, category)
    return found.otherwise("UNKNOWN")


def classify_browser(name: Column, message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    return (
        F.when((name == "TimeoutError") | text.rlike("(?i)timeout"), "BROWSER_TIMEOUT")
        .when(text.rlike("(?i)crash|browser has been closed|target closed|target page, context or browser"), "BROWSER_CRASH")
        .otherwise("BROWSER_NAVIGATION")
    )


def classify_robots_failure(category: Column) -> Column:
    return F.when(category.isin(*_ROBOTS_KEPT), category).otherwise("ROBOTS_UNREACHABLE")


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for: seconds, or a date less ``now``; null if it asks for none."""
    trimmed = F.trim(value)
    # the weekday is stripped, as date patterns with one are rejected
    date = F.try_to_timestamp(F.regexp_replace(trimmed, r"^[A-Za-z]+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.when(trimmed.rlike(r"^\d{1,15}$"), trimmed.try_cast("bigint") * 1000)
    delay = F.when(trimmed.rlike(r"^\d+$"), F.coalesce(seconds, F.lit(DAY_MS))).otherwise(F.unix_millis(date) - F.unix_millis(now.cast("timestamp")))
    return F.when((value != "") & (delay >= 0), F.least(delay, F.lit(DAY_MS)))


def backoff_ms(attempts_made: Column, retry_after: Column | None = None) -> Column:
    """Delay before the next attempt: what the server asked for, or doubling to a limit."""
    power = F.least(F.lit(float(MAX_DELAY_MS)), BASE_DELAY_MS * F.pow(F.lit(2.0), F.greatest(attempts_made - 1, F.lit(0)))).cast("long")
    return F.coalesce(retry_after, power) if retry_after is not None else power


def is_terminal(retryable: Column, attempts_made: Column, attempts: int = MAX_ATTEMPTS) -> Column:
    return ~retryable | (attempts_made + 1 >= attempts)


# robots rules


def parse_robots(body: str) -> list[dict]:
    """Groups of a robots.txt: agents, rules (allow, pattern), crawl delay."""
    groups: list[dict] = []
    group, ruled = None, True
    for line in (body or "").replace("\r", "\n").split("\n"):
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name in ("user-agent", "useragent"):
            if ruled:
                group, ruled = {"agents": [], "rules": [], "delay": None}, False
                groups.append(group)
            group["agents"].append(value.lower())
        elif group is not None and name in ("allow", "disallow"):
            ruled = True
            if value:
                group["rules"].append((name == "allow", value))
        elif group is not None and name == "crawl-delay":
            ruled = True
            try:
                group["delay"] = float(value)
            except ValueError:
                pass
    return groups


def _own_groups(groups: list[dict], agent: str) -> list[dict]:
    product = agent.split("/", 1)[0].strip().lower()
    named = [g for g in groups if product in g["agents"]]
    return named or [g for g in groups if "*" in g["agents"]]


def _pattern(rule: str) -> re.Pattern:
    anchored = rule.endswith("$")
    body = ".*".join(re.escape(unquote(p)) for p in (rule[:-1] if anchored else rule).split("*"))
    return re.compile(body + ("$" if anchored else ""), re.S)


def robots_decision(body: str | None, status: int | None, url: str, agent: str) -> tuple[bool | None, int | None, str | None]:
    """(allowed, crawl delay in ms, failure). A robots.txt that is missing or refused (4xx) allows everything; if it can't be reached, nothing is decided."""
    if status is None or not (200 <= status < 300 or 400 <= status < 500):
        return None, None, "ROBOTS_UNREACHABLE"
    if status >= 400:
        return True, None, None
    groups = _own_groups(parse_robots(body or ""), agent)
    parts = urlsplit(url)
    path = unquote((parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
    best, allowed = -1, True
    for allow, rule in (r for g in groups for r in g["rules"]):
        if _pattern(rule).match(path) and (len(rule) > best or (len(rule) == best and allow)):
            best, allowed = len(rule), allow
    return allowed, crawl_delay_ms(groups), None


def crawl_delay_ms(groups: list[dict]) -> int | None:
    """The first delay of an agent's groups, a day at most; None where there is none or it is no such number."""
    delay = next((g["delay"] for g in groups if g["delay"] is not None), None)
    return min(int(delay * 1000), DAY_MS) if delay is not None and 0 <= delay < float("inf") else None


def robots(body: Column, status: Column, url: Column, agent: str) -> Column:
    """struct<allowed, crawl_delay_ms, failure> of each page under its origin's robots.txt."""

    @F.pandas_udf("allowed boolean, crawl_delay_ms long, failure string")
    def run(b: pd.Series, s: pd.Series, u: pd.Series) -> pd.DataFrame:
        rows = [robots_decision(x, None if pd.isna(y) else int(y), z or "", agent) for x, y, z in zip(b, s, u, strict=True)]
        frame = pd.DataFrame(rows, columns=["allowed", "crawl_delay_ms", "failure"])
        return frame.astype({"allowed": "boolean", "crawl_delay_ms": "Int64"})

    return run(body, status, url)


# safe addresses

#: Networks that a crawl must not reach.
UNSAFE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "100.64.0.0/10", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
)
UNSAFE_V6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32", "2001::/32", "2002::/16", "64:ff9b::/32", "::/96")
_V4 = tuple(map(ipaddress.ip_network, UNSAFE_V4))
_V6 = tuple(map(ipaddress.ip_network, UNSAFE_V6))


def is_unsafe(address: str | None) -> bool:
    """Whether an address is private, reserved or no address at all."""
    try:
        found = ipaddress.ip_address((address or "").strip("[]").split("%", 1)[0])
    except ValueError:
        return True
    if found.version == 6:
        if found.ipv4_mapped is not None:
            return is_unsafe(str(found.ipv4_mapped))
        return any(found in n for n in _V6)
    return any(found in n for n in _V4)


def unsafe_v4(address: Column) -> Column:
    """The same for IPv4 addresses, natively: bit tests on the address as a number; null where it is none."""
    parts = F.split(address, r"\.")
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    number = sum((parts[i].try_cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), parts[0].try_cast("bigint") * 256**3)
    unsafe = F.lit(False)
    for network in _V4:
        unsafe = unsafe | (F.shiftright(number, 32 - network.prefixlen) == int(network.network_address) >> (32 - network.prefixlen))
    return F.when(address.rlike(rf"^{octet}(\.{octet}){{3}}$"), unsafe)


def unsafe_addresses(addresses: Column) -> Column:
    """Whether any of a host's addresses is unsafe, or there is none."""

    @F.pandas_udf("boolean")
    def run(found: pd.Series) -> pd.Series:
        return pd.Series([a is None or len(a) == 0 or any(is_unsafe(x) for x in a) for a in found])

    return run(addresses)


def navigation(url: Column, page_url: Column, allowed_origin: Column, addresses: Column) -> Column:
    """struct<url, error_code> of an address that a page's browser wants to open: it must stay in the origin and lead to safe addresses only; files may be downloads."""
    found = urls.normalize_url(url, page_url, allowed_origin, reject_downloadable=False)
    unsafe = found["error_code"].isNull() & unsafe_addresses(addresses)
    return F.struct(F.when(~unsafe, found["url"]).alias("url"), F.when(unsafe, "UNSAFE_TARGET").otherwise(found["error_code"]).alias("error_code"))
