"""URL normalisation by the URL standard, with one error code for what a crawl must not follow."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import WHITESPACE

MAX_URL_LENGTH = 2048
#: Extensions of resources that are no pages.
DOWNLOADABLE = frozenset(
    "7z apk avi bin bmp bz2 class css csv doc docx dmg epub exe gif gz ico iso jar jpeg jpg js json m4a mkv mov mp3 mp4 mpeg mpg msi ogg ogv pdf png "
    "ppt pptx rar rss svg tar tgz tif tiff tsv wav webm webp woff woff2 xls xlsx xml xz zip".split()
)
_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")


class UrlError(ValueError):
    """Why a URL was not accepted; ``code`` is one of seven fixed values."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class Parts:
    """A parsed URL."""

    def __init__(self, scheme, username="", password="", host=None, port="", path="", query=None, opaque=False):
        self.scheme, self.username, self.password, self.host, self.port = scheme, username, password, host, port
        self.path, self.query, self.opaque = path, query, opaque

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port else "") if self.scheme in _PORTS else "null"

    def __str__(self) -> str:
        auth = f"//{self.username + (':' + self.password if self.password else '') + '@' if self.username or self.password else ''}{self.host}{':' + self.port if self.port else ''}" if self.host is not None else ""
        return f"{self.scheme}:{auth}{self.path}" + (f"?{self.query}" if self.query is not None else "")


def _encode(value: str, keep: str) -> str:
    return quote(value, safe=keep + "%", encoding="utf-8", errors="replace")


_PATH_KEEP = "!$&'()*+,-./:;=@_~[]|\\^"
_QUERY_KEEP = "!$&()*+,-./:;=@_~?[]|\\^`{}"


def _host(raw: str) -> str:
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise ValueError("host")
        return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
    host = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), raw)
    if not host or re.search(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]", host):
        raise ValueError("host")
    if not host.isascii():
        host = host.encode("idna").decode()
    host = host.lower()
    last = host.rstrip(".").rsplit(".", 1)[-1]
    if last and (last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last)):
        return _ipv4(host)
    return host


def _ipv4(host: str) -> str:
    numbers = []
    for part in host.rstrip(".").split("."):
        base = 16 if part.startswith("0x") else 8 if len(part) > 1 and part[0] == "0" else 10
        numbers.append(int(part[2:] or "0", 16) if base == 16 else int(part, base))
    if not numbers or len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError("ipv4")
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _squash(path: str) -> str:
    """Resolve dot segments of an absolute path."""
    out: list[str] = []
    segments = path.split("/")[1:]
    for i, segment in enumerate(segments):
        plain = segment.lower().replace("%2e", ".")
        last = i == len(segments) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(segment)
    return "/" + "/".join(out)


def parse(value: str, base: Parts | None = None) -> Parts:
    """Parse an absolute URL, or one relative to ``base``. ValueError if it is none."""
    value = re.sub(r"[\t\n\r]", "", value.strip("".join(map(chr, range(33)))))
    value = value.split("#", 1)[0]
    found = _SCHEME.match(value)
    if found:
        scheme, rest = found[1].lower(), value[found.end() :]
        if scheme not in _PORTS:
            if rest.startswith("//"):
                authority, slash, path = rest[2:].partition("/")
                return Parts(scheme, host=authority, path=slash + path)
            return Parts(scheme, path=rest, opaque=True)
        slashed = rest.replace("\\", "/")
        if base is not None and base.scheme == scheme and not slashed.startswith("/"):
            return _relative(rest, base)
        return _authority(scheme, rest)
    if base is None or base.opaque:
        raise ValueError("relative")
    return _relative(value, base)


def _authority(scheme: str, rest: str) -> Parts:
    head, mark, query = rest.partition("?")
    head = head.replace("\\", "/").lstrip("/")
    authority, slash, path = head.partition("/")
    user, at, host_port = authority.rpartition("@")
    username, _, password = user.partition(":") if at else ("", "", "")
    match = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", host_port)
    if not match:
        raise ValueError("authority")
    host, port = _host(match[1]), match[2] or ""
    if port:
        if int(port) > 65535:
            raise ValueError("port")
        port = str(int(port))
    port = "" if port == _PORTS[scheme] else port
    return Parts(scheme, username, password, host, port, _encode(_squash("/" + path), _PATH_KEEP), _encode(query, _QUERY_KEEP) if mark else None)


def _relative(value: str, base: Parts) -> Parts:
    head, mark, query = value.partition("?")
    head = head.replace("\\", "/")
    new_query = _encode(query, _QUERY_KEEP) if mark else None
    if head.startswith("//"):
        return _authority(base.scheme, value)
    if head.startswith("/"):
        path = _encode(_squash(head), _PATH_KEEP)
    elif head:
        path = _encode(_squash(base.path.rsplit("/", 1)[0] + "/" + head), _PATH_KEEP)
    else:
        path, new_query = base.path, new_query if mark else base.query
    return Parts(base.scheme, base.username, base.password, base.host, base.port, path, new_query)


def downloadable(path: str) -> bool:
    path = path.lower()
    name = path.rsplit("/", 1)[-1]
    return path.endswith(".tar.gz") or ("." in name and name.rsplit(".", 1)[-1] in DOWNLOADABLE)


def origin(url: str) -> str:
    """Scheme, host and non-default port."""
    return parse(url).origin


def _units(value: str) -> int:
    return len(value) + sum(ord(c) > 0xFFFF for c in value)


def normalize(value: str, base_url: str | None = None, allowed_origin: str | None = None, reject_downloadable: bool = True) -> str:
    """The normal form of a URL that a crawl may follow; UrlError otherwise, errors taking precedence in a fixed order."""
    value = (value or "").strip(WHITESPACE)
    if not value:
        raise UrlError("EMPTY_URL")
    if _units(value) > MAX_URL_LENGTH:
        raise UrlError("URL_TOO_LONG")
    try:
        parts = parse(value, parse(base_url) if base_url else None)
    except (ValueError, UnicodeError) as error:
        raise UrlError("INVALID_URL") from error
    if parts.scheme not in ("http", "https"):
        raise UrlError("UNSUPPORTED_PROTOCOL")
    if parts.username or parts.password:
        raise UrlError("CREDENTIALS_NOT_ALLOWED")
    if allowed_origin and parts.origin != origin(allowed_origin):
        raise UrlError("EXTERNAL_ORIGIN")
    if reject_downloadable and downloadable(parts.path):
        raise UrlError("DOWNLOADABLE_URL")
    found = str(parts)
    if _units(found) > MAX_URL_LENGTH:
        raise UrlError("URL_TOO_LONG")
    return found


def try_normalize(value: str | None, **options) -> tuple[str | None, str | None]:
    """(url, null) or (null, error code)."""
    try:
        return normalize(value or "", **options), None
    except UrlError as error:
        return None, error.code


def normalize_url(url: Column, base_url: Column | None = None, allowed_origin: Column | None = None, reject_downloadable: bool = True) -> Column:
    """struct<url, error_code> for each row."""

    def one(u, b, o) -> dict:
        found, code = try_normalize(u, base_url=b or None, allowed_origin=o or None, reject_downloadable=reject_downloadable)
        return {"url": found, "error_code": code}

    @F.pandas_udf("url string, error_code string")
    def run(u: pd.Series, b: pd.Series, o: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(u, b, o, strict=True)], columns=["url", "error_code"])

    empty = F.lit(None).cast("string")
    return run(url, base_url if base_url is not None else empty, allowed_origin if allowed_origin is not None else empty)


def url_origin(url: Column) -> Column:
    """Origin of an already normalised or plain http(s) URL, natively: lower-case host, no default port."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)", 1)
    default = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("")
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise("")))
