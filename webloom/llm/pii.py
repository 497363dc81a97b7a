"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass a check of their own are replaced by a keyed
permutation of their format: card numbers (Luhn) stay card numbers of the same
length and issuer digit, telephone numbers keep country code and separators, IP
addresses stay addresses, dates stay valid dates, and so on. The permutation is a
balanced Feistel network over the values of the format, walked on until the result
is valid again, so it is one to one: equal values get equal pseudonyms in every
document, different values different ones, and the key turns them back.

The key must be given. A value is found by its pattern at a place where no digit
or letter touches it, and replaced only if its check passes; a long number that fails
the check of card numbers is left alone.

Cases: a null text stays null and has no finds. Empty texts stay empty. Equal rows
give equal rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


@dataclass(frozen=True)
class PiiConfig:
    key: bytes


class Feistel:
    """A keyed permutation of the numbers 0 .. size-1: a balanced Feistel network on a little more than them, walked until the value is inside."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key, self.tweak, self.size = key, tweak.encode(), size
        self.half = max(2, math.isqrt(size - 1) + 1)

    def _round(self, k: int, value: int) -> int:
        data = self.tweak + b"|%d|%d|%d" % (self.size, k, value)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big") % self.half

    def _once(self, x: int, forward: bool) -> int:
        a, b = divmod(x, self.half)
        if forward:
            for k in range(ROUNDS):
                a, b = b, (a + self._round(k, b)) % self.half
        else:
            for k in reversed(range(ROUNDS)):
                a, b = (b - self._round(k, a)) % self.half, a
        return a * self.half + b

    def walk(self, x: int, forward: bool = True, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The next valid value after ``x`` on the permutation's cycle."""
        while True:
            x = self._once(x, forward)
            if x < self.size and valid(x):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _luhn_digit(digits: str) -> str:
    return next(c for c in "0123456789" if luhn(digits + c))


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _digits(shape: str) -> str:
    return "".join(c for c in shape if c.isdigit())


def _card(value: str, key: bytes, forward: bool) -> str | None:
    """Keep the first digit, permute the rest, and set the check digit anew."""
    d = _digits(value)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = d[1:-1]
    new = d[0] + str(Feistel(key, "card" + d[0], 10 ** len(body)).walk(int(body), forward)).zfill(len(body))
    return _refill(value, new + _luhn_digit(new))


def _phone(value: str, key: bytes, forward: bool) -> str | None:
    """Keep the country code; the national number is permuted, its area code not starting with 0 if it did not."""
    code = re.match(r"\+\d{1,3}", value)
    head = code[0] if code else ""
    d = _digits(value[len(head) :])
    if not 7 <= len(d) <= 12:
        return None
    zero = d[0] == "0"
    new = Feistel(key, "phone" + head, 10 ** len(d)).walk(int(d), forward, lambda x: (str(x).zfill(len(d))[0] == "0") == zero)
    return head + _refill(value[len(head) :], str(new).zfill(len(d)))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(value: str, key: bytes, forward: bool) -> str | None:
    d = _digits(value)
    if not _ssn_valid(d):
        return None
    new = Feistel(key, "ssn", 10**9).walk(int(d), forward, lambda x: _ssn_valid(str(x).zfill(9)))
    return _refill(value, str(new).zfill(9))


def _ip(value: str, key: bytes, forward: bool) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if any(p > 255 or (len(s) > 1 and s[0] == "0") for p, s in zip(parts, value.split("."), strict=True)):
        return None
    new = Feistel(key, "ip", 2**32).walk(int.from_bytes(bytes(parts), "big"), forward)
    return ".".join(map(str, new.to_bytes(4, "big")))


_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(value: str, key: bytes, forward: bool) -> str | None:
    """Dates of 1900 to 2099, year first or last; the order of the parts and the separator stay."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", value))
    mark = re.search(r"[-/.]", value)[0]
    orders = {"ymd": (a, b, c)} if len(re.split(r"[-/.]", value)[0]) == 4 else ({"dmy": (c, b, a)} if mark == "." else {"mdy": (c, a, b), "dmy": (c, b, a)})
    for order, (y, m, d) in orders.items():
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            continue
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None

        def readable(x: int, order: str = order) -> bool:
            """A day-first date must not read as a month-first one, or it would not turn back."""
            return order != "dmy" or mark == "." or datetime.date.fromordinal(_FIRST_DAY + x).day > 12

        new = Feistel(key, "date" + order + mark, _LAST_DAY - _FIRST_DAY + 1).walk(day - _FIRST_DAY, forward, readable)
        t = datetime.date.fromordinal(_FIRST_DAY + new)
        parts = {"y": f"{t.year:04d}", "m": f"{t.month:02d}", "d": f"{t.day:02d}"}
        return mark.join(parts[o] for o in order)
    return None


def _iban_ok(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban(value: str, key: bytes, forward: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or not _iban_ok(plain):
        return None
    body, country = plain[4:], plain[:2]
    new = _permute_text(body, key, "iban" + country, forward)
    check = 98 - int("".join(str(int(c, 36)) for c in new + country + "00")) % 97
    rest = iter(f"{country}{check:02d}{new}")
    return "".join(c if c == " " else next(rest) for c in value)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _permute_text(value: str, key: bytes, tweak: str, forward: bool) -> str:
    """Digits become digits, letters letters of the same case; other characters stay."""
    owners = [next((a for a in _ALPHABETS if c in a), None) for c in value]
    size = x = 0
    for c, a in zip(value, owners, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), (size or 1) * len(a)
    if not size:
        return value
    shape = "".join("-" if a is None else str(_ALPHABETS.index(a)) for a in owners)
    x = Feistel(key, f"{tweak}:{shape}", size).walk(x, forward)
    out = []
    for c, a in zip(reversed(value), reversed(owners), strict=True):
        if a:
            x, k = divmod(x, len(a))
            out.append(a[k])
        else:
            out.append(c)
    return "".join(reversed(out))


def _email(value: str, key: bytes, forward: bool) -> str:
    local, _, domain = value.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{_permute_text(local, key, 'mail', forward)}@{_permute_text(host, key, 'host', forward)}.{top}"


def _secret(value: str, key: bytes, forward: bool) -> str:
    """Keys and tokens: hexadecimal ones stay hexadecimal."""
    if re.fullmatch(r"[0-9a-f]+", value):
        return format(Feistel(key, "hex", 16 ** len(value)).walk(int(value, 16), forward), "x").zfill(len(value))
    head = re.match(r"AKIA|ghp_|sk-|", value)[0]
    return head + _permute_text(value[len(head) :], key, "secret" + head, forward)


#: Kind, pattern, and the function that gives the pseudonym or None if the value fails its check. In order of precedence.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])", _email),
    ("secret", r"(?<!\w)(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?!\w)", _secret),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    ("date", r"(?<![\w.-])(?:(?:19|20)\d\d([-/.])\d\d\1\d\d|\d\d([-/.])\d\d\2(?:19|20)\d\d)(?![\w-])", _date),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)", _phone),
    ("phone", r"(?<![\w+])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\w)", _phone),
    ("card", r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)", _card),
)
NAMES = tuple(dict.fromkeys(k for k, _, _ in KINDS))
_PATTERNS = tuple((k, re.compile(p), f) for k, p, f in KINDS)
_HINT = re.compile(r"@|\d[\d .()/-]{5}|[0-9a-f]{32}|AKIA|ghp_|sk-|[A-Z]{2}\d\d")


@functools.lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, rule: int, value: str, key: bytes, forward: bool = True) -> str | None:
    return _PATTERNS[rule][2](value, key, forward)


def pseudonymise(text: str, key: bytes, forward: bool = True) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with every validated value replaced, and (kind, value, pseudonym) of each in order."""
    if not _HINT.search(text):
        return text, []
    taken: list[tuple[int, int, str, str, str]] = []  # in order, and apart
    for rule, (kind, pattern, _) in enumerate(_PATTERNS):
        for m in pattern.finditer(text):
            at = bisect.bisect_left(taken, (m.end(),))
            if at and taken[at - 1][1] > m.start():
                continue
            new = pseudonym(kind, rule, m[0], key, forward)
            if new is not None:
                taken.insert(at, (m.start(), m.end(), kind, m[0], new))
    if not taken:
        return text, []
    out, at = [], 0
    for a, b, _, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(k, v, n) for _, _, k, v, n in taken]


def _replace(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_found", *(f"n_{k}" for k in NAMES), "pseudonyms", "text"]
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            texts, counts, found = [], {k: [] for k in NAMES}, []
            for t in part.column(1).to_pylist():
                new, got = pseudonymise(t, key) if t is not None else (None, [])
                texts.append(new)
                found.append([n for _, _, n in got])
                for k in NAMES:
                    counts[k].append(sum(g[0] == k for g in got))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(f) for f in found], pa.int64()), *(pa.array(counts[k], pa.int64()) for k in NAMES), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names,
            )


def replace(documents: DataFrame, config: PiiConfig) -> DataFrame:
    """doc_id, counts of replaced values by kind, the pseudonyms in order, and the new text of every row."""
    counts = ", ".join(f"n_{k} long" for k in NAMES)
    schema = f"doc_id long, n_found long, {counts}, pseudonyms array<string>, text string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _replace(it, config.key), schema)
