"""Text functions as native columns. Whitespace is one explicit class everywhere, as engines disagree about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space.
WHITESPACE = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
_CLASS = r"\t\n\x0B\f\r    -     　﻿"
_INLINE = rf"[{_CLASS.replace(chr(92) + 'n', '')}]+"

EXCERPT_LENGTH = 500
MAX_RESPONSE_BYTES = 2 * 1024 * 1024
MAX_FAILURE_MESSAGE = 2000
MAX_JOB_PAYLOAD = 8192


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_text(text: Column) -> Column:
    """Lines trimmed, inner white space collapsed to one space, empty lines dropped."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    collapsed = F.transform(lines, lambda line: F.btrim(F.regexp_replace(line, _INLINE, " "), F.lit(" ")))
    return F.array_join(F.filter(collapsed, lambda line: line != ""), "\n")


def content_hash(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def passage_text(text: Column) -> Column:
    return _prefixed(text, "passage: ")


def query_text(text: Column) -> Column:
    return _prefixed(text, "query: ")


def _prefixed(text: Column, prefix: str) -> Column:
    """Model input: one old prefix is taken off, the wanted one put before."""
    return F.concat(F.lit(prefix), F.regexp_replace(trim(text), rf"^(?i:passage|query):[{_CLASS}]*", ""))


#: Characters that take two UTF-16 units.
_PAIRED = "[\\x{10000}-\\x{10FFFF}]"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text, in which all limits of lengths are meant."""
    return _bound(text, lambda t: F.length(t) + F.regexp_count(t, F.lit(_PAIRED)))


def utf16_prefix(text: Column, units: int | Column) -> Column:
    """The longest beginning of a text of no more than so many UTF-16 units; a pair is not parted."""
    most = F.lit(units) if isinstance(units, int) else units
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("fit"))

    def cut(x: Column) -> Column:
        # the characters that fit, counted only where there are any of two units
        def step(s: Column, c: Column) -> Column:
            used = s["used"] + 1 + F.regexp_count(c, F.lit(_PAIRED))
            return F.struct(used.alias("used"), (s["fit"] + (used <= x["most"]).cast("int")).alias("fit"))

        fit = F.aggregate(F.split(x["head"], ""), state, step, lambda s: s["fit"])
        return F.when(F.rlike(x["head"], F.lit(_PAIRED)), F.substring(x["head"], F.lit(1), fit)).otherwise(x["head"])

    return _bound(F.struct(F.substring(text, F.lit(1), most).alias("head"), most.alias("most")), cut)


def excerpt(text: Column, length: int = EXCERPT_LENGTH) -> Column:
    return utf16_prefix(text, length)


def within_byte_limit(text: Column, limit: int = MAX_RESPONSE_BYTES) -> Column:
    return F.octet_length(text) <= limit


def grounding_title(title: Column, limit: int = 200) -> Column:
    """Trimmed and cut; null if nothing is left."""
    trimmed = trim(title)
    return F.when(trimmed != "", utf16_prefix(trimmed, limit))


def bounded_message(message: Column) -> Column:
    return utf16_prefix(message, MAX_FAILURE_MESSAGE)


def bounded_payload(payload: Column) -> Column:
    """A job's JSON, or an object with the beginning of it if it is too long."""
    wrapper = len('{"truncated":true,"preview":""}')
    short = F.to_json(F.struct(F.lit(True).alias("truncated"), utf16_prefix(payload, MAX_JOB_PAYLOAD - wrapper).alias("preview")))
    return F.when(utf16_length(payload) <= MAX_JOB_PAYLOAD, payload).otherwise(utf16_prefix(short, MAX_JOB_PAYLOAD))


def title_or(document_title: Column, heading_title: Column, fallback: Column | None = None) -> Column:
    """The first of the titles that is not empty."""
    found = F.coalesce(F.nullif(document_title, F.lit("")), F.nullif(heading_title, F.lit("")))
    return F.coalesce(found, fallback) if fallback is not None else found
