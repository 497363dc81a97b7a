"""Words of a text as a full-text store's default parser tells them apart, in order of place.

Beside plain words, an address with a path gives three words (all of it, the host, the
path), a host one, a hyphenated word itself and then its parts, an e-mail address one, and
a number its sign, points and all. Everything is lower-cased; a protocol is no word.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}]"
_HOST = rf"(?={_W}[\p{{L}}\p{{N}}-]*+\.){_W}++(?:[.-]{_W}++)*+(?<=\.\p{{L}}{{2,63}})"
#: What begins where no word is going on, so that a long run is tried once: e-mail address, address with path, host, hyphenated word, number.
_COMPOUND = (
    rf"(?<![\p{{L}}\p{{N}}._@/-])(?={_W}*+[._@:+-])(?:"
    rf"({_W}++(?:[._-]++{_W}++)*+@{_W}++(?:[.-]{_W}++)*+)"
    rf"|(?:[a-z]{{2,8}}://)?+(?:({_HOST})(?::\d++)?+(/[^\s<>\"'(){{}}\[\]]*+)|({_HOST}))"
    rf"|(\p{{L}}[\p{{L}}\p{{N}}]*+(?:-{_W}++)++)"
    rf"|([+-]?+\d++(?:\.\d++)++(?!{_W}))"
    r")"
)
#: Whole words stand between these marks while a text is taken apart.
_OPEN, _CLOSE = "\u0001", "\u0002"
_PARTED = " {0}$1{1}{0}$2$3{1}{0}$2{1}{0}$3{1}{0}$4{1}{0}$5{1} $5 {0}$6{1} ".format(_OPEN, _CLOSE)
_WORDS = rf"(?<={_OPEN})[^{_CLOSE}]++(?={_CLOSE})|(?<!{_OPEN}){_W}++"


def lexemes(value: Column) -> Column:
    """The words of a text, each at its place; null counts as empty."""
    plain = F.translate(F.lower(F.coalesce(value, F.lit(""))), _OPEN + _CLOSE, "  ")
    return F.regexp_extract_all(F.regexp_replace(plain, _COMPOUND, _PARTED), F.lit(_WORDS), F.lit(0))


def query_lexemes(spark: SparkSession, query: str) -> list[str]:
    """The distinct words of a query, in order."""
    return list(dict.fromkeys(spark.range(1).select(lexemes(F.lit(query))).first()[0]))
