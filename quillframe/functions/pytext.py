"""Text primitives with the Unicode behaviour of Python strings, as Column expressions.

Java's classes are ASCII-only without (?U), its `$` also matches before a final
line break, and trim() knows U+0020 only; the helpers here spell things out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in Python's sense: Unicode's, and the separators U+001C to U+001F. Needs (?U).
SPACE = r"[\s\x1C-\x1F]"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in chars) + "]"


def strip(c: Column, chars: str | None = None) -> Column:
    return lstrip(rstrip(c, chars), chars)


def lstrip(c: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_class(chars) if chars else SPACE}+", "")


def rstrip(c: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(c, rf"(?U){_class(chars) if chars else SPACE}+\z", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def lines(c: Column) -> Column:
    """Lines of a text; a final line break leaves an empty last line, unlike in Python."""
    return F.split(c, _LINE_END, -1)


def norm_key(c: Column) -> Column:
    """Lower-cased words of letters and digits, separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null where there is none (or the group took no part)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def normalized(c: Column, form: str) -> Column:
    """Unicode normal form; the one thing here that Spark has no function for."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize(form, v))

    return run(c)


def ascii_letters(c: Column) -> Column:
    """Compatibility decomposition without whatever is not ASCII: é becomes e, € goes."""
    return F.regexp_replace(normalized(c, "NFKD"), r"[^\x00-\x7F]", "")
