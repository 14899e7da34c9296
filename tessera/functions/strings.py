"""String functions.  NULL in, NULL out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return rtrim(ltrim(c))


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def concat(*parts: Column) -> Column:
    """NULL parts are skipped; never NULL."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def substr(c: Column, start: int, length: int | None = None) -> Column:
    """From the 1-based ``start``; starts below 1 count as 1."""
    return F.substring(c, max(1, start), length if length is not None else 2**31 - 1)


def initcap(c: Column) -> Column:
    """A capital after anything that is no letter or digit: foo-bar is Foo-Bar."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))), "")


def split_literal(c: Column, delimiter: str) -> Column:
    """Split at a plain string, not a pattern; '' gives no elements."""
    import re

    parts = F.split(c, re.escape(delimiter), -1)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(parts)


def regexp_extract(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, NULL without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def char(c: Column) -> Column:
    """The character of a code point."""
    hexed = F.lpad(F.hex(c.cast("long")), 8, "0")
    return F.decode(F.unhex(hexed), "UTF-32")


def glob(c: Column, pattern: str) -> Column:
    """Unanchored match in which * stands for anything."""
    import re

    return c.rlike(".*".join(re.escape(p) for p in pattern.split("*")))


def space(n: Column) -> Column:
    """So many blanks; none below one."""
    return F.repeat(F.lit(" "), F.greatest(n, F.lit(0)).cast("int"))
