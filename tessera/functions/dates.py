"""Date functions on dates or date texts; what is no date gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime token: Java pattern.
TOKENS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%%": "%"}


def to_date(c: Column) -> Column:
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def date_format(c: Column, pattern: str) -> Column:
    """By a strftime pattern."""
    out, at, plain = "", 0, ""
    while at < len(pattern):
        token = pattern[at : at + 2]
        if token in TOKENS:
            out += (f"'{plain}'" if plain else "") + TOKENS[token]
            plain, at = "", at + 2
        else:
            plain, at = plain + pattern[at].replace("'", "''"), at + 1
    return F.date_format(c, out + (f"'{plain}'" if plain else ""))


def months_between(a: Column, b: Column) -> Column:
    """Whole months apart and a 31st of the days apart."""
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    return months + (F.day(a) - F.day(b)) / F.lit(31.0)


def now() -> Column:
    """The time the query began, one for all its rows."""
    return F.current_timestamp()


def current_date() -> Column:
    return F.current_date()
