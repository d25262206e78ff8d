"""Text and timestamp expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"^[\s\x1c-\x1f\x85\p{Z}]*$"


def is_blank(text: Column) -> Column:
    """True for text made only of Unicode white space, and for empty text."""
    return text.rlike(_BLANK)


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    """Plain, case-insensitive substring test against a few fixed markers."""
    lowered = F.lower(text)
    tests = [lowered.contains(F.lit(m.lower())) for m in markers]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text; the fraction is left out when it is zero."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microseconds, as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def single_line(text: Column) -> Column:
    """Each line feed and each carriage return becomes one space."""
    return F.translate(text, "\n\r", "  ")
