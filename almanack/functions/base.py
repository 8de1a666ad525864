"""Small Column helpers shared by every module."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s alone is ASCII; (?U) makes it the Unicode white-space class.


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(ref) -> Column:
    """An explicit reference time as a zone-less timestamp (UTC wall clock)."""
    if isinstance(ref, Column):
        return ref
    return F.lit(str(ref)).cast("timestamp_ntz")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def strip(c: Column | str) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only values."""
    return F.coalesce(~col(c).rlike(r"(?U)\S"), F.lit(True))


def has_text(c: Column | str) -> Column:
    return ~blank(c)


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; keeps nested rules small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_grams(c: Column, n: int) -> Column:
    """All runs of n characters, repeats included; linear in the length of the text."""
    def runs(chars: Column) -> Column:
        last = F.size(chars) - (n - 1)
        return F.when(last >= 1, F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), "")))

    return F.coalesce(let(F.split(c, ""), runs), F.array().cast("array<string>"))


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    return any_of(col(c).contains(w) for w in words)


def percent_half_up(part: Column, whole: Column) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(part * 100.0 / whole + F.lit(0.5)).cast("long")
