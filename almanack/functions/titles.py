"""Title rules: brackets, report suffixes, original titles, title replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.base import strip

# Bracket pairs that may enclose a title, in the order they are tried.
TITLE_BRACKETS = (("《", "》"), ("「", "」"), ("『", "』"), ("‘", "’"), ("“", "”"), ("'", "'"), ('"', '"'))

# Words that end a report title. Inner white space is tolerated.
EVENT_WORDS = ("トークイベント", "イベント")
REPORT_WORDS = ("レポート", "レビュー", "報告", "まとめ", "振り返り", "記録", "紀錄", "recap", "report", "review")


def bracketed(c: Column) -> Column:
    """Text of the first corner-bracket pair, trimmed; null when there is none."""
    return F.nullif(strip(F.regexp_extract(c, "[『「](.+?)[』」]", 1)), F.lit(""))


def bracket_title(c: Column) -> Column:
    """Text of the first corner-bracket pair, else the whole title."""
    inner = F.regexp_extract(c, "[「『]([^」』]+)[」』]", 1)
    return F.when(inner != "", strip(inner)).otherwise(c)


def _spaced(word: str) -> str:
    return r"\s*".join(word)


def report_suffix() -> str:
    talk, plain = EVENT_WORDS
    event = f"(?:{_spaced(talk)}|{plain})?"
    first, rest = REPORT_WORDS[0], REPORT_WORDS[1:]
    report = f"(?:{_spaced(first)}|{'|'.join(rest)})"
    return rf"(?Uis)\s*{event}\s*{report}[^\n]*$"


def strip_report(c: Column) -> Column:
    """Cut a report suffix and whatever follows it on the last line."""
    return strip(F.regexp_replace(c, report_suffix(), ""))


def report_fragment(c: Column) -> Column:
    """Search term of a report title: its last dash segment, or all of it when that is short.

    Null when fewer than four characters remain.
    """
    base = strip_report(c)
    tail = strip(F.element_at(F.split(base, r"(?U)\s*[-－—]\s*"), -1))
    term = F.when(F.length(tail) < 4, base).otherwise(tail)
    return F.when(F.length(base) >= 4, term)


def split_title(c: Column) -> tuple[Column, Column]:
    """(CJK title, Latin title) of an "original title" line; nulls where a part is absent."""
    line = strip(F.regexp_extract(c, r"原題(?:または英題)?[：:]\s*([^\n]+)", 1))
    pair = r"^([^\x00-\x7f]+)\s+([A-Za-z].+)$"
    cjk, latin = F.regexp_extract(line, pair, 1), F.regexp_extract(line, pair, 2)
    both = cjk != ""
    has_cjk = line.rlike("[\\u4e00-\\u9fff]")
    some = line != ""
    zh = F.when(both, strip(cjk)).when(some & has_cjk, line)
    en = F.when(both, strip(latin)).when(some & ~has_cjk, line)
    return zh, en


def swap_title(c: Column, olds: list[Column], new: Column) -> Column:
    """Replace old titles, but only where a bracket pair encloses them."""

    def one(text: Column, old: Column) -> Column:
        usable = F.coalesce((old != "") & (old != new), F.lit(False))
        swapped = reduce(
            lambda t, b: F.replace(
                t,
                F.concat(F.lit(b[0]), old, F.lit(b[1])),
                F.concat(F.lit(b[0]), new, F.lit(b[1])),
            ),
            TITLE_BRACKETS,
            text,
        )
        return F.when(usable, swapped).otherwise(text)

    return reduce(one, olds, c)
