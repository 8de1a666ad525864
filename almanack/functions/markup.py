"""Plain text and key/value pairs from HTML.

Tag removal is native. Entity decoding and element structure need a parser, which runs on
Arrow batches with the standard library.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.base import strip

HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>"


def strip_tags(c: Column, with_: str = "") -> Column:
    return F.regexp_replace(c, r"<[^>]+>", with_)


def _unescape(c: Column) -> Column:
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return apply(c)


def html_text(c: Column, mode: str = "plain") -> Column:
    """Text of a page.

    ``plain``: tags out, trimmed. ``spaced``: tags become spaces, entities decoded, white space
    collapsed. ``lines``: line breaks kept, entities decoded, blank lines dropped. ``visible``:
    as ``spaced``, without scripts and styles.
    """
    if mode == "plain":
        return strip(strip_tags(c))
    if mode == "lines":
        broken = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
        rows = F.transform(F.split(_unescape(strip_tags(broken)), "\r\n|\r|\n"), strip)
        return F.array_join(F.filter(rows, lambda x: x != ""), "\n")
    if mode == "visible":
        c = F.regexp_replace(c, HIDDEN, " ")
    elif mode != "spaced":
        raise ValueError(mode)
    return strip(F.regexp_replace(_unescape(strip_tags(c, " ")), r"(?U)\s+", " "))


class _Pairs(HTMLParser):
    """Collects text of key cells and of the value cell that follows each of them."""

    KEYS, VALUES = {"dt", "th"}, {"dd"}

    def __init__(self) -> None:
        super().__init__()
        self.pairs: dict[str, str] = {}
        self._key, self._open, self._text, self._cells = None, None, [], []

    def _close(self) -> None:
        if self._open is None:
            return
        text = re.sub(r"\s+", " ", "".join(self._text)).strip()
        if self._open in self.KEYS:
            self._key = text
        elif self._open in self.VALUES and self._key:
            self.pairs[self._key] = text
            self._key = None
        if self._open in ("td", "th"):
            self._cells.append(text)
        self._open, self._text = None, []

    def _end_row(self) -> None:
        self._close()
        if len(self._cells) >= 2 and self._cells[0]:
            self.pairs[self._cells[0]] = self._cells[1]
        self._cells = []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._end_row()
        if tag in ("dt", "dd", "td", "th"):
            self._close()
            self._open = tag

    def handle_endtag(self, tag):
        if tag == self._open:
            self._close()
        if tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data):
        if self._open:
            self._text.append(data)


def _pairs(page: str) -> dict[str, str]:
    p = _Pairs()
    p.feed(page)
    p.close()
    p._end_row()
    return p.pairs


def html_kv(c: Column) -> Column:
    """Key/value map of definition lists (dt/dd) and of tables (first and second cell)."""

    @F.pandas_udf("map<string,string>")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(_pairs, na_action="ignore")

    return apply(c)
