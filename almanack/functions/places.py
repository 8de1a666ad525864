"""Venue and address rules over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.base import strip

# Markers of online events, and the canonical word written for them.
ONLINE_WORD = "オンライン"
ONLINE_MARKERS = r"(?:online|オンライン|ライブ配信|配信のみ|[Zz][Oo][Oo][Mm])"

# A bracketed prefecture, as written after a venue name.
PREFECTURE_IN_BRACKETS = r"[（(][^）)]+[都道府県][）)]"

# Navigation text that follows an address.
ADDRESS_TAIL = r"会場マップ・アクセス方法はこちら.*"


def by_label(c: Column, labels: Sequence[str], least: int, most: int, cut: str | None = None) -> Column:
    """Value after ``label：`` on one line, between ``least`` and ``most`` characters.

    ``cut`` is a pattern of trailing noise; text from its first hit on is dropped.
    """
    names = "|".join(labels)
    got = F.regexp_extract(c, rf"(?U)(?:{names})\s*[：:]\s*([^\n]{{{least},{most}}})", 1)
    if cut:
        got = F.element_at(F.split(got, cut, 2), 1)
    return F.nullif(strip(got), F.lit(""))


def below_label(c: Column, labels: Sequence[str], least: int, most: int) -> Column:
    """Value after a label, on the same or on the next line."""
    names = "|".join(labels)
    got = F.regexp_extract(c, rf"(?U)(?:{names})\s*\n?\s*([^\n]{{{least},{most}}})", 1)
    return F.nullif(strip(got), F.lit(""))


def at_venue(c: Column) -> Column:
    """Venue after an at sign in a title, closing brackets removed."""
    got = F.regexp_extract(c, r"(?U)[＠@]([^\s）)]+)", 1)
    return F.nullif(F.regexp_replace(got, "[）)」]+$", ""), F.lit(""))


def override_venue(c: Column) -> Column:
    """Venue named by a "this time the venue is ..." sentence."""
    got = F.regexp_extract(c, r"(?U)※\s*会場は[、\s]*(.+?)(?:\s+です|。|$)", 1)
    return F.nullif(strip(got), F.lit(""))


def split_venue(c: Column) -> tuple[Column, Column]:
    """(name, address), split after a bracketed prefecture; without one, only a name."""
    head = F.regexp_extract(c, rf"(?s)^(.*?{PREFECTURE_IN_BRACKETS})(.*)$", 1)
    tail = F.regexp_extract(c, rf"(?s)^(.*?{PREFECTURE_IN_BRACKETS})(.*)$", 2)
    name = F.when(head != "", strip(head)).otherwise(strip(c))
    address = F.when(head != "", strip(F.regexp_replace(tail, ADDRESS_TAIL, "")))
    return F.nullif(name, F.lit("")), F.nullif(address, F.lit(""))


def online_name(place: Column, markers: str = ONLINE_MARKERS) -> Column:
    return F.when(F.coalesce(place.rlike(markers), F.lit(False)), F.lit(ONLINE_WORD)).otherwise(
        F.nullif(place, F.lit(""))
    )


def online_address(place: Column, address: Column, markers: str = ONLINE_MARKERS) -> Column:
    return F.when(F.coalesce(place.rlike(markers), F.lit(False)), F.lit(ONLINE_WORD)).otherwise(
        F.nullif(address, F.lit(""))
    )


def venue_tokens(c: Column) -> Column:
    """Tokens of two or more characters, split on spaces, commas, brackets and middle dots."""
    return F.array_distinct(
        F.filter(F.split(c, r"(?U)[\s、,（()）・]"), lambda t: F.length(t) >= 2)
    )


def venues_overlap(a: Column, b: Column) -> Column:
    """True when two venue strings share a token; a missing side gives false."""
    return F.coalesce(F.arrays_overlap(venue_tokens(a), venue_tokens(b)), F.lit(False))


# Labels in front of a place, and simplified characters with their replacements.
LABEL_PUNCTUATION = "：；:; 　"
SIMPLIFIED = "东区内园来长进实诺厅络设联馆门发会"
TRADITIONAL = "東區內園來長進實諾廳絡設聯館門發會"


def strip_label(c: Column) -> Column:
    """Blank becomes null; leading label punctuation goes."""
    cleaned = F.ltrim(F.when(c.rlike(r"(?U)\S"), c), F.lit(LABEL_PUNCTUATION))
    return F.nullif(cleaned, F.lit(""))


def to_traditional(c: Column) -> Column:
    return F.translate(c, SIMPLIFIED, TRADITIONAL)
