"""Localised values with fall-back; an empty string counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.base import empty_to_null

# The fall-back orders and the placeholders shown when nothing is set.
NAME_ORDER = ("ja", "zh", "en")
TITLE_ORDER = ("zh", "ja", "en")
UNNAMED = "（未命名）"
UNTITLED = "?"


def _first(field: str, languages) -> list[Column]:
    return [empty_to_null(f"{field}_{x}") for x in languages]


def localized_name(locale: str, field: str = "name") -> Column:
    return F.coalesce(*_first(field, [locale, *NAME_ORDER]), F.lit(UNNAMED))


def localized_description(locale: str, field: str = "description") -> Column:
    return F.coalesce(*_first(field, [locale, *NAME_ORDER]))


def localized_place(field: str, locale: str) -> Column:
    """Venue, address and hours: the translation, else the original text as it is."""
    if locale in ("zh", "en"):
        return F.coalesce(empty_to_null(f"{field}_{locale}"), F.col(field))
    return F.col(field)


def broadcast_title(locale: str) -> Column:
    """Message titles fall back in another order than listing names."""
    return F.coalesce(*_first("name", [locale, *TITLE_ORDER]), F.lit(UNTITLED))
