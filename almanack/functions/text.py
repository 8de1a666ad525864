"""Cleaning, cutting, slugs, block parsing and report text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.base import let, strip, strings

# Section markers after which a page's own text has ended.
NOISE_MARKERS = ("Q&A イベントについて", "近くの看板", "近くのイベント", "地図検索に切り替えて")


def cut_at(c: Column, markers: Sequence[str] = NOISE_MARKERS) -> Column:
    """Text before each marker in turn, trimmed."""
    return strip(reduce(lambda t, m: F.substring_index(t, m, 1), markers, c))


def blank_null(c: Column) -> Column:
    return F.when(c.rlike(r"(?U)\S"), c)


def cut(c: Column, n: int) -> Column:
    """The first n characters, where the rule itself is a length limit."""
    return F.left(c, F.lit(n))


def slug(c: Column, n: int = 60) -> Column:
    """Word characters and CJK kept, the rest folded to single underscores, at most n long."""
    t = F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w぀-ヿ一-鿿]+", "_")
    return F.left(F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", ""), F.lit(n))


def snake(c: Column, suffix: str = "Scraper") -> Column:
    """Class name to key: suffix dropped, words split at capitals."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"{suffix}$", ""), "(?<!^)(?=[A-Z])", "_"))


def prices(c: Column) -> Column:
    """All price runs, distinct, joined; null when there is none."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)[¥￥][\d,，]+[^\s　]{0,20}"), F.lit(0)))
    return F.when(F.size(found) > 0, F.array_join(found, " / "))


def ticket_paid(c: Column) -> Column:
    """False for a zero price or a free word, true for any other ticket text, null without."""
    return F.when(c.isNotNull(), ~c.rlike(r"(?U)[¥￥]0\b|無料"))


# Words of the two price tests; free words win.
FREE_WORDS = ("無料", "入場無料", "参加無料", "free")
PAID_WORDS = ("有料", "入場料", "料金", "円", "¥", "費用")
FREE_WORDS_ANY_CASE = ("無料", "free", "免費", "免费")
PAID_WORDS_ANY_CASE = ("有料", "入場料", "料金", "円", "¥", "yen", "paid", "費用")


def is_paid(c: Column, free: Sequence[str] = FREE_WORDS, paid: Sequence[str] = PAID_WORDS, any_case: bool = False) -> Column:
    t = F.lower(c) if any_case else c
    hit = lambda words: F.exists(strings(words), lambda w: F.contains(t, w))
    return F.when(hit(free), F.lit(False)).when(hit(paid), F.lit(True))


def lines_of(c: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(c, "\r\n|\r|\n"), strip), lambda x: x != "")


def label_block(c: Column, labels: Sequence[str], most: int = 3) -> Column:
    """Array of struct(label, value): a label alone on a line, then up to ``most`` other lines."""
    alone = rf"^({'|'.join(labels)})[：:]?$"

    def until_label(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda r: r.rlike(alone)), F.lit(True)).cast("int")
        return F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)

    def blocks(lines: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            kept = let(F.slice(lines, i + 2, F.lit(most)), until_label)
            return F.when(
                x.rlike(alone),
                F.struct(F.regexp_extract(x, alone, 1).alias("label"), F.array_join(kept, "\n").alias("value")),
            )

        return F.filter(F.transform(lines, value), lambda e: e["value"] != "")

    return let(lines_of(c), blocks)


def label_value(blocks: Column, label: str) -> Column:
    """Value of a label; of several blocks the last one counts."""
    return F.try_element_at(F.filter(blocks, lambda e: e["label"] == label), F.lit(-1))["value"]


def next_line(c: Column, labels: Sequence[str]) -> Column:
    """Array of struct(label, value) from label/value line pairs."""
    known = strings(labels)

    def blocks(lines: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            nxt = F.get(lines, i + 1)
            good = F.array_contains(known, x) & nxt.isNotNull() & ~F.array_contains(known, nxt)
            return F.when(good, F.struct(x.alias("label"), nxt.alias("value")))

        return F.filter(F.transform(lines, value), lambda e: e.isNotNull())

    return let(lines_of(c), blocks)


def card_fields(lines: Column, prefectures: Sequence[str]) -> Column:
    """struct(prefecture, title, bullets, station) of a card's text lines."""
    known = strings(prefectures)
    tidy = F.transform(lines, strip)
    tail = lambda n: F.reverse(F.slice(tidy, F.greatest(F.size(tidy) - n + 1, F.lit(1)), F.lit(n)))
    pref = F.filter(tail(8), lambda x: F.array_contains(known, x) & ~x.contains("駅") & ~x.startswith("-"))
    body = F.filter(tidy, lambda x: (x != "") & ~x.startswith("-"))
    bullet = F.transform(F.filter(tidy, lambda x: x.startswith("-")), lambda x: strip(F.ltrim(x, F.lit("- "))))
    station = F.filter(tail(5), lambda x: x.contains("駅"))
    return F.struct(
        F.coalesce(F.get(pref, F.lit(0)), F.lit("")).alias("prefecture"),
        F.coalesce(F.get(body, F.lit(1)), F.get(body, F.lit(0)), F.lit("")).alias("title"),
        F.array_join(bullet, "\n").alias("bullets"),
        F.get(station, F.lit(0)).alias("station"),
    )


def json_pick(c: Column, field: str, locale: str) -> Column:
    """A localised JSON field: the plain value, or its entry for the locale; '' when nested deeper."""
    raw = F.get_json_object(c, f"$.{field}")
    entry = F.get_json_object(c, f"$.{field}.{locale}")
    nested = raw.startswith("{")
    deeper = entry.startswith("{") | entry.startswith("[")
    picked = F.when(nested, F.when(deeper, F.lit("")).otherwise(entry)).otherwise(raw)
    return F.coalesce(picked, F.lit(""))


def status_icon(rate: Column) -> Column:
    return F.when(rate == 1.0, F.lit("✅")).when(rate >= 0.5, F.lit("⚠")).otherwise(F.lit("❌"))


def report_line(source: Column, events: Column, runs: Column, rate: Column) -> Column:
    """One line of the weekly report; the percentage is cut, not rounded."""
    return F.format_string(
        "  %s %s: %d 件 (%d 次, 成功率 %d%%)", status_icon(rate), source, events, runs, F.floor(rate * 100).cast("int")
    )


# The lines above the sources of a weekly report.
REPORT_HEAD = "📅 %s ～\n\n🆕 本週新增事件: %d 件\n⏳ 待標注: %d 件\n💰 本週費用: $%.6f\n🔄 執行次數: %d 次\n\n📋 各來源狀態:"


def report_head(day: Column, new: Column, pending: Column, cost: Column, runs: Column) -> Column:
    """Period, new and pending events, cost and number of runs."""
    return F.format_string(REPORT_HEAD, day, new, pending, F.bround(cost, 6), runs)
