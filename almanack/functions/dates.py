"""Dates and date ranges in free text, as native column expressions.

A date that does not exist is null. Publish and reference dates are explicit. All results are
zone-less timestamps at midnight unless a time of day is part of the rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.base import let, strip

# Weekday brackets, range marks, body labels, imperial eras, weekday names, and the written forms below.
BRACKETED_NOTE = r"[（(][^）)\d][^）)]*[）)]"
WEEKDAY_NOTE = r"[（(][月火水木金土日祝・休]+[）)]"
RANGE_MARK = r"[～~〜]|(?<=\d)\s*[–—]\s*(?=\d)"
BODY_LABELS = r"(?:日\s*時|開催日時|日時|会期|開催期間|期間|開催日|イベント日時)"
RELEASE_LABELS = r"(?:開催日時|開催日|開催期間|日時|日程|イベント日時|期間)"
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911}
WEEKDAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
FULL_WIDTH = "０１２３４５６７８９"

FULL_KANJI = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
MONTH_DAY = r"(\d{1,2})月(\d{1,2})日"
FULL_SLASH = r"(\d{4})/(\d{1,2})/(\d{1,2})"
# Eras: a Western year, an era year with the Western one in brackets, an era year alone.
WESTERN_DAY = r"(20\d{2})年(\d{1,2})月(\d{1,2})日"
BRACKETED_YEAR = r"[（(](\d{4})[）)]"
ERA_NAMES = "|".join(k for k in ERAS if k != "大正")
ERA_WITH_YEAR = rf"(?:{ERA_NAMES})\d+[（(]\d{{4}}[）)]年(\d{{1,2}})月(\d{{1,2}})日"
ERA_DAY = rf"({ERA_NAMES})(\d+)年(\d{{1,2}})月(\d{{1,2}})日"
# Reports: a labelled line and section, a dotted day, a range in prose, days with their weekday.
LABELLED_LINE = rf"(?Ud)[■●▶◆◇・]?\s*{BODY_LABELS}\s*[：:]\s*(.{{5,120}})"
LABELLED_SECTION = rf"(?Uds)[■●▶◆◇・]?\s*{BODY_LABELS}\s*[：:]\s*(.{{1,200}})"
DOTTED_DAY = rf"(?Ui)(\d{{1,2}})\.(\d{{2}})\s*(?:{WEEKDAYS})"
PROSE_DAY = r"((?:\d{4}年)?\d{1,2}月\d{1,2}日)"
PROSE_RANGE = PROSE_DAY + r"[^\d年]{0,6}[～~〜][^\d年]{0,6}" + PROSE_DAY
KANJI_WEEKDAY = MONTH_DAY + r"[（(][月火水木金土日祝・]+[）)]"
SLASH_WEEKDAY = r"(\d{1,2})/(\d{1,2})[（(][月火水木金土日祝・]+[）)]"
# Press releases.
RELEASE_LINE = RELEASE_LABELS + r"[：:]\s*((?:\d{4}年)?\d{1,2}月\d{1,2}日[^\n。]{0,60})"
CLOCK = r"(\d{1,2})[：:](\d{2})"
# Schedules, periods, broadcast slots.
SHOW_TIME = r"\d{1,2}:\d{2}"
SCHEDULE_TOKEN = r"(?U)\d{1,2}/\d{1,2}|[～~・、]\s*\d{1,2}\b(?!/)"
PERIOD = r"(?U)(\d{1,2})/(\d{1,2})\s*(?:[～~]\s*(\d{1,2})/(\d{1,2}))?"
SLOT = r"(?Ud)(\d{1,2})月(\d{1,2})日\s+\S+?\s+(\d{1,2}):(\d{2})\s*(.+)"
# Ticket pages and store notices.
ENGLISH_DAY = rf"(?:{WEEKDAYS}),\s+[A-Z][a-z]+\s+\d{{1,2}},\s+\d{{4}}"
ENGLISH_RANGE = rf"(?U)({ENGLISH_DAY})\s*[-–]\s*({ENGLISH_DAY})"
ENGLISH_TIMES = r"(?U)(\d{1,2}:\d{2})\s*([AP])M\s*[-–]\s*(\d{1,2}:\d{2})\s*([AP])M"
JAPANESE_DAY = r"(\d{4}[年/]\d{1,2}[月/]\d{1,2}日?)"
STORE_DAY = r"(?U)◎\s*(\d{1,2})月(\d{1,2})日"
STORE_RANGE = STORE_DAY + r"[^～〜]*[～〜]\s*(\d{1,2})月(\d{1,2})日"
STORE_SAME_MONTH = STORE_DAY + r"[^～〜]*[～〜]\s*(\d{1,2})日"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, "0123456789")


def number(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def groups(c: Column, pattern: str, n: int) -> Column:
    """The first n groups of the first match as integers; nulls where there is none."""
    joined = " ".join(f"${i + 1}" for i in range(n))
    # the pattern runs over the text once; the second run is over its match alone
    return let(F.regexp_extract(c, pattern, 0), lambda found: F.when(
        found != "", F.split(F.regexp_replace(found, pattern, joined), " ").try_cast("array<int>")))


def part(g: Column, i: int) -> Column:
    return F.get(g, F.lit(i))


def moment(y: Column, m: Column, d: Column, h=None, mi=None) -> Column:
    """A zone-less timestamp, null when any part is null or out of range."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(y, m, d, zero if h is None else h, zero if mi is None else mi, zero)


def ymd(c: Column, pattern: str) -> Column:
    return let(groups(c, pattern, 3), lambda g: moment(part(g, 0), part(g, 1), part(g, 2)))


def month_day(c: Column, pattern: str, body) -> Column:
    """Bind the month and day of the first match and apply ``body(month, day)``."""
    return let(groups(c, pattern, 2), lambda g: body(part(g, 0), part(g, 1)))


def first_of(candidates: list[Column], keep) -> Column:
    """First candidate that exists and passes ``keep``."""
    return F.get(F.filter(F.array(*candidates), lambda x: F.coalesce(keep(x), F.lit(False))), F.lit(0))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


# One pattern for the five whole-string forms; the day is absent in the last one.
WHOLE_DATE = (
    r"(?U)^(\d{4})(?:/(\d{1,2})/(\d{1,2})|\.(\d{1,2})\.(\d{1,2})|-(\d{1,2})-(\d{1,2})|年(\d{1,2})月(\d{1,2})日"
    r"|\s*年\s*(\d{1,2})\s*月\s*(?:\([^)]*\)\s*)?)$"
)


def parse_date(c: Column) -> Column:
    """A whole string as a date: four numeric forms, else year and month (its first day)."""
    tidy = F.replace(strip(F.regexp_replace(strip(ascii_digits(c)), BRACKETED_NOTE, "")), F.lit("　"), F.lit(" "))

    def read(t: Column) -> Column:
        dashed = F.regexp_replace(t, WHOLE_DATE, "$1-$2$4$6$8$10-$3$5$7$9")
        return F.when(t.rlike(WHOLE_DATE), F.try_to_date(F.regexp_replace(dashed, "-$", "-1"), "y-M-d"))

    return let(tidy, read).cast("timestamp_ntz")


def parse_era(c: Column) -> Column:
    """First date of a text in Western or imperial years; a bracketed Western year wins."""
    table = F.create_map(*[F.lit(x) for kv in ERAS.items() for x in kv])

    def read(t: Column) -> Column:
        bracketed = number(t, BRACKETED_YEAR, 1)
        base = F.element_at(table, F.regexp_extract(t, ERA_DAY, 1))
        numbers = F.regexp_replace(F.regexp_extract(t, ERA_DAY, 0), f"^(?:{ERA_NAMES})", "")
        return F.coalesce(
            ymd(t, WESTERN_DAY),
            month_day(t, ERA_WITH_YEAR, lambda m, d: moment(bracketed, m, d)),
            let(groups(numbers, r"^(\d+)年(\d{1,2})月(\d{1,2})日", 3), lambda g: moment(base + part(g, 0), part(g, 1), part(g, 2))),
        )

    return let(ascii_digits(c), read)


def split_range(c: Column) -> tuple[Column, Column]:
    """Both sides of a range. Wave dashes always split, dashes only between digits, hyphens never."""
    parts = F.split(ascii_digits(c), "(?U)" + RANGE_MARK)
    return parse_date(F.get(parts, F.lit(0))), parse_date(F.get(parts, F.lit(1)))


def _labelled(raw: Column) -> Column:
    """One labelled value as struct(start, end); short ends inherit what they leave out."""
    clean = strip(F.regexp_replace(strip(raw), BRACKETED_NOTE, ""))
    only_month = r"(?U)^\d{1,2}\s*月\s*$"

    def full_end(tail: Column, start: Column) -> Column:
        year = F.concat(F.year(start).cast("string"), F.lit("年"))
        return (
            F.when(tail.rlike(r"^\d{4}"), tail)
            .when(tail.rlike(only_month) | tail.rlike(r"^\d{1,2}月"), F.concat(year, tail))
            .when(tail.rlike(r"^\d{1,2}日"), F.concat(year, F.month(start).cast("string"), F.lit("月"), tail))
            .otherwise(tail)
        )

    def end_of(full: Column) -> Column:
        month_end = full.rlike(r"(?U)年\d{1,2}\s*月\s*$")
        return let(parse_date(full), lambda e: F.when(month_end, F.last_day(e).cast("timestamp_ntz")).otherwise(e))

    def both(parts: Column) -> Column:
        tail = strip(F.get(parts, F.lit(1)))
        return let(
            parse_date(F.get(parts, F.lit(0))),
            lambda start: F.struct(
                start.alias("start"),
                F.when(start.isNotNull(), let(let(tail, lambda t: full_end(t, start)), end_of)).alias("end"),
            ),
        )

    return let(F.split(clean, "(?U)" + RANGE_MARK, 2), both)


def body_dates(c: Column) -> Column:
    """struct(start, end) of the first date label whose value parses; null when none does."""
    values = F.transform(F.regexp_extract_all(ascii_digits(c), F.lit(LABELLED_LINE), F.lit(1)), _labelled)
    return F.get(F.filter(values, lambda x: x["start"].isNotNull()), F.lit(0))


def dotted_day(c: Column, pub: Column) -> Column:
    """``10.11 Sat`` inside a labelled section, within 180 days of publishing."""
    section = F.regexp_extract(ascii_digits(c), LABELLED_SECTION, 1)
    y = F.year(pub)
    return month_day(section, DOTTED_DAY, lambda m, d: first_of(
        [moment(y + k, m, d) for k in (0, 1, -1)], lambda x: F.abs(days_between(x, pub)) <= 180))


def prose_range(c: Column, pub: Column) -> Column:
    """struct(start, end) of an unlabelled kanji range; years by nearness to publishing."""
    y = F.year(pub)

    def side(raw: Column) -> Column:
        near = month_day(raw, MONTH_DAY, lambda m, d: first_of(
            [moment(y + k, m, d) for k in (0, 1, -1)], lambda x: F.abs(days_between(x, pub)) <= 365))
        return F.when(raw.rlike(r"^\d{4}年"), parse_date(raw)).otherwise(near)

    return let(ascii_digits(c), lambda t: F.struct(
        let(F.regexp_extract(t, PROSE_RANGE, 1), side).alias("start"), let(F.regexp_extract(t, PROSE_RANGE, 2), side).alias("end")))


def prose_day(c: Column, pub: Column) -> Column:
    """First ``10月25日(土)`` of a report, at most 180 days before publishing."""
    y = F.year(pub)
    return month_day(ascii_digits(c), KANJI_WEEKDAY, lambda m, d: first_of(
        [moment(y + k, m, d) for k in (0, -1, 1)], lambda x: days_between(pub, x).between(0, 180)))


def title_day(c: Column, pub: Column) -> Column:
    """``3/17(火)`` in a title; next year when more than 30 days before publishing."""
    y = F.year(pub)
    return month_day(ascii_digits(c), SLASH_WEEKDAY, lambda m, d: F.when(
        days_between(pub, moment(y, m, d)) > 30, moment(y + 1, m, d)).otherwise(moment(y, m, d)))


def tier_dates(title: Column, body: Column, pub: Column) -> Column:
    """struct(start, end, tier): labelled, dotted, range, prose, title, else publish date.

    Later tiers are evaluated only where the earlier ones found nothing.
    """
    none = F.lit(None).cast("timestamp_ntz")

    def row(tier: str, start: Column, end: Column) -> Column:
        return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"), F.lit(tier).alias("tier")))

    span = lambda tier, x: let(x, lambda r: row(tier, r["start"], r["end"]))
    day = lambda tier, x: let(x, lambda r: row(tier, r, none))

    def best_of(text: Column, head: Column) -> Column:
        # a tier is tried only on texts with the character that its pattern can't do without
        return F.coalesce(
            F.when(text.rlike("[：:]"), span("label", body_dates(text))),
            F.when(text.contains("."), day("dotted", dotted_day(text, pub))),
            F.when(text.contains("月"), span("range", prose_range(text, pub))),
            F.when(text.contains("月"), day("prose", prose_day(text, pub))),
            F.when(head.contains("/"), day("title", title_day(head, pub))),
            day("published", pub.cast("timestamp_ntz")),
        )

    best = let(F.struct(ascii_digits(body).alias("body"), ascii_digits(title).alias("title")), lambda t: best_of(t["body"], t["title"]))
    return let(best, lambda b: F.struct(b["start"].alias("start"), F.coalesce(b["end"], b["start"]).alias("end"), b["tier"].alias("tier")))


def anchored_date(c: Column, pub: Column) -> Column:
    """Full date, else month and day near publishing (half a year either way), else publishing."""
    def near(m: Column, d: Column) -> Column:
        return moment(F.year(pub) + F.when(m < F.month(pub) - 6, 1).when(m > F.month(pub) + 6, -1).otherwise(0), m, d)

    return let(ascii_digits(c), lambda t: F.coalesce(
        ymd(t, FULL_KANJI), ymd(t, FULL_SLASH), month_day(t, MONTH_DAY, near), pub.cast("timestamp_ntz")))


def release_date(c: Column, published: Column, ref: Column) -> Column:
    """Event date of a press release: labelled, else a later full date of the last two years."""
    def timed(label: Column) -> Column:
        rest = F.regexp_extract(label, FULL_KANJI + r"([^\n]*)", 4)
        day = let(groups(label, FULL_KANJI, 3), lambda g: let(groups(rest, CLOCK, 2), lambda t: moment(
            part(g, 0), part(g, 1), part(g, 2), F.coalesce(part(t, 0), F.lit(0)), F.coalesce(part(t, 1), F.lit(0)))))
        return day

    def rolled(m: Column, d: Column) -> Column:
        this = moment(F.year(published), m, d)
        late = this < published - F.expr("interval 30 days")
        return F.when(late, moment(F.year(published) + 1, m, d)).otherwise(this)

    def read(t: Column) -> Column:
        later = F.transform(
            F.slice(F.regexp_extract_all(t, F.lit(FULL_KANJI), F.lit(0)), F.lit(2), F.lit(2_000_000_000)),
            lambda x: ymd(x, FULL_KANJI),
        )
        recent = F.get(F.filter(later, lambda x: x > ref - F.expr("interval 730 days")), F.lit(0))
        labelled = let(F.regexp_extract(t, RELEASE_LINE, 1), lambda v: F.coalesce(timed(v), month_day(v, MONTH_DAY, rolled)))
        return F.coalesce(labelled, recent, published)

    return let(ascii_digits(c), read)


def infer_year(month: Column, day: Column, ref: Column, policy: str, lookback: int = 7) -> Column:
    """Year of a month and day without one.

    ``quarter``: a month more than three behind is next year's. ``december``: in December,
    January to March are next year's. ``year``: a date over a year old is next year's.
    ``lookback``: a date older than ``lookback`` days is next year's.
    """
    y = F.year(ref)
    if policy == "quarter":
        roll = month < F.month(ref) - 3
    elif policy == "december":
        roll = (month < F.month(ref)) & (F.month(ref) == 12) & (month <= 3)
    elif policy == "year":
        roll = days_between(ref, moment(y, month, day)) > 365
    elif policy == "lookback":
        roll = moment(y, month, day) < ref - F.make_dt_interval(F.lit(lookback))
    else:
        raise ValueError(policy)
    return y + F.when(F.coalesce(roll, F.lit(False)), 1).otherwise(0)


def schedule_span(c: Column, ref: Column) -> Column:
    """struct(start, end) over all days of a screening schedule.

    Bare days belong to the month last named before them, so the tokens are folded left to
    right with that month as state.
    """
    t = F.regexp_replace(F.regexp_replace(ascii_digits(c), WEEKDAY_NOTE, ""), SHOW_TIME, "")
    tokens = F.regexp_extract_all(t, F.lit(SCHEDULE_TOKEN), F.lit(0))
    start = F.struct(F.lit(None).cast("int").alias("m"), F.array().cast("array<timestamp_ntz>").alias("days"))

    def step(acc: Column, tok: Column) -> Column:
        def grow(m: Column) -> Column:
            return let(number(tok, r"(\d{1,2})$", 1), lambda d: F.struct(
                m.alias("m"), F.array_append(acc["days"], moment(infer_year(m, d, ref, "quarter"), m, d)).alias("days")))

        return let(F.coalesce(number(tok, r"^(\d{1,2})/", 1), acc["m"]), grow)

    return let(F.aggregate(tokens, start, step)["days"], lambda days: F.struct(
        F.array_min(days).alias("start"), F.array_max(days).alias("end")))


def period_span(c: Column, ref: Column) -> Column:
    """struct(start, end) of ``4/25(土)～5/8(金)`` or one day; a smaller end month is next year's."""
    t = strip(F.regexp_replace(ascii_digits(c), WEEKDAY_NOTE, ""))

    def read(g: Column) -> Column:
        m, d, m2, d2 = (part(g, i) for i in range(4))
        y = infer_year(m, d, ref, "quarter")
        end = moment(y + F.when(m2 < m, 1).otherwise(0), m2, d2)
        return let(moment(y, m, d), lambda s: F.struct(s.alias("start"), F.when(s.isNotNull(), F.coalesce(end, s)).alias("end")))

    return let(groups(t, PERIOD, 4), read)


def broadcast_slot(c: Column, ref: Column, lookback: int = 7) -> Column:
    """struct(at, channel) of ``4月29日 水曜 25:00　channel``; hours from 24 on roll to next days."""
    def read(raw: Column) -> Column:
        def when(g: Column) -> Column:
            m, d, h, mi = (part(g, i) for i in range(4))
            at = lambda y: moment(y, m, d, F.pmod(h, F.lit(24)), mi) + F.make_dt_interval(F.floor(h / 24).cast("int"))
            stale = lambda x: x < ref - F.make_dt_interval(F.lit(lookback))
            return let(at(F.year(ref)), lambda x: F.when(stale(x), at(F.year(ref) + 1)).otherwise(x))

        head = F.regexp_replace(F.regexp_extract(ascii_digits(raw), SLOT, 0), SLOT, "$1月$2日 . $3:$4")
        slot = let(groups(head, r"^(\d+)月(\d+)日 \. (\d+):(\d+)$", 4), when)
        channel = F.regexp_extract(raw, SLOT, 5)
        return F.struct(slot.alias("at"), F.when(raw.rlike(SLOT), strip(channel)).otherwise(raw).alias("channel"))

    return let(strip(c), read)


def ticket_span(c: Column) -> Column:
    """struct(start, end) of a ticket page: English range, English day with times, Japanese day."""
    pair = lambda s, e: F.struct(s.alias("start"), e.alias("end"))

    def to_day(x: Column) -> Column:
        tidy = F.regexp_extract(F.regexp_replace(x, r"(?U)\s+", " "), r"([A-Z][a-z]{2} \d{1,2}, \d{4})$", 1)
        return F.try_to_date(F.nullif(tidy, F.lit("")), "MMM d, yyyy").cast("timestamp_ntz")

    def clock(near: Column, day_: Column, h: int) -> Column:
        text = F.concat(F.date_format(day_, "yyyy-MM-dd "), F.regexp_extract(near, ENGLISH_TIMES, h), F.lit(" "), F.regexp_extract(near, ENGLISH_TIMES, h + 1), F.lit("M"))
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd h:mm a")).cast("timestamp_ntz")

    def single(one: Column) -> Column:
        near = F.left(F.regexp_extract(c, rf"(?Us)({ENGLISH_DAY}.*)$", 1), F.lit(200))
        timed = let(near, lambda n: let(pair(clock(n, one, 1), clock(n, one, 3)), lambda t: F.when(
            t["start"].isNotNull() & t["end"].isNotNull(), t)))
        return F.coalesce(timed, pair(one, one))

    ranged = let(pair(to_day(F.regexp_extract(c, ENGLISH_RANGE, 1)), to_day(F.regexp_extract(c, ENGLISH_RANGE, 2))), lambda r: F.when(
        r["start"].isNotNull() & r["end"].isNotNull(), r))
    jp = F.regexp_extract(c, JAPANESE_DAY, 1)
    jp_day = let(jp, lambda x: F.when(x.rlike(rf"^(?:{FULL_KANJI}|\d{{4}}/\d{{1,2}}/\d{{1,2}})$"), parse_date(x)))
    return F.when(
        c.rlike(f"(?U){ENGLISH_DAY}"), F.coalesce(ranged, let(to_day(F.regexp_extract(c, rf"(?U)({ENGLISH_DAY})", 1)), single))
    ).otherwise(let(jp_day, lambda x: pair(x, x)))


def store_span(c: Column, ref: Column) -> Column:
    """struct(start, end) of a store notice marked with a double circle."""

    def span(t: Column, p: str, n: int) -> Column:
        def read(g: Column) -> Column:
            m, d = part(g, 0), part(g, 1)
            m2 = part(g, 2) if n == 4 else m
            y = infer_year(m, d, ref, "december")
            s, e = moment(y, m, d), moment(y + F.when(m2 < m, 1).otherwise(0), m2, part(g, n - 1))
            return let(F.struct(s.alias("start"), e.alias("end")), lambda r: F.when(r["start"].isNotNull() & r["end"].isNotNull(), r))

        return let(groups(t, p, n), read)

    return let(ascii_digits(c), lambda t: F.coalesce(span(t, STORE_RANGE, 4), span(t, STORE_SAME_MONTH, 3), span(t, STORE_DAY, 2)))


def with_date_hint(desc: Column, start: Column, end: Column, label: str = "開催日時: ", dash: str = " ～ ") -> Column:
    """Description led by its date line; the end is written only when it differs."""
    day = lambda x: F.date_format(x, "yyyy年MM月dd日")
    tail = F.when(end != start, F.concat(F.lit(dash), day(end))).otherwise(F.lit(""))
    line = F.concat(F.lit(label), day(start), F.coalesce(tail, F.lit("")), F.lit("\n\n"))
    return F.concat(F.coalesce(line, F.lit("")), F.coalesce(desc, F.lit("")))


def short_day(c: Column, zone: str = "Asia/Tokyo") -> Column:
    """``M/D`` in a zone; the stored value is UTC."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), c), "M/d")


def date_in_range(value: Column, start: Column, end: Column, lookback: int = 0) -> Column:
    """Whether a day lies between ``lookback`` days before the start and the end; false if any is missing."""
    day = F.to_date(value)
    return F.coalesce(day.between(F.date_sub(F.to_date(start), lookback), F.to_date(end)), F.lit(False))
