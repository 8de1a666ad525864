"""Row filters. Each returns a DataFrame and is a plain predicate Catalyst can push down."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.base import (
    all_of,
    any_of,
    blank,
    col,
    contains_any,
    has_text,
    instant,
    strings,
)
from almanack.functions.localized import localized_name

# The category vocabulary of the listing.
CATEGORIES = (
    "movie", "performing_arts", "senses", "drama", "retail", "nature", "tech", "tourism",
    "lifestyle_food", "books_media", "gender", "geopolitics", "art", "lecture", "taiwan_japan",
    "business", "academic", "competition", "indigenous", "history", "urban", "workshop",
    "literature", "tv_program", "exhibition", "taiwan_mandarin", "report",
)

# Address markers of the region filter.
HOME_MARKERS = ("東京", "新宿区", "港区", "渋谷区", "千代田区", "文京区", "台東区", "台北駐日")
ABROAD_MARKERS = ("台北", "台中", "台南", "高雄", "台湾", "台灣")
LOOK_ALIKES = ("台北駐日", "台湾文化センター", "台北経済文化")
ONLINE = "オンライン"


@dataclass(frozen=True)
class RegionRules:
    """Marker lists of one region filter; the admin variant has fewer of them."""

    home: tuple[str, ...] = HOME_MARKERS
    abroad: tuple[str, ...] = ABROAD_MARKERS
    look_alikes: tuple[str, ...] = LOOK_ALIKES
    online: str = ONLINE


PUBLIC_REGIONS = RegionRules()
ADMIN_REGIONS = RegionRules(home=HOME_MARKERS[:-1], look_alikes=())


def visible(df: DataFrame, flag: str = "is_active") -> DataFrame:
    return df.where(F.col(flag))


def matches(cols: Sequence[str], q: str) -> Column:
    """Case-insensitive substring over several columns; ``%`` and ``_`` act as wildcards."""
    if "%" in q or "_" in q:
        return any_of(F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False)) for c in cols)
    return any_of(F.coalesce(F.lower(c).contains(q.lower()), F.lit(False)) for c in cols)


def search(df: DataFrame, cols: Sequence[str], q: str) -> DataFrame:
    return df.where(matches(cols, q))


def admin_match(q: str, locale: str, raw_title: str = "raw_title") -> Column:
    needle = q.lower()
    raw = F.coalesce(F.col(raw_title), F.lit(""))
    return F.lower(localized_name(locale)).contains(needle) | F.lower(raw).contains(needle)


def search_admin(df: DataFrame, q: str, locale: str) -> DataFrame:
    return df.where(admin_match(q, locale))


def category_match(tags: Sequence[str], column: str = "category") -> Column:
    if len(tags) == 1:
        return F.array_contains(column, tags[0])
    return F.arrays_overlap(F.col(column), strings(tags))


def by_category(
    df: DataFrame, wanted: str, column: str = "category", vocabulary: Sequence[str] = CATEGORIES
) -> DataFrame:
    """``wanted`` is a comma list; unknown names are dropped, and none left means no filter."""
    tags = [t.strip() for t in wanted.split(",")]
    tags = [t for t in tags if t in vocabulary]
    return df.where(category_match(tags, column)) if tags else df


def is_ongoing(ref, end: str = "end_date") -> Column:
    today = instant(ref).cast("date").cast("timestamp_ntz")
    return F.col(end).isNull() | (F.col(end) >= today)


def ongoing(df: DataFrame, ref, end: str = "end_date") -> DataFrame:
    return df.where(is_ongoing(ref, end))


def starts_between(start: str = "start_date", from_=None, to=None) -> Column:
    bounds = []
    if from_:
        bounds.append(F.col(start) >= instant(from_))
    if to:
        bounds.append(F.col(start) <= instant(to))
    return all_of(bounds)


def in_range(df: DataFrame, from_=None, to=None, start: str = "start_date") -> DataFrame:
    return df.where(starts_between(start, from_, to))


def admin_range(start: str = "start_date", from_=None, to=None) -> Column:
    """The upper day is inclusive up to its last second."""
    return starts_between(start, from_, f"{to} 23:59:59" if to else None)


def in_range_admin(df: DataFrame, from_=None, to=None, start: str = "start_date") -> DataFrame:
    return df.where(admin_range(start, from_, to))


def paid_match(mode: str, column: str = "is_paid") -> Column:
    """``free`` or ``paid``; an unknown price (null) is in neither."""
    if mode == "free":
        return F.coalesce(~F.col(column), F.lit(False))
    if mode == "paid":
        return F.coalesce(F.col(column), F.lit(False))
    return F.lit(True)


def by_paid(df: DataFrame, mode: str, column: str = "is_paid") -> DataFrame:
    return df.where(paid_match(mode, column))


def region_match(
    region: str,
    rules: RegionRules = PUBLIC_REGIONS,
    address: str = "location_address",
    venue: str = "location_name",
) -> Column:
    """Public rule. A null address is in the home region; a null venue is never elsewhere."""
    a, v = F.col(address), F.col(venue)
    if region == "tokyo":
        return a.isNull() | (a == "") | contains_any(a, rules.home)
    if region == "taiwan":
        return contains_any(a, rules.abroad) & ~contains_any(a, rules.look_alikes)
    if region == "other_japan":
        near = contains_any(a, rules.home + rules.abroad)
        return a.isNotNull() & (a != "") & ~near & ~v.contains(rules.online)
    if region == "online":
        return v.contains(rules.online)
    return F.lit(True)


def by_region(df: DataFrame, region: str, **kw) -> DataFrame:
    return df.where(region_match(region, **kw))


def region_match_admin(
    region: str,
    rules: RegionRules = ADMIN_REGIONS,
    address: str = "location_address",
    venue: str = "location_name",
) -> Column:
    """Admin rule: blanks count as home, the online marker is looked for in the address."""
    a = F.coalesce(F.col(address), F.lit(""))
    v = F.coalesce(F.col(venue), F.lit(""))
    home = blank(a) | contains_any(a, rules.home)
    if region == "tokyo":
        return home
    if region == "taiwan":
        return contains_any(a, rules.abroad)
    if region == "other_japan":
        return ~home & ~a.contains(rules.online) & ~contains_any(a, rules.abroad)
    if region == "online":
        return v.contains(rules.online)
    return F.lit(True)


def by_region_admin(df: DataFrame, region: str, **kw) -> DataFrame:
    return df.where(region_match_admin(region, **kw))


def state_match(active: str = "all", annotation: str = "", source: str = "") -> Column:
    parts = []
    if active != "all":
        parts.append(F.col("is_active") if active == "active" else ~F.col("is_active"))
    if annotation:
        parts.append(F.col("annotation_status") == annotation)
    if source:
        parts.append(F.col("source_name") == source)
    return all_of(parts)


def by_state(df: DataFrame, active: str = "all", annotation: str = "", source: str = "") -> DataFrame:
    return df.where(state_match(active, annotation, source))


def upcoming(df: DataFrame, ref, days: int, n: int) -> DataFrame:
    """Active top-level rows starting within ``days``; the first ``n`` by start, then id."""
    start = F.col("start_date")
    until = instant(ref) + F.make_dt_interval(F.lit(days))
    return (
        df.where(F.col("is_active") & F.col("parent_event_id").isNull())
        .where((start >= instant(ref)) & (start <= until))
        .orderBy("start_date", "id")
        .limit(n)
    )


def relevant(df: DataFrame, cols: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Any keyword in any column, case-sensitive; column-wise so ``contains`` can push down."""
    return df.where(any_of(F.coalesce(F.col(c).contains(w), F.lit(False)) for c in cols for w in words))


def relevant_guarded(df: DataFrame, c: str, words: Sequence[str], false_hits: str) -> DataFrame:
    """A keyword must survive removal of look-alike words; the plain test runs first."""
    cleaned = F.regexp_replace(F.col(c), false_hits, "")
    return df.where(contains_any(c, words)).where(contains_any(cleaned, words))


def relevant_both(df: DataFrame, c: str, topic: str, kind: str) -> DataFrame:
    """Both patterns must occur."""
    return df.where(F.col(c).rlike(topic) & F.col(c).rlike(kind))


def reject(
    df: DataFrame, title: str, titles: Sequence[str] = (), series: str = "",
    organizer: str | None = None, organizers: Sequence[str] = (),
) -> DataFrame:
    """Drop blocked titles, blocked series and blocked organizers."""
    out = df
    if titles:
        out = out.where(~F.coalesce(contains_any(title, titles), F.lit(False)))
    if series:
        out = out.where(~F.coalesce(F.col(title).rlike(series), F.lit(False)))
    if organizer and organizers:
        out = out.where(~F.coalesce(contains_any(organizer, organizers), F.lit(False)))
    return out


def reject_context(df: DataFrame, cols: Sequence[str], pattern: str) -> DataFrame:
    """Drop rows whose text puts the topic in a "many places" context, across lines."""
    return df.where(~F.concat_ws("\n", *cols).rlike(f"(?s){pattern}"))


def reject_place(df: DataFrame, title: str, title_pattern: str, venue: str, venue_pattern: str) -> DataFrame:
    """Drop rows whose title or venue says the event is held elsewhere."""
    hit = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    return df.where(~hit(title, title_pattern) & ~hit(venue, venue_pattern))


def relevant_signals(df: DataFrame, html: str, marker: str, host: str, words: Sequence[str]) -> DataFrame:
    """Any of: a marker inside a given element, a link to a host, a keyword in the markup."""
    link = F.col(html).rlike(rf'href="[^"]*{host}')
    return df.where(F.col(html).rlike(marker) | link | contains_any(html, words))


def relevant_two_phase(df: DataFrame, title: str, body: str, words: Sequence[str]) -> DataFrame:
    """Title or body; the reader saved page loads by order, a scan does not need to."""
    t = F.coalesce(contains_any(title, words), F.lit(False))
    return df.where(t | F.coalesce(contains_any(body, words), F.lit(False)))


def fresh(df: DataFrame, ref, back: int | None, ahead: int | None, c: str = "start_date") -> DataFrame:
    """Keep rows from ``back`` days before to ``ahead`` days after the reference time."""
    out = df
    if back is not None:
        out = out.where(F.col(c) >= instant(ref) - F.make_dt_interval(F.lit(back)))
    if ahead is not None:
        out = out.where(F.col(c) <= instant(ref) + F.make_dt_interval(F.lit(ahead)))
    return out


def venue_in(df: DataFrame, venue: Column, address: Column, markers: Sequence[str]) -> DataFrame:
    """Some marker on the venue or address line; neither line means no."""
    both = F.concat_ws(" ", venue, address)
    return df.where(has_text(both) & contains_any(both, markers))


def select_queue(df: DataFrame, mode: str = "pending") -> DataFrame:
    """Rows to annotate, newest first. Reviewed rows are only ever chosen by their own mode."""
    status = F.col("annotation_status")
    names_missing = F.col("name_zh").isNull() | F.col("name_en").isNull()
    texts_missing = F.col("description_zh").isNull() | F.col("description_en").isNull()
    rules = {
        "pending": status == "pending",
        "all": (status != "reviewed") & F.col("is_active"),
        "missing": (status != "reviewed") & F.col("is_active") & (names_missing | texts_missing),
        "reviewed": (status == "reviewed") & names_missing,
    }
    return df.where(rules[mode]).orderBy(F.col("created_at").desc(), "id")


def missing(df: DataFrame, c: str) -> DataFrame:
    return df.where(blank(c))


def generic_candidates(
    df: DataFrame,
    generic: Sequence[str],
    generic_sources: Sequence[str],
    null_sources: Sequence[str],
    address: str = "location_address",
) -> DataFrame:
    """Active rows with only a prefecture-level address, plus null addresses of other sources.

    The two source lists are disjoint, so one scan with an OR gives the concatenation.
    """
    tidy = F.trim(F.regexp_replace(F.col(address), "　", " "))
    first = F.col("source_name").isin(*generic_sources) & F.coalesce(tidy.isin(*generic), F.lit(False))
    second = F.col("source_name").isin(*null_sources) & F.col(address).isNull()
    return df.where(F.col("is_active") & (first | second))


def enrich_candidates(df: DataFrame, tag: str, skip_source: str) -> DataFrame:
    return df.where(
        F.array_contains("category", tag)
        & (F.col("annotation_status") != "reviewed")
        & (F.col("source_name") != skip_source)
    )


def effective_type(own: Sequence[str] = ("peatix_organizer",), default: str = "other") -> Column:
    """Some agent categories are their own type; the rest use the type map."""
    return F.when(F.col("agent_category").isin(*own), F.col("agent_category")).otherwise(
        F.coalesce(F.col("source_type"), F.lit(default))
    )


def registry_status(choice: str) -> Column:
    if choice == "all":
        return F.lit(True)
    if choice == "has_issue":
        return F.coalesce(F.col("issue_url") != "", F.lit(False))
    return F.col("status") == choice


def filter_sources(df: DataFrame, choice: str = "all", source_type: str = "all") -> DataFrame:
    out = df.where(registry_status(choice))
    return out if source_type == "all" else out.where(effective_type() == source_type)


def flags(df: DataFrame, ref) -> DataFrame:
    """``ended`` and ``multi_day``; a missing end gives false for both."""
    s, e = F.col("start_date"), F.col("end_date")
    return df.withColumns(
        {
            "ended": F.coalesce(e < instant(ref), F.lit(False)),
            "multi_day": F.coalesce(F.to_date(e) != F.to_date(s), F.lit(False)),
        }
    )


def registry(
    df: DataFrame, status: str, kind: str, vocabulary: Sequence[str] = CATEGORIES,
    default_tag: str = "taiwan_japan",
) -> DataFrame:
    """Registry rows of one kind with profile settings: profile, then column, then default."""
    field = lambda k: F.nullif(F.get_json_object("source_profile", f"$.{k}"), F.lit(""))
    tags = F.from_json(F.get_json_object("source_profile", "$.categories"), "array<string>")
    own = F.when(F.col("category").isin(*vocabulary), F.array("category"))
    fallback = F.array(F.lit(default_tag))
    return df.where((F.col("status") == status) & (F.col("agent_category") == kind)).withColumns(
        {
            "location_name": F.coalesce(field("location_name"), F.col("name")),
            "location_address": field("location_address"),
            "tags": F.coalesce(F.when(F.size(tags) > 0, tags), own, fallback),
        }
    )


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows that lack any required value."""
    return df.where(all_of(has_text(col(c)) for c in cols))
