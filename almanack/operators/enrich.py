"""Jobs that change stored rows: annotation, translation, labels, places, reports, archive.

Each returns the new state of the table (or only the changed rows, where stated). Landed
results of outside services come in as DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.base import blank, empty_to_null, has_text, instant, strings
from almanack.functions.places import strip_label, to_traditional
from almanack.functions.tags import inject_labels, valid_labels
from almanack.functions.text import blank_null, cut, cut_at
from almanack.functions.titles import bracket_title, swap_title
from almanack.operators.joins import left_by_key
from almanack.operators.sets import tags_added, tags_union


# -- archive and flags -------------------------------------------------------------------------

def is_ended(ref) -> Column:
    """Active, ended before yesterday's midnight (UTC); an open end never counts."""
    cutoff = F.date_sub(instant(ref).cast("date"), 1).cast("timestamp_ntz")
    return F.coalesce(F.col("is_active") & (F.col("end_date") < cutoff), F.lit(False))


def archive_ended(df: DataFrame, ref) -> DataFrame:
    return df.withColumn("is_active", F.col("is_active") & ~is_ended(ref))


def set_flag(df: DataFrame, ids: DataFrame, column: str, value, key: str = "id") -> DataFrame:
    """Set one column on the selected rows."""
    chosen = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    new = value if isinstance(value, Column) else F.lit(value)
    return (
        df.join(chosen, key, "left")
        .withColumn(column, F.when(F.col("_hit"), new).otherwise(F.col(column)))
        .drop("_hit")
    )


def init_layers(df: DataFrame, ref) -> DataFrame:
    """First fill of the raw layer: raw text from names and texts, status and time."""
    title = F.coalesce("raw_title", "name_ja", "name_zh", "name_en")
    text = F.coalesce("raw_description", "description_ja", "description_zh", "description_en")
    return df.withColumns(
        {"raw_title": title, "raw_description": text, "annotation_status": F.lit("annotated"), "annotated_at": instant(ref)}
    )


# -- labels, texts, places ---------------------------------------------------------------------

def backfill_tags(df: DataFrame, found: Column, allowed: Sequence[str], column: str = "category") -> DataFrame:
    """Add listed labels the classifier found; only changed rows are returned."""
    added = tags_added(found, strings(allowed), F.col(column))
    return (
        df.withColumn("_added", added).where(F.size("_added") > 0)
        .withColumn(column, tags_union(F.col(column), F.col("_added"))).drop("_added")
    )


def clean_text(df: DataFrame, columns: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Cut page noise from stored texts; only changed rows are returned, empty texts are null."""
    new = {c: empty_to_null(cut_at(F.col(c), markers)) for c in columns}
    marked = df.withColumns({f"_n_{c}": v for c, v in new.items()})
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"_n_{c}").eqNullSafe(F.col(c))
    return marked.where(changed).withColumns({c: F.col(f"_n_{c}") for c in columns}).drop(*[f"_n_{c}" for c in columns])


def _landed(df: DataFrame, found: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    side = found.select(key, *[F.col(f).alias(f"_l_{f}") for f in fields], F.lit(True).alias("_landed"))
    return df.join(side, key, "left")


def backfill_place(df: DataFrame, found: DataFrame) -> DataFrame:
    """A found address always replaces; a found name only fills an empty one."""
    joined = _landed(df, found, ["location_name", "location_address"])
    return joined.withColumns(
        {
            "location_address": F.coalesce(empty_to_null("_l_location_address"), "location_address"),
            "location_name": F.coalesce(empty_to_null("location_name"), empty_to_null("_l_location_name"), "location_name"),
        }
    ).select(*df.columns)


def fill_address(df: DataFrame, found: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Fill missing addresses: the landed one, else the fixed address of the source."""
    fixed = F.lit(None).cast("string")
    for source, address in constants.items():
        fixed = F.when(F.col("source_name") == source, F.lit(address)).otherwise(fixed)
    joined = _landed(df, found, ["location_address"])
    new = F.coalesce(empty_to_null("_l_location_address"), fixed, F.col("location_address"))
    todo = F.col("is_active") & blank("location_address")
    return joined.withColumn("location_address", F.when(todo, new).otherwise(F.col("location_address"))).select(*df.columns)


TRANSLATED = ("name_zh", "name_en", "description_zh", "description_en")


def fill_reviewed(df: DataFrame, landed: DataFrame, fields: Sequence[str] = TRANSLATED) -> DataFrame:
    """Reviewed rows take landed translations where given; nothing is emptied, status stays."""
    joined = _landed(df, landed, fields)
    reviewed = F.col("annotation_status") == "reviewed"
    return joined.withColumns(
        {f: F.when(reviewed, F.coalesce(blank_null(F.col(f"_l_{f}")), f)).otherwise(F.col(f)) for f in fields}
    ).select(*df.columns)


def fill_translations(df: DataFrame, landed: DataFrame, fields: Sequence[str] = ("name", "description"), languages: Sequence[str] = ("ja", "zh", "en")) -> DataFrame:
    """Fill empty target languages from landed translations; the original language is left alone."""
    columns = [f"{f}_{x}" for f in fields for x in languages]
    joined = _landed(df, landed, columns)
    out = {}
    for x in languages:
        for f in fields:
            c = f"{f}_{x}"
            new = F.coalesce(empty_to_null(c), empty_to_null(f"_l_{c}"), F.col(c))
            out[c] = F.when(F.col("original_language") == x, F.col(c)).otherwise(new)
    return joined.withColumns(out).select(*df.columns)


# -- annotation --------------------------------------------------------------------------------

PLACE_FIELDS = "location_name string, location_address string, business_hours string, is_paid boolean, price_info string"
LOCAL_FIELDS = ("location_name_zh", "location_name_en", "location_address_zh", "location_address_en", "business_hours_zh", "business_hours_en")
BASIC = (
    "name_ja string, name_zh string, name_en string, description_ja string, description_zh string, description_en string, "
    f"category array<string>, start_date string, end_date string, {PLACE_FIELDS}, " + ", ".join(f"{f} string" for f in LOCAL_FIELDS)
)
# The layout of a landed annotation. The reason may be an object, so it is kept as text.
ANNOTATION = f"{BASIC}, selection_reason string, sub_events array<struct<{BASIC.replace(' string', ':string').replace(' array<string>', ':array<string>').replace(' boolean', ':boolean')}>>"


def parse_annotations(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Read landed JSON; ``ok`` is false where it does not parse."""
    ann = F.from_json(F.col(payload), f"{ANNOTATION}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return landed.withColumn("ann", ann).withColumn("ok", F.col("ann").isNotNull() & F.col("ann._bad").isNull())


def _stamp_of(c: Column) -> Column:
    return F.try_to_timestamp(F.nullif(c, F.lit(""))).cast("timestamp_ntz")


def _local(ann: Column, f: str) -> Column:
    if f.startswith("business_hours"):
        return blank_null(ann[f])
    return to_traditional(strip_label(ann[f])) if f.endswith("_zh") else strip_label(ann[f])


def apply_annotations(events: DataFrame, landed: DataFrame, ref, human: DataFrame | None = None) -> DataFrame:
    """Apply landed annotations to unreviewed rows.

    A new value wins over the scraped one, except that nothing is emptied where the scraper
    knew a date, place, price or paid flag. The end defaults to the start. Human labels win
    over machine labels. A payload that does not parse marks the row as an error.
    """
    side = parse_annotations(landed).select("id", "ann", "ok")
    joined = events.join(side, "id", "left")
    if human is not None:
        h = human.select("id", F.col("category").alias("_human")).where(F.size("_human") > 0)
        joined = joined.join(h, "id", "left")
    else:
        joined = joined.withColumn("_human", F.lit(None).cast("array<string>"))
    a = F.col("ann")
    use = F.coalesce(F.col("ok"), F.lit(False)) & (F.col("annotation_status") != "reviewed")
    failed = F.coalesce(~F.col("ok"), F.lit(False)) & (F.col("annotation_status") != "reviewed")
    title = F.coalesce(empty_to_null("raw_title"), empty_to_null("name_ja"), F.lit(""))
    text = F.coalesce(empty_to_null("raw_description"), empty_to_null("description_ja"), F.lit(""))
    machine = inject_labels(valid_labels(F.coalesce(a["category"], strings([]))), F.concat(title, F.lit(" "), text))
    start = F.coalesce(_stamp_of(a["start_date"]), "start_date")
    end = F.coalesce(_stamp_of(a["end_date"]), "end_date", start)
    new = {
        "name_ja": F.coalesce(blank_null(a["name_ja"]), title),
        **{f: blank_null(a[f]) for f in ("name_zh", "name_en", "description_ja", "description_zh", "description_en")},
        "category": F.coalesce("_human", machine),
        "start_date": start,
        "end_date": end,
        **{f: F.coalesce(strip_label(a[f]), strip_label(F.col(f))) for f in ("location_name", "location_address")},
        "business_hours": F.coalesce(empty_to_null(a["business_hours"]), "business_hours"),
        "is_paid": F.coalesce(a["is_paid"], "is_paid"),
        "price_info": F.coalesce(empty_to_null(a["price_info"]), "price_info"),
        "selection_reason": F.coalesce(empty_to_null(a["selection_reason"]), "selection_reason"),
        **{f: F.coalesce(_local(a, f), f) for f in LOCAL_FIELDS},
        "annotated_at": instant(ref),
    }
    out = {c: F.when(use, v).otherwise(F.col(c)) for c, v in new.items() if c in events.columns}
    out["annotation_status"] = F.when(failed, F.lit("error")).when(use, F.lit("annotated")).otherwise(F.col("annotation_status"))
    return joined.withColumns(out).select(*events.columns)


def expand_subs(events: DataFrame, landed: DataFrame, ref) -> DataFrame:
    """Sub-event rows of landed annotations; what a sub-event leaves out comes from its parent.

    ``events`` must already carry the annotation (:func:`apply_annotations`), as the parent's
    new values are inherited. The result goes through the keyed upsert like any batch.
    """
    subs = (
        parse_annotations(landed).where("ok")
        .select("id", F.posexplode("ann.sub_events").alias("_pos", "sub"))
    )
    p = events.where(F.col("annotation_status") != "reviewed").join(subs, "id")
    s = F.col("sub")
    name = F.coalesce(s["name_ja"], F.lit(""))
    labels = inject_labels(
        valid_labels(F.coalesce(s["category"], F.col("category"))), F.concat(name, F.lit(" "), F.coalesce(s["description_ja"], F.lit("")))
    )
    start = _stamp_of(s["start_date"])
    cols = {
        "source_name": F.col("source_name"),
        "source_id": F.concat("source_id", F.lit("_sub"), (F.col("_pos") + 1).cast("string")),
        "source_url": F.col("source_url"),
        "original_language": F.coalesce("original_language", F.lit("ja")),
        "name_ja": name,
        **{f: s[f] for f in ("name_zh", "name_en", "description_ja", "description_zh", "description_en")},
        "category": labels,
        "start_date": start,
        "end_date": F.coalesce(_stamp_of(s["end_date"]), start),
        **{f: F.coalesce(empty_to_null(s[f]), f) for f in ("location_name", "location_address", "business_hours", "price_info")},
        "is_paid": F.coalesce(s["is_paid"], "is_paid"),
        **{f: F.coalesce(_local(s, f), f) for f in LOCAL_FIELDS if f in events.columns},
        "is_active": F.lit(True),
        "parent_event_id": F.col("id"),
        "raw_title": name,
        "raw_description": s["description_ja"],
        "annotation_status": F.lit("annotated"),
        "annotated_at": instant(ref),
    }
    return p.select(*[v.alias(k) for k, v in cols.items()])


def patch_titles(
    events: DataFrame, found: DataFrame, news_sources: Sequence[str], skip_source: str | None, tag: str = "movie"
) -> DataFrame:
    """Overwrite translated titles with official ones and repair quoted titles in the texts.

    ``found`` maps a looked-up title to (title_zh, title_en); of a title that stands there more than
    once the smallest pair counts. News rows are looked up by the bracketed part of their title.
    Reviewed rows and one exempt source are left alone.
    """
    news = F.col("source_name").isin(*news_sources)
    raw = F.coalesce(empty_to_null("raw_title"), empty_to_null("name_ja"), F.lit(""))
    bracket = F.when(bracket_title(raw) != raw, bracket_title(raw))
    own = F.coalesce(empty_to_null("name_ja"), empty_to_null("raw_title"))
    wanted = F.array_contains("category", tag) & (F.col("annotation_status") != "reviewed")
    if skip_source:
        wanted = wanted & (F.col("source_name") != skip_source)
    keyed = events.withColumn("_title", F.when(wanted, F.when(news, bracket).otherwise(own)))
    pair = F.min(F.struct("title_zh", "title_en"))
    side = found.where("title IS NOT NULL").groupBy(F.col("title").alias("_title")).agg(pair.alias("_p")).select("_title", F.col("_p.title_zh").alias("_zh"), F.col("_p.title_en").alias("_en"))
    j = left_by_key(keyed, side, "_title")
    old = lambda f: F.coalesce(F.col(f), F.lit(""))
    news_title = F.when(news, F.col("_title")).otherwise(F.lit(""))
    return j.withColumns(
        {
            "description_zh": F.when(has_text("_zh") & has_text("description_zh"), swap_title(F.col("description_zh"), [old("name_zh"), news_title], F.col("_zh"))).otherwise(F.col("description_zh")),
            "description_en": F.when(has_text("_en") & has_text("description_en"), swap_title(F.col("description_en"), [old("name_en")], F.col("_en"))).otherwise(F.col("description_en")),
            "name_zh": F.coalesce(empty_to_null("_zh"), "name_zh"),
            "name_en": F.coalesce(empty_to_null("_en"), "name_en"),
        }
    ).select(*events.columns)


# -- reports and corrections -------------------------------------------------------------------

# The columns behind each reportable field, and those an annotator can refill.
FIELD_COLUMNS = {
    "name": {"zh": "name_zh", "en": "name_en", "ja": "name_ja"},
    "venue": {"zh": "location_name_zh", "en": "location_name_en", "ja": "location_name"},
    "address": {"zh": "location_address_zh", "en": "location_address_en", "ja": "location_address"},
    "business_hours": {"zh": "business_hours_zh", "en": "business_hours_en", "ja": "business_hours"},
    "description": {"zh": "description_zh", "en": "description_en", "ja": "description_ja"},
    "start_date": {"ja": "start_date"},
    "end_date": {"ja": "end_date"},
    "price": {"ja": "price_info"},
}


# Columns emptied for re-annotation when a field is wrong and no value is given.
REFILL = {
    "name": ["name_zh", "name_en"],
    "description": ["description_zh", "description_en"],
    "price": ["is_paid", "price_info"],
}


def chosen_labels() -> Column:
    """Admin choice, else user suggestion, else null."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return F.coalesce(some("correct_category"), some("suggested_category"))


def confirm(events: DataFrame, reports: DataFrame, refill: dict[str, Sequence[str]] = REFILL) -> DataFrame:
    """Event state after confirmed reports, one report per event.

    ``reports`` has id (of the event), report_types, correct_category, suggested_category,
    fixes (map of column to corrected value) and selection_reason. ``refill`` names the columns
    emptied for re-annotation when a field is wrong and no value is given.
    """
    side = reports.select(
        "id", "report_types", chosen_labels().alias("_labels"), F.col("fixes").alias("_fixes"), F.col("selection_reason").alias("_reason"),
        F.lit(True).alias("_rep"),
    )
    j = events.join(side, "id", "left")
    has = lambda t: F.coalesce(F.array_contains("report_types", t), F.lit(False))
    fields = F.filter("report_types", lambda t: t.startswith("field:"))
    wrong_tags = has("wrongCategory")
    wrong_details = has("wrongDetails") & F.coalesce(F.size(fields) > 0, F.lit(False))
    irrelevant = has("irrelevant") & ~wrong_tags & ~wrong_details
    fix = lambda c: F.nullif(F.trim(F.element_at("_fixes", F.lit(c))), F.lit(""))
    given, open_ = {}, F.lit(False)
    for field, cols in FIELD_COLUMNS.items():
        named = has(f"field:{field}")
        some = F.lit(False)
        for c in cols.values():
            some = some | fix(c).isNotNull()
        given[field] = (named, some)
        if field in refill:
            open_ = open_ | (named & ~some)
    out: dict[str, Column] = {}
    for field, cols in FIELD_COLUMNS.items():
        named, some = given[field]
        for c in {*cols.values(), *refill.get(field, ())}:
            if c not in events.columns:
                continue
            kind = events.schema[c].dataType.simpleString()
            value = F.when(wrong_details & named & fix(c).isNotNull(), fix(c).cast(kind)) if c in cols.values() else F.when(F.lit(False), F.col(c))
            if c in refill.get(field, ()):
                value = value.when(wrong_details & named & ~some, F.lit(None).cast(kind))
            out[c] = value.otherwise(F.col(c))
    empty = F.array().cast("array<string>")
    if "category" in events.columns:
        out["category"] = F.when(wrong_tags, F.coalesce("_labels", empty)).otherwise(F.col("category"))
    tags_ok = F.col("_labels").isNotNull()
    out["is_active"] = (
        F.when(wrong_details, ~open_).when(wrong_tags, tags_ok).when(irrelevant, F.lit(False)).otherwise(F.col("is_active"))
    )
    out["annotation_status"] = (
        F.when(wrong_details, F.when(open_, F.lit("pending")).otherwise(F.lit("reviewed")))
        .when(wrong_tags, F.when(tags_ok, F.lit("annotated")).otherwise(F.lit("pending")))
        .when(irrelevant, F.lit("pending")).otherwise(F.col("annotation_status"))
    )
    if "selection_reason" in events.columns:
        use = has("wrongSelectionReason") & has_text("_reason")
        out["selection_reason"] = F.when(use, F.col("_reason")).otherwise(F.col("selection_reason"))
    return j.withColumns(out).select(*events.columns)


def corrections_of(events: DataFrame, reports: DataFrame, ref, text_limit: int | None = None) -> DataFrame:
    """Correction rows of confirmed label reports: admin choice, else user suggestion."""
    e = events.select("id", "raw_title", "raw_description", F.col("category").alias("ai_category"))
    r = reports.where(F.array_contains("report_types", "wrongCategory")).withColumn("corrected_category", chosen_labels())
    text = F.col("raw_description") if text_limit is None else cut(F.coalesce("raw_description", F.lit("")), text_limit)
    return r.where("corrected_category IS NOT NULL").select("id", "corrected_category").join(e, "id", "left").select(
        F.col("id").alias("event_id"), "raw_title", text.alias("raw_description"),
        F.coalesce("ai_category", F.array().cast("array<string>")).alias("ai_category"), "corrected_category", instant(ref).alias("created_at"),
    )


# -- registry ----------------------------------------------------------------------------------

def advance(sources: DataFrame, changes: DataFrame, ref) -> DataFrame:
    """Status changes by URL. Implemented rows never change; an issue moves a row to recommended."""
    side = changes.select("url", F.col("status").alias("_st"), F.nullif("issue_url", F.lit("")).alias("_issue"), F.lit(True).alias("_chg"))
    j = sources.join(side, "url", "left")
    go = F.coalesce("_chg", F.lit(False)) & (F.col("status") != "implemented")
    return j.withColumns(
        {
            "status": F.when(go, F.when(F.col("_issue").isNotNull(), F.lit("recommended")).otherwise(F.col("_st"))).otherwise(F.col("status")),
            "issue_url": F.when(go, F.coalesce("_issue", "issue_url")).otherwise(F.col("issue_url")),
            "last_seen_at": F.when(go, instant(ref)).otherwise(F.col("last_seen_at")),
        }
    ).select(*sources.columns)


def account_row(found: DataFrame, ref, tag: str = "taiwan_japan") -> DataFrame:
    """Registry rows of verified accounts; the profile names the platform and the account."""
    note = F.col("platform") == "note"
    profile = F.when(
        note, F.to_json(F.struct(F.lit("note.com").alias("platform"), F.col("account").alias("creator_id"), F.array(F.lit(tag)).alias("categories")))
    ).otherwise(
        F.to_json(F.struct(F.lit("peatix").alias("platform"), F.col("account").alias("group_id"), F.array(F.lit(tag)).alias("categories")))
    )
    return found.withColumns(
        {
            "agent_category": F.when(note, F.lit("note_creator")).otherwise(F.lit("peatix_organizer")),
            "category": F.lit(tag),
            "status": F.lit("candidate"),
            "source_profile": profile,
            "first_seen_at": instant(ref),
            "last_seen_at": instant(ref),
        }
    )


def register(registry: DataFrame, found: DataFrame, ref) -> DataFrame:
    """Upsert account rows by URL; unlike discovery finds they replace whatever is stored."""
    from almanack.operators.upsert import last_per_key, upsert

    rows = account_row(found, ref)
    return upsert(registry, last_per_key(rows.select(*[c for c in registry.columns if c in rows.columns]), ["url"]), ["url"])


def verified_new(found: DataFrame) -> DataFrame:
    """First find per account that was verified; ``is_new`` tells the unknown ones apart."""
    from almanack.operators.joins import first_by

    return first_by(found, ["account"], "ord").where(F.col("url_verified"))


def apply_mapping(df: DataFrame, mapping: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fill columns from an id table; rows without an entry keep theirs."""
    m = mapping.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns])
    return df.join(m, key, "left").withColumns({c: F.coalesce(f"_m_{c}", c) for c in columns}).select(*df.columns)
