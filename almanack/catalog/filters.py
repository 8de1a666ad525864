"""Scan, filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.catalog.carriers import REF
from almanack.catalog.registry import query
from almanack.functions.localized import (
    broadcast_title,
    localized_description,
    localized_name,
    localized_place,
)
from almanack.functions.places import by_label
from almanack.operators import filters as f
from almanack.plans.listing import ListingSpec, all_facets, facet_counts, listing, masked_facets, public_rows
from almanack.sources.tables import extract_all, read_table

GENERIC = ("東京", "東京都", "東 京", "Tokyo", "tokyo")
NAMES = ("name_ja", "name_zh", "name_en")


@query("s1_table_scan", "SELECT event_id, event_type, value FROM events WHERE value >= 50 AND event_type = 'view'")
def _(c):
    pred = (F.col("value") >= 50) & (F.col("event_type") == "view")
    return read_table(c.spark, c.sf_dir, "events", ["event_id", "event_type", "value"], pred)


@query("s2_full_extract", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_day, o_orderpriority FROM orders""")
def _(c):
    df = extract_all(c.spark, c.sf_dir, "orders")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                     F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"), "o_orderpriority")


@query("f1_visible", "SELECT id, source_name FROM ev WHERE is_active", "ev")
def _(c):
    return f.visible(c.events()).select("id", "source_name")


@query("f2_keyword_search", """
SELECT id FROM doc WHERE lower(coalesce(name_ja,'')) LIKE '%tion of%' OR lower(coalesce(name_zh,'')) LIKE '%tion of%'
 OR lower(coalesce(name_en,'')) LIKE '%tion of%' OR lower(coalesce(description_ja,'')) LIKE '%tion of%'
 OR lower(coalesce(description_zh,'')) LIKE '%tion of%' OR lower(coalesce(description_en,'')) LIKE '%tion of%'""", "doc")
def _(c):
    return f.search(c.plain_docs(), [*NAMES, "description_ja", "description_zh", "description_en"], "TION of").select("id")


@query("f2_keyword_search_wildcard", """
SELECT id FROM doc WHERE coalesce(name_ja,'') ILIKE '%th_re%for%' OR coalesce(name_en,'') ILIKE '%th_re%for%'""", "doc")
def _(c):
    return f.search(c.plain_docs(), ["name_ja", "name_en"], "th_re%for").select("id")


@query("f3_admin_search", """
SELECT id FROM doc WHERE contains(lower(coalesce(nullif(name_en,''), nullif(name_ja,''), nullif(name_zh,''), '（未命名）')), 'en the')
 OR contains(lower(raw_title), 'en the')""", "doc")
def _(c):
    return f.search_admin(c.plain_docs(), "en THE", "en").select("id")


@query("f4_category_one", "SELECT id FROM doc WHERE list_contains(category, 'books_media')", "doc")
def _(c):
    return f.by_category(c.docs(), "books_media, nonsense").select("id")


@query("f4_category_many", "SELECT id FROM doc WHERE list_has_any(category, ['report', 'tech'])", "doc")
def _(c):
    return f.by_category(c.docs(), "report,tech,nonsense").select("id")


@query("f5_ongoing", f"SELECT id FROM ev WHERE end_date IS NULL OR end_date >= CAST(CAST(TIMESTAMP '{REF}' AS DATE) AS TIMESTAMP)", "ev")
def _(c):
    return f.ongoing(c.events(), REF).select("id")


@query("f6_time_range", """
SELECT id FROM ev WHERE start_date >= TIMESTAMP '2024-01-05 00:00:00' AND start_date <= TIMESTAMP '2024-01-20 00:00:00'""", "ev")
def _(c):
    return f.in_range(c.events(), "2024-01-05", "2024-01-20").select("id")


@query("f7_admin_range", "SELECT id FROM ev WHERE start_date <= TIMESTAMP '2024-01-20 23:59:59'", "ev")
def _(c):
    return f.in_range_admin(c.events(), to="2024-01-20").select("id")


@query("f8_paid", """
SELECT id, 'free' AS mode FROM doc WHERE is_paid = false UNION ALL SELECT id, 'paid' FROM doc WHERE is_paid = true""", "doc")
def _(c):
    d = c.docs()
    pick = lambda m: f.by_paid(d, m).select("id", F.lit(m).alias("mode"))
    return pick("free").unionByName(pick("paid"))


HOME = "['東京','新宿区','港区','渋谷区','千代田区','文京区','台東区','台北駐日']"
ABROAD = "['台北','台中','台南','高雄','台湾','台灣']"


def _hit(c, words):
    return f"len(list_filter({words}, lambda m: contains({c}, m))) > 0"


@query("f9_region", f"""
SELECT id, 'tokyo' AS region FROM place WHERE location_address IS NULL OR location_address = '' OR {_hit('location_address', HOME)}
UNION ALL SELECT id, 'taiwan' FROM place WHERE {_hit('location_address', ABROAD)} AND NOT {_hit('location_address', "['台北駐日','台湾文化センター','台北経済文化']")}
UNION ALL SELECT id, 'other_japan' FROM place WHERE location_address IS NOT NULL AND location_address <> ''
  AND NOT {_hit('location_address', HOME)} AND NOT {_hit('location_address', ABROAD)} AND location_name NOT ILIKE '%オンライン%'
UNION ALL SELECT id, 'online' FROM place WHERE location_name ILIKE '%オンライン%'""", "place")
def _(c):
    p = c.places()
    parts = [f.by_region(p, r).select("id", F.lit(r).alias("region")) for r in ("tokyo", "taiwan", "other_japan", "online")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


ADMIN_HOME = "['東京','新宿区','港区','渋谷区','千代田区','文京区','台東区']"


@query("f10_region_admin", f"""
SELECT id, 'tokyo' AS region FROM place WHERE trim(coalesce(location_address,'')) = '' OR {_hit('location_address', ADMIN_HOME)}
UNION ALL SELECT id, 'taiwan' FROM place WHERE {_hit("coalesce(location_address,'')", ABROAD)}
UNION ALL SELECT id, 'other_japan' FROM place WHERE trim(coalesce(location_address,'')) <> '' AND NOT contains(location_address, 'オンライン')
  AND NOT {_hit('location_address', ADMIN_HOME)} AND NOT {_hit('location_address', ABROAD)}
UNION ALL SELECT id, 'online' FROM place WHERE contains(coalesce(location_name,''), 'オンライン')""", "place")
def _(c):
    p = c.places()
    parts = [f.by_region_admin(p, r).select("id", F.lit(r).alias("region")) for r in ("tokyo", "taiwan", "other_japan", "online")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("f11_state", """
SELECT id FROM ev WHERE is_active AND annotation_status = 'pending' AND source_name = 'view_3'""", "ev")
def _(c):
    return f.by_state(c.events(), "active", "pending", "view_3").select("id")


@query("f12_upcoming", """
SELECT id, source_name FROM ev WHERE is_active AND parent_event_id IS NULL
 AND start_date BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 35 DAYS
ORDER BY start_date, id LIMIT 80""", "ev")
def _(c):
    return f.upcoming(c.events(), "2024-01-10", 35, 80).select("id", "source_name")


@query("f13_topic_relevance", """
SELECT id FROM doc WHERE contains(coalesce(raw_title,''), 'tion of') OR contains(coalesce(raw_title,''), 'Lesle')
 OR contains(raw_description, 'tion of') OR contains(raw_description, 'Lesle')""", "doc")
def _(c):
    return f.relevant(c.plain_docs(), ["raw_title", "raw_description"], ["tion of", "Lesle"]).select("id")


@query("f14_relevance_guarded", """
SELECT id FROM doc WHERE contains(regexp_replace(raw_title, 'the[a-z]|[a-z]the', '', 'g'), 'the')""", "doc")
def _(c):
    return f.relevant_guarded(c.plain_docs(), "raw_title", ["the"], "the[a-z]|[a-z]the").select("id")


@query("f15_two_set_filter", """
SELECT id FROM doc WHERE regexp_matches(raw_title, 'tion|ment') AND regexp_matches(raw_title, 'the|und|les')""", "doc")
def _(c):
    return f.relevant_both(c.plain_docs(), "raw_title", "tion|ment", "the|und|les").select("id")


@query("f16_reject_patterns", """
SELECT id FROM doc WHERE NOT (contains(raw_title, 'http') OR contains(raw_title, ' | ')) AND NOT regexp_matches(raw_title, 'thea|tion.*ment')
 AND NOT contains(source_name, 'src1')""", "doc")
def _(c):
    return f.reject(c.plain_docs(), "raw_title", ["http", " | "], "thea|tion.*ment", "source_name", ["src1"]).select("id")


@query("f17_reject_context", """
SELECT id FROM doc WHERE NOT regexp_matches(concat_ws(chr(10), raw_title, raw_description), '(?s)ment.*@|@.*tion')""", "doc")
def _(c):
    return f.reject_context(c.plain_docs(), ["raw_title", "raw_description"], "ment.*@|@.*tion").select("id")


@query("f18_reject_place", """
SELECT id FROM doc WHERE NOT regexp_matches(raw_title, 'in (the|le|der)') AND NOT coalesce(regexp_matches(location_name, '中山|大阪'), false)""", "doc")
def _(c):
    return f.reject_place(c.plain_docs(), "raw_title", "in (the|le|der)", "location_name", "中山|大阪").select("id")


@query("f19_multi_signal", """
SELECT page_id FROM pages WHERE regexp_matches(html, '<h1>[^<]*tion') OR regexp_matches(html, 'href="[^"]*thanedble') OR contains(html, 'zusch')""")
def _(c):
    return f.relevant_signals(c.table("pages"), "html", "<h1>[^<]*tion", "thanedble", ["zusch"]).select("page_id")


@query("f20_two_phase", """
SELECT id FROM doc WHERE contains(raw_title, 'ähne') OR contains(raw_title, 'tionch') OR contains(raw_description, 'ähne') OR contains(raw_description, 'tionch')""", "doc")
def _(c):
    return f.relevant_two_phase(c.plain_docs(), "raw_title", "raw_description", ["ähne", "tionch"]).select("id")


@query("f21_fresh", """
SELECT id FROM ev WHERE start_date BETWEEN TIMESTAMP '2024-01-12 12:00:00' - INTERVAL 7 DAYS AND TIMESTAMP '2024-01-12 12:00:00' + INTERVAL 10 DAYS""", "ev")
def _(c):
    return f.fresh(c.events(), "2024-01-12 12:00:00", 7, 10).select("id")


@query("f22_venue_markers", r"""
SELECT id FROM (SELECT id, regexp_extract(t, '(?:場\s*所|会場)\s*[：:]\s*([^\n]{3,80})', 1) || ' ' || regexp_extract(t, '住\s*所\s*[：:]\s*([^\n]{3,80})', 1) AS v
 FROM (SELECT id, '日時：1月' || chr(10) || '会場：' || coalesce(location_name,'') || chr(10) || '住所：' || coalesce(location_address,'') AS t FROM place))
WHERE trim(v) <> '' AND (contains(v, '東京') OR contains(v, '新宿') OR contains(v, '会館2'))""", "place")
def _(c):
    text = F.concat(F.lit("日時：1月\n会場："), F.coalesce("location_name", F.lit("")), F.lit("\n住所："), F.coalesce("location_address", F.lit("")))
    d = c.places().withColumn("t", text)
    venue = by_label(F.col("t"), [r"場\s*所", "会場"], 3, 80)
    addr = by_label(F.col("t"), [r"住\s*所"], 3, 80)
    return f.venue_in(d, venue, addr, ["東京", "新宿", "会館2"]).select("id")


@query("f23_work_queue", """
SELECT id, 'pending' AS mode FROM doc WHERE annotation_status = 'pending'
UNION ALL SELECT id, 'all' FROM doc WHERE annotation_status <> 'reviewed' AND is_active
UNION ALL SELECT id, 'missing' FROM doc WHERE annotation_status <> 'reviewed' AND is_active AND (name_zh IS NULL OR name_en IS NULL OR description_zh IS NULL OR description_en IS NULL)
UNION ALL SELECT id, 'reviewed' FROM doc WHERE annotation_status = 'reviewed' AND (name_zh IS NULL OR name_en IS NULL)""", "doc")
def _(c):
    d = c.docs()
    out = None
    for m in ("pending", "all", "missing", "reviewed"):
        part = f.select_queue(d, m).select("id", F.lit(m).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f24_missing_address", "SELECT id, name FROM place WHERE location_address IS NULL OR trim(location_address) = ''", "place")
def _(c):
    return f.missing(c.places(), "location_address").select("id", "name")


@query("f25_generic_address", """
SELECT id FROM place WHERE is_active AND source_name IN ('iwafu', 'koryu') AND trim(replace(location_address, '　', ' ')) IN ('東京', '東京都', '東 京', 'Tokyo', 'tokyo')
UNION ALL SELECT id FROM place WHERE is_active AND source_name = 'peatix' AND location_address IS NULL""", "place")
def _(c):
    return f.generic_candidates(c.places(), GENERIC, ["iwafu", "koryu"], ["peatix"]).select("id")


@query("f26_enrich_candidates", """
SELECT id FROM doc WHERE list_contains(category, 'movie') AND annotation_status <> 'reviewed' AND source_name <> 'src3'""", "doc")
def _(c):
    return f.enrich_candidates(c.docs(), "movie", "src3").select("id")


@query("f27_registry_filter", """
SELECT id, 'researched' AS choice FROM reg WHERE status = 'researched' AND (CASE WHEN agent_category = 'peatix_organizer' THEN agent_category ELSE coalesce(source_type, 'other') END) = 'museum'
UNION ALL SELECT id, 'has_issue' FROM reg WHERE coalesce(issue_url, '') <> ''""", "reg")
def _(c):
    r = c.registry()
    a = f.filter_sources(r, "researched", "museum").select("id", F.lit("researched").alias("choice"))
    return a.unionByName(f.filter_sources(r, "has_issue").select("id", F.lit("has_issue").alias("choice")))


@query("f28_flags", f"""
SELECT id, coalesce(end_date < TIMESTAMP '{REF}', false) AS ended, coalesce(CAST(end_date AS DATE) <> CAST(start_date AS DATE), false) AS multi_day FROM ev""", "ev")
def _(c):
    return f.flags(c.events(), REF).select("id", "ended", "multi_day")


@query("f29_registry_profile", """
SELECT id, coalesce(nullif(json_extract_string(source_profile, '$.location_name'), ''), name) AS location_name,
 CASE WHEN json_array_length(source_profile, '$.categories') > 0 THEN json_extract_string(source_profile, '$.categories[0]')
  WHEN category = 'movie' THEN category ELSE 'taiwan_japan' END AS tag
FROM reg WHERE status = 'implemented' AND agent_category = 'note_creator'""", "reg")
def _(c):
    return f.registry(c.registry(), "implemented", "note_creator").select("id", "location_name", F.col("tags")[0].alias("tag"))


@query("f30_required_fields", "SELECT id FROM doc WHERE trim(coalesce(name_zh, '')) <> '' AND start_date IS NOT NULL", "doc")
def _(c):
    return f.require(c.plain_docs(), ["name_zh"]).where(F.col("start_date").isNotNull()).select("id")


LISTING_SQL = f"""
SELECT d.id, coalesce(nullif(d.name_en,''), nullif(d.name_ja,''), nullif(d.name_zh,''), '（未命名）') AS name,
 CASE WHEN p.id IS NOT NULL THEN coalesce(nullif(p.name_en,''), nullif(p.name_ja,''), nullif(p.name_zh,''), '（未命名）') END AS parent_name,
 array_to_string(d.category[1:2], ',') AS tags, strftime(d.start_date, '%Y-%m-%d') AS start_day,
 coalesce(d.end_date < TIMESTAMP '{REF}', false) AS ended, d.is_paid
FROM doc d LEFT JOIN doc p ON d.parent_event_id = p.id
WHERE d.is_active AND (d.end_date IS NULL OR d.end_date >= TIMESTAMP '2024-01-25')
 AND (lower(coalesce(d.name_ja,'')) LIKE '%the%' OR lower(coalesce(d.name_zh,'')) LIKE '%the%' OR lower(coalesce(d.name_en,'')) LIKE '%the%'
  OR lower(coalesce(d.description_ja,'')) LIKE '%the%' OR lower(coalesce(d.description_zh,'')) LIKE '%the%' OR lower(coalesce(d.description_en,'')) LIKE '%the%')"""


@query("listing_page", LISTING_SQL, "doc")
def _(c):
    page = listing(c.docs(), ListingSpec(q="the", time_mode="active", locale="en"), REF)
    return page.select("id", "name", "parent_name", F.array_join("tags", ",").alias("tags"),
                       F.date_format("start_date", "yyyy-MM-dd").alias("start_day"), "ended", "is_paid")


@query("listing_page_filtered", f"""
SELECT id FROM doc WHERE is_active AND list_has_any(category, ['movie', 'books_media']) AND start_date >= TIMESTAMP '2024-01-03'
 AND start_date <= TIMESTAMP '2024-02-20' AND is_paid = false
 AND (location_address IS NULL OR location_address = '' OR {_hit('location_address', HOME)})""", "doc")
def _(c):
    spec = ListingSpec(categories="movie,books_media", time_mode="past", from_="2024-01-03", to="2024-02-20", paid="free", region="tokyo")
    return public_rows(c.docs(), spec, REF).select("id")


@query("a6_facet_counts", f"""
SELECT source_name, count(*) AS n FROM ev WHERE is_active AND annotation_status = 'pending' AND (end_date IS NULL OR end_date >= TIMESTAMP '2024-01-25')
GROUP BY source_name""", "ev")
def _(c):
    e = c.events().withColumns({"is_paid": F.lit(None).cast("boolean"), "location_address": F.lit(None).cast("string")})
    return facet_counts(e, ListingSpec(annotation="pending", source="view_3"), REF)


@query("a6_facet_all_switches", f"""
SELECT source_name, count(*) AS n FROM doc WHERE is_active AND annotation_status = 'annotated' AND list_has_any(category, ['movie', 'tech'])
 AND contains(lower(raw_title), 'th')
 AND start_date >= TIMESTAMP '2024-01-03' AND start_date <= TIMESTAMP '2024-02-20 23:59:59' AND is_paid = false GROUP BY source_name""", "doc")
def _(c):
    spec = ListingSpec(q="th", categories="movie,tech", time_mode="past", from_="2024-01-03", to="2024-02-20", paid="free", annotation="annotated", source="src3")
    return facet_counts(c.docs(), spec, REF)


SWITCHES = {
    "q": "contains(lower(raw_title), 'th')", "categories": "list_has_any(category, ['movie', 'tech', 'books_media'])",
    "time_mode": "(start_date >= TIMESTAMP '2024-01-03' AND start_date <= TIMESTAMP '2024-02-20 23:59:59')", "paid": "is_paid = false",
    "active": "is_active", "annotation": "annotation_status = 'annotated'", "source": "source_name IN ('src3')",
}


def facet_sql(facet, switch, value=None, rows="doc"):
    kept = " AND ".join(f"coalesce({test}, false)" for name, test in SWITCHES.items() if name != switch)
    return f"SELECT '{facet}' AS facet, CAST({value or facet} AS VARCHAR) AS value, count(*) AS n FROM {rows} WHERE {kept} GROUP BY ALL"


@query("a6_all_facets", " UNION ALL ".join([
    facet_sql("source_name", "source"), facet_sql("is_paid", "paid"), facet_sql("is_active", "active"), facet_sql("annotation_status", "annotation"),
    facet_sql("category", "categories", "c", "(SELECT *, unnest(category) AS c FROM doc)")]), "doc")
def _(c):
    spec = ListingSpec(q="th", categories="movie,tech,books_media", time_mode="past", from_="2024-01-03", to="2024-02-20", paid="free", annotation="annotated", source="src3")
    return all_facets(c.docs(), spec, REF)


@query("a7_all_facets", """
WITH r AS (SELECT status, CASE WHEN agent_category = 'peatix_organizer' THEN agent_category ELSE coalesce(source_type, 'other') END AS t FROM reg)
SELECT 'source_type' AS facet, t AS value, count(*) AS n FROM r WHERE status = 'candidate' GROUP BY t
UNION ALL SELECT 'status', status, count(*) FROM r WHERE t = 'other' GROUP BY status""", "reg")
def _(c):
    kind = f.effective_type()
    tests = {"status": f.registry_status("candidate"), "type": kind == "other"}
    return masked_facets(c.registry(), tests, {"source_type": (kind, "type"), "status": (F.col("status"), "status")})


@query("h1_localised_values", """
SELECT id, coalesce(nullif(name_zh,''), nullif(name_ja,''), nullif(name_zh,''), nullif(name_en,''), '（未命名）') AS name_for_zh,
 md5(coalesce(nullif(description_en,''), nullif(description_ja,''), nullif(description_zh,''))) AS description_for_en_md5,
 location_name AS place_for_ja FROM doc""", "doc")
def _(c):
    return c.plain_docs().select("id", localized_name("zh").alias("name_for_zh"),
                           F.md5(localized_description("en")).alias("description_for_en_md5"),
                           localized_place("location_name", "ja").alias("place_for_ja"))


@query("h2_broadcast_title", """
SELECT id, coalesce(nullif(name_ja,''), nullif(name_zh,''), nullif(name_ja,''), nullif(name_en,''), '?') AS title FROM doc""", "doc")
def _(c):
    return c.plain_docs().select("id", broadcast_title("ja").alias("title"))
