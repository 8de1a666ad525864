"""State-change jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.catalog.carriers import REF
from almanack.catalog.registry import query
from almanack.operators import enrich as e
from almanack.operators.upsert import upsert

T = f"TIMESTAMP '{REF}'"


@query("e2_archive_ended", f"""
SELECT id, is_active AND NOT coalesce(end_date < TIMESTAMP '2024-01-24 00:00:00', false) AS is_active FROM ev""", "ev")
def _(c):
    return e.archive_ended(c.events(), REF).select("id", "is_active")


@query("e2_archive_dry_run", "SELECT count(*) AS n FROM ev WHERE is_active AND end_date < TIMESTAMP '2024-01-24 00:00:00'", "ev")
def _(c):
    return c.events().where(e.is_ended(REF)).agg(F.count(F.lit(1)).alias("n"))


def annotated_docs(c):
    """Listings with the columns an annotation may write."""
    return c.docs().withColumns({
        "business_hours": F.lit("10-18"), "price_info": F.lit(None).cast("string"), "selection_reason": F.lit(None).cast("string"),
        "annotated_at": F.lit(None).cast("timestamp_ntz"), "location_name_zh": F.lit(None).cast("string"), "location_name_en": F.lit("old")})


SUBS = ('"sub_events": [{"name_ja": "S1 ', '", "start_date": "2024-05-01", "is_paid": false}, {"name_ja": "S2", "location_name": "別会場", "category": ["art", "x"], "start_date": "2024-06-01", "end_date": "2024-06-02"}]}')


def landed(c):
    """Annotations of English rows; French payloads are broken, others have none."""
    d = c.docs().where("lang IN ('en', 'fr')")
    sid = F.col("id").cast("string")
    good = F.concat(F.lit('{"name_ja": "N '), sid, F.lit('", "name_zh": " ", "name_en": "E", "category": ["movie", "bogus", 5], "start_date": null, "location_name": "：会場", '
                          '"location_name_zh": ": 东京会", "is_paid": true, "selection_reason": {"ja": "r"}, '), F.lit(SUBS[0]), sid, F.lit(SUBS[1]))
    return d.select("id", F.when(F.col("lang") == "en", good).otherwise(F.lit('{"name_ja": ')).alias("payload"))


USE = "lang = 'en' AND annotation_status <> 'reviewed'"


@query("e3_apply_annotations", f"""
SELECT id, CASE WHEN {USE} THEN 'N ' || CAST(id AS STRING) ELSE name_ja END AS name_ja, CASE WHEN {USE} THEN NULL ELSE name_zh END AS name_zh, CASE WHEN {USE} THEN 'E' ELSE name_en END AS name_en,
 CASE WHEN {USE} THEN CASE WHEN is_paid THEN 'human' ELSE 'movie' END ELSE array_to_string(category, ',') END AS labels, CASE WHEN {USE} THEN true ELSE is_paid END AS is_paid,
 CASE WHEN {USE} THEN '会場' ELSE location_name END AS location_name, CASE WHEN {USE} THEN '東京會' END AS location_name_zh, 'old' AS location_name_en, CASE WHEN {USE} THEN '{{"ja":"r"}}' END AS reason,
 strftime(start_date, '%Y-%m-%d') AS s, strftime(CASE WHEN {USE} THEN coalesce(end_date, start_date) ELSE end_date END, '%Y-%m-%d') AS e,
 CASE WHEN annotation_status = 'reviewed' THEN 'reviewed' WHEN lang = 'en' THEN 'annotated' WHEN lang = 'fr' THEN 'error' ELSE annotation_status END AS status FROM doc""", "doc")
def _(c):
    human = c.docs().where("is_paid").select("id", F.array(F.lit("human")).alias("category"))
    out = e.apply_annotations(annotated_docs(c), landed(c), REF, human)
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return out.select("id", "name_ja", "name_zh", "name_en", F.array_join("category", ",").alias("labels"), "is_paid", "location_name", "location_name_zh", "location_name_en",
                      F.col("selection_reason").alias("reason"), day("start_date").alias("s"), day("end_date").alias("e"), F.col("annotation_status").alias("status"))


@query("e4_expand_subs", f"""
SELECT source_id || '_sub1' AS source_id, 'S1 ' || CAST(id AS STRING) AS name_ja, '会場' AS location_name, 'movie' AS labels, false AS is_paid, '2024-05-01' AS e, id AS parent_event_id FROM doc WHERE {USE}
UNION ALL SELECT source_id || '_sub2', 'S2', '別会場', 'art', true, '2024-06-02', id FROM doc WHERE {USE}""", "doc")
def _(c):
    rows = e.apply_annotations(annotated_docs(c), landed(c), REF)
    return e.expand_subs(rows, landed(c), REF).select("source_id", "name_ja", "location_name", F.array_join("category", ",").alias("labels"), "is_paid",
                                                      F.date_format("end_date", "yyyy-MM-dd").alias("e"), "parent_event_id")


HIT = "lang = 'en' AND annotation_status <> 'reviewed' AND source_name <> 'src3' AND right(source_name, 1) IN ('1', '2', '4')"
NEWS = [f"src{i}" for i in range(10, 20)]
ISNEWS = "length(source_name) > 4"


@query("e5_patch_titles", f"""
SELECT id, CASE WHEN {HIT} THEN 'ZH' ELSE 'old' END AS name_zh, CASE WHEN {HIT} AND right(source_name, 1) = '2' THEN 'EN' ELSE 'older' END AS name_en,
 CASE WHEN {HIT} THEN CASE WHEN {ISNEWS} THEN '《ZH》と「ZH」とold' ELSE '《ZH》と「' || source_name || '」とold' END ELSE '《old》と「' || source_name || '」とold' END AS description_zh,
 CASE WHEN {HIT} AND right(source_name, 1) = '2' THEN 'the ''EN'' film' ELSE 'the ''older'' film' END AS description_en FROM doc""", "doc")
def _(c):
    src = F.col("source_name")
    d = c.docs().withColumns({
        "raw_title": F.concat(F.lit("速報「"), src, F.lit("」公開")), "name_ja": src, "name_zh": F.lit("old"), "name_en": F.lit("older"),
        "description_zh": F.concat(F.lit("《old》と「"), src, F.lit("」とold")), "description_en": F.lit("the 'older' film")})
    last = F.right(F.col("title"), F.lit(1))
    found = c.docs().select(src.alias("title")).distinct().where(last.isin("1", "2", "4")).select(
        "title", F.lit("ZH").alias("title_zh"), F.when(last == "2", F.lit("EN")).alias("title_en"))
    return e.patch_titles(d, found, NEWS, "src3").select("id", "name_zh", "name_en", "description_zh", "description_en")


@query("e6_fill_reviewed", """
SELECT id, CASE WHEN annotation_status = 'reviewed' THEN coalesce(CASE WHEN lang = 'fr' THEN 'Z' || lang END, name_zh) ELSE name_zh END AS name_zh, CASE WHEN annotation_status = 'reviewed' THEN 'E' ELSE name_en END AS name_en, annotation_status FROM doc""", "doc")
def _(c):
    land = c.docs().select("id", F.when(F.col("lang") == "fr", F.concat(F.lit("Z"), F.col("lang"))).otherwise(F.lit(" ")).alias("name_zh"), F.lit("E").alias("name_en"))
    return e.fill_reviewed(c.docs(), land, ["name_zh", "name_en"]).select("id", "name_zh", "name_en", "annotation_status")


@query("e7_fill_translations", """
SELECT id, coalesce(nullif(name_zh, ''), 'tz') AS name_zh, CASE WHEN original_language = 'en' THEN name_en ELSE coalesce(nullif(name_en, ''), 'te') END AS name_en, coalesce(nullif(name_ja, ''), name_ja) AS name_ja FROM doc""", "doc")
def _(c):
    land = c.plain_docs().select("id", F.lit("tz").alias("name_zh"), F.lit("te").alias("name_en"), F.lit(None).cast("string").alias("name_ja"))
    return e.fill_translations(c.plain_docs(), land, ["name"]).select("id", "name_zh", "name_en", "name_ja")


@query("e9_backfill_place", """
SELECT id, coalesce(nullif(location_name, ''), CASE WHEN balance >= 0 THEN 'found ' || name END, location_name) AS location_name, CASE WHEN balance >= 0 THEN 'addr ' || name ELSE location_address END AS location_address FROM place""", "place")
def _(c):
    p = c.places()
    found = p.where("balance >= 0").select("id", F.concat(F.lit("found "), F.col("name")).alias("location_name"), F.concat(F.lit("addr "), F.col("name")).alias("location_address"))
    return e.backfill_place(p, found).select("id", "location_name", "location_address")


@query("e10_fill_address", """
SELECT id, CASE WHEN is_active AND trim(coalesce(location_address, '')) = '' THEN coalesce(CASE WHEN balance > 3000 THEN 'landed' END, CASE WHEN source_name = 'koryu' THEN '固定' END, location_address) ELSE location_address END AS location_address FROM place""", "place")
def _(c):
    p = c.places()
    found = p.select("id", F.when(F.col("balance") > 3000, "landed").otherwise("").alias("location_address"))
    return e.fill_address(p, found, {"koryu": "固定"}).select("id", "location_address")


KIND = "CASE WHEN quality = 1 AND toxic = 0 THEN 'cat' WHEN quality = 1 THEN 'full' WHEN toxic = 1 THEN 'open' ELSE 'irr' END"


@query("e12_confirm_reports", f"""
WITH r AS (SELECT doc_id, {KIND} AS kind FROM labels)
SELECT id, CASE WHEN kind = 'cat' THEN CASE WHEN lang = 'en' THEN 'fixed' WHEN lang = 'fr' THEN 'hint' ELSE '' END ELSE array_to_string(category, ',') END AS labels,
 CASE kind WHEN 'cat' THEN lang IN ('en', 'fr') WHEN 'full' THEN true WHEN 'open' THEN false WHEN 'irr' THEN false ELSE is_active END AS is_active,
 CASE kind WHEN 'cat' THEN CASE WHEN lang IN ('en', 'fr') THEN 'annotated' ELSE 'pending' END WHEN 'full' THEN 'reviewed' WHEN 'open' THEN 'pending' WHEN 'irr' THEN 'pending' ELSE annotation_status END AS status,
 CASE WHEN kind = 'full' THEN 'Z' WHEN kind = 'open' THEN name_zh ELSE name_zh END AS name_zh, CASE WHEN kind = 'open' THEN NULL ELSE md5(description_en) END AS description_md5
FROM doc LEFT JOIN r ON r.doc_id = id""", "doc")
def _(c):
    none = F.lit(None).cast("array<string>")
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    r = c.table("labels").withColumn("kind", F.expr(KIND)).join(c.docs().select(F.col("id").alias("doc_id"), "lang"), "doc_id")
    types = F.when(F.col("kind") == "cat", arr("wrongCategory")).when(F.col("kind") == "full", arr("wrongDetails", "field:name")).when(
        F.col("kind") == "open", arr("wrongDetails", "field:description", "field:price", "irrelevant")).otherwise(arr("irrelevant"))
    reports = r.select(
        F.col("doc_id").alias("id"), types.alias("report_types"), F.when(F.col("lang") == "en", arr("fixed")).otherwise(none).alias("correct_category"),
        F.when(F.col("lang") == "fr", arr("hint")).otherwise(arr()).alias("suggested_category"),
        F.when(F.col("kind") == "full", F.create_map(F.lit("name_zh"), F.lit(" Z "))).otherwise(F.create_map(F.lit("price_info"), F.lit("¥1"))).alias("fixes"), F.lit(None).cast("string").alias("selection_reason"))
    out = e.confirm(annotated_docs(c), reports)
    return out.select("id", F.array_join("category", ",").alias("labels"), "is_active", F.col("annotation_status").alias("status"), "name_zh", F.md5("description_en").alias("description_md5"))


@query("e13_correction_upsert", """
WITH n AS (SELECT l.doc_id, CASE WHEN d.lang = 'en' THEN 'fixed' ELSE 'hint' END AS lab, left(d.raw_description, 500) AS txt, array_to_string(d.category, ',') AS ai FROM labels l JOIN doc d ON d.id = l.doc_id WHERE l.quality = 1 AND d.lang IN ('en', 'fr')),
 o AS (SELECT doc_id, 'old' AS lab, 'old text' AS txt, 'x' AS ai FROM labels WHERE toxic = 0)
SELECT doc_id AS event_id, coalesce(n.lab, o.lab) AS labels, md5(coalesce(n.txt, o.txt)) AS text_md5, coalesce(n.ai, o.ai) AS ai FROM n FULL JOIN o USING (doc_id)""", "doc")
def _(c):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    none = F.lit(None).cast("array<string>")
    r = c.table("labels").where("quality = 1").join(c.docs().select(F.col("id").alias("doc_id"), "lang"), "doc_id").select(
        F.col("doc_id").alias("id"), arr("wrongCategory").alias("report_types"), F.when(F.col("lang") == "en", arr("fixed")).otherwise(none).alias("correct_category"),
        F.when(F.col("lang").isin("en", "fr"), arr("hint")).otherwise(none).alias("suggested_category"))
    new = e.corrections_of(c.docs(), r, REF, 500)
    old = c.table("labels").where("toxic = 0").select(F.col("doc_id").alias("event_id"), F.lit("t").alias("raw_title"), F.lit("old text").alias("raw_description"),
                                                      arr("x").alias("ai_category"), arr("old").alias("corrected_category"), F.lit(REF).cast("timestamp_ntz").alias("created_at"))
    return upsert(old, new, ["event_id"]).select("event_id", F.array_join("corrected_category", ",").alias("labels"), F.md5("raw_description").alias("text_md5"), F.array_join("ai_category", ",").alias("ai"))


@query("e14_bulk_flags", """
SELECT id, is_active AND item NOT IN (SELECT item FROM ev WHERE event_type = 'error' AND value > 90) AS is_active FROM ev""", "ev")
def _(c):
    ev = c.events()
    bad = ev.where("event_type = 'error' AND value > 90").select("item")
    return e.set_flag(ev, bad, "is_active", False, "item").select("id", "is_active")


@query("e15_init_layers", """
SELECT id, coalesce(name_ja, name_zh, name_en) AS raw_title, md5(coalesce(description_ja, description_zh, description_en)) AS text_md5, 'annotated' AS status, '2024-01-25' AS at FROM doc""", "doc")
def _(c):
    bare = c.plain_docs().withColumns({"raw_title": F.lit(None).cast("string"), "raw_description": F.lit(None).cast("string")})
    out = e.init_layers(bare, REF)
    return out.select("id", "raw_title", F.md5("raw_description").alias("text_md5"), F.col("annotation_status").alias("status"), F.date_format("annotated_at", "yyyy-MM-dd").alias("at"))


@query("e16_source_advance", """
SELECT id, CASE WHEN status = 'implemented' OR agent_category <> 'general' THEN status WHEN coalesce(source_type, '') = 'museum' THEN 'recommended' ELSE 'not-viable' END AS status,
 CASE WHEN status <> 'implemented' AND agent_category = 'general' AND coalesce(source_type, '') = 'museum' THEN 'https://new.example.org' ELSE issue_url END AS issue_url,
 CASE WHEN status <> 'implemented' AND agent_category = 'general' THEN '2024-01-25' ELSE strftime(first_seen_at, '%Y-%m-%d') END AS seen FROM reg""", "reg")
def _(c):
    r = c.registry().withColumn("last_seen_at", F.col("first_seen_at"))
    changes = r.where("agent_category = 'general'").select("url", F.lit("not-viable").alias("status"), F.when(F.col("source_type") == "museum", "https://new.example.org").otherwise("").alias("issue_url"))
    return e.advance(r, changes, REF).select("id", "status", "issue_url", F.date_format("last_seen_at", "yyyy-MM-dd").alias("seen"))


@query("e17_register_accounts", """
WITH f AS (SELECT url, id, 'acc ' || CAST(id AS STRING) AS name, CASE WHEN source_type = 'theater' THEN 'note' ELSE 'peatix' END AS platform FROM reg WHERE agent_category = 'note_creator')
SELECT reg.url, CASE WHEN f.url IS NOT NULL THEN f.name ELSE reg.name END AS name, CASE WHEN f.url IS NOT NULL THEN CASE platform WHEN 'note' THEN 'note_creator' ELSE 'peatix_organizer' END ELSE agent_category END AS agent_category,
 CASE WHEN f.url IS NOT NULL THEN 'candidate' ELSE status END AS status,
 CASE WHEN f.url IS NOT NULL THEN CASE platform WHEN 'note' THEN '{"platform":"note.com","creator_id":"a' || CAST(f.id AS STRING) || '","categories":["taiwan_japan"]}' ELSE '{"platform":"peatix","group_id":"a' || CAST(f.id AS STRING) || '","categories":["taiwan_japan"]}' END ELSE source_profile END AS profile
FROM reg LEFT JOIN f ON f.url = reg.url""", "reg")
def _(c):
    r = c.registry()
    found = r.where("agent_category = 'note_creator'").select(
        "url", F.concat(F.lit("acc "), F.col("id").cast("string")).alias("name"), F.when(F.col("source_type") == "theater", "note").otherwise("peatix").alias("platform"),
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("account"))
    return e.register(r, found, REF).select("url", "name", "agent_category", "status", F.col("source_profile").alias("profile"))


@query("e18_verified_new", r"""
SELECT account, page_id, is_new FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS account, page_id, url LIKE 'https%' AS ok, length(html) > 3000 AS is_new FROM pages)
QUALIFY row_number() OVER (PARTITION BY account ORDER BY page_id) = 1 AND ok""")
def _(c):
    from almanack.functions.urls import host_or_raw
    found = c.table("pages").select(host_or_raw(F.col("url")).alias("account"), "page_id", F.col("page_id").alias("ord"), F.col("url").startswith("https").alias("url_verified"), (F.length("html") > 3000).alias("is_new"))
    return e.verified_new(found).select("account", "page_id", "is_new")


@query("e19_apply_mapping", """
SELECT id, coalesce(m.s_name, reg.scraper_source_name) AS scraper_source_name FROM reg LEFT JOIN (SELECT s_suppkey, s_name FROM supplier) m ON m.s_suppkey = reg.id""", "reg")
def _(c):
    m = c.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("scraper_source_name"))
    return e.apply_mapping(c.registry(), m, "id", ["scraper_source_name"]).select("id", "scraper_source_name")
