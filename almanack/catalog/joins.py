"""Upsert, lookup, registry and archive joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.catalog.carriers import REF
from almanack.catalog.registry import query
from almanack.operators import aggregates as a
from almanack.operators import joins as j
from almanack.operators import upsert as u

T = f"TIMESTAMP '{REF}'"

# -- upsert over orders: two overlapping status groups play the table and the batch ------------

EXISTING = ("SELECT o_orderpriority AS source_name, 'o' || CAST(o_orderkey AS STRING) AS source_id, o_totalprice >= 60000 AS is_active, "
            "CASE WHEN o_custkey < 300 THEN 'reviewed' ELSE 'annotated' END AS annotation_status, o_totalprice > 250000 AS force_rescrape, "
            "o_totalprice AS price, CASE WHEN o_custkey > 700 THEN 'https://old.example.org' END AS official_url, 'kept' AS note FROM orders WHERE o_orderstatus IN ('F', 'P')")
INCOMING = ("SELECT o_orderpriority AS source_name, 'o' || CAST(o_orderkey AS STRING) AS source_id, o_totalprice + 1 AS price, true AS is_active, "
            "CASE WHEN o_custkey < 600 THEN 'https://new.example.org' END AS official_url FROM orders WHERE o_orderstatus IN ('O', 'P')")
CLASSIFIED = f"""e AS ({EXISTING}), i AS ({INCOMING}), cl AS (SELECT i.*, CASE WHEN e.source_id IS NULL THEN 'new' WHEN NOT e.is_active THEN 'blocked'
 WHEN e.annotation_status = 'reviewed' THEN 'reviewed' WHEN e.force_rescrape THEN 'forced' ELSE 'existing' END AS class FROM i LEFT JOIN e USING (source_name, source_id))"""


def existing(c):
    o = c.table("orders").where(F.col("o_orderstatus").isin("F", "P"))
    return o.select(
        F.col("o_orderpriority").alias("source_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_id"),
        (F.col("o_totalprice") >= 60000).alias("is_active"),
        F.when(F.col("o_custkey") < 300, "reviewed").otherwise("annotated").alias("annotation_status"),
        (F.col("o_totalprice") > 250000).alias("force_rescrape"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_custkey") > 700, "https://old.example.org").alias("official_url"), F.lit("kept").alias("note"))


def incoming(c):
    o = c.table("orders").where(F.col("o_orderstatus").isin("O", "P"))
    return o.select(
        F.col("o_orderpriority").alias("source_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_id"),
        (F.col("o_totalprice") + 1).alias("price"), F.lit(True).alias("is_active"),
        F.when(F.col("o_custkey") < 600, "https://new.example.org").alias("official_url"))


@query("c1_upsert_classes", f"WITH {CLASSIFIED} SELECT source_name, source_id, class FROM cl")
def _(c):
    return u.classify(incoming(c), existing(c)).select("source_name", "source_id", "class")


@query("a27_class_counts", f"WITH {CLASSIFIED} SELECT class, count(*) AS n FROM cl GROUP BY class")
def _(c):
    return a.class_counts(u.classify(incoming(c), existing(c)))


@query("c2_upsert", f"""
WITH {CLASSIFIED}, w AS (SELECT * FROM cl WHERE class IN ('new', 'forced'))
SELECT source_name, source_id, CASE WHEN w.source_id IS NOT NULL THEN w.price ELSE e.price END AS price,
 CASE WHEN w.source_id IS NOT NULL THEN coalesce(w.official_url, e.official_url) ELSE e.official_url END AS official_url,
 CASE WHEN w.source_id IS NOT NULL THEN 'pending' ELSE e.annotation_status END AS annotation_status,
 CASE WHEN w.source_id IS NOT NULL THEN false ELSE e.force_rescrape END AS force_rescrape, e.note
FROM e FULL JOIN w USING (source_name, source_id)""")
def _(c):
    merged = u.upsert_events(existing(c), incoming(c))
    return merged.select("source_name", "source_id", "price", "official_url", "annotation_status", "force_rescrape", "note")


@query("c22_force_keys", "SELECT source_name, source_id FROM (SELECT o_orderpriority AS source_name, 'o' || CAST(o_orderkey AS STRING) AS source_id, o_orderkey AS id FROM orders) WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(c):
    ev = c.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_name"),
                                  F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_id"))
    return j.force_keys(ev, c.table("lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("id")))


# -- look-ups ------------------------------------------------------------------------------------

@query("c7_not_merged", """
WITH m AS (SELECT 'https://x.example.org/' || CAST(id + 1 AS STRING) AS url FROM doc WHERE lang = 'de')
SELECT id FROM doc WHERE 'https://x.example.org/' || CAST(id AS STRING) NOT IN (SELECT url FROM m)""", "doc")
def _(c):
    url = lambda k: F.concat(F.lit("https://x.example.org/"), k.cast("string"))
    d = c.plain_docs().withColumn("source_url", url(F.col("id")))
    merged = d.where("lang = 'de'").select(F.array(url(F.col("id") + 1)).alias("secondary_source_urls"))
    return j.not_merged(d, merged).select("id")


@query("c8_human_override", """
SELECT doc.id, array_to_string(CASE WHEN l.toxic = 1 THEN ['human'] WHEN l.quality = 1 THEN ['good', 'human'] ELSE category END, ',') AS tags
FROM doc LEFT JOIN labels l ON l.doc_id = doc.id""", "doc")
def _(c):
    tags = F.when(F.col("toxic") == 1, F.array(F.lit("human"))).when(F.col("quality") == 1, F.array(F.lit("good"), F.lit("human"))).otherwise(F.array().cast("array<string>"))
    human = c.table("labels").select(F.col("doc_id").alias("id"), tags.alias("category"))
    return j.override(c.docs(), human).select("id", F.array_join("category", ",").alias("tags"))


W3 = ("array_join(slice(split(raw_title, ' '), 1, 3), ' ')", "array_to_string(string_split(raw_title, ' ')[1:3], ' ')")
NAMED = "CASE WHEN lang IN ('en', 'fr') THEN '「' || {w} || '」 トークイベント レポート' ELSE raw_title || ' - ' || {w} || ' レポート' END"


@query("c9_find_parent", rf"""
WITH r0 AS (SELECT id, source_name, lang, {NAMED.format(w=W3[1])} AS nm FROM doc),
 r1 AS (SELECT *, trim(regexp_extract(nm, '[『「](.+?)[』」]', 1)) AS b, trim(regexp_replace(nm, '\s*(トークイベント|イベント)?\s*レポート[^\n]*$', '')) AS base FROM r0),
 r AS (SELECT id, source_name, CASE WHEN length(b) >= 3 THEN lower(b) END AS t1,
   CASE WHEN length(base) >= 4 THEN lower(CASE WHEN length(trim(regexp_split_to_array(base, '\s*[-－—]\s*')[-1])) < 4 THEN base ELSE trim(regexp_split_to_array(base, '\s*[-－—]\s*')[-1]) END) END AS t2 FROM r1),
 h AS (SELECT r.id, s, e.id AS eid, list_contains(e.category, 'report') AS rep, row_number() OVER (PARTITION BY r.id, s ORDER BY e.id) AS rn
   FROM (SELECT id, source_name, 0 AS s, t1 AS t FROM r UNION ALL SELECT id, source_name, 1, t2 FROM r) r JOIN doc e ON e.source_name = r.source_name AND lower(e.raw_title) LIKE '%' || r.t || '%' WHERE r.t IS NOT NULL),
 p AS (SELECT id, s, min(eid) AS parent_id FROM h WHERE rn <= 10 AND NOT rep GROUP BY 1, 2)
SELECT r.id, arg_min(p.parent_id, p.s) AS parent_id FROM r LEFT JOIN p ON p.id = r.id GROUP BY r.id""", "doc")
def _(c):
    d = c.docs()
    reports = d.withColumn("name_ja", F.expr(NAMED.format(w=W3[0])))
    return j.find_parent(reports, d.withColumn("name_ja", F.col("raw_title")))


@query("c10_parent_label", """
SELECT k.conv_id, k.turn, p.text AS parent_name FROM conversations k LEFT JOIN conversations p ON k.turn > 0 AND p.conv_id = k.conv_id AND p.turn = 0""")
def _(c):
    t = c.table("conversations")
    key = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    rows = t.select("conv_id", "turn", F.when(F.col("turn") > 0, key(F.lit(0))).alias("parent_event_id"))
    names = t.select(key(F.col("turn")).alias("id"), "text")
    return j.with_parent(rows, names, F.col("text")).drop("parent_event_id")


def turns(c):
    """Later turns of a conversation are children of its first one."""
    return c.table("conversations").select(
        "conv_id", "turn", F.col("turn").alias("start_date"), F.col("conv_id").alias("id"), (F.col("role") == "assistant").alias("is_active"),
        F.when(F.col("turn") > 0, F.col("conv_id")).alias("parent_event_id"))


@query("c11_children", """
SELECT conv_id, turn FROM conversations WHERE turn > 0 AND role = 'assistant'""")
def _(c):
    return j.children(turns(c)).select("conv_id", "turn")


@query("c11_children_of_one", "SELECT conv_id, turn FROM conversations WHERE conv_id = 0 AND turn > 0 AND role = 'assistant'")
def _(c):
    return j.children(turns(c), 0).select("conv_id", "turn")


@query("c12_users_roles", """
SELECT c_custkey AS user_id, coalesce(role, 'user') AS role FROM customer LEFT JOIN (
 SELECT DISTINCT o_custkey, 'admin' AS role FROM orders WHERE o_totalprice > 490000) ON c_custkey = o_custkey""")
def _(c):
    users = c.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("created_at"))
    roles = c.table("orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("user_id"), F.lit("admin").alias("role")).distinct()
    return j.users_roles(users, roles).select("user_id", "role")


@query("c13_reports_with_event", """
SELECT l.doc_id AS event_id, l.toxic, d.source_name, d.raw_title AS title FROM labels l LEFT JOIN doc d ON d.id = l.doc_id""", "doc")
def _(c):
    reports = c.table("labels").withColumnRenamed("doc_id", "event_id")
    d = c.plain_docs().withColumn("title", F.col("raw_title"))
    return j.reports_with_event(reports, d, ["source_name", "title"]).select("event_id", "toxic", "event.source_name", "event.title")


@query("c14_saved_events", """
SELECT e.id, strftime(s.start_date, '%Y-%m-%d %H:%M:%S') AS saved_at FROM ev s JOIN ev e ON e.id = s.item WHERE s.user_id = 8 AND s.event_type = 'click'""", "ev")
def _(c):
    e = c.events()
    saves = e.where("event_type = 'click'").select("user_id", F.col("item").cast("long").alias("event_id"), F.col("start_date").alias("saved_at"))
    return j.saved_by(8, saves, e.select("id")).select("id", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"))


@query("c15_name_top", f"""
SELECT id, source_name, view_count FROM ev JOIN (SELECT event_id, count(*) AS view_count FROM views WHERE viewed_at >= {T} - INTERVAL 30 DAYS
 GROUP BY event_id ORDER BY view_count DESC, event_id LIMIT 10) ON id = event_id""", "views")
def _(c):
    top = a.top_viewed(c.views(), REF).drop("share")
    return j.name_top(top, c.events().select("id", "source_name"))


@query("c16_source_counts", """
SELECT id, coalesce(n, 0) AS n_events FROM reg LEFT JOIN (SELECT 'supp_' || CAST(l_suppkey AS STRING) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON scraper_source_name = s""", "reg")
def _(c):
    items = c.table("lineitem").select(F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("source_name"))
    return j.source_counts(c.registry(), items).select("id", "n_events")


STATUS = ("CASE WHEN url LIKE '%/en/%' THEN 'implemented' WHEN url LIKE '%#top' THEN 'not-viable' WHEN url LIKE '%?%' THEN 'candidate' ELSE 'researched' END")


@query("c17_url_status", rf"""
WITH h AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, arg_max({STATUS}, page_id) AS st FROM pages WHERE length(html) > 3000 GROUP BY 1)
SELECT page_id, st AS current_status FROM pages LEFT JOIN h ON h.h = regexp_extract(url, '^https?://([^/?#]+)', 1)""")
def _(c):
    p = c.table("pages")
    registry = p.where("length(html) > 3000").select("url", F.expr(STATUS).alias("status"), F.col("page_id").alias("id"))
    return j.url_status(p.select("page_id", "url"), registry).select("page_id", "current_status")


REG0 = (f"SELECT url, max({STATUS}) AS status, 'old' AS name, TIMESTAMP '2023-05-01 00:00:00' AS first_seen_at, TIMESTAMP '2023-06-01 00:00:00' AS last_seen_at FROM pages WHERE length(html) > 2500 GROUP BY url")


def page_registry(c):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return c.table("pages").where("length(html) > 2500").groupBy("url").agg(F.max(F.expr(STATUS)).alias("status")).select(
        "url", "status", F.lit("old").alias("name"), at("2023-05-01").alias("first_seen_at"), at("2023-06-01").alias("last_seen_at"))


@query("c18_registry_upsert", f"""
WITH r AS ({REG0}), f AS (SELECT url, 'new ' || CAST(max(page_id) AS STRING) AS name FROM pages WHERE url LIKE 'https%' GROUP BY url)
SELECT url, CASE WHEN f.url IS NOT NULL AND coalesce(r.status, 'candidate') = 'candidate' THEN 'candidate' ELSE r.status END AS status,
 CASE WHEN f.url IS NOT NULL AND coalesce(r.status, 'candidate') = 'candidate' THEN f.name ELSE r.name END AS name,
 strftime(CASE WHEN f.url IS NOT NULL AND r.url IS NULL THEN {T} ELSE r.first_seen_at END, '%Y-%m-%d') AS first_seen,
 strftime(CASE WHEN f.url IS NOT NULL THEN {T} ELSE r.last_seen_at END, '%Y-%m-%d') AS last_seen FROM r FULL JOIN f USING (url)""")
def _(c):
    found = c.table("pages").select("url", F.concat(F.lit("new "), F.col("page_id").cast("string")).alias("name"),
                                    F.col("url").startswith("https").alias("url_verified"), F.col("page_id").alias("ord"))
    out = j.upsert_registry(page_registry(c), found, REF)
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return out.select("url", "status", "name", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"))


@query("c19_only_new", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE length(html) > 2500)")
def _(c):
    return j.only_new(c.table("pages"), page_registry(c)).select("page_id")


@query("c20_archive_children", f"""
SELECT doc_id AS source_event_id, 'purged' AS archive_reason, '2024-01-25' AS archived_on, doc_id * 10 AS original_id, toxic FROM labels WHERE doc_id IN (SELECT id FROM doc WHERE NOT is_active)""", "doc")
def _(c):
    child = c.table("labels").select((F.col("doc_id") * 10).alias("id"), F.col("doc_id").alias("event_id"), "toxic")
    out = j.archive_children(child, c.docs().where("NOT is_active"), "purged", REF)
    return out.select("source_event_id", "archive_reason", F.date_format("archived_at", "yyyy-MM-dd").alias("archived_on"), "original_id", "toxic")


@query("c21_purge_orphans", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
def _(c):
    return j.purge_orphans(c.table("labels"), c.plain_docs().where("lang <> 'de'"), "doc_id").select("doc_id", "quality")


@query("c21_orphans", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
def _(c):
    return j.orphans(c.table("labels"), c.plain_docs().where("lang <> 'de'"), "doc_id").select("doc_id", "quality")


@query("c23_pick_ordered", """
SELECT e.id, e.source_name, p.pos FROM ev e JOIN (SELECT item AS id, min(id) AS pos FROM ev WHERE event_type = 'purchase' GROUP BY item) p ON p.id = e.id""", "ev")
def _(c):
    e = c.events()
    picks = e.where("event_type = 'purchase'").groupBy(F.col("item").cast("long").alias("id")).agg(F.min("id").alias("pos"))
    return j.pick_ordered(e, picks).select("id", "source_name", "pos")


@query("c24_creator_events", """
SELECT l_orderkey, l_linenumber, s_name, p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""")
def _(c):
    links = c.table("lineitem").select(F.col("l_suppkey").alias("creator_id"), F.col("l_partkey").alias("event_id"), "l_orderkey", "l_linenumber")
    creators = c.table("supplier").select(F.col("s_suppkey").alias("creator_id"), "s_name")
    events = c.table("part").select(F.col("p_partkey").alias("event_id"), "p_name")
    return j.creator_events(creators, links, events).select("l_orderkey", "l_linenumber", "s_name", "p_name")


@query("c25_seed_union", """
SELECT id, name, 'seed' AS origin FROM reg WHERE status = 'implemented' UNION ALL
SELECT id, name, 'stored' FROM reg WHERE status <> 'implemented' AND name NOT IN (SELECT name FROM reg WHERE status = 'implemented')""", "reg")
def _(c):
    r = c.registry()
    seed = r.where("status = 'implemented'").select("id", "name", F.lit("seed").alias("origin"))
    stored = r.where("status <> 'implemented'").select("id", "name", F.lit("stored").alias("origin"))
    return j.seed_union(seed, stored, "name")


@query("s12_event_row", f"""
SELECT id, CASE WHEN official_url <> '' THEN official_url END AS official_url, '2024-01-25 12:00:00' AS scraped_at FROM doc""", "doc")
def _(c):
    return u.event_row(c.plain_docs(), REF).select("id", "official_url", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


@query("e20_updated_stamp", f"""
SELECT source_name, source_id, CASE WHEN price <> old_price THEN '2024-01-25' ELSE '2020-01-01' END AS updated FROM (
 SELECT o_orderpriority AS source_name, 'o' || CAST(o_orderkey AS STRING) AS source_id, o_totalprice AS old_price, CASE WHEN o_custkey < 500 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders)""")
def _(c):
    o = c.table("orders")
    base = [F.col("o_orderpriority").alias("source_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_id")]
    at = F.lit("2020-01-01").cast("timestamp_ntz").alias("updated_at")
    old = o.select(*base, F.col("o_totalprice").alias("price"), at)
    new = o.select(*base, F.when(F.col("o_custkey") < 500, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"), at)
    return u.stamp(old, new, REF, ["source_name", "source_id"]).select("source_name", "source_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))
