"""Latest-per-key, dedup, ordered picks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.catalog.carriers import REF
from almanack.catalog.registry import query
from almanack.operators import ordering as o
from almanack.operators import sets as s
from almanack.operators.numbering import number_rows

T = f"TIMESTAMP '{REF}'"


@query("w1_latest_per_key", """
SELECT source, id, events_processed FROM runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY ran_at DESC, id DESC) = 1""", "runs")
def _(c):
    return o.latest_per_key(c.runs(), ["source"], "ran_at").select("source", "id", "events_processed")


@query("w2_dedup_in_source", r"""
SELECT id FROM (SELECT id, source_id, source_name, lower(regexp_replace(coalesce(name_en,''), '^\s+|\s+$', '', 'g')) AS nm, CAST(start_date AS DATE) AS d FROM doc)
QUALIFY contains(source_id, '_sub') OR nm = '' OR row_number() OVER (PARTITION BY source_name, nm, d, contains(source_id, '_sub') ORDER BY id) = 1""", "doc")
def _(c):
    return o.dedup_first(c.plain_docs(), ["id"], "name_en").select("id")


@query("w2_dedup_across_sources", r"""
SELECT id FROM (SELECT id, lower(regexp_replace(raw_title, '^\s+|\s+$', '', 'g')) AS nm, CAST(start_date AS DATE) AS d FROM doc)
QUALIFY nm = '' OR row_number() OVER (PARTITION BY nm, d ORDER BY id) = 1""", "doc")
def _(c):
    one = c.plain_docs().withColumns({"source_name": F.lit("all"), "source_id": F.col("id").cast("string")})
    return o.dedup_first(one, ["id"], "raw_title").select("id")


@query("w3_dedup_by_id", "SELECT item, id FROM ev QUALIFY row_number() OVER (PARTITION BY item ORDER BY start_date, id) = 1", "ev")
def _(c):
    return o.dedup_by_id(c.events(), "item", "start_date", "id").select("item", "id")


LINKS = ("transform(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), u -> named_struct('url', u))",
         "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")


@query("w4_first_per_url", f"""
SELECT page_id, url, CAST(min(pos) AS INT) AS pos FROM (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, {LINKS[1]} AS l FROM pages)) GROUP BY 1, 2""")
def _(c):
    d = c.table("pages").withColumn("links", F.expr(LINKS[0]))
    return o.first_per_url(d, "page_id", "links").select("page_id", "item.url", "pos")


@query("w5_best_candidate", """
SELECT user_id, id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 99 END, start_date, id) = 1""", "ev")
def _(c):
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2).otherwise(99)
    return o.best_candidate(c.events(), "user_id", rank, "start_date", "id").select("user_id", "id", "event_type")


@query("w6_child_numbering", """
SELECT conv_id, turn, 'c' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) || '_sub' || CAST(pos AS STRING) AS child_id, line FROM (
 SELECT conv_id, turn, unnest(w) AS line, generate_subscripts(w, 1) AS pos FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS w FROM conversations))""")
def _(c):
    d = c.table("conversations").withColumns({
        "base": F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")),
        "key": F.struct("conv_id", "turn"), "lines": F.split("text", "\n")})
    return o.number_children(d, "key", "lines", "base").select("key.conv_id", "key.turn", "child_id", F.col("item").alias("line"))


@query("w7_distinct_ordered", r"""
SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: row(list_position(w, x), x))), lambda y: y[2]), '/') AS words
FROM (SELECT doc_id, list_concat(string_split(text, ' '), string_split(lang || ' ' || source, ' ')) AS w FROM documents)""")
def _(c):
    d = c.table("documents")
    first = F.split("text", " ")
    second = F.split(F.concat("lang", F.lit(" "), "source"), " ")
    return d.select("doc_id", F.array_join(o.distinct_ordered(first, second), "/").alias("words"))


@query("w8_sort_any", """
SELECT id, row_number() OVER (ORDER BY coalesce(location_name, ''), id) AS pos FROM ev""", "ev")
def _(c):
    e = c.events()
    ranked = number_rows(e.select("id", o.sort_key(e, "location_name").alias("k")), ["k", "id"])
    return ranked.select("id", "pos")


@query("w8_sort_boolean", "SELECT id, is_active FROM ev", "ev")
def _(c):
    return o.sort_any(c.events(), "is_active", "desc").select("id", "is_active")


@query("w9_verified_first", """
SELECT page_id, row_number() OVER (ORDER BY url LIKE 'https%' DESC, page_id) AS pos FROM pages""")
def _(c):
    d = c.table("pages").select("page_id", F.col("url").startswith("https").alias("ok"))
    return number_rows(d, [F.col("ok").desc(), F.col("page_id")]).select("page_id", "pos")


@query("w9_verified_first_sorted", "SELECT page_id, url LIKE 'https%' AS ok FROM pages")
def _(c):
    return o.verified_first(c.table("pages").select("page_id", F.col("url").startswith("https").alias("ok")), "ok", "page_id")


@query("w10_two_key_sort", "SELECT id, row_number() OVER (ORDER BY is_active DESC, name, id) AS pos FROM place", "place")
def _(c):
    return number_rows(c.places().select("id", "is_active", "name"), [F.col("is_active").desc(), F.col("name"), F.col("id")]).select("id", "pos")


@query("w11_newest", "SELECT id, raw_title FROM doc WHERE is_paid IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 15", "doc")
def _(c):
    return o.newest(c.docs().where("is_paid is not null"), "created_at", 15).select("id", "raw_title")


QUOTAS = {"arts": 2, "lifestyle": 1, "knowledge": 1, "society": 1}
FALLBACK = {"arts": "knowledge", "lifestyle": "knowledge", "knowledge": "society", "society": "arts"}


@query("w12_quota_selection", """
WITH g AS (SELECT id, start_date, CASE WHEN list_contains(category, 'business') THEN 'lifestyle' WHEN list_contains(category, 'lecture') THEN 'knowledge' WHEN list_contains(category, 'history') THEN 'society' WHEN list_contains(category, 'movie') THEN 'arts' END AS grp FROM doc WHERE is_active),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY start_date, id) AS rk FROM g WHERE grp IS NOT NULL),
 m AS (SELECT *, rk <= CASE grp WHEN 'arts' THEN 2 ELSE 1 END AS mandatory FROM r)
SELECT id, grp, mandatory FROM m ORDER BY mandatory DESC, start_date, id LIMIT 7""", "doc")
def _(c):
    has = lambda t: F.array_contains("category", t)
    grp = F.when(has("business"), "lifestyle").when(has("lecture"), "knowledge").when(has("history"), "society").when(has("movie"), "arts")
    d = c.docs().where("is_active").withColumn("grp", grp)
    return o.quota_select(d, QUOTAS, FALLBACK, 7).select("id", "grp", "mandatory")


@query("w12_quota_fallback", """
WITH g AS (SELECT id, start_date, CASE WHEN list_contains(category, 'lecture') THEN 'knowledge' WHEN list_contains(category, 'history') THEN 'society' END AS grp FROM doc WHERE is_active),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY start_date, id) AS rk FROM g WHERE grp IS NOT NULL),
 m AS (SELECT *, rk <= CASE grp WHEN 'knowledge' THEN 4 ELSE 1 END AS mandatory FROM r)
SELECT id, grp, mandatory FROM m ORDER BY mandatory DESC, start_date, id LIMIT 7""", "doc")
def _(c):
    has = lambda t: F.array_contains("category", t)
    d = c.docs().where("is_active").withColumn("grp", F.when(has("lecture"), "knowledge").when(has("history"), "society"))
    return o.quota_select(d, QUOTAS, FALLBACK, 7).select("id", "grp", "mandatory")


@query("w13_first_tags", "SELECT id, array_to_string(category[1:2], ',') AS tags FROM doc", "doc")
def _(c):
    return c.docs().select("id", F.array_join(o.first_tags("category", 2), ",").alias("tags"))


@query("w14_status_split", """
SELECT id, CASE WHEN annotation_status = 'pending' THEN 'pending' ELSE 'rest' END AS part FROM ev""", "ev")
def _(c):
    a, b = o.split_status(c.events(), "annotation_status", "pending")
    return a.select("id", F.lit("pending").alias("part")).unionByName(b.select("id", F.lit("rest").alias("part")))


# -- sets ---------------------------------------------------------------------------------

@query("g1_union_last", """
SELECT id, coalesce(b.v, a.v) AS v FROM (SELECT id, value AS v FROM ev WHERE start_date < TIMESTAMP '2024-01-20') a
FULL JOIN (SELECT id, value + 1 AS v FROM ev WHERE start_date >= TIMESTAMP '2024-01-10') b USING (id)""", "ev")
def _(c):
    e = c.events()
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    a = e.where(F.col("start_date") < at("2024-01-20")).select("id", F.col("value").alias("v"))
    b = e.where(F.col("start_date") >= at("2024-01-10")).select("id", (F.col("value") + 1).alias("v"))
    return s.union_last(a, b, "id")


@query("g2_set_difference", f"""
SELECT DISTINCT source FROM runs WHERE source NOT IN (SELECT source FROM runs WHERE ran_at BETWEEN {T} - INTERVAL 2 HOURS AND {T}) AND source NOT IN ('view_1')""", "runs")
def _(c):
    r = c.runs()
    at = F.lit(REF).cast("timestamp_ntz")
    ran = r.where(F.col("ran_at").between(at - F.expr("interval 2 hours"), at))
    return s.missing(r, ran, "source", ["view_1"])


@query("g3_tags_union", "SELECT id, array_to_string(list_sort(list_distinct(list_concat(category, [lang, 'art']))), ',') AS tags FROM doc", "doc")
def _(c):
    return c.docs().select("id", F.array_join(s.tags_union(F.col("category"), F.array("lang", F.lit("art"))), ",").alias("tags"))


@query("g4_tags_added", """
SELECT id, array_to_string(list_sort(list_filter(['art', 'tech', lang], lambda x: list_contains(['art', 'tech', 'urban'], x) AND NOT list_contains(category, x))), ',') AS added FROM doc""", "doc")
def _(c):
    found = F.array(F.lit("art"), F.lit("tech"), F.col("lang"))
    added = s.tags_added(found, F.array(*[F.lit(x) for x in ("art", "tech", "urban")]), F.col("category"))
    return c.docs().select("id", F.array_join(F.array_sort(added), ",").alias("added"))


@query("g5_drop_tag", """
SELECT id, array_to_string(CASE WHEN is_paid THEN list_filter(category, lambda x: x <> 'tech') ELSE category END, ',') AS tags FROM doc""", "doc")
def _(c):
    d = c.docs()
    return s.drop_tag(d, d.where("is_paid"), "tech").select("id", F.array_join("category", ",").alias("tags"))


@query("g6_stack", "SELECT o_orderkey, 'new' AS part FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'forced' FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(c):
    r = c.table("orders")
    pick = lambda w, p: r.where(w).select("o_orderkey", F.lit(p).alias("part"))
    return s.stack(pick("o_orderstatus = 'O'", "new"), pick("o_orderpriority = '1-URGENT'", "forced"))


@query("g7_tags_changed", "SELECT id, list_sort(category) <> list_sort(['tech', 'movie']) AS changed FROM doc", "doc")
def _(c):
    return c.docs().select("id", s.tags_changed(F.col("category"), F.array(F.lit("tech"), F.lit("movie"))).alias("changed"))


@query("g8_force_flag", """
SELECT o_orderkey, o_orderpriority = '1-URGENT' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) AS force_rescrape FROM orders""")
def _(c):
    d = c.table("orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("force_rescrape"))
    keys = c.table("lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return s.force_flag(d, keys, ["o_orderkey"])
