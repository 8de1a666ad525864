"""Entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanack.catalog.registry import query
from almanack.functions.places import venue_tokens, venues_overlap
from almanack.functions.similarity import norm_name, ratio
from almanack.operators import resolve as r
from almanack.plans.broadcast import broadcast
from almanack.plans.daily import daily_batch, merge_decisions, run_log

RANKS = {"src0": 1, "src1": 2, "src2": 3, "src3": 3, "src4": 5}


def titled(c, labelled=False):
    """Documents as listings whose name is the title; the day is the block."""
    return r.mergeable((c.docs() if labelled else c.plain_docs()).withColumns({"name_ja": F.col("raw_title"), "is_active": F.lit(True)}))


DAY = lambda: F.to_date("start_date")


# Names whose likeness is known in closed form: 36 distinct characters, the last 0, 1, 4 or 7 of them
# replaced by characters of the variant's own. Two variants share all but the longer tail.
STEMS = ("abcdefghijklmnopqrstuvwxyz0123456789", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもや")
TAILS = ("", "α", "βγδε", "ζηθικλμ")
TAIL = "CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TAILS)) + " END"
STEM = f"CASE CAST(floor(o_custkey / 5) AS INT) % 2 WHEN 0 THEN '{STEMS[0]}' ELSE '{STEMS[1]}' END"
WRITTEN = f"substr({STEM}, 1, 36 - length({TAIL})) || {TAIL}"
WRITTEN_SQL = f"""w AS (SELECT o_orderkey AS id, 'src' || CAST(o_custkey % 5 AS STRING) AS src, [1, 2, 3, 3, 5][o_custkey % 5 + 1] AS rank, CAST(o_orderdate AS DATE) AS day, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS start,
 CAST(floor(o_custkey / 5) AS INT) % 2 AS g, o_orderkey % 4 AS v, length({TAIL}) AS a, {WRITTEN} AS name FROM orders)"""
ALIKE = "CASE WHEN x.v = y.v THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (36 - greatest(x.a, y.a)) / 72 END"


def written(c):
    o = c.table("orders")
    return r.mergeable(o.selectExpr(
        "o_orderkey AS id", "'src' || CAST(o_custkey % 5 AS STRING) AS source_name", "'s' || CAST(o_orderkey AS STRING) AS source_id", "'u' || CAST(o_orderkey AS STRING) AS source_url",
        f"{WRITTEN} AS name_ja", "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT)) AS start_date", "true AS is_active",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'off' || CAST(o_orderkey AS STRING) END AS official_url", "'text of ' || CAST(o_orderkey AS STRING) || '.' AS raw_description",
        "'annotated' AS annotation_status", "CAST(array() AS array<string>) AS secondary_source_urls"))


@query("c3_written_pairs", f"""
WITH {WRITTEN_SQL}, p AS (SELECT day, g, v, a, md5(name) AS m, count(*) AS n, min(src) AS lo, max(src) AS hi FROM w GROUP BY ALL)
SELECT strftime(x.day, '%Y-%m-%d') AS day, x.m AS a, y.m AS b, {ALIKE} AS sim_ab, {ALIKE} AS sim_ba, x.n AS n_a, y.n AS n_b FROM p x JOIN p y ON x.day = y.day AND x.g = y.g AND x.m < y.m
 WHERE greatest(x.a, y.a) <= 5 AND NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo)
UNION ALL SELECT strftime(day, '%Y-%m-%d'), m, m, 1.0, 1.0, n, n FROM p WHERE lo <> hi""")
def _(c):
    p = r.similar_pairs(written(c), DAY()).withColumns({"ma": F.md5("norm_a"), "mb": F.md5("norm_b")})
    turn = F.col("ma") > F.col("mb")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return p.select(
        F.date_format("block", "yyyy-MM-dd").alias("day"), pick("ma", "mb").alias("a"), pick("mb", "ma").alias("b"),
        pick("sim_ab", "sim_ba").alias("sim_ab"), pick("sim_ba", "sim_ab").alias("sim_ba"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"))


# The scan of a day, row by row: who absorbs the next row, 0 if nobody.
SCAN_SQL = f"""{WRITTEN_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY start, id) AS k FROM w),
 d AS (SELECT day, count(*) AS n, list(g ORDER BY k) AS g, list(v ORDER BY k) AS v, list(a ORDER BY k) AS a, list(src ORDER BY k) AS s, list(rank ORDER BY k) AS r FROM k GROUP BY day),
 t AS (SELECT day, 1 AS k, [0::BIGINT] AS b FROM d UNION ALL
  SELECT d.day, t.k + 1, list_append(t.b, coalesce(list_filter(range(1, t.k + 1), lambda j: t.b[j] = 0 AND d.g[j] = d.g[t.k + 1] AND d.s[j] <> d.s[t.k + 1] AND d.r[j] <= d.r[t.k + 1]
   AND (d.v[j] = d.v[t.k + 1] OR greatest(d.a[j], d.a[t.k + 1]) <= 5))[1], 0)) FROM t JOIN d ON d.day = t.day WHERE t.k < d.n),
 u AS (SELECT k.*, t.b[k.k] AS by_k FROM k JOIN d ON d.day = k.day JOIN t ON t.day = k.day AND t.k = d.n),
 m AS (SELECT y.id AS primary_id, x.id AS secondary_id, {ALIKE} AS sim FROM u x JOIN u y ON x.day = y.day AND y.k = x.by_k
  UNION ALL SELECT y.id, x.id, {ALIKE} FROM u x JOIN u y ON x.day = y.day AND x.g = y.g AND x.k < y.k AND x.src <> y.src AND x.rank > y.rank
   WHERE x.by_k = 0 AND (y.by_k = 0 OR y.by_k > x.k) AND (x.v = y.v OR greatest(x.a, y.a) <= 5))"""


@query("c4_written_primary", f"WITH RECURSIVE {SCAN_SQL} SELECT * FROM m")
def _(c):
    return r.assign_primary(written(c), DAY(), ranks=RANKS)


@query("c4_written_rows", f"""WITH RECURSIVE {SCAN_SQL}, a AS (SELECT x.id, y.id AS absorbed_by FROM u x JOIN u y ON x.day = y.day AND y.k = x.by_k),
 n AS (SELECT primary_id AS id, count(*) AS n FROM m GROUP BY 1)
SELECT u.id, a.absorbed_by, CAST(coalesce(n.n, 0) AS BIGINT) AS secondaries, u.id IN (SELECT secondary_id FROM m) AS lost FROM u LEFT JOIN a ON a.id = u.id LEFT JOIN n ON n.id = u.id""")
def _(c):
    return r.decide(written(c), DAY(), ranks=RANKS).rows()


@query("e1_written_merge", f"""
WITH RECURSIVE {SCAN_SQL}, f AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'off' || CAST(id AS STRING) END AS official, 'text of ' || CAST(id AS STRING) || '.' AS text FROM w),
 s AS (SELECT m.primary_id AS id, count(*) AS n, first(f.official ORDER BY f.start, f.id) FILTER (f.official IS NOT NULL) AS official,
  string_agg(chr(10) || chr(10) || '---' || chr(10) || '別来源補足 (' || f.src || ')' || chr(10) || f.text, '' ORDER BY f.start, f.id) AS more FROM m JOIN f ON f.id = m.secondary_id GROUP BY 1)
SELECT f.id, f.id NOT IN (SELECT secondary_id FROM m) AS is_active, CASE WHEN s.n > 0 THEN 'pending' ELSE 'annotated' END AS annotation_status, CAST(coalesce(s.n, 0) AS INT) AS n_urls,
 coalesce(f.official, s.official) AS official_url, md5(f.text || coalesce(s.more, '')) AS text_md5 FROM f LEFT JOIN s ON s.id = f.id""")
def _(c):
    rows = written(c)
    merged = r.apply_merge(rows, r.assign_primary(rows, DAY(), ranks=RANKS))
    return merged.select("id", "is_active", "annotation_status", F.size("secondary_source_urls").alias("n_urls"), "official_url", F.md5("raw_description").alias("text_md5"))


@query("c6_written_audit", f"""
WITH {WRITTEN_SQL} SELECT {ALIKE} AS sim, x.id AS id_a, y.id AS id_b FROM w x JOIN w y ON x.g = y.g AND y.day BETWEEN x.day AND x.day + 3 AND (x.start, x.id) < (y.start, y.id) AND x.src <> y.src
WHERE x.v = y.v OR greatest(x.a, y.a) <= 7 ORDER BY 1 DESC, 2, 3 LIMIT 50""")
def _(c):
    return r.audit_pairs(written(c), days=3, k=50)


@query("c3_similar_pairs")
def _(c):
    return r.similar_pairs(titled(c), DAY()).select(
        F.date_format("block", "yyyy-MM-dd").alias("day"), F.md5("norm_a").alias("a"), F.md5("norm_b").alias("b"), "sim_ab", "sim_ba", "n_a", "n_b")


@query("c3_similar_pairs_by_language")
def _(c):
    return r.similar_pairs(titled(c), F.col("lang"), threshold=0.9).select(
        F.col("block").alias("lang"), F.md5("norm_a").alias("a"), F.md5("norm_b").alias("b"), "sim_ab", "sim_ba", "n_a", "n_b")


@query("c4_assign_primary")
def _(c):
    return r.assign_primary(titled(c), DAY(), ranks=RANKS)


@query("e1_apply_merge")
def _(c):
    rows = titled(c, labelled=True)
    merged = r.apply_merge(rows, r.assign_primary(rows, DAY(), ranks=RANKS))
    return merged.select("id", "is_active", "annotation_status", F.size("secondary_source_urls").alias("n_urls"), "official_url", F.md5("raw_description").alias("text_md5"))


NEWS_RANKS = {f"purchase_{i}": i % 4 for i in range(10)}
RANK_SQL = "CASE WHEN o.event_type = 'purchase' THEN CAST(split_part(o.source_name, '_', 2) AS INT) % 4 ELSE 99 END"
TOKENS = r"list_distinct(list_filter(regexp_split_to_array(location_name, '[\s\x{3000}\x{00a0}、,（()）・]'), lambda x: length(x) >= 2))"


@query("c5_match_news", f"""
WITH n AS (SELECT id, CAST(start_date AS DATE) AS d, unnest({TOKENS}) AS tok FROM ev WHERE event_type = 'signup'),
 o AS (SELECT id, event_type, source_name, start_date, CAST(start_date AS DATE) AS s, CAST(coalesce(end_date, start_date) AS DATE) AS e, unnest({TOKENS}) AS tok FROM ev WHERE event_type IN ('purchase', 'view'))
SELECT news_id, official_id, CAST(rank AS INT) AS rank FROM (SELECT n.id AS news_id, o.id AS official_id, {RANK_SQL} AS rank, o.start_date FROM n JOIN o ON n.tok = o.tok AND n.d BETWEEN o.s - 2 AND o.e)
QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY rank, start_date, official_id) = 1""", "ev")
def _(c):
    e = c.events()
    return r.match_news(e.where("event_type = 'signup'"), e.where("event_type IN ('purchase', 'view')"), lookback=2, ranks=NEWS_RANKS)


@query("c6_audit_pairs")
def _(c):
    return r.audit_pairs(titled(c), days=3, k=50)


@query("h3_norm_name", r"""
SELECT id, md5(lower(regexp_replace(regexp_replace(replace(replace(raw_title, '®', '(r)'), 'Ⓡ', '(r)'), '[－—\-][^－—\-]{2,}[－—\-]\s*$', ''), '[\s\x{3000}\x{00a0}]+', '', 'g'))) AS norm_md5 FROM doc""", "doc")
def _(c):
    return c.plain_docs().select("id", F.md5(norm_name(F.col("raw_title"))).alias("norm_md5"))


@query("h4_ratio")
def _(c):
    d = c.plain_docs().select("id", norm_name(F.col("raw_title")).alias("a"), norm_name(F.concat(F.col("source_name"), F.lit(" "), F.col("raw_title"))).alias("b"))
    return d.select("id", ratio(F.col("a"), F.col("b")).alias("sim"))


@query("h4_written_ratio", """
WITH p AS (SELECT o_orderkey, o_orderkey % 4 AS v, CAST(floor(o_orderkey / 4) AS BIGINT) % 4 AS u, [0, 1, 4, 7] AS a FROM orders)
SELECT o_orderkey AS id, CASE WHEN v = u THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (36 - greatest(a[v + 1], a[u + 1])) / 72 END AS sim FROM p""")
def _(c):
    other = WRITTEN.replace("o_orderkey % 4", "CAST(floor(o_orderkey / 4) AS BIGINT) % 4")
    names = c.table("orders").selectExpr("o_orderkey AS id", f"{WRITTEN} AS a", f"{other} AS b")
    return names.select("id", ratio(F.col("a"), F.col("b")).alias("sim"))


OTHER = "'ホール' || CAST(item + 1 AS STRING) || ' 会館' || CAST(CAST(floor(item / 7) AS INT) AS STRING) || ' 中'"


@query("h5_venue_overlap", rf"""
SELECT id, array_to_string(list_sort({TOKENS}), '|') AS tokens, coalesce(list_has_any({TOKENS}, {TOKENS.replace('location_name', f'({OTHER})')}), false) AS overlap FROM ev""", "ev")
def _(c):
    e = c.events()
    other = F.expr(OTHER)
    return e.select("id", F.array_join(F.array_sort(venue_tokens(F.col("location_name"))), "|").alias("tokens"),
                    venues_overlap(F.col("location_name"), other).alias("overlap"))


@query("h7_source_rank", "SELECT id, CASE source_name WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 WHEN 'src3' THEN 3 WHEN 'src4' THEN 5 ELSE 99 END AS rank FROM doc", "doc")
def _(c):
    return c.plain_docs().select("id", r.source_rank(F.col("source_name"), RANKS).alias("rank"))


@query("h8_append_description", """
SELECT id, md5(CASE WHEN raw_title <> '' AND NOT contains(coalesce(description_en, ''), raw_title) THEN coalesce(description_en, '') || chr(10) || chr(10) || '---' || chr(10) || '別来源補足 (' || source_name || ')' || chr(10) || raw_title ELSE coalesce(description_en, '') END) AS text_md5 FROM doc""", "doc")
def _(c):
    p = F.coalesce(F.col("description_en"), F.lit(""))
    return c.plain_docs().select("id", F.md5(r.append_desc(p, F.col("raw_title"), F.col("source_name"))).alias("text_md5"))


# -- messages and the daily batch --------------------------------------------------------------

HEAD = {"zh": ("週報", "【本週】", "【下月】"), "ja": ("週間", "【今週】", "【来月】"), "en": ("Weekly", "【This Week】", "【Next Month】")}
FOOT = {"zh": "完", "ja": "以上", "en": "end"}
TITLE = "coalesce(nullif(CASE lang WHEN 'zh' THEN name_zh WHEN 'ja' THEN name_ja ELSE name_en END, ''), nullif(name_zh, ''), nullif(name_ja, ''), nullif(name_en, ''), '?')"


@query("h49_broadcast_messages", f"""
WITH w AS (SELECT *, row_number() OVER (ORDER BY start_date, id) AS pos FROM doc WHERE is_active AND start_date >= TIMESTAMP '2024-01-05' QUALIFY pos <= 7),
 m AS (SELECT *, row_number() OVER (ORDER BY start_date, id) AS pos FROM doc WHERE is_active AND start_date >= TIMESTAMP '2024-02-05' QUALIFY pos <= 3),
 l AS (SELECT unnest(['zh', 'ja', 'en']) AS lang), D AS (SELECT '%-m/%-d' AS f),
 wl AS (SELECT l.lang, string_agg('• ' || {TITLE} || '　' || strftime(start_date + INTERVAL 9 HOURS, '%-m/%-d') || chr(10) || '  https://x.example.org/r/' || CAST(id AS STRING), chr(10) ORDER BY pos) AS t FROM (SELECT * EXCLUDE (lang) FROM w) w2, l GROUP BY 1),
 ml AS (SELECT l.lang, string_agg('• ' || {TITLE} || '（' || strftime(start_date + INTERVAL 9 HOURS, '%-m/%-d') || CASE WHEN end_date IS NOT NULL AND strftime(end_date + INTERVAL 9 HOURS, '%-m/%-d') <> strftime(start_date + INTERVAL 9 HOURS, '%-m/%-d') THEN '–' || strftime(end_date + INTERVAL 9 HOURS, '%-m/%-d') ELSE '' END || '）' || chr(10) || '  https://x.example.org/r/' || CAST(id AS STRING), chr(10) ORDER BY pos) AS t FROM (SELECT * EXCLUDE (lang) FROM m) m2, l GROUP BY 1)
SELECT wl.lang, CASE wl.lang WHEN 'zh' THEN '週報' WHEN 'ja' THEN '週間' ELSE 'Weekly' END || chr(10) || '1/25 ～ 1/31' || chr(10) || chr(10) || CASE wl.lang WHEN 'zh' THEN '【本週】' WHEN 'ja' THEN '【今週】' ELSE '【This Week】' END || chr(10) || wl.t
 || chr(10) || chr(10) || CASE wl.lang WHEN 'zh' THEN '【下月】' WHEN 'ja' THEN '【来月】' ELSE '【Next Month】' END || chr(10) || ml.t || chr(10) || chr(10) || CASE wl.lang WHEN 'zh' THEN '完' WHEN 'ja' THEN '以上' ELSE 'end' END AS message FROM wl JOIN ml ON wl.lang = ml.lang""", "doc")
def _(c):
    d = c.docs().where("is_active").drop("lang")
    at = lambda x: F.lit(x).cast("timestamp_ntz")

    def picks(since, n):
        top = d.where(F.col("start_date") >= at(since)).orderBy("start_date", "id").limit(n)
        return top.withColumn("pos", F.row_number().over(Window.orderBy("start_date", "id")))

    return broadcast(picks("2024-01-05", 7), picks("2024-02-05", 3), "2024-01-25 12:00:00", "https://x.example.org", HEAD, FOOT)


@query("daily_merge_decisions")
def _(c):
    return merge_decisions(titled(c), RANKS, ["src18", "src19"])


@query("daily_batch")
def _(c):
    d = titled(c, labelled=True).withColumns({"force_rescrape": F.lit(False), "scraped_at": F.lit(None).cast("timestamp_ntz")})
    target, landed = d.where("lang IN ('en', 'fr')"), d.where("lang IN ('fr', 'de', 'es')")
    out = daily_batch(target, landed, "2024-01-25 12:00:00", ranks=RANKS, news_sources=["src18", "src19"])
    return out.select("id", "source_name", "is_active", "annotation_status", F.size("secondary_source_urls").alias("n_urls"))


# The daily run over written names: every other order is stored, all are landed, a third of them annotated.
DAY_NOW = "1997-01-25 12:00:00"
PAYLOAD = "CASE o_orderkey % 6 WHEN 0 THEN '{\"name_ja\": \"N ' || CAST(o_orderkey AS STRING) || '\", \"category\": [\"movie\"], \"sub_events\": [{\"name_ja\": \"S\", \"start_date\": \"1998-01-01\"}]}' WHEN 1 THEN '{' END"


def stored_written(c):
    text = lambda *names: {n: F.lit(None).cast("string") for n in names}
    return written(c).withColumns({
        "raw_title": F.col("name_ja"), "end_date": F.col("start_date") + F.expr("INTERVAL 1 DAY"), "category": F.array(F.lit("art")), "is_paid": F.lit(False),
        "original_language": F.lit("ja"), "parent_event_id": F.lit(None).cast("long"), "force_rescrape": F.lit(False),
        **text("name_zh", "name_en", "description_ja", "description_zh", "description_en", "location_name", "location_address", "business_hours", "price_info", "selection_reason"),
        "annotated_at": F.lit(None).cast("timestamp_ntz"), "scraped_at": F.lit(None).cast("timestamp_ntz")})


# of the landed orders, a source lists each name once a day
DAILY_SQL = SCAN_SQL.replace("w AS (SELECT o_orderkey", "w0 AS (SELECT o_orderkey").replace(
    "FROM orders)", "FROM orders), w AS (SELECT * FROM w0 QUALIFY id % 2 = 0 OR min(id) OVER (PARTITION BY src, name, day) = id)")


@query("daily_written", f"""
WITH RECURSIVE {DAILY_SQL}, n AS (SELECT primary_id AS id, count(*) AS n FROM m GROUP BY 1),
 a AS (SELECT w.id, w.src, w.start, w.name, w.id NOT IN (SELECT secondary_id FROM m) AS active, coalesce(n.n, 0) AS n, w.id % 6 AS k, CASE WHEN n.n > 0 OR w.id % 2 = 1 THEN 'pending' ELSE 'annotated' END AS status FROM w LEFT JOIN n USING (id)),
 x AS (SELECT *, status = 'pending' AND k = 0 AS used, start + INTERVAL 1 DAY < TIMESTAMP '1997-01-24' AS over FROM a)
SELECT src AS source_name, 's' || CAST(id AS STRING) AS source_id, id, CASE WHEN used THEN 'N ' || CAST(id AS STRING) ELSE name END AS name, active AND NOT over AS is_active,
 CASE WHEN used THEN 'annotated' WHEN status = 'pending' AND k = 1 THEN 'error' ELSE status END AS status, CASE WHEN used THEN 'movie' ELSE 'art' END AS tags, CAST(n AS INT) AS n_urls, NULL::BIGINT AS parent FROM x
UNION ALL SELECT src, 's' || CAST(id AS STRING) || '_sub1', NULL, 'S', true, 'annotated', 'movie', 0, id FROM x WHERE used""")
def _(c):
    rows = stored_written(c)
    payloads = c.table("orders").selectExpr("o_orderkey AS id", f"{PAYLOAD} AS payload").where("payload IS NOT NULL")
    out = daily_batch(rows.where("id % 2 = 0"), rows, DAY_NOW, ranks=RANKS, news_sources=[], annotations=payloads)
    return out.select("source_name", "source_id", F.when(F.col("parent_event_id").isNull(), F.col("id")).alias("id"), F.col("name_ja").alias("name"), "is_active", F.col("annotation_status").alias("status"),
                      F.array_join("category", ",").alias("tags"), F.coalesce(F.size("secondary_source_urls"), F.lit(0)).alias("n_urls"), F.col("parent_event_id").alias("parent"))


@query("daily_run_log", """
WITH a AS (SELECT 'src' || CAST(n_nationkey AS STRING) AS source, n_nationkey % 4 <> 1 AS ok, n_nationkey AS k FROM nation),
 e AS (SELECT 'src' || CAST(o_custkey % 20 AS STRING) AS source, count(*) AS n FROM orders GROUP BY 1)
SELECT source, CAST(CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS events_processed, CAST(CASE WHEN ok AND k % 3 > 0 THEN k * 10 ELSE 0 END AS BIGINT) AS translated_chars, ok AS success, CAST(k AS BIGINT) AS duration_seconds FROM a LEFT JOIN e USING (source)""")
def _(c):
    landed = c.table("orders").selectExpr("o_orderkey AS id", "'src' || CAST(o_custkey % 20 AS STRING) AS source_name", "'s' || CAST(o_orderkey AS STRING) AS source_id", "'name ' || CAST(o_orderkey AS STRING) AS name_ja", "o_orderdate AS start_date")
    landed = landed.unionByName(landed.where("id % 5 = 0"))  # listed twice by the site
    attempts = c.table("nation").selectExpr("'src' || CAST(n_nationkey AS STRING) AS source", "n_nationkey % 4 <> 1 AS success", "n_nationkey + 0.7 AS duration_seconds", "CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 10 END AS translated_chars")
    return run_log(landed, attempts, DAY_NOW).drop("ran_at")
