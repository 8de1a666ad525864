"""Dashboard and run-report queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from almanack.catalog.carriers import REF
from almanack.catalog.registry import query
from almanack.operators import aggregates as a
from almanack.operators import filters as f
from almanack.operators.joins import source_counts
from almanack.operators.numbering import batches, recipient_batches


T = f"TIMESTAMP '{REF}'"
LAST100 = "last100 AS (SELECT * FROM runs ORDER BY ran_at DESC, id DESC LIMIT 100)"
SUMS = """count(*) AS runs, CAST(coalesce(sum(events_processed),0) AS BIGINT) AS events, CAST(coalesce(sum(tokens_in),0) AS BIGINT) AS tokens_in,
 CAST(coalesce(sum(tokens_out),0) AS BIGINT) AS tokens_out, CAST(coalesce(sum(cost_usd),0) AS DOUBLE) AS cost"""


@query("a1_view_counts", "SELECT event_id, count(*) AS view_count FROM views GROUP BY event_id", "views")
def _(c):
    return a.view_counts(c.views())


@query("a2_top_viewed", f"""
SELECT event_id, view_count, CAST(floor(view_count * 100.0 / max(view_count) OVER () + 0.5) AS BIGINT) AS share FROM (
 SELECT event_id, count(*) AS view_count FROM views WHERE viewed_at >= {T} - INTERVAL 30 DAYS GROUP BY event_id ORDER BY view_count DESC, event_id LIMIT 10)""", "views")
def _(c):
    return a.top_viewed(c.views(), REF)


@query("a3_category_share", """
SELECT tag, n, CAST(floor(n * 100.0 / sum(n) OVER () + 0.5) AS BIGINT) AS share FROM (
 SELECT tag, count(*) AS n FROM (SELECT unnest(category) AS tag FROM doc WHERE is_active) GROUP BY tag)""", "doc")
def _(c):
    return a.category_share(c.docs().where("is_active"))


@query("a4_category_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(category) AS tag FROM doc) GROUP BY tag", "doc")
def _(c):
    return a.category_counts(c.docs())


HIST = """
SELECT strftime(m, '%Y-%m') AS month, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '2000-10-01', DATE '2001-09-01', INTERVAL 1 MONTH)) AS m)
LEFT JOIN (SELECT date_trunc('month', o_orderdate) AS om, count(*) AS n FROM orders WHERE o_orderdate >= DATE '2000-10-01' GROUP BY 1) ON m = om"""


@query("a5_monthly_histogram", HIST)
def _(c):
    return a.monthly_hist(c.table("orders"), "2001-09-15 10:00:00", 12, "o_orderdate")


@query("a30_share_of_max", f"SELECT month, n, CAST(floor(n * 100.0 / greatest(max(n) OVER (), 1) + 0.5) AS BIGINT) AS pct FROM ({HIST})")
def _(c):
    return a.share_of_max(a.monthly_hist(c.table("orders"), "2001-09-15 10:00:00", 12, "o_orderdate"))


EFFECTIVE = "CASE WHEN agent_category = 'peatix_organizer' THEN agent_category ELSE coalesce(source_type, 'other') END"


@query("a7_type_counts", f"SELECT {EFFECTIVE} AS source_type, count(*) AS n FROM reg WHERE status = 'candidate' GROUP BY 1", "reg")
def _(c):
    rows = f.filter_sources(c.registry(), "candidate")
    return rows.groupBy(f.effective_type().alias("source_type")).agg(a.count_rows())


ITEMS = "items AS (SELECT 'supp_' || CAST(l_suppkey AS STRING) AS source_name FROM lineitem)"


def line_events(c):
    return c.table("lineitem").select(F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("source_name"))


@query("a8_events_by_type", f"""
WITH {ITEMS}, n AS (SELECT source_name, count(*) AS n FROM items GROUP BY 1)
SELECT {EFFECTIVE} AS source_type, CAST(sum(coalesce(n.n, 0)) AS BIGINT) AS n_events FROM reg LEFT JOIN n ON reg.scraper_source_name = n.source_name
GROUP BY 1""", "reg")
def _(c):
    joined = source_counts(c.registry(), line_events(c))
    return joined.groupBy(f.effective_type().alias("source_type")).agg(F.sum("n_events").alias("n_events"))


@query("a9_active_by_source", "SELECT source_name, count(*) AS n FROM ev WHERE is_active GROUP BY 1", "ev")
def _(c):
    return a.active_by_source(c.events())


@query("a10_run_totals", f"WITH {LAST100} SELECT {SUMS} FROM last100", "runs")
def _(c):
    return a.run_totals(c.runs(), 100)


@query("a11_month_totals", f"WITH {LAST100} SELECT {SUMS} FROM last100 WHERE ran_at >= TIMESTAMP '2024-01-01'", "runs")
def _(c):
    return a.month_totals(c.runs(), REF, 100)


@query("a12_cost_trend", f"""
WITH {LAST100} SELECT CAST(coalesce(sum(CASE WHEN ran_at >= {T} - INTERVAL 30 DAYS THEN cost_usd END),0) AS DOUBLE) AS last30_cost,
 CAST(sum(cost_usd) AS DOUBLE) / greatest(1.0::DOUBLE, (epoch_us({T}) - epoch_us(min(ran_at))) / CAST(2592000000000 AS DOUBLE)) AS avg_monthly_cost FROM last100""", "runs")
def _(c):
    return a.cost_trend(c.runs(), REF, 100)


@query("a13_health_counters", f"""
SELECT count(*) AS active, count(*) FILTER (annotation_status = 'pending') AS pending,
 count(*) FILTER (created_at >= date_trunc('week', {T})) AS new_week, count(*) FILTER (created_at >= date_trunc('month', {T})) AS new_month FROM ev WHERE is_active""", "ev")
def _(c):
    return a.health_counters(c.events(), REF)


@query("a14_admin_counters", """
SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (is_active AND annotation_status = 'pending') AS pending_active,
 count(*) FILTER (NOT is_active AND annotation_status = 'pending') AS pending_inactive FROM doc""", "doc")
def _(c):
    return a.admin_counters(c.docs())


@query("a15_localisation_issues", """
SELECT 'name' AS field, count(*) AS n FROM doc WHERE is_active AND annotation_status = 'pending' AND trim(coalesce(raw_title,'')) <> '' AND (trim(coalesce(name_zh,'')) = '' OR trim(coalesce(name_en,'')) = '') HAVING count(*) > 0
UNION ALL SELECT 'description', count(*) FROM doc WHERE is_active AND annotation_status = 'pending' AND trim(coalesce(raw_description,'')) <> '' AND (trim(coalesce(description_zh,'')) = '' OR trim(coalesce(description_en,'')) = '') HAVING count(*) > 0""", "doc")
def _(c):
    d = c.docs().withColumns({"name": F.col("raw_title"), "description": F.col("raw_description")})
    return a.localisation_issues(d, ["name", "description"])


@query("a16_pending_count", "SELECT count(*) AS pending FROM ev WHERE annotation_status = 'pending'", "ev")
def _(c):
    return a.pending_count(c.events(), "annotation_status")


@query("a17_weekly_by_source", f"""
SELECT source, count(*) AS runs, round_even(CAST(count(*) FILTER (coalesce(success, true)) AS DOUBLE) / count(*), 2) AS success_rate,
 CAST(sum(events_processed) AS BIGINT) AS total_events, round_even(CAST(sum(events_processed) AS DOUBLE) / count(*), 1) AS avg_events, CAST(sum(cost_usd) AS DOUBLE) AS total_cost_usd
FROM runs WHERE ran_at >= {T} - INTERVAL 7 DAYS GROUP BY source""", "runs")
def _(c):
    return a.weekly_by_source(c.runs(), "2024-01-18 12:00:00")


@query("a18_weekly_totals", f"""
SELECT * FROM (SELECT CAST(coalesce(sum(cost_usd),0) AS DOUBLE) AS total_cost_usd, count(*) AS total_runs FROM runs WHERE ran_at >= {T} - INTERVAL 7 DAYS),
 (SELECT count(*) FILTER (created_at >= {T} - INTERVAL 7 DAYS) AS new_events, count(*) FILTER (annotation_status = 'pending') AS pending_annotation FROM ev WHERE is_active)""", "runs")
def _(c):
    return a.weekly_totals(c.runs(), c.events(), "2024-01-18 12:00:00")


@query("a19_run_anomalies", f"""
WITH last200 AS (SELECT * FROM runs ORDER BY ran_at DESC, id DESC LIMIT 200),
 latest AS (SELECT source, events_processed AS latest FROM last200 QUALIFY row_number() OVER (PARTITION BY source ORDER BY ran_at DESC, id DESC) = 1),
 avg7 AS (SELECT source, avg(events_processed) AS avg_7d FROM runs WHERE ran_at >= {T} - INTERVAL 7 DAYS GROUP BY 1)
SELECT source, latest, coalesce(avg_7d, 0.0) AS avg_7d, CASE WHEN latest = 0 THEN 'zero' ELSE 'drop' END AS reason FROM latest LEFT JOIN avg7 USING (source)
WHERE latest = 0 OR (coalesce(avg_7d, 0.0) >= 2 AND latest < avg_7d * 0.5)""", "runs")
def _(c):
    return a.run_anomalies(c.runs(), REF)


EXEMPT = ["signup_1", "view_9"]


@query("a20_run_health", f"""
WITH d AS (SELECT * FROM runs WHERE ran_at >= {T} - INTERVAL 3 HOURS), w AS (SELECT DISTINCT source FROM runs WHERE ran_at >= {T} - INTERVAL 7 DAYS)
SELECT DISTINCT source, 'failed' AS issue FROM d WHERE NOT coalesce(success, true)
UNION ALL SELECT DISTINCT source, 'zero' FROM d WHERE coalesce(success, true) AND coalesce(events_processed, 0) = 0
UNION ALL SELECT source, 'missing' FROM w WHERE source NOT IN (SELECT source FROM d) AND source NOT IN ('signup_1', 'view_9')""", "runs")
def _(c):
    return a.run_health(c.runs(), REF, EXEMPT, hours=3)


@query("a20_run_health_counts", f"""
WITH d AS (SELECT * FROM runs WHERE ran_at >= {T} - INTERVAL 24 HOURS)
SELECT count(DISTINCT source) AS ran, count(DISTINCT source) - count(DISTINCT CASE WHEN NOT coalesce(success, true) THEN source END)
 - count(DISTINCT CASE WHEN coalesce(success, true) AND coalesce(events_processed, 0) = 0 THEN source END) AS ok FROM d""", "runs")
def _(c):
    return a.run_health_counts(c.runs(), REF)


@query("a21_latest_run_summary", """
SELECT source, CAST(sum(events_processed) AS BIGINT) AS events FROM runs, (SELECT max(ran_at) AS m FROM runs)
WHERE ran_at BETWEEN m - INTERVAL 120 MINUTES AND m + INTERVAL 120 MINUTES GROUP BY source""", "runs")
def _(c):
    return a.latest_run_summary(c.runs(), 120)


@query("a22_common_tags", """
WITH sel AS (SELECT id, category FROM doc WHERE lang = 'en' AND n_chars > 1500), t AS (SELECT id, unnest(category) AS tag, generate_subscripts(category, 1) - 1 AS pos FROM sel)
SELECT tag, CAST(arg_min(pos, id) AS INT) AS pos FROM t GROUP BY tag HAVING count(DISTINCT id) = (SELECT count(*) FROM sel)""", "doc")
def _(c):
    return a.common_tags(c.docs().where("lang = 'en' AND n_chars > 1500"))


@query("a23_by_language", "SELECT lang, count(*) AS n FROM place WHERE status = 'active' AND lang IN ('zh', 'en', 'ja') GROUP BY lang", "place")
def _(c):
    return a.by_language(c.places().where("status = 'active'"), ["zh", "en", "ja"])


@query("a24_recipient_batches", """
SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 500) AS BIGINT) AS batch FROM place WHERE status = 'active'""", "place")
def _(c):
    return batches(c.places().where("status = 'active'").select("id"), ["id"], 500).select("id", "batch")


@query("a24_language_batches", """
SELECT lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY id) - 1) / 500) AS BIGINT) AS batch, id FROM place WHERE status = 'active' AND lang IN ('zh', 'en', 'ja')""", "place")
def _(c):
    return recipient_batches(c.places().where("status = 'active'"), ["zh", "en", "ja"], 500)


@query("a25_usage_cost", """
SELECT source, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
 CAST(round_even(CAST(sum(tokens_in) * 0.15 + sum(tokens_out) * 0.60 AS DECIMAL(30,4)) / 1000000, 6) AS DOUBLE) AS cost_usd FROM runs GROUP BY source""", "runs")
def _(c):
    return a.usage_cost(c.runs(), keys=["source"])


WORDS = ("filter(split(text, ' '), x -> length(x) > 3)", "list_filter(string_split(text, ' '), lambda x: length(x) > 3)")


def results(c):
    t = c.table("conversations").withColumn("ord", F.struct("conv_id", "turn"))
    return t.select("ord", F.expr(WORDS[0]).alias("keywords"), F.split("text", "\n").alias("news"), (F.length("text") < 200).alias("error"))


@query("a26_report_keywords", f"""
SELECT keyword, conv_id, turn, CAST(pos AS INT) AS pos FROM (SELECT keyword, min(row(conv_id, turn, pos)) AS f FROM (
 SELECT conv_id, turn, unnest(w) AS keyword, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT conv_id, turn, {WORDS[1]} AS w FROM conversations)) GROUP BY keyword) x,
 LATERAL (SELECT f[1] AS conv_id, f[2] AS turn, f[3] AS pos) ORDER BY conv_id, turn, pos LIMIT 8""")
def _(c):
    return a.merged_keywords(results(c)).select("keyword", "ord.conv_id", "ord.turn", "pos")


@query("a26_report_news", """
SELECT conv_id, turn, CAST(pos AS INT) AS pos, line FROM (SELECT conv_id, turn, unnest(w) AS line, generate_subscripts(w, 1) - 1 AS pos FROM
 (SELECT conv_id, turn, string_split(text, chr(10)) AS w FROM conversations)) ORDER BY conv_id, turn, pos LIMIT 5""")
def _(c):
    return a.merged_news(results(c)).select("ord.conv_id", "ord.turn", "pos", "line")


@query("a26_report_totals", "SELECT count(*) AS agents_run, count(*) FILTER (length(text) < 200) AS agents_failed FROM conversations")
def _(c):
    return a.merge_reports(results(c))


@query("a28_distinct_sources", "SELECT DISTINCT source_name FROM ev", "ev")
def _(c):
    return a.distinct_sources(c.events())


@query("a29_run_span", """
SELECT source_name, strftime(min(start_date), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(start_date), '%Y-%m-%d %H:%M:%S') AS last_date FROM ev GROUP BY 1""", "ev")
def _(c):
    fmt = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return a.run_span(c.events(), ["source_name"]).select("source_name", fmt("first_date"), fmt("last_date"))
