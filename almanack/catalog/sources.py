"""Landing, sinks, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.catalog.carriers import REF, Carriers
from almanack.catalog.joins import CLASSIFIED, existing, incoming
from almanack.catalog.registry import query
from almanack.session import shared_path
from almanack.sources import feeds, pages, sinks, trees
from almanack.sources.tables import SCHEMAS
from almanack.streaming import stateful as sf
from almanack.streaming import streams as st

T = f"TIMESTAMP '{REF}'"


@query("s3_snapshot_rows", f"SELECT id FROM ev WHERE NOT is_active OR updated_at >= {T} - INTERVAL 5 DAYS", "ev")
def _(c):
    return sinks.snapshot_rows(c.events(), REF, 5).select("id")


def snapshot(c):
    path = shared_path(c.spark, "snapshots")
    tables = {"documents": c.table("documents"), "labels": c.table("labels"), "orders": c.table("orders"), "none": c.table("orders").where("false")}
    return path, sinks.write_snapshot(tables, path)


@query("s4_snapshot_manifest", """
SELECT 'documents' AS "table", count(*) AS row_count FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'none', 0""")
def _(c):
    return snapshot(c)[1].select("table", "row_count")


@query("s5_snapshot_verify", """
SELECT 'labels' AS "table", 'error' AS level, 'missing columns: score' AS finding UNION ALL SELECT 'none', 'warning', 'empty table' UNION ALL SELECT 'pages', 'error', 'missing table'""")
def _(c):
    path, _m = snapshot(c)
    need = {"documents": ["doc_id", "text"], "labels": ["doc_id", "score"], "orders": ["o_orderkey"], "pages": ["url"]}
    return sinks.verify_snapshot(c.spark, path, need)


@query("s5_changed_rows", """
SELECT o_orderkey, 'changed' AS change FROM orders WHERE o_orderkey % 997 = 5 AND o_orderkey % 1000 <> 7 UNION ALL SELECT o_orderkey, 'removed' FROM orders WHERE o_orderkey % 1000 = 7
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 3001 = 11 AND o_orderkey % 1000 <> 7""")
def _(c):
    before, after = shared_path(c.spark, "trees"), shared_path(c.spark, "trees")
    rows = c.table("orders")
    now = rows.where("o_orderkey % 1000 <> 7").withColumn("o_totalprice", F.expr("IF(o_orderkey % 997 = 5, o_totalprice + 1, o_totalprice)"))
    now = now.unionByName(now.where("o_orderkey % 3001 = 11").withColumn("o_orderkey", -F.col("o_orderkey")))
    trees.write_tree(rows, before, ["o_orderkey"])
    trees.write_tree(now, after, ["o_orderkey"])
    return trees.changed_rows(c.spark, before, after, ["o_orderkey"])


@query("s6_impact", f"""
WITH s AS (SELECT id, parent_event_id FROM doc WHERE NOT is_active OR created_at >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 50 DAYS)
SELECT (SELECT count(*) FROM s) AS events, (SELECT count(parent_event_id) FROM s) AS sub_events, (SELECT count(*) FROM labels WHERE toxic = 1 AND doc_id IN (SELECT id FROM s)) AS event_reports,
 (SELECT count(*) FROM labels WHERE quality = 1 AND doc_id IN (SELECT id FROM s)) AS category_corrections""", "doc")
def _(c):
    rows = sinks.snapshot_rows(c.docs().withColumn("updated_at", F.col("created_at")), REF, 50)
    lab = c.table("labels").withColumnRenamed("doc_id", "event_id")
    return sinks.impact(rows, lab.where("toxic = 1"), lab.where("quality = 1"))


@query("s7_nested_json_feed", """
SELECT o_orderpriority AS hall, 'h' || o_orderstatus AS room, o_orderkey * 10 + n AS id, strftime(o_orderdate, '%Y%m%d') AS starts FROM orders, (VALUES (1), (2)) v(n)""")
def _(c):
    key = F.col("o_orderkey") * 10
    item = lambda n: F.struct((key + n).alias("id"), F.lit("催事").alias("eventName"), F.date_format("o_orderdate", "yyyyMMdd").alias("eventStartDate"))
    halls = F.array(F.struct(F.concat(F.lit("h"), F.col("o_orderstatus")).alias("eventHallName"), F.array(item(1), item(2)).alias("events")))
    doc = F.to_json(F.struct(F.col("o_orderpriority").alias("largeEventHallName"), halls.alias("eventHalls")))
    path = shared_path(c.spark, "feeds")
    c.table("orders").select(doc.alias("value")).write.text(path)
    return feeds.land_nested_json(c.spark, path).select(F.col("largeEventHallName").alias("hall"), F.col("eventHallName").alias("room"), "id", F.col("eventStartDate").alias("starts"))


@query("s8_feed_items", """
SELECT 'T & <' || CAST(event_id AS STRING) AS title, 'https://n.example.org/' || CAST(event_id AS STRING) AS link, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published FROM events""")
def _(c):
    sid = F.col("event_id").cast("string")
    path = shared_path(c.spark, "feeds")
    c.table("events").select(
        F.concat(F.lit("T & <"), sid).alias("title"), F.concat(F.lit("https://n.example.org/"), sid).alias("link"),
        F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("pubDate"),
    ).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    land = feeds.land_feed(c.spark, path)
    return land.select("title", "link", F.date_format(feeds.feed_time(F.col("pubDate")), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("s8_atom_entries", """
SELECT 'T & <' || CAST(event_id AS STRING) AS title, 'https://n.example.org/' || CAST(event_id AS STRING) AS link, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published FROM events""")
def _(c):
    sid = F.col("event_id").cast("string")
    path = shared_path(c.spark, "feeds")
    c.table("events").select(
        F.concat(F.lit("T & <"), sid).alias("title"), F.struct(F.concat(F.lit("https://n.example.org/"), sid).alias("_href")).alias("link"),
        F.date_format(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+09:00'").alias("updated"),
    ).write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    land = feeds.land_feed(c.spark, path, "entry", feeds.ATOM_ENTRY)
    return land.select("title", F.col("link._href").alias("link"), F.date_format(feeds.feed_time(F.col("updated")), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("s9_api_pages", "SELECT event_id AS id, event_type AS title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_date FROM events")
def _(c):
    ev = F.array(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_date")))
    path = shared_path(c.spark, "feeds")
    c.table("events").select(F.to_json(F.struct(F.lit(1).alias("total"), ev.alias("events"))).alias("value")).write.text(path)
    return feeds.land_api_pages(c.spark, path).select("id", "title", "start_date")


@query("s9_paged_extract", "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('view', 'click') AND user_id >= 20")
def _(c):
    path, rows = shared_path(c.spark, "pages"), c.table("events").select("event_id", "event_type", "user_id")
    pages.land_pages(rows, path, ["event_id"])
    # a full page and a short one of an earlier, longer extract, behind the short page
    more = rows.where("event_id < 1200").withColumn("offset", F.when(F.col("event_id") < 1000, F.lit(90_000_000)).otherwise(F.lit(90_001_000)))
    more.withColumn("rows", F.when(F.col("event_id") < 1000, F.lit(1000)).otherwise(F.lit(200))).write.mode("append").partitionBy("offset", "rows").json(path)
    landed = pages.read_pages(c.spark, path, "event_id long, event_type string, user_id long")
    return landed.where("event_type IN ('view', 'click') AND user_id >= 20")


@query("s10_json_rows", "SELECT '{\"id\":' || CAST(id AS STRING) || ',\"source_name\":\"' || source_name || '\",\"is_active\":' || CAST(is_active AS STRING) || '}' AS row FROM ev", "ev")
def _(c):
    return sinks.to_json_rows(c.events().select("id", "source_name", "is_active"))


@query("s11_run_record", """
SELECT source, count(*) AS events_processed, bool_and(coalesce(success, true)) AS success, CAST(sum(duration_seconds) AS BIGINT) AS duration_seconds, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
 CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM runs GROUP BY source""", "runs")
def _(c):
    path = shared_path(c.spark, "runs")
    sinks.append(sinks.run_record(c.runs(), REF), path)
    return c.spark.read.parquet(path).withColumn("cost_usd", F.col("cost_usd").cast("double")).drop("ran_at")


@query("s13_append", "SELECT event_type, event_id FROM events")
def _(c):
    path = shared_path(c.spark, "clicks")
    for kind in ("view", "click", "purchase", "signup", "error"):
        sinks.append(c.table("events").where(F.col("event_type") == kind).select("event_type", "event_id"), path)
    return c.spark.read.schema("event_type string, event_id long").parquet(path)


# -- streams -----------------------------------------------------------------------------------

class StreamCarriers(Carriers):
    """The same domain views with the events table read as a stream."""

    def table(self, name):
        if name == "events":
            return st.read_feed(self.spark, f"{self.sf_dir}/events.parquet", SCHEMAS["events"])
        return super().table(name)


def timed(df, c):
    return df.withColumn(c, F.col(c).cast("timestamp"))


def live(c):
    return StreamCarriers(c.spark, c.sf_dir)


FMT = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")


@query("j1_stream_view_counts", """
WITH w AS (SELECT event_id, time_bucket(INTERVAL 1 HOUR, viewed_at) AS s, count(*) AS n FROM views GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS s, event_id, n AS view_count FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(viewed_at) FROM views) - INTERVAL 10 MINUTES""", "views")
def _(c):
    stream = st.stream_views(timed(live(c).views(), "viewed_at"), "1 hour", "10 minutes")
    return st.drain(c.spark, stream, "views").select(FMT("start").alias("s"), "event_id", "view_count")


@query("j2_stream_popularity", """
WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS e)
SELECT strftime(e, '%Y-%m-%d') AS e, event_id, count(*) AS view_count FROM d JOIN views ON viewed_at >= e - INTERVAL 7 DAYS AND viewed_at < e
WHERE e <= (SELECT max(viewed_at) FROM views) - INTERVAL 1 DAY GROUP BY 1, 2""", "views")
def _(c):
    stream = st.stream_popularity(timed(live(c).views(), "viewed_at"), "7 days", "1 day", "1 day")
    return st.drain(c.spark, stream, "popularity").select(F.date_format("end", "yyyy-MM-dd").alias("e"), "event_id", "view_count")


@query("j5_stream_health", """
SELECT strftime(s, '%Y-%m-%d') AS s, source, count(*) AS runs, count(*) FILTER (NOT coalesce(success, true)) AS failed, count(*) FILTER (coalesce(success, true) AND coalesce(events_processed, 0) = 0) AS zero
FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ran_at) AS s FROM runs) WHERE s + INTERVAL 1 DAY <= (SELECT max(ran_at) FROM runs) - INTERVAL 1 HOUR GROUP BY 1, 2""", "runs")
def _(c):
    stream = st.stream_health(timed(live(c).runs(), "ran_at"))
    return st.drain(c.spark, stream, "health").select(F.date_format("start", "yyyy-MM-dd").alias("s"), "source", "runs", "failed", "zero")


LABELS = {"k1": "movie", "k2": "art", "k3": "tech"}


SUBSCRIBERS_SQL = """
WITH b AS (SELECT user_id, start_date AS tm, id, event_type, item FROM ev), f AS (SELECT user_id, min(row(tm, id)) AS f FROM b WHERE event_type = 'signup' GROUP BY 1),
 l AS (SELECT b.*, row(tm, id) AS o FROM b JOIN f USING (user_id) WHERE row(tm, id) >= f.f)
SELECT user_id, arg_max(CASE event_type WHEN 'signup' THEN 'active' ELSE 'blocked' END, o) FILTER (event_type IN ('signup', 'error')) AS status,
 arg_max(CASE WHEN event_type = 'view' THEN 'ja' ELSE CASE WHEN item < 50 THEN 'zh' ELSE 'en' END END, o) FILTER ((event_type = 'click' AND item < 90) OR (event_type = 'view' AND item < 30)) AS language,
 arg_max(CASE WHEN item < 60 THEN 'movie,art' ELSE 'tech' END, o) FILTER (event_type = 'purchase' AND item < 80) AS tags FROM l GROUP BY user_id"""


def chat(c):
    """The events as what users send: follows, unfollows, postbacks, messages."""
    ev = live(c).events()
    k = F.col("item")
    kind = F.create_map(*[F.lit(x) for x in ("signup", "follow", "error", "unfollow", "click", "postback", "purchase", "message", "view", "message")])
    body = (F.when(F.col("event_type") == "click", F.when(k < 50, "lang:zh").when(k < 90, "lang:en").otherwise("lang:xx"))
            .when(F.col("event_type") == "purchase", F.when(k < 60, "k1, k2").when(k < 80, "k3").otherwise("??")).when(F.col("event_type") == "view", F.when(k < 30, "日本語").otherwise("hello")))
    return ev.select("user_id", "id", F.col("start_date").alias("at"), F.element_at(kind, F.col("event_type")).alias("kind"), body.alias("body"))


def subscribers(c, run, name):
    table = st.KeptTable(c.spark, shared_path(c.spark, name), st.SUBSCRIBERS, ["user_id"])
    last = run(chat(c), table, LABELS, shared_path(c.spark, "state", name))
    return table.read(last).select("user_id", "status", "language", F.array_join("tags", ",").alias("tags"))


@query("j3_stream_subscribers", SUBSCRIBERS_SQL, "ev")
def _(c):
    return subscribers(c, st.stream_subscribers, "subscribers")


@query("j3_subscriber_state", SUBSCRIBERS_SQL, "ev")
def _(c):
    return subscribers(c, sf.stream_subscriber_state, "subscriber_state")


@query("j2_rolling_popularity", """
WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS e)
SELECT strftime(e, '%Y-%m-%d') AS e, event_id, count(*) AS view_count FROM d JOIN views ON viewed_at >= e - INTERVAL 30 DAYS AND viewed_at < e
WHERE e <= (SELECT max(viewed_at) FROM views) - INTERVAL 1 DAY GROUP BY 1, 2""", "views")
def _(c):
    stream = sf.stream_rolling(timed(live(c).views(), "viewed_at"))
    return st.drain(c.spark, stream, "rolling").select(F.date_format("end", "yyyy-MM-dd").alias("e"), "event_id", "view_count")


@query("j5_silent_sources", """
WITH r AS (SELECT event_type || '_' || CAST(user_id AS STRING) AS source, start_date AS ran_at FROM ev),
 d AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS e)
SELECT strftime(d.e, '%Y-%m-%d') AS e, source, strftime(max(ran_at), '%Y-%m-%d %H:%M:%S') AS last_run FROM d JOIN r ON ran_at >= d.e - INTERVAL 7 DAYS AND ran_at < d.e
WHERE d.e <= (SELECT max(ran_at) FROM r) - INTERVAL 1 HOUR GROUP BY d.e, source HAVING max(ran_at) < d.e - INTERVAL 24 HOURS""", "ev")
def _(c):
    runs = live(c).events().select(F.expr("event_type || '_' || CAST(user_id AS STRING)").alias("source"), F.col("start_date").cast("timestamp").alias("ran_at"))
    return st.drain(c.spark, sf.stream_silent(runs), "silent").select(F.date_format("checked_at", "yyyy-MM-dd").alias("e"), "source", FMT("last_run").alias("last_run"))


@query("j4_stream_ingest", f"""
WITH {CLASSIFIED}, w AS (SELECT * FROM cl WHERE class IN ('new', 'forced'))
SELECT source_name, source_id, CASE WHEN w.source_id IS NOT NULL THEN w.price ELSE e.price END AS price,
 CASE WHEN w.source_id IS NOT NULL THEN 'pending' ELSE e.annotation_status END AS annotation_status FROM e FULL JOIN w USING (source_name, source_id)""")
def _(c):
    class Orders(Carriers):
        def table(self, name):
            if name == "orders":
                return st.read_feed(self.spark, f"{self.sf_dir}/orders.parquet", SCHEMAS["orders"])
            return super().table(name)

    start = existing(c)
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in start.schema)
    table = st.KeptTable(c.spark, shared_path(c.spark, "ingest"), layout, ["source_name", "source_id"])
    table.write(0, start)
    stream = incoming(Orders(c.spark, c.sf_dir))
    last = st.stream_ingest(stream, table, shared_path(c.spark, "state", "ingest"))
    return table.read(last).select("source_name", "source_id", "price", "annotation_status")
