"""Upsert, archive, reports, snapshots, numbering and streams on small tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from almanack.operators import aggregates as a
from almanack.operators import enrich as e
from almanack.operators import upsert as u
from almanack.operators.joins import archive_children
from almanack.operators.numbering import batches, number_rows
from almanack.operators.ordering import dedup_first
from almanack.session import shared_path
from almanack.sources import sinks
from almanack.streaming import streams as st

TARGET = "source_name string, source_id string, is_active boolean, annotation_status string, force_rescrape boolean, title string, official_url string, extra int"
BATCH = "source_name string, source_id string, title string, official_url string, ord int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def existing(spark):
    return spark.createDataFrame([
        ("a", "1", False, "pending", True, "t", None, 1), ("a", "2", True, "reviewed", True, "t", None, 2), ("a", "3", True, "annotated", False, "t", "u3", 3),
        ("a", "4", True, "annotated", True, "t", "u4", 4), ("a", "5", True, "annotated", None, "t", "u5", 5), ("b", "3", True, "annotated", True, "t", "ub", 6)], TARGET)


def batch(spark):
    return spark.createDataFrame([("a", str(i), f"n{i}", None, i) for i in range(1, 7)] + [("a", "6", "later", "u6", 9), ("c", "3", "n", None, 1)], BATCH)


def test_classes(spark):
    force = spark.createDataFrame([("a", "5")], "source_name string, source_id string")
    got = u.classify(batch(spark).where("ord < 9"), existing(spark), force=force)
    assert rows(got, "source_name", "source_id", "class") == [
        ("a", "1", "blocked"), ("a", "2", "reviewed"), ("a", "3", "existing"), ("a", "4", "forced"), ("a", "5", "forced"), ("a", "6", "new"), ("c", "3", "new")]


def test_upsert_keeps_protected_rows_and_is_repeatable(spark):
    once = u.upsert_events(existing(spark), batch(spark), order="ord")
    got = {(r["source_name"], r["source_id"]): r for r in once.collect()}
    assert got["a", "1"]["title"] == got["a", "2"]["title"] == got["a", "3"]["title"] == "t"
    four = got["a", "4"]
    assert (four["title"], four["official_url"], four["force_rescrape"], four["annotation_status"], four["extra"]) == ("n4", "u4", False, "pending", 4)
    assert got["a", "6"]["title"] == "later" and got["b", "3"]["force_rescrape"] is True and len(got) == 8
    twice = u.upsert_events(spark.createDataFrame(once.collect(), once.schema), batch(spark), order="ord")
    changed = {k for k, r in got.items()} ^ {(r["source_name"], r["source_id"]) for r in twice.collect()}
    assert not changed


def test_dedup(spark):
    d = dt.datetime
    data = [(1, "s", "x1", "Fest", d(2024, 1, 1, 9)), (2, "s", "x2", " fest ", d(2024, 1, 1, 20)), (3, "s", "x3", "fest", d(2024, 1, 2)), (4, "s", "x4", "", d(2024, 1, 1)),
            (5, "s", "x5", None, d(2024, 1, 1)), (6, "s", "x6_sub1", "fest", d(2024, 1, 1)), (7, "t", "x7", "fest", d(2024, 1, 1)), (8, "s", "x8", "f", None), (9, "s", "x9", "F", None)]
    df = spark.createDataFrame(data, "id int, source_name string, source_id string, name_ja string, start_date timestamp_ntz")
    for n in (1, 8):
        assert [r[0] for r in rows(dedup_first(df.repartition(n), ["id"]), "id")] == [1, 3, 4, 5, 6, 7, 8]


def test_archive(spark):
    d = dt.datetime
    df = spark.createDataFrame([(1, True, d(2024, 5, 8, 23, 59, 59)), (2, True, d(2024, 5, 9)), (3, True, None), (4, False, d(2024, 1, 1))], "id int, is_active boolean, end_date timestamp_ntz")
    assert rows(e.archive_ended(df, "2024-05-10 15:00:00"), "id", "is_active") == [(1, False), (2, True), (3, True), (4, False)]


def test_confirm(spark):
    ev = spark.createDataFrame([(i, True, "annotated", ["x"], "zh", "en", "dz", "de", "venue", True, "p") for i in range(1, 9)],
                               "id int, is_active boolean, annotation_status string, category array<string>, name_zh string, name_en string, description_zh string, description_en string, location_name string, is_paid boolean, price_info string")
    R = [(1, ["wrongCategory"], ["adm"], ["usr"], None, None), (2, ["wrongCategory"], [], ["usr"], None, None), (3, ["wrongCategory"], None, None, None, None),
         (4, ["wrongDetails", "field:name"], None, None, {"name_zh": " new "}, None), (5, ["wrongDetails", "field:name", "field:price", "irrelevant"], None, None, {"name_en": "E"}, None),
         (6, ["wrongDetails"], None, None, None, None), (7, ["irrelevant"], None, None, None, None), (8, ["wrongDetails", "field:venue"], None, None, None, "r")]
    rep = spark.createDataFrame(R, "id int, report_types array<string>, correct_category array<string>, suggested_category array<string>, fixes map<string,string>, selection_reason string")
    g = {r["id"]: r for r in e.confirm(ev, rep).collect()}
    state = lambda i: (g[i]["is_active"], g[i]["annotation_status"])
    assert g[1]["category"] == ["adm"] and g[2]["category"] == ["usr"] and g[3]["category"] == [] and state(1) == (True, "annotated") and state(3) == (False, "pending")
    assert (g[4]["name_zh"], g[4]["name_en"]) == ("new", "en") and state(4) == (True, "reviewed")
    assert (g[5]["name_en"], g[5]["is_paid"], g[5]["price_info"]) == ("E", None, None) and state(5) == (False, "pending")
    assert state(6) == (True, "annotated") and state(7) == (False, "pending") and state(8) == (True, "reviewed")


def test_archive_needs_a_reason(spark):
    df = spark.createDataFrame([(1, 1)], "id int, event_id int")
    with pytest.raises(ValueError):
        archive_children(df, df, " ", "2024-01-01")


def test_anomalies(spark):
    d = dt.datetime
    data = [(1, "zero", d(2024, 1, 9), 0), (2, "half", d(2024, 1, 9), 2), (3, "half", d(2024, 1, 8), 6), (4, "low", d(2024, 1, 9), 1), (5, "low", d(2024, 1, 8), 5), (6, "small", d(2024, 1, 9), 0), (7, "few", d(2024, 1, 9), 0),
            (8, "tiny", d(2024, 1, 9), 1), (9, "tiny", d(2024, 1, 8), 2)]
    runs = spark.createDataFrame(data, "id int, source string, ran_at timestamp_ntz, events_processed int")
    got = {(r["source"], r["reason"]) for r in a.run_anomalies(runs, "2024-01-10").collect()}
    assert got == {("zero", "zero"), ("small", "zero"), ("few", "zero"), ("low", "drop")}


def test_health(spark):
    d = dt.datetime
    data = [("both", d(2024, 1, 10), 0, False), ("both", d(2024, 1, 10), 0, True), ("ok", d(2024, 1, 10), 3, None), ("gone", d(2024, 1, 5), 3, True), ("rest", d(2024, 1, 5), 3, True), ("old", d(2023, 1, 5), 3, True)]
    runs = spark.createDataFrame(data, "source string, ran_at timestamp_ntz, events_processed int, success boolean")
    assert rows(a.run_health(runs, "2024-01-10 12:00:00", ["rest"]), "source", "issue") == [("both", "failed"), ("both", "zero"), ("gone", "missing")]
    assert rows(a.run_health_counts(runs, "2024-01-10 12:00:00"), "ran", "ok") == [(2, 0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_numbering(spark, parts):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("c")).repartition(parts)
    got = [r["pos"] for r in number_rows(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1, 5001))
    sizes = [r["n"] for r in batches(df, ["k"], 500).groupBy("batch").agg(F.count("*").alias("n")).collect()]
    assert sizes == [500] * 10


def test_snapshot_findings(spark):
    path = shared_path(spark, "t")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.write_snapshot({"x": t, "y": t.where("id > 5"), "z": t}, path)
    check = lambda **need: rows(sinks.verify_snapshot(spark, path, need), "table", "level", "finding")
    assert check(x=["id"], z=["v"]) == [("y", "warning", "empty table")] == rows(sinks.verify_snapshot(spark, path), "table", "level", "finding")
    assert check(y=["id"], gone=["id"], x=["id", "w"]) == [("gone", "error", "missing table"), ("x", "error", "missing columns: w"), ("y", "warning", "empty table")]
    spark.createDataFrame([(1, "a"), (2, "c")], "id int, v string").write.mode("overwrite").parquet(os.path.join(path, "z"))
    assert check(z=["id"]) == [("y", "warning", "empty table"), ("z", "error", "digest differs")]
    t.limit(1).write.mode("append").parquet(os.path.join(path, "x"))
    assert check(x=["id"])[:3] == [("x", "error", "byte count differs"), ("x", "error", "digest differs"), ("x", "error", "row count differs")]


def test_stream_ingest_replay(spark):
    folder, root, state = (shared_path(spark, "t", x) for x in ("in", "table", "state"))
    b = batch(spark).drop("ord").where("title <> 'later'")
    b.coalesce(1).write.parquet(folder)
    layout = TARGET
    table = st.KeptTable(spark, root, layout, ["source_name", "source_id"])
    table.write(0, existing(spark))
    feed = lambda: st.read_feed(spark, folder, "source_name string, source_id string, title string, official_url string")
    v1 = st.stream_ingest(feed(), table, state)
    first = rows(table.read(v1), "source_name", "source_id", "title")
    b.coalesce(1).write.mode("append").parquet(folder)
    v2 = st.stream_ingest(feed(), table, state)
    assert st.stream_ingest(feed(), st.KeptTable(spark, root, layout, table.keys), state) == v2  # a restart without new files
    assert v2 == v1 + 1 and rows(table.read(v2), "source_name", "source_id", "title") == first and len(first) == 8


def test_stream_late_rows(spark):
    folder = shared_path(spark, "t", "views")
    d = dt.datetime
    schema = "event_id long, viewed_at timestamp"
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
    out, state = shared_path(spark, "t", "out"), shared_path(spark, "t", "state")
    go = lambda: st.run_append(st.stream_views(st.read_feed(spark, folder, schema), "1 hour", "10 minutes"), out, state)
    put([(1, d(2024, 1, 1, 0, 5)), (1, d(2024, 1, 1, 1, 5))])
    go()
    put([(1, d(2024, 1, 1, 0, 58)), (1, d(2024, 1, 1, 0, 30)), (1, d(2024, 1, 1, 5))])
    go()
    got = rows(spark.read.parquet(out), "start", "event_id", "view_count")
    assert got[1:] == [(d(2024, 1, 1, 1), 1, 1)] and got[0][:2] == (d(2024, 1, 1), 1)


def test_stream_subscribers(spark):
    d = dt.datetime
    schema = "user_id long, id long, at timestamp_ntz, kind string, body string"
    folder, root, state = (shared_path(spark, "t", x) for x in ("subs", "subst", "subss"))
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
    table = st.KeptTable(spark, root, st.SUBSCRIBERS, ["user_id"])
    go = lambda first=0: st.stream_subscribers(st.read_feed(spark, folder, schema), table, {"1": "movie"}, state, first)
    put([(1, 1, d(2024, 1, 1), "message", "English"), (1, 2, d(2024, 1, 2), "follow", None), (1, 3, d(2024, 1, 3), "postback", "lang:zh"), (2, 4, d(2024, 1, 3), "message", "1")])
    v = go()
    assert rows(table.read(v), "user_id", "status", "language") == [(1, "active", "zh")]
    put([(1, 5, d(2024, 1, 4), "unfollow", None), (1, 6, d(2024, 1, 5), "message", "1"), (1, 7, d(2024, 1, 6), "postback", "lang:xx"), (2, 8, d(2024, 1, 6), "follow", None)])
    v = go()
    assert rows(table.read(v).withColumn("tags", F.array_join("tags", ",")), "user_id", "status", "language", "tags") == [(1, "blocked", "zh", "movie"), (2, "active", None, None)]


def test_kept_table_rewrites_touched_buckets_only(spark):
    table = st.KeptTable(spark, shared_path(spark, "t", "kept"), "k long, v long", ["k"], bucket_rows=13)
    assert table.latest() == -1 and table.read().count() == 0
    table.write(0, spark.range(100).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")))
    before = table.manifest(0)["buckets"]
    batch = spark.createDataFrame([(7, 1), (1000, 1)], "k long, v long")
    table.apply(1, batch, lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new))
    after = table.manifest(1)["buckets"]
    moved = {b for b in after if after[b] != before.get(b)}
    assert len(before) == 8 and 1 <= len(moved) <= 2 and table.latest() == 1
    assert rows(table.read(), "k", "v") == [(k, int(k == 7)) for k in range(100)] + [(1000, 1)]
    assert rows(table.read(0), "k", "v") == [(k, 0) for k in range(100)]
    table.apply(1, batch, lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new))  # a replay
    assert table.read().count() == 101


def test_feed_of_many_files(spark):
    """A folder of overlapping files gives what one file gives; a path without files is an error."""
    d = dt.datetime
    schema = "event_id long, viewed_at timestamp"
    data = [(i % 3, d(2024, 1, 1, i % 12, i % 60)) for i in range(200)] + [(9, d(2024, 1, 3))]
    df = spark.createDataFrame(data, schema)
    results = []
    for parts in (1, 7):
        folder, out, state = (shared_path(spark, "t", x) for x in ("feed", "out", "state"))
        df.repartition(parts).write.parquet(folder)
        st.run_append(st.stream_views(st.read_feed(spark, folder, schema)), out, state)
        results.append(rows(spark.read.parquet(out), "start", "event_id", "view_count"))
    assert results[0] == results[1] and sum(r[2] for r in results[0]) == 200
    with pytest.raises(Exception):
        st.read_feed(spark, shared_path(spark, "t", "nothing"), schema)


def test_last_per_key_is_deterministic(spark):
    from almanack.operators.upsert import last_per_key

    data = [("a", "x", i, [str(i)]) for i in range(50)] + [("b", None, 1, None), (None, "y", 1, None), ("c", "z", None, None)]
    df = spark.createDataFrame(data, "source_name string, source_id string, v int, w array<string>")
    for n in (1, 9):
        assert rows(last_per_key(df.repartition(n)), "source_name", "source_id", "v") == [("a", "x", 49), ("c", "z", None)]
    assert rows(last_per_key(df, order="v"), "source_name", "v")[0] == ("a", 49)
