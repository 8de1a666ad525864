"""Keyed-state streams against the rules over whole tables, with restarts between batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from almanack.operators.aggregates import run_health
from almanack.session import shared_path
from almanack.streaming import stateful as sf
from almanack.streaming import streams as st

START = dt.datetime(2024, 1, 1)
LABELS = {"1": "movie", "2": "art"}
CHAT = "user_id long, id long, at timestamp_ntz, kind string, body string"


def put(spark, folder, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def chat(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["follow", "unfollow", "message", "postback", "message", "other"])
        body = rng.choice(["English", "1", "2", "1 2", "hello", None]) if kind == "message" else rng.choice(["lang:zh", "lang:ja", "lang:xx", None])
        rows.append((rng.choice([1, 2, 3, 4, 5, 6, 7, None]), i, START + dt.timedelta(minutes=rng.randrange(90)), kind, body))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_subscribers_in_any_batches_equal_the_batch_rule(spark, seed):
    """The query is started anew for each of three batches, which hold the events out of order."""
    folder, root, state = (shared_path(spark, "t", x) for x in ("chat", "chat_table", "chat_state"))
    rows = chat(seed)
    table = st.KeptTable(spark, root, st.SUBSCRIBERS, ["user_id"])
    for part in (rows[::3], rows[2::3], rows[1::3]):
        put(spark, folder, part, CHAT)
        sf.stream_subscriber_state(st.read_feed(spark, folder, CHAT), st.KeptTable(spark, root, st.SUBSCRIBERS, ["user_id"]), LABELS, state)
    whole = spark.createDataFrame([r for r in rows if r[0] is not None], CHAT)
    want = st.subscriber_changes(whole, spark.createDataFrame([], "user_id long"), LABELS)
    cols = ["user_id", "status", "language", F.array_join("tags", ",").alias("tags"), "updated_at"]
    assert sorted(map(str, table.read().select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert table.read().count() > 3


def feed_in_parts(spark, name, rows, schema, build, parts):
    """Rows in order of time, one file and one start of the query for each part."""
    folder, out, state = (shared_path(spark, "t", f"{name}_{x}") for x in ("in", "out", "state"))
    rows = sorted(rows, key=lambda r: r[1])
    for k in range(parts):
        put(spark, folder, rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema)
        st.run_append(build(st.read_feed(spark, folder, schema)), out, state)
    return spark.read.parquet(out)


@pytest.mark.parametrize("parts", [1, 3])
def test_silent_sources_equal_run_health(spark, parts):
    rng = random.Random(parts)
    rows = [(f"s{rng.randrange(6)}", START + dt.timedelta(minutes=rng.randrange(20 * 1440))) for _ in range(60)]
    rows += [("often", START + dt.timedelta(hours=5 * k)) for k in range(100)] + [("once", START + dt.timedelta(hours=3)), ("off", START)]
    build = lambda s: sf.stream_silent(s, exempt=["off"])
    got = feed_in_parts(spark, "silent", rows, "source string, ran_at timestamp", build, parts)
    got = {(r.checked_at, r.source) for r in got.collect()}
    runs = spark.createDataFrame([(*r, True, 1) for r in rows], "source string, ran_at timestamp_ntz, success boolean, events_processed int").cache()
    newest, want = max(r[1] for r in rows), set()
    for day in range(1, 22):
        end = START + dt.timedelta(days=day)
        if end <= newest - dt.timedelta(hours=1):
            missing = run_health(runs.where(F.col("ran_at") < F.lit(end).cast("timestamp_ntz")), str(end), exempt=["off"]).where("issue = 'missing'")
            want |= {(end, r.source) for r in missing.collect()}
    assert got == want and len(want) > 20 and ("once" in {s for _, s in want})


@pytest.mark.parametrize("panes,parts", [(30, 1), (3, 1), (3, 4)])
def test_rolling_counts_equal_windows(spark, panes, parts):
    rng = random.Random(panes)
    rows = [(rng.randrange(4), START + dt.timedelta(minutes=rng.randrange(6 * 1440) + rng.choice([0, 0, 25 * 1440]))) for _ in range(150)]
    schema = "event_id long, viewed_at timestamp"
    got = feed_in_parts(spark, "rolling", rows, schema, lambda s: sf.stream_rolling(s, panes, 1, "1 day"), parts)
    got = {(r.start, r.end, r.event_id, r.view_count) for r in got.collect()}
    newest, want = max(r[1] for r in rows), set()
    for day in range(1, 80):
        end = START + dt.timedelta(days=day)
        if end > newest - dt.timedelta(days=1):
            break
        for e in range(4):
            n = sum(end - dt.timedelta(days=panes) <= at < end for i, at in rows if i == e)
            if n:
                want.add((end - dt.timedelta(days=panes), end, e, n))
    assert got == want and want


def test_silent_sources_are_windows(spark):
    """One newest run per source and check time, combined by Spark; check times fall on whole steps."""
    folder = shared_path(spark, "t", "silent_plain")
    rows = [("a", START + dt.timedelta(hours=3)), ("a", START + dt.timedelta(hours=30)), ("b", START + dt.timedelta(days=9))]
    put(spark, folder, rows, "source string, ran_at timestamp")
    stream = sf.stream_silent(st.read_feed(spark, folder, "source string, ran_at timestamp"), hours=24, memory=2.5, step=2)
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString()
    got = [(r.checked_at, r.source, r.last_run) for r in st.drain(spark, stream, "silent_plain").collect()]
    step = dt.timedelta(days=2)
    ends = [dt.datetime(1970, 1, 1) + k * step for k in range(9850, 9880)]
    want = [(e, s, max(t for x, t in rows if x == s and t < e)) for e in ends for s in "ab" if e <= rows[-1][1] - dt.timedelta(hours=1) and any(x == s and t < e for x, t in rows)]
    assert got == [w for w in want if dt.timedelta(days=1) < w[0] - w[2] <= dt.timedelta(days=2.5)] and len(got) == 1
