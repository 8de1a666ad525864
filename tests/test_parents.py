"""Parent lookup against a plain statement of its rule."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanack.operators import joins as j


def like(name, term):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term)
    return re.search(f"(?s){pattern}", name) is not None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab%_.\\", max_size=6), min_size=1, max_size=6, unique=True), st.text("ab.\\\n", max_size=14))
def test_index_finds_what_like_finds(terms, name):
    assert j.TermIndex(terms).found(name) == {k for k, t in enumerate(terms) if like(name, t)}


def tables(spark, seed=3, n=400):
    rng = random.Random(seed)
    words = ["lantern", "night market", "台湾", "film", "100%", "a_b", "x", "talk (2)", "\\E.*"]
    names = [(i, f"s{min(rng.randrange(6), 3)}", " ".join(rng.choices(words, k=rng.randrange(1, 4))).title(), ["report"] if rng.random() < 0.3 else []) for i in range(n)]
    names += [(n, "s0", "", []), (n + 1, "s0", None, []), (n + 2, None, "film", []), (n + 3, "s1", "film", None)]
    reports = [(i, f"s{rng.randrange(5)}", f"『{' '.join(rng.choices(words, k=rng.randrange(1, 3)))}』 イベント レポート") for i in range(120)]
    reports += [(900, None, "『film』 レポート"), (901, "s0", None), (902, "s0", "『%』 レポート"), (903, "s0", "『___』 レポート")]
    ev = spark.createDataFrame(names, "id long, source_name string, name_ja string, category array<string>")
    return ev, spark.createDataFrame(reports, "id long, source_name string, name_ja string"), names


@pytest.mark.parametrize("term_bytes,name_bytes,few", [(j.TERM_BYTES, j.NAME_BYTES, j.FEW_SOURCES), (30, 700, 0), (1, 100, 5)])
def test_first_hits(spark, monkeypatch, term_bytes, name_bytes, few):
    """However terms and names are cut, a term's first ids are the same."""
    monkeypatch.setattr(j, "TERM_BYTES", term_bytes)
    monkeypatch.setattr(j, "NAME_BYTES", name_bytes)
    monkeypatch.setattr(j, "FEW_SOURCES", few)
    ev, _, names = tables(spark)
    terms = [(s, t) for s in ("s0", "s1", "s3", "none") for t in ("film", "100%", "a_b", "l%t", "_", "%", "台湾", "e.*", "(2)", "zzz")] + [(None, "film")]
    df = spark.createDataFrame(terms, "source_name string, term string")
    flagged = ev.withColumn("is_report", F.coalesce(F.array_contains("category", "report"), F.lit(False)))
    got = {(r.source_name, r.term, r.id, r.is_report) for r in j._substring_hits(df, flagged, 5).collect()}
    want = set()
    for s, t in terms:
        held = [(s, t, i, "report" in (c or [])) for i, src, n, c in names if n and src and src == s and like(n.lower(), t)]
        want |= set(held[:5])
    assert got == want and len(want) > 60


def test_find_parent_takes_the_first_that_is_no_report(spark):
    ev, reports, names = tables(spark)
    got = {r.id: r.parent_id for r in j.find_parent(reports, ev, 10).collect()}
    assert got[900] is None and got[901] is None
    for r in reports.where("id < 900").collect():
        term = re.search("『(.+?)』", r.name_ja)[1].strip().lower()
        if len(term) < 3:
            continue
        held = [(i, "report" in (c or [])) for i, s, n, c in names if n and s == r.source_name and like(n.lower(), term)][:10]
        parents = [i for i, report in held if not report]
        if parents:
            assert got[r.id] == parents[0]


def test_rows_without_a_key_are_dealt_over_tasks(spark):
    """The rows of a plain left join, and no task that has all keyless rows."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 70).alias("k"), F.lit("x").alias("name"))
    side = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id")).alias("label")).unionByName(spark.createDataFrame([(None, "none")], "k long, label string"))
    plain = rows.join(side, "k", "left").select("id", "k", "label")
    got = j.left_by_key(rows, side, "k")
    assert sorted(map(str, got.select("id", "k", "label").collect())) == sorted(map(str, plain.collect()))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("-1", "false", "8")):
            spark.conf.set(k, v)
        tasks = j.left_by_key(rows, side, "k").where("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 800


def test_a_doubled_title_multiplies_no_rows(spark):
    from almanack.operators.enrich import patch_titles

    layout = "id long, source_name string, raw_title string, name_ja string, name_zh string, name_en string, description_zh string, description_en string, category array<string>, annotation_status string"
    rows = [(1, "a", "T", "T", "old", None, "《old》", None, ["movie"], "pending"), (2, "a", None, None, "z", None, None, None, ["movie"], "pending"), (3, "a", "T", "T", "old", None, None, None, ["art"], "pending")]
    found = spark.createDataFrame([("T", "B", "e2"), ("T", "A", "e1"), (None, "x", "y")], "title string, title_zh string, title_en string")
    out = {r.id: (r.name_zh, r.name_en) for r in patch_titles(spark.createDataFrame(rows, layout), found, ["news"], None).collect()}
    assert out == {1: ("A", "e1"), 2: ("z", None), 3: ("old", None)}
