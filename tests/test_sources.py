"""Landed pages as a data source, and snapshots with a tree of digests."""

import os

import pytest
from pyspark.sql import functions as F

from almanack.plans.listing import ListingSpec, all_facets, facet_counts
from almanack.session import shared_path
from almanack.sources import pages, trees


@pytest.fixture
def landed(spark):
    path = shared_path(spark, "t", "pages")
    rows = spark.range(250).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), F.col("id") % 5)).alias("name"), (F.col("id") / 2).alias("v"))
    pages.land_pages(rows, path, ["k"], size=40)
    return path, rows


LAYOUT = "k long, name string, v double"


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("per", [1, 3, 100])
def test_pages_until_the_short_one(spark, landed, per):
    path, rows = landed
    rows.where("k < 40").withColumns({"offset": F.lit(280), "rows": F.lit(40)}).write.mode("append").partitionBy("offset", "rows").json(path)
    read = pages.read_pages(spark, path, LAYOUT, size=40, pages=per)
    assert content(read) == content(rows)
    assert read.rdd.getNumPartitions() == {1: 7, 3: 3, 100: 1}[per]


def test_a_gap_ends_the_extract(spark, landed):
    path, rows = landed
    read = pages.read_pages(spark, path, LAYOUT, size=20)
    assert content(read) == content(rows.where("k < 40"))  # the next page would start at 20


@pytest.mark.parametrize("test", ["k >= 30 AND k < 90", "name = 'n3'", "name IN ('n1', 'n2') AND v > 20", "name IS NOT NULL AND v <= 8.5", "k = 3 OR k = 5", "name LIKE '%4'", "name IS NULL"])
def test_filters(spark, landed, test):
    path, rows = landed
    assert content(pages.read_pages(spark, path, LAYOUT, size=40).where(test)) == content(rows.where(test))


def test_filter_is_in_the_scan(spark, landed):
    """The plan keeps the filter that a page can't apply, and only that."""
    path, _ = landed
    read = pages.read_pages(spark, path, LAYOUT, size=40).where("k >= 30 AND name LIKE '%4'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan landed_pages" in plan and "EndsWith(name" in plan and ">= 30" not in plan


def test_no_pages(spark):
    path = shared_path(spark, "t", "none")
    os.makedirs(path.removeprefix("file:"), exist_ok=True)
    assert pages.read_pages(spark, path, LAYOUT).count() == 0


# ---- trees ----------------------------------------------------------------------------------


def bytes_read(spark):
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in stats)


def test_one_changed_row_of_600_000_is_found_in_few_bytes(spark):
    a, b = shared_path(spark, "t", "tree"), shared_path(spark, "t", "tree")
    rows = spark.range(600_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    trees.write_tree(rows, a, ["k"])
    trees.write_tree(rows.withColumn("v", F.when(F.col("k") == 345_678, F.lit("x")).otherwise(F.col("v"))), b, ["k"])
    size = sum(os.path.getsize(os.path.join(d, f)) for p in (a, b) for d, _, fs in os.walk(p.removeprefix("file:") + "/rows") for f in fs)
    before = bytes_read(spark)
    assert trees.changed_rows(spark, a, b, ["k"]).collect() == [(345_678, "changed")]
    assert bytes_read(spark) - before < 0.05 * size
    assert trees.damaged(spark, a).count() == 0


@pytest.mark.parametrize("few", [trees.FEW_LEAVES, 0])
def test_changes_of_all_kinds(spark, monkeypatch, few):
    monkeypatch.setattr(trees, "FEW_LEAVES", few)
    a, b = shared_path(spark, "t", "tree"), shared_path(spark, "t", "tree")
    rows = spark.range(3000).select((F.col("id") % 50).alias("p"), F.concat(F.lit("q"), F.col("id")).alias("q"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    later = rows.where("q <> 'q7'").withColumn("v", F.expr("CASE WHEN q = 'q8' THEN NULL WHEN q = 'q9' THEN 1 ELSE v END")).unionByName(spark.createDataFrame([(1, "new", None)], "p long, q string, v long"))
    trees.write_tree(rows, a, ["p", "q"], leaf_rows=20)
    trees.write_tree(later, b, ["p", "q"], leaf_rows=200)  # another depth
    want = {(7, "q7", "removed"), (8, "q8", "changed"), (9, "q9", "changed"), (1, "new", "added")}
    assert set(map(tuple, trees.changed_rows(spark, a, b, ["p", "q"]).collect())) == want
    assert trees.changed_rows(spark, a, a, ["p", "q"]).count() == 0


def test_damage_is_placed(spark):
    a = shared_path(spark, "t", "tree")
    trees.write_tree(spark.range(5000).withColumnRenamed("id", "k"), a, ["k"], leaf_rows=50)
    rows = spark.read.parquet(f"{a}/rows")
    held = spark.createDataFrame(rows.where("k <> 77").collect(), rows.schema)
    held.write.mode("overwrite").parquet(f"{a}/rows")
    found = trees.damaged(spark, a).collect()
    assert len(found) == 1 and found[0].n == found[0].found + 1


def test_empty_tree(spark):
    a, b = shared_path(spark, "t", "tree"), shared_path(spark, "t", "tree")
    none = spark.createDataFrame([], "k long, v string")
    trees.write_tree(none, a, ["k"])
    trees.write_tree(spark.createDataFrame([(1, "a")], "k long, v string"), b, ["k"])
    assert trees.changed_rows(spark, a, b, ["k"]).collect() == [(1, "added")]


# ---- facets ---------------------------------------------------------------------------------


def test_all_facets_equal_each_facet_and_scan_once(spark):
    rows = [(i, f"s{i % 4}", ["a", "b"][: i % 3], i % 2 == 0 if i % 5 else None, i % 3 > 0, ["pending", "annotated", None][i % 3], "2024-01-20", "2024-02-01", "name", None) for i in range(300)]
    layout = "id long, source_name string, category array<string>, is_paid boolean, is_active boolean, annotation_status string, start_date string, end_date string, name_ja string, location_address string"
    path = shared_path(spark, "t", "facets")
    spark.createDataFrame(rows, layout).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_date", "end_date")}).write.parquet(path)
    df = spark.read.parquet(path)
    spec = ListingSpec(categories="a,b", paid="free", annotation="annotated", source="s1", time_mode="active", active="active")
    made = all_facets(df, spec, "2024-01-25")
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.facet, r.value): r.n for r in made.collect()}
    for facet, switch in (("source_name", "source"), ("is_paid", "paid"), ("annotation_status", "annotation")):
        one = {(facet, None if r[0] is None else str(r[0]).lower() if facet == "is_paid" else r[0]): r.n for r in facet_counts(df, spec, "2024-01-25", facet, switch).collect()}
        assert one and one == {k: n for k, n in got.items() if k[0] == facet}
