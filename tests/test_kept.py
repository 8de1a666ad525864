"""The kept table: growth, deltas, replays, expiry."""

import os

import pytest
from pyspark.sql import functions as F

from almanack.operators.upsert import upsert
from almanack.streaming.kept import KeptTable

SCHEMA = "k long, v string"


def merge(old, batch):
    return upsert(old, batch, ["k"])


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    rows = [(r.k, r.v) for r in df.collect()]
    assert len({k for k, _ in rows}) == len(rows)
    return dict(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13, 64, 100])
def test_a_split_moves_rows_of_one_bucket_only(spark, tmp_path, count):
    table = KeptTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    rows = spark.range(4000).select(F.col("id").alias("k")).select(table.bucket(count).alias("a"), table.bucket(count + 1).alias("b")).collect()
    assert {r.a for r in rows} == set(range(count)) and {r.b for r in rows} == set(range(count + 1))
    whole = 1 << (count.bit_length() - 1)
    assert {r.a for r in rows if r.a != r.b} == {count - whole} and {r.b for r in rows if r.a != r.b} == {count}


def test_random_batches(spark, tmp_path):
    """Growing, changing and repeating batches against a dictionary."""
    import random

    rng = random.Random(7)
    table = KeptTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], bucket_rows=40)
    want, seen = {}, set()
    for version in range(24):
        rows = {rng.randrange(60 + 25 * version): f"{version}" for _ in range(12 if version else 90)}
        table.apply(version, batch(spark, list(rows.items())), merge)
        want |= rows
        if version % 5 == 0:  # replayed: the same version once more
            table.apply(version, batch(spark, list(rows.items())), merge)
        assert content(table.read()) == want
        seen.add(table.manifest(version)["count"])
    last = table.manifest(table.latest())
    assert last["count"] > 3 and len(seen) > 3
    assert any(b["deltas"] for b in last["buckets"].values())
    gone = table.expire(keep=1)
    assert gone and table.versions() == [23] and content(table.read()) == want
    assert not table.expire(keep=1)


def test_unchanged_rows_are_not_written(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    table.apply(0, batch(spark, [(i, "a") for i in range(50)]), merge)
    table.apply(1, batch(spark, [(3, "a"), (4, "a")]), merge)
    assert all(not b["deltas"] for b in table.manifest(1)["buckets"].values())
    table.apply(2, batch(spark, [(3, "a"), (4, "b"), (99, "n")]), merge)
    assert sum(b["changed"] for b in table.manifest(2)["buckets"].values()) == 2


def test_small_batch_on_a_large_table_writes_little(spark, tmp_path):
    """1,000 keys on a million rows: under 5 % of the table's bytes, splits and rewrites included."""
    root = str(tmp_path / "t")
    table = KeptTable(spark, root, SCHEMA, ["k"], bucket_rows=15_880)
    table.write(0, spark.range(1_000_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    size = lambda v: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/rows/{v}") for f in fs)
    for version in (1, 2):
        ids = F.when(F.col("id") < 900, F.col("id") * 997 + version).otherwise(F.col("id") + 1_000_000 * version)
        table.apply(version, spark.range(1000).select(ids.alias("k"), F.lit(f"v{version}").alias("v")), merge)
        assert size(version) < 0.05 * size(0)
    assert table.manifest(2)["count"] > table.manifest(0)["count"]
    assert table.read().count() == 1_000_200
    assert table.read().where("v in ('v1', 'v2')").count() == 2000


def test_empty_and_null_keys(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    assert table.latest() == -1 and table.read().count() == 0
    table.apply(0, batch(spark, []), merge)
    assert table.read().count() == 0
    table.apply(1, batch(spark, [(i, "x") for i in range(20)] + [(None, "n")]), merge)
    table.apply(2, batch(spark, [(5, "y")]), merge)
    rows = table.read().collect()
    assert len(rows) == 21 and {r.v for r in rows if r.k is None} == {"n"}
