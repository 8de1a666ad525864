import zlib

import pytest
from pyspark.sql import functions as F

from almanack.llm import sharding

from .conftest import ROWS


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_and_inverse(spark, n):
    rows = spark.range(n).select("id", sharding.permute(F.col("id"), n).alias("p"))
    both = rows.select("id", "p", sharding.permute(F.col("p"), n, inverse=True).alias("back")).collect()
    assert sorted(r.p for r in both) == list(range(n))
    assert all(r.back == r.id for r in both)


def test_seeds_and_repeats(spark):
    at = lambda seed: [r[0] for r in spark.range(500).select(sharding.permute(F.col("id"), 500, seed)).collect()]
    assert at(1) == at(1) != at(2)
    assert at(1) != sorted(at(1))


def test_documents(docs):
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS
    )
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_documents(docs.repartition(5), shards=4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    n = len(rows)
    check = docs.sparkSession.createDataFrame(rows).withColumn("back", sharding.row_of(F.col("shard"), F.col("slot"), n, 4))
    assert check.where("back <> row").count() == 0


def test_fewer_rows_than_shards_and_none(docs, no_docs):
    assert sorted(r.shard for r in sharding.shard_documents(docs.where("doc_id in (1, 2)")).collect()) == [0, 1]
    assert sharding.shard_documents(no_docs).count() == 0
