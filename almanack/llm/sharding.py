"""Reproducible shuffle and sharding: a keyed permutation of global row numbers.

Rows are numbered once in key order. A Feistel network over the grid ``a x b`` (``a`` the root
of the row count, rounded up) permutes the numbers; numbers that leave ``0..n-1`` walk along
their cycle until they come back. Position ``p`` of the permutation is slot ``p div shards`` of
shard ``p mod shards``, so shard and slot follow from the row number alone, both ways.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import number_rows

SHARDS = 8
SEED = 42
ROUNDS = 6


def _div(x: Column, by: int) -> Column:
    """Whole-number division without a detour over doubles."""
    return F.call_function("div", x, F.lit(by))


def _network(at: Column, n: int, seed: int, inverse: bool) -> Column:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    left, right = _div(at, b), at % b
    for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        mix = lambda half, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), half), F.lit(m))  # noqa: E731, B023
        sign = -1 if inverse else 1
        if k % 2 == 0:
            left = F.pmod(left + sign * mix(right, a), F.lit(a))
        else:
            right = F.pmod(right + sign * mix(left, b), F.lit(b))
    return (left * b + right).cast("long")


def permute(row: Column, n: int, seed: int = SEED, inverse: bool = False) -> Column:
    """The permutation of ``0..n-1`` (or its inverse) applied to ``row``.

    The grid exceeds ``n`` by fewer than ``a`` points and a walk meets each of them at most once.
    64 steps are therefore enough for every ``n`` up to 4,096; above it a walk of more than 64
    steps has a chance below 64**-64, and would raise an error, not a wrong number.
    """
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        _network(row, n, seed, inverse),
        lambda at, _: F.when(at >= n, _network(at, n, seed, inverse)).otherwise(at),
    )
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the walk did not return")).cast("long"))


def shard_rows(rows: DataFrame, order: list, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``row``, ``shard`` and ``slot``; shard sizes differ by one at most.

    ``order`` must tell rows apart for a reproducible result; rows equal in all of it are
    interchangeable. Nulls come first. An empty table gives an empty result.
    """
    numbered, n = number_rows(rows, order, "row")
    at = permute(F.col("row"), n, seed)
    return (
        numbered.withColumn("_at", at)
        .withColumn("shard", (F.col("_at") % shards).cast("int"))
        .withColumn("slot", _div(F.col("_at"), shards))
        .drop("_at")
    )


def row_of(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The row number that sits at (shard, slot)."""
    return permute((slot * shards + shard).cast("long"), n, seed, inverse=True)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, row, shard, slot`` of every document; texts don't travel.

    ``size`` is the UTF-8 length of the text (null: none) plus 1. Equal or null ids are told
    apart by their text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_rows(narrow, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], shards, seed)
