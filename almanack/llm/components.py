"""Connected components of a large undirected graph by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import settle


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest node among ``u`` and its neighbours; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; ``root`` is the smallest node it can reach.

    Null ends and loops are ignored. Each round rewrites the edges towards local minima and
    settles them; a node with very many neighbours is only ever met through a combined minimum
    and a join that Spark may split.
    """
    now = settle(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_minima(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = settle(large)
        lowest = _minima(large)
        pulled = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(pulled.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        was, mark, now = mark, _mark(after), after
        if mark == was:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
