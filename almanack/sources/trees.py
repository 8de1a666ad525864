"""Snapshots with a tree of digests: where two of them differ, and which rows, without reading the rest.

Rows are kept in the order of a hash of their key. The leaves of the tree are ranges of that
hash, each with the number of its rows and a digest of them that no order changes; a node above
adds up its ``FAN`` children. Two trees are compared from the root down, below differing nodes
only, and rows are read from differing leaves alone: by range filters that reach the files'
statistics. Keys are unique; a repeated key shows as changed when either side's rows differ.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.session import durable
from almanack.sources.sinks import row_hash

FAN_BITS = 4
TOKEN_BITS = 60
LEAF_ROWS = 1000
TREE, ROWS = "tree", "rows"
#: Up to so many differing leaves are looked up by range; beyond, all rows are scanned once.
FEW_LEAVES = 400


def token(keys: Sequence[str]) -> Column:
    """A key's place: the upper bits of its hash, from 0."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - TOKEN_BITS)


def _node(place: Column, level: int) -> Column:
    return F.shiftright(place, TOKEN_BITS - FAN_BITS * level)


def _digests(rows: DataFrame, level: int) -> DataFrame:
    plain = rows.drop("_token")
    return rows.select(_node(F.col("_token"), level).alias("node"), row_hash(plain.columns).alias("h")).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.sum("h").cast("decimal(38,0)").alias("digest"))


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    return max(1, math.ceil(math.log(max(rows, 1) / leaf_rows, 1 << FAN_BITS)) if rows > leaf_rows else 1)


def write_tree(df: DataFrame, path: str, keys: Sequence[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Write the rows of ``df`` in order of their keys' hash, and the tree over what was written; returns the tree."""
    spark = df.sparkSession
    placed = df.withColumn("_token", token(keys)).repartitionByRange("_token").sortWithinPartitions("_token")
    placed.write.mode("overwrite").option("parquet.page.row.count.limit", 500).option("parquet.block.size", 8 << 20).parquet(os.path.join(path, ROWS))
    rows = spark.read.parquet(os.path.join(path, ROWS))
    depth = depth_for(rows.count(), leaf_rows)
    level = durable(_digests(rows, depth))
    levels = [level.withColumn("level", F.lit(depth))]
    for up in range(depth - 1, -1, -1):
        level = level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
        levels.append(level.withColumn("level", F.lit(up)))
    reduce(DataFrame.unionByName, levels).repartition("level").write.mode("overwrite").partitionBy("level").parquet(os.path.join(path, TREE))
    return read_tree(spark, path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node long, n long, digest decimal(38,0), level int").parquet(os.path.join(path, TREE))


def depth(tree: DataFrame) -> int:
    return tree.agg(F.max("level")).first()[0] or 0


def differing_leaves(a: DataFrame, b: DataFrame) -> tuple[DataFrame, int]:
    """Nodes of the deepest level both trees have whose digests differ, and that level."""
    down = min(depth(a), depth(b))
    found = None
    for level in range(down + 1):
        side = lambda t: t.where(F.col("level") == level).select("node", "n", "digest")  # noqa: B023
        if found is not None:
            above = F.shiftright("node", FAN_BITS)
            pick = lambda t, f=found: side(t).join(f.withColumnRenamed("node", "_up"), above == F.col("_up"), "left_semi")
        else:
            pick = side
        x, y = pick(a).alias("x"), pick(b).alias("y")
        both = x.join(y, F.col("x.node") == F.col("y.node"), "full_outer")
        same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.digest").eqNullSafe(F.col("y.digest"))
        found = durable(both.where(~same).select(F.coalesce("x.node", "y.node").alias("node")))
        if found.isEmpty():
            break
    return found, down


def changed_rows(spark: SparkSession, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """(keys, change): rows added, removed or changed from snapshot ``a`` to ``b``."""
    leaves, level = differing_leaves(read_tree(spark, a), read_tree(spark, b))
    few = leaves.limit(FEW_LEAVES + 1).collect()
    width = TOKEN_BITS - FAN_BITS * level

    def rows(path: str) -> DataFrame:
        df = spark.read.parquet(os.path.join(path, ROWS))
        plain = [c for c in df.columns if c != "_token"]
        if len(few) <= FEW_LEAVES:
            ranges = [F.col("_token").between(r["node"] << width, ((r["node"] + 1) << width) - 1) for r in few]
            df = df.where(reduce(lambda x, y: x | y, ranges, F.lit(False)))
        else:
            df = df.join(leaves, _node(F.col("_token"), level) == leaves["node"], "left_semi")
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(row_hash(plain)).alias("h"))

    same_key = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    both = rows(a).alias("x").join(rows(b).alias("y"), same_key, "full_outer")
    change = F.when(F.col("x.n").isNull(), "added").when(F.col("y.n").isNull(), "removed").when((F.col("x.h") != F.col("y.h")) | (F.col("x.n") != F.col("y.n")), "changed")
    return both.select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], change.alias("change")).where("change IS NOT NULL")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(node, n, found): leaves of a snapshot whose rows no longer have the digest of its tree."""
    tree = read_tree(spark, path)
    level = depth(tree)
    kept = tree.where(F.col("level") == level).alias("x")
    now = _digests(spark.read.parquet(os.path.join(path, ROWS)), level).alias("y")
    both = kept.join(now, F.col("x.node") == F.col("y.node"), "full_outer")
    same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.digest").eqNullSafe(F.col("y.digest"))
    return both.where(~same).select(F.coalesce("x.node", "y.node").alias("node"), F.col("x.n").alias("n"), F.col("y.n").alias("found"))
