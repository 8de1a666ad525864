"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.session import durable


def number_rows(df: DataFrame, order: Sequence, name: str = "pos", start: int = 1) -> DataFrame:
    """Consecutive numbers in ``order`` over the whole table.

    Rows are range-partitioned and made durable with their partition number, so that the
    second read sees the same split. Only one count per partition passes through a window.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    fixed = durable(ranged)
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        fixed.withColumn("_rn", inside)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_rn") + F.lit(start - 1))
        .drop("_part", "_rn", "_off")
    )


def running_sum(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same key up to and with each row, in ``order``.

    Rows are range-partitioned by key and order, so a frequent key is split between tasks. A window
    inside each range gives the sums so far, and a second one over one total per range and key
    brings what earlier ranges held.
    """
    fixed = durable(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    totals = fixed.groupBy("_part", *key).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"_c.{k}").eqNullSafe(F.col(f"_f.{k}")) for k in ("_part", *key)]
    summed = fixed.withColumn("_inside", F.sum(value).over(inside)).alias("_f").join(carried.alias("_c"), same)
    return summed.select("_f.*", "_c._carried").withColumn(name, F.col("_inside") + F.col("_carried")).drop("_inside", "_carried", "_part")


def batches(ids: DataFrame, order: Sequence, size: int = 500) -> DataFrame:
    """Recipient rows with a batch number; every batch but the last has ``size`` rows."""
    return number_rows(ids, order, "pos", start=0).withColumn(
        "batch", F.floor(F.col("pos") / F.lit(size)).cast("long")
    )


def recipient_batches(subs: DataFrame, languages: Sequence[str], size: int = 500, lang: str = "lang", key: str = "id") -> DataFrame:
    """(lang, batch, id): the recipients of each known language in batches of ``size``.

    All languages are numbered in one pass in order of language and id; a language starts where
    its first number is, one row each.
    """
    known = subs.where(F.col(lang).isin(*languages)).select(F.col(lang).alias("lang"), F.col(key).alias("id"))
    placed = durable(number_rows(known, ["lang", "id"], "pos", start=0))
    starts = placed.groupBy("lang").agg(F.min("pos").alias("_from"))
    batch = F.floor((F.col("pos") - F.col("_from")) / F.lit(size)).cast("long")
    return placed.join(F.broadcast(starts), "lang").select("lang", batch.alias("batch"), "id")
