"""What the operators share: table reads, durable intermediate tables, numbering, Arrow plumbing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it from there.

    Later stages start from files that every executor can open, so a lost executor costs the
    tasks that it ran and never a recomputation of what came before. Spark drops the shuffle
    files of a finished job only when the driver's garbage is collected; that is asked for here.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm")
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """``df`` with consecutive numbers from 0 in ``order``, and the number of rows.

    Range-partitioned once and settled with its partition number; only a row count per
    partition passes through a window.
    """
    fixed = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = (
        fixed.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_inside") - 1)
        .drop("_part", "_inside", "_start")
    )
    return numbered, fixed.count()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; one row at least."""
    for batch in batches:
        at = 0
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        while at < batch.num_rows:
            stop, held = at, 0
            for size in itertools.islice(sizes, at, None):
                if stop > at and held + (size or 0) > limit:
                    break
                held += size or 0
                stop += 1
            yield batch.slice(at, stop - at)
            at = stop

