"""Set operations on tables and on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.operators.joins import first_by


def union_last(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union in which the second table wins on equal keys."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return first_by(both, [key], F.col("_side").desc()).drop("_side")


def missing(expected: DataFrame, ran: DataFrame, key: str, exempt: Sequence[str] = ()) -> DataFrame:
    """Expected keys that did not run, without the exempt ones."""
    out = expected.select(key).distinct().join(ran.select(key), key, "left_anti")
    return out.where(~F.col(key).isin(*exempt)) if exempt else out


def stack(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def tags_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def tags_added(found: Column, allowed: Column, current: Column) -> Column:
    return F.array_except(F.array_intersect(found, allowed), current)


def drop_tag(df: DataFrame, ids: DataFrame, tag: str, column: str = "category") -> DataFrame:
    """Remove one tag from the selected rows."""
    chosen = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return (
        df.join(chosen, "id", "left")
        .withColumn(column, F.when(hit, F.array_remove(column, tag)).otherwise(F.col(column)))
        .drop("_hit")
    )


def tags_changed(a: Column, b: Column) -> Column:
    """True when two tag lists differ as sets of entries."""
    return ~F.array_sort(a).eqNullSafe(F.array_sort(b))


def force_flag(df: DataFrame, extra: DataFrame, keys: Sequence[str], flag: str = "force_rescrape") -> DataFrame:
    """Stored flag OR membership in the caller's key set."""
    k = extra.select(*keys).distinct().withColumn("_f", F.lit(True))
    return (
        df.join(k, list(keys), "left")
        .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce("_f", F.lit(False)))
        .drop("_f")
    )
