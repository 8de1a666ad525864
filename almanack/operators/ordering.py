"""First/last per key, ordered picks, sorts and quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.base import strip
from almanack.operators.joins import first_by


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: str = "id") -> DataFrame:
    """Newest row per key. The group limit keeps one row per key before the shuffle."""
    return first_by(df, keys, F.col(ts).desc(), F.col(tie).desc())


def dedup_first(df: DataFrame, order: Sequence, name: str = "name_ja", start: str = "start_date") -> DataFrame:
    """First row per (source, tidy name, day); unnamed rows and sub-rows pass through.

    Each pass-through row is its own key, so that blank names do not meet in one task.
    """
    tidy = F.lower(strip(F.coalesce(F.col(name), F.lit(""))))
    passes = F.col("source_id").contains("_sub") | (tidy == "")
    keyed = df.withColumns(
        {
            "_name": F.when(~passes, tidy),
            "_day": F.when(~passes, F.to_date(start)),
            "_own": F.when(passes, F.col("source_id")),
            "_id": F.when(passes, F.col("id")),
        }
    )
    return first_by(keyed, ["source_name", "_name", "_day", "_own", "_id"], *order).drop("_name", "_day", "_own", "_id")


def dedup_by_id(df: DataFrame, key: str, *order) -> DataFrame:
    return first_by(df, [key], *order)


def first_per_url(df: DataFrame, key: str, items: str, url: str = "url") -> DataFrame:
    """Items of a nested array, first occurrence per URL inside each row."""
    flat = df.select(key, F.posexplode(items).alias("pos", "item"))
    return first_by(flat.withColumn("_u", F.col("item")[url]), [key, "_u"], "pos").drop("_u")


def best_candidate(cands: DataFrame, key: str, *order) -> DataFrame:
    return first_by(cands, [key], *order)


def number_children(df: DataFrame, key: str, items: str, base: str, pattern: str = "_sub{}", start: int = 1) -> DataFrame:
    """One row per child with an id built from its position in the parent."""
    head, tail = pattern.split("{}")
    return df.select(key, base, F.posexplode(items).alias("_p", "item")).select(
        key,
        F.concat(F.col(base), F.lit(head), (F.col("_p") + start).cast("string"), F.lit(tail)).alias("child_id"),
        "item",
    )


def distinct_ordered(a: Column, b: Column) -> Column:
    """Order-preserving union of two arrays."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def sort_key(df: DataFrame, c: str) -> Column:
    """Nulls sort as empty, booleans as 0 and 1."""
    kind = df.schema[c].dataType.typeName()
    if kind == "boolean":
        return F.coalesce(F.col(c).cast("int"), F.lit(-1))
    if kind == "string":
        return F.coalesce(F.col(c), F.lit(""))
    return F.col(c)


def sort_any(df: DataFrame, c: str, direction: str = "asc", tie: str = "id") -> DataFrame:
    k = sort_key(df, c)
    return df.orderBy(k.asc_nulls_first() if direction == "asc" else k.desc_nulls_last(), tie)


def verified_first(df: DataFrame, flag: str, pos: str) -> DataFrame:
    return df.orderBy(F.coalesce(F.col(flag), F.lit(False)).desc(), pos)


def newest(df: DataFrame, ts: str, n: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def first_tags(c: str, n: int) -> Column:
    return F.slice(c, 1, n)


def split_status(df: DataFrame, c: str, value) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(F.col(c) == value, F.lit(False))
    return df.where(hit), df.where(~hit)


def quota_select(
    df: DataFrame,
    quotas: dict[str, int],
    fallback: dict[str, str],
    total: int,
    group: str = "grp",
    order: Sequence = ("start_date", "id"),
) -> DataFrame:
    """A fixed-size pick: each group fills its quota, empty groups hand theirs on, the rest
    is filled in order.

    Only the first ``total`` rows of each group can ever be picked, so the group limit runs
    before the shuffle and everything after it works on ``groups x total`` rows.
    """
    names = list(quotas)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    heads = df.where(F.col(group).isin(*names)).withColumn("_rank", rank).where(F.col("_rank") <= total)
    present = [F.count_if(F.col(group) == g).over(Window.partitionBy()) > 0 for g in names]
    slots = F.lit(0)
    for g in names:
        own = F.lit(quotas[g])
        inherited = sum(
            (F.when(~present[names.index(src)], F.lit(quotas[src])).otherwise(F.lit(0))
             for src, dst in fallback.items() if dst == g),
            F.lit(0),
        )
        slots = F.when(F.col(group) == g, own + inherited).otherwise(slots)
    must = F.col("_rank") <= F.col("_slots")
    return (
        heads.withColumn("_slots", slots)
        .withColumn("_pick", F.row_number().over(Window.orderBy(must.desc(), *order)))
        .where(F.col("_pick") <= total)
        .withColumn("mandatory", must)
        .drop("_rank", "_slots", "_pick")
    )
