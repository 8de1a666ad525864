"""Keyed upsert with protection of human-edited rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.base import instant
from almanack.operators.joins import first_by

KEYS = ("source_name", "source_id")


def last_per_key(incoming: DataFrame, keys: Sequence[str] = KEYS, order: str | None = None) -> DataFrame:
    """One incoming row per key: the last in ``order``; among equals, and without an order, the
    largest by all columns in turn, so that a retry picks the same row.

    Rows with a null in the key can't be matched again and are left out.
    """
    keys = list(keys)
    rows = incoming.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    # maps have no order; as text they have
    plain = [F.to_json(c) if "map<" in t else F.col(c) for c, t in rows.dtypes if c not in keys]
    ranked = ([F.col(order).desc()] if order else []) + [c.desc_nulls_last() for c in plain]
    return first_by(rows, keys, *ranked) if ranked else rows.dropDuplicates(keys)


def classify(
    incoming: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = KEYS,
    force: DataFrame | None = None,
) -> DataFrame:
    """Add ``class``: blocked, reviewed, forced, existing or new, in this precedence.

    Only flags of the existing table are read; each side is shuffled once on the key.
    """
    keys = list(keys)
    known = existing.select(
        *keys,
        F.col("is_active").alias("_active"),
        (F.col("annotation_status") == "reviewed").alias("_reviewed"),
        F.coalesce("force_rescrape", F.lit(False)).alias("_forced"),
        F.lit(True).alias("_known"),
    )
    rows = incoming.join(known, keys, "left")
    forced = F.col("_forced")
    if force is not None:
        mine = force.select(*keys).distinct().withColumn("_mine", F.lit(True))
        rows = rows.join(mine, keys, "left")
        forced = forced | F.coalesce("_mine", F.lit(False))
    label = (
        F.when(F.col("_known").isNull(), F.lit("new"))
        .when(~F.coalesce("_active", F.lit(False)), F.lit("blocked"))
        .when(F.coalesce("_reviewed", F.lit(False)), F.lit("reviewed"))
        .when(forced, F.lit("forced"))
        .otherwise(F.lit("existing"))
    )
    return rows.withColumn("class", label).drop("_active", "_reviewed", "_forced", "_known", "_mine")


def writable(classified: DataFrame) -> DataFrame:
    """New and forced rows, the ones an upsert may write."""
    return classified.where(F.col("class").isin("new", "forced"))


def upsert(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str] = KEYS,
    keep: Sequence[str] = (),
    insert: dict[str, Column] | None = None,
    update: dict[str, Column] | None = None,
) -> DataFrame:
    """Merge by key. Columns in ``keep`` retain the target's value where the incoming is null.

    Target columns that ``incoming`` lacks are retained. ``insert`` and ``update`` set further
    columns of new and of matched rows. Keys are unique on both sides, so the full outer join
    has no hot partition.
    """
    keys = list(keys)
    fields = [c for c in incoming.columns if c not in keys and c in target.columns]
    i = incoming.select(*keys, *[F.col(c).alias(f"_i_{c}") for c in fields], F.lit(True).alias("_in"))
    t = target.withColumn("_old", F.lit(True))
    joined = t.join(i, keys, "full_outer")
    arrived, fresh = F.col("_in").isNotNull(), F.col("_old").isNull()
    out: dict[str, Column] = {}
    for c in target.columns:
        if c in keys:
            continue
        value = F.col(c)
        if c in fields:
            new = F.coalesce(f"_i_{c}", c) if c in keep else F.col(f"_i_{c}")
            value = F.when(arrived, new).otherwise(value)
        if insert and c in insert:
            value = F.when(arrived & fresh, insert[c]).otherwise(value)
        if update and c in update:
            value = F.when(arrived & ~fresh, update[c]).otherwise(value)
        out[c] = value
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in target.columns])


def upsert_events(target: DataFrame, incoming: DataFrame, force: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Classify, write new and forced rows, and re-queue the forced ones.

    The flag reset is keyed on (source, id), not on the id alone.
    """
    batch = last_per_key(incoming, KEYS, order)
    rows = writable(classify(batch, target, KEYS, force)).drop("class")
    requeue = {"annotation_status": F.lit("pending"), "force_rescrape": F.lit(False)}
    return upsert(target, rows, KEYS, keep=("official_url",), insert=requeue, update=requeue)


def event_row(df: DataFrame, ref) -> DataFrame:
    """Table row of a landed event; a missing official URL stays null and keeps the target's."""
    return df.withColumns({"official_url": F.nullif("official_url", F.lit("")), "scraped_at": instant(ref)})


def stamp(old: DataFrame, new: DataFrame, ref, keys: Sequence[str], c: str = "updated_at") -> DataFrame:
    """Set ``updated_at`` on rows that differ from before; untouched rows keep theirs."""
    keys = list(keys)
    fields = [x for x in new.columns if x not in keys and x != c]
    before = old.select(*keys, *[F.col(x).alias(f"_o_{x}") for x in fields], F.lit(True).alias("_was"))
    same = F.col("_was").isNotNull()
    for x in fields:
        same = same & F.col(x).eqNullSafe(F.col(f"_o_{x}"))
    return new.join(before, keys, "left").withColumn(
        c, F.when(same, F.col(c)).otherwise(instant(ref))
    ).select(*new.columns)
