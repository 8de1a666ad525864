"""The daily batch: dedup, upsert, run log, cross-source merge, landed annotations, archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.functions.base import instant
from almanack.operators.enrich import apply_annotations, archive_ended, expand_subs
from almanack.operators.ordering import dedup_first
from almanack.operators.resolve import NEWS_SOURCES, apply_merge, assign_primary, match_news, mergeable
from almanack.operators.upsert import KEYS, classify, event_row, last_per_key, upsert, upsert_events, writable
from almanack.session import durable


def merge_decisions(events: DataFrame, ranks: dict[str, int] | None = None, news_sources: Sequence[str] = NEWS_SOURCES) -> DataFrame:
    """(primary_id, secondary_id) of both passes: similar names of one day, then news reports.

    The second pass leaves out whatever the first one absorbed, on both sides.
    """
    rows = mergeable(events)
    first = durable(assign_primary(rows, F.to_date("start_date"), ranks=ranks).select("primary_id", "secondary_id"))
    gone = first.select(F.col("secondary_id").alias("id")).distinct()
    left = rows.join(gone, "id", "left_anti")
    is_news = F.col("source_name").isin(*news_sources)
    second = match_news(left.where(is_news), left.where(~is_news), ranks=ranks)
    return first.unionByName(second.select(F.col("official_id").alias("primary_id"), F.col("news_id").alias("secondary_id")))


def merge_sources(events: DataFrame, ranks: dict[str, int] | None = None, news_sources: Sequence[str] = NEWS_SOURCES) -> DataFrame:
    return apply_merge(events, merge_decisions(events, ranks, news_sources))


def run_log(landed: DataFrame, attempts: DataFrame, ref, order: Sequence[str] = ("id",)) -> DataFrame:
    """One run-log row per attempted source: what was landed of it, after dedup, and how the attempt went.

    ``attempts`` has source, success, duration_seconds and translated_chars, one row per source. A failed
    attempt counts no events; neither does one that landed nothing.
    """
    counts = dedup_first(landed, order).groupBy(F.col("source_name").alias("source")).agg(F.count(F.lit(1)).alias("_n"))
    ok = F.coalesce("success", F.lit(False))
    return attempts.join(counts, "source", "left").select(
        "source", F.when(ok, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("events_processed"),
        F.when(ok, F.coalesce("translated_chars", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("translated_chars"),
        ok.alias("success"), F.floor("duration_seconds").cast("long").alias("duration_seconds"), instant(ref).alias("ran_at"),
    )


def annotate_pending(events: DataFrame, annotations: DataFrame, ref, human: DataFrame | None = None) -> DataFrame:
    """Apply landed annotations (id, payload) to pending rows and add their sub-events.

    A sub-event is an annotated row of its own. It goes through the guarded upsert by (source, id),
    so one that is there already, reviewed or switched off stays as it is. A new one's id follows
    from its key.
    """
    pending = events.where("annotation_status = 'pending'").select("id")
    meant = durable(annotations.join(pending, "id", "left_semi"))
    done = durable(apply_annotations(events, meant, ref, human))
    subs = last_per_key(expand_subs(done, meant, ref))
    kind = dict(events.dtypes)["id"]
    fresh = writable(classify(subs, done)).drop("class").withColumn("id", F.xxhash64(*KEYS).cast(kind))
    return upsert(done, fresh.select(*[c for c in fresh.columns if c in events.columns]), KEYS)


def daily_batch(
    target: DataFrame,
    landed: DataFrame,
    ref,
    order: Sequence[str] = ("id",),
    force: DataFrame | None = None,
    ranks: dict[str, int] | None = None,
    news_sources: Sequence[str] = NEWS_SOURCES,
    annotations: DataFrame | None = None,
    human: DataFrame | None = None,
) -> DataFrame:
    """New state of the event table after one day's landed rows, in the order of the daily run:
    dedup, upsert, merge across sources, landed annotations, archive. :func:`run_log` has the day's log rows.
    """
    batch = event_row(dedup_first(landed, order), ref)
    stored = durable(upsert_events(target, batch, force))
    merged = merge_sources(stored, ranks, news_sources)
    if annotations is not None:
        merged = annotate_pending(durable(merged), annotations, ref, human)
    return archive_ended(merged, ref)
