"""Streams over append-only feeds: view counts, popularity, subscribers, ingest, run health.

The windowed streams keep one counter per key and window, so state grows with keys and not
with rows. They emit closed windows only: a window is out once the watermark, the newest time
seen less the delay, has passed its end, so the newest windows wait for later input.

Table-keeping streams merge each batch into a :class:`~almanack.streaming.kept.KeptTable`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions.tags import LANGUAGE_COMMANDS, parse_command
from almanack.operators.aggregates import succeeded
from almanack.operators.upsert import upsert, upsert_events
from almanack.session import shared_path
from almanack.streaming.kept import KeptTable as KeptTable


def read_feed(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A table's files, one or a folder of many, as a stream with a declared schema.

    By default all files at hand form one micro-batch, so neither their number nor their order
    decides which rows are late. With ``per_trigger`` files a batch, rows older than the
    watermark of the batches before are dropped: pass files in order of event time then.
    """
    if not spark.read.schema(schema).parquet(path).inputFiles():
        raise ValueError(f"no files to read in {path}")
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    # as a pattern that only this path matches: the file source takes one file as a pattern alone
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def stream_views(src: DataFrame, bucket: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Clicks per event and time bucket."""
    return (
        src.withWatermark("viewed_at", delay).groupBy(F.window("viewed_at", bucket).alias("w"), "event_id")
        .agg(F.count(F.lit(1)).alias("view_count")).select("w.start", "w.end", "event_id", "view_count")
    )


def stream_popularity(src: DataFrame, span: str = "30 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rolling popularity: views per event over ``span``, renewed every ``step``."""
    return (
        src.withWatermark("viewed_at", delay).groupBy(F.window("viewed_at", span, step).alias("w"), "event_id")
        .agg(F.count(F.lit(1)).alias("view_count")).select("w.start", "w.end", "event_id", "view_count")
    )


def stream_health(src: DataFrame, span: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Runs, failures and empty runs per source and day window."""
    ok = succeeded()
    return (
        src.withWatermark("ran_at", delay).groupBy(F.window("ran_at", span).alias("w"), "source")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(~ok).alias("failed"),
            F.count_if(ok & (F.coalesce("events_processed", F.lit(0)) == 0)).alias("zero"),
        )
        .select("w.start", "w.end", "source", "runs", "failed", "zero")
    )


def run_append(stream: DataFrame, out: str, state: str) -> None:
    """Drain what is available into files; closed windows only, each exactly once."""
    q = (
        stream.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def run_versions(stream: DataFrame, table: KeptTable, merge: Callable[[DataFrame, DataFrame], DataFrame], state: str, first: int = 0, mode: str = "append") -> int:
    """Apply ``merge(old rows, batch)`` per micro-batch; returns the newest version of the table."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            table.apply(first + batch_id, batch, merge)
        finally:
            batch.unpersist()

    q = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return table.latest()


def stream_ingest(stream: DataFrame, table: KeptTable, state: str, first: int = 1) -> int:
    """Idempotent ingest: known keys are skipped, so a replay of old files changes nothing."""
    return run_versions(stream, table, upsert_events, state, first)


SUBSCRIBERS = "user_id long, status string, language string, tags array<string>, updated_at timestamp_ntz"


def subscriber_changes(batch: DataFrame, known: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Newest value per user and field out of follow, unfollow, postback and message events.

    ``batch`` has user_id, kind, body, at, id. Only a follow creates a user; what an unknown
    user sends before following is ignored. Values are folded with ``max_by``, so a chatty
    user is reduced before the shuffle.
    """
    ord_ = F.struct("at", "id")
    cmd = parse_command(F.coalesce("body", F.lit("")), labels)
    post = F.regexp_extract(F.coalesce("body", F.lit("")), "^lang:(.+)$", 1)
    langs = sorted(set(LANGUAGE_COMMANDS.values()))
    language = F.when((F.col("kind") == "postback") & post.isin(*langs), post).when(
        (F.col("kind") == "message") & (cmd["kind"] == "lang"), cmd["lang"]
    )
    status = F.when(F.col("kind") == "follow", F.lit("active")).when(F.col("kind") == "unfollow", F.lit("blocked"))
    tags = F.when((F.col("kind") == "message") & (cmd["kind"] == "category"), cmd["tags"])
    rows = batch.select("user_id", ord_.alias("ord"), status.alias("status"), language.alias("language"), tags.alias("tags"))
    follows = batch.where("kind = 'follow'").groupBy("user_id").agg(F.min(ord_).alias("_from"))
    have = known.select("user_id", F.lit(True).alias("_known"))
    live = (
        rows.where("status IS NOT NULL OR language IS NOT NULL OR tags IS NOT NULL")
        .join(follows, "user_id", "left").join(have, "user_id", "left")
        .where(F.col("_known") | (F.col("ord") >= F.col("_from")))
    )
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    return live.groupBy("user_id").agg(newest("status"), newest("language"), newest("tags"), F.max("ord")["at"].alias("updated_at"))


def merge_subscribers(labels: Mapping[str, str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        changes = subscriber_changes(batch, old, labels)
        return upsert(old, changes, ["user_id"], keep=("status", "language", "tags"))

    return merge


def stream_subscribers(stream: DataFrame, table: KeptTable, labels: Mapping[str, str], state: str, first: int = 0) -> int:
    return run_versions(stream, table, merge_subscribers(labels), state, first)


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a windowed stream to its end and read back the emitted rows."""
    out = shared_path(spark, "streams", name)
    run_append(stream, out, shared_path(spark, "state", name))
    return spark.read.schema(stream.schema).parquet(out)
