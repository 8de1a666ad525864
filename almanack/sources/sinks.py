"""Appends, JSON rows, run records and snapshots."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions.base import instant
from almanack.operators.aggregates import succeeded

MANIFEST = "_manifest"


def to_json_rows(df: DataFrame, name: str = "row") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def run_record(events: DataFrame, ref, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Run-log rows: events, success, duration, tokens, cost, one per key."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events_processed"),
        F.min(succeeded()).alias("success"),
        F.sum("duration_seconds").alias("duration_seconds"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"),
    ).withColumn("ran_at", instant(ref))


def snapshot_rows(df: DataFrame, ref, days: int = 30) -> DataFrame:
    """Inactive rows and rows updated in the last ``days``; ids are unique, so one OR is the union."""
    recent = F.col("updated_at") >= instant(ref) - F.make_dt_interval(F.lit(days))
    return df.where(~F.col("is_active") | recent)


def impact(events: DataFrame, reports: DataFrame, corrections: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: snapshot events, their reports and corrections, and sub-events among them."""
    ids = events.select(F.col("id").alias("_pid"))
    hits = lambda child, name: child.join(ids, child[key] == ids["_pid"], "left_semi").agg(F.count(F.lit(1)).alias(name))
    own = events.agg(F.count(F.lit(1)).alias("events"), F.count("parent_event_id").alias("sub_events"))
    keyed = lambda d: d.select(F.lit(0).alias("_k"), "*")
    return (
        keyed(own).join(keyed(hits(reports, "event_reports")), "_k")
        .join(keyed(hits(corrections, "category_corrections")), "_k").drop("_k")
    )


def row_text(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def row_hash(columns: Sequence[str]) -> Column:
    """60 bits of a row's digest, to be added up."""
    return F.conv(F.substring(F.sha2(row_text(columns), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def digest(df: DataFrame) -> DataFrame:
    """Row count, bytes and an order-free digest of a table."""
    text, h = row_text(df.columns), row_hash(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"),
    )


def write_snapshot(tables: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Write every table and a manifest over what was written; returns the manifest.

    The digest is taken on the files, so a retried task cannot count twice.
    """
    manifest = None
    for name, df in tables.items():
        out = os.path.join(path, name)
        df.write.mode("overwrite").parquet(out)
        part = digest(df.sparkSession.read.parquet(out)).select(
            F.lit(name).alias("table"), "*", F.lit(df.schema.json()).alias("schema")
        )
        manifest = part if manifest is None else manifest.unionByName(part)
    manifest.coalesce(1).write.mode("overwrite").json(os.path.join(path, MANIFEST))
    return read_manifest(manifest.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    layout = "`table` string, row_count long, bytes long, digest string, schema string"
    return spark.read.schema(layout).json(os.path.join(path, MANIFEST))


FINDING = "`table` string, level string, finding string"


def verify_snapshot(spark: SparkSession, path: str, required: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Findings of a snapshot check: missing tables, counts, digests, columns, empty tables.

    Every table of the manifest is checked, and those of ``required`` for their columns too.
    """
    known = read_manifest(spark, path)
    listed = {r["table"]: [] for r in known.select("table").distinct().collect()}
    required = listed | dict(required or {})
    found = spark.createDataFrame([], FINDING)
    fixed: list[tuple[str, str, str]] = []
    for name, columns in required.items():
        try:
            df = spark.read.parquet(os.path.join(path, name))
        except AnalysisException as lost:
            if lost.getCondition() != "PATH_NOT_FOUND":
                raise
            fixed.append((name, "error", "missing table"))
            continue
        lost = sorted(set(columns) - set(df.columns))
        if lost:
            fixed.append((name, "error", "missing columns: " + ", ".join(lost)))
        m = known.where(F.col("table") == name).select(F.lit(name).alias("table"), F.col("row_count").alias("m_rows"), F.col("bytes").alias("m_bytes"), F.col("digest").alias("m_digest"))
        now = digest(df).select(F.lit(name).alias("table"), "row_count", "bytes", "digest")
        both = now.join(m, "table", "left")
        tests = F.array_compact(
            F.array(
                F.when(F.col("m_rows").isNull(), F.struct(F.lit("error").alias("level"), F.lit("not in manifest").alias("finding"))),
                F.when(F.col("m_rows") != F.col("row_count"), F.struct(F.lit("error").alias("level"), F.lit("row count differs").alias("finding"))),
                F.when(F.col("m_bytes") != F.col("bytes"), F.struct(F.lit("error").alias("level"), F.lit("byte count differs").alias("finding"))),
                F.when(F.col("m_digest") != F.col("digest"), F.struct(F.lit("error").alias("level"), F.lit("digest differs").alias("finding"))),
                F.when(F.col("row_count") == 0, F.struct(F.lit("warning").alias("level"), F.lit("empty table").alias("finding"))),
            )
        )
        found = found.unionByName(both.select("table", F.inline(tests)))
    return found.unionByName(spark.createDataFrame(fixed, FINDING)) if fixed else found
