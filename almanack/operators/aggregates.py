"""Counts, shares, histograms and run reports: one aggregation each, combined map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.base import blank, has_text, instant, percent_half_up
from almanack.operators.joins import first_by



def count_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def since(c: str, ref, days: int) -> Column:
    return F.col(c) >= instant(ref) - F.make_dt_interval(F.lit(days))


def view_counts(views: DataFrame, key: str = "event_id") -> DataFrame:
    return views.groupBy(key).agg(count_rows("view_count"))


def top_viewed(views: DataFrame, ref, days: int = 30, n: int = 10, key: str = "event_id") -> DataFrame:
    """The n most viewed items with their share of the top one; the window spans n rows at most."""
    recent = views.where(since("viewed_at", ref, days))
    top = view_counts(recent, key).orderBy(F.col("view_count").desc(), key).limit(n)
    best = F.max("view_count").over(Window.partitionBy())
    return top.withColumn("share", percent_half_up(F.col("view_count"), best))


def category_counts(df: DataFrame, column: str = "category") -> DataFrame:
    return df.select(F.explode(column).alias("tag")).groupBy("tag").agg(count_rows())


def category_share(df: DataFrame, column: str = "category") -> DataFrame:
    """Tag counts with their share of all tags; the total spans one row per vocabulary entry."""
    counts = category_counts(df, column)
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", percent_half_up(F.col("n"), total))


def monthly_hist(df: DataFrame, ref, months: int = 12, c: str = "start_date") -> DataFrame:
    """Rows per calendar month over the last ``months``, zero-filled from a month spine."""
    last = F.trunc(instant(ref), "month")
    first = F.add_months(last, -(months - 1))
    spine = df.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("_m")
    )
    counts = (
        df.where(F.col(c) >= first.cast("timestamp_ntz"))
        .groupBy(F.trunc(c, "month").alias("_m"))
        .agg(count_rows())
    )
    return spine.join(counts, "_m", "left").select(
        F.date_format("_m", "yyyy-MM").alias("month"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def share_of_max(hist: DataFrame, n: str = "n") -> DataFrame:
    """Bar length in percent of the longest bar; a histogram has one row per month."""
    top = F.greatest(F.max(n).over(Window.partitionBy()), F.lit(1))
    return hist.withColumn("pct", percent_half_up(F.col(n), top))


def active_by_source(df: DataFrame) -> DataFrame:
    return df.where("is_active").groupBy("source_name").agg(count_rows())


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.col("ran_at").desc(), F.col("id").desc()).limit(n)


def _run_sums(when: Column | None = None) -> list[Column]:
    pick = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    zero = lambda c, t: F.coalesce(F.sum(pick(F.col(c))), F.lit(0)).cast(t)
    return [
        F.count(pick(F.lit(1))).alias("runs"),
        zero("events_processed", "long").alias("events"),
        zero("tokens_in", "long").alias("tokens_in"),
        zero("tokens_out", "long").alias("tokens_out"),
        zero("cost_usd", "decimal(18,6)").cast("double").alias("cost"),
    ]


def run_totals(runs: DataFrame, n: int = 100) -> DataFrame:
    """Totals over the last n runs."""
    return latest_runs(runs, n).agg(*_run_sums())


def month_totals(runs: DataFrame, ref, n: int = 100) -> DataFrame:
    """Month-to-date totals within the last n runs."""
    month = F.trunc(instant(ref), "month").cast("timestamp_ntz")
    return latest_runs(runs, n).agg(*_run_sums(F.col("ran_at") >= month))


def cost_trend(runs: DataFrame, ref, n: int = 100) -> DataFrame:
    """Cost of the last 30 days and average cost per 30 days, over the last n runs."""
    month_us = 30.0 * 86_400_000_000
    agg = latest_runs(runs, n).agg(
        F.coalesce(F.sum(F.when(since("ran_at", ref, 30), F.col("cost_usd"))), F.lit(0)).cast("double").alias("last30_cost"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("_all"),
        F.min("ran_at").alias("_first"),
    )
    elapsed = F.unix_micros(instant(ref).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    months = F.greatest(F.lit(1.0), F.coalesce(elapsed / F.lit(month_us), F.lit(1.0)))
    return agg.select("last30_cost", (F.col("_all") / months).alias("avg_monthly_cost"))


def health_counters(df: DataFrame, ref) -> DataFrame:
    """Active, pending, new this week (from Monday) and new this month, in one pass."""
    week = F.date_trunc("week", instant(ref).cast("timestamp")).cast("timestamp_ntz")
    month = F.trunc(instant(ref), "month").cast("timestamp_ntz")
    return df.where("is_active").agg(
        count_rows("active"),
        F.count_if(F.col("annotation_status") == "pending").alias("pending"),
        F.count_if(F.col("created_at") >= week).alias("new_week"),
        F.count_if(F.col("created_at") >= month).alias("new_month"),
    )


def admin_counters(df: DataFrame) -> DataFrame:
    pending = F.col("annotation_status") == "pending"
    return df.agg(
        count_rows("total"),
        F.count_if("is_active").alias("active"),
        F.count_if(pending & F.col("is_active")).alias("pending_active"),
        F.count_if(pending & ~F.col("is_active")).alias("pending_inactive"),
    )


def localisation_issues(df: DataFrame, fields: Sequence[str], languages: Sequence[str] = ("zh", "en")) -> DataFrame:
    """Active pending rows whose original text lacks a translation, per field; zeros dropped."""
    todo = df.where(F.col("is_active") & (F.col("annotation_status") == "pending"))
    lacks = lambda f: has_text(f) & F.greatest(*[blank(f"{f}_{x}").cast("int") for x in languages]).cast("boolean")
    wide = todo.agg(*[F.count_if(lacks(f)).alias(f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])
    return wide.select(F.inline(pairs)).where("n > 0")


def pending_count(df: DataFrame, c: str = "status") -> DataFrame:
    return df.where(F.col(c) == "pending").agg(count_rows("pending"))


def succeeded(c: str = "success") -> Column:
    """A run that logged no outcome counts as a success."""
    return F.coalesce(F.col(c), F.lit(True))


def weekly_by_source(runs: DataFrame, from_) -> DataFrame:
    """Per source: runs, success rate, events, average, cost. Rates round half to even."""
    agg = runs.where(F.col("ran_at") >= instant(from_)).groupBy("source").agg(
        count_rows("runs"),
        F.count_if(succeeded()).alias("_ok"),
        F.sum("events_processed").alias("total_events"),
        F.sum("cost_usd").cast("double").alias("total_cost_usd"),
    )
    return agg.select(
        "source",
        "runs",
        F.bround(F.col("_ok") / F.col("runs"), 2).alias("success_rate"),
        "total_events",
        F.bround(F.col("total_events") / F.col("runs"), 1).alias("avg_events"),
        "total_cost_usd",
    )


def weekly_totals(runs: DataFrame, events: DataFrame, from_) -> DataFrame:
    """One row: new active events, pending events, cost and number of runs."""
    r = runs.where(F.col("ran_at") >= instant(from_)).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("total_cost_usd"),
        count_rows("total_runs"),
    )
    e = events.where("is_active").agg(
        F.count_if(F.col("created_at") >= instant(from_)).alias("new_events"),
        F.count_if(F.col("annotation_status") == "pending").alias("pending_annotation"),
    )
    return r.select(F.lit(0).alias("_k"), "*").join(e.select(F.lit(0).alias("_k"), "*"), "_k").drop("_k")


def latest_per_source(runs: DataFrame, n: int = 200) -> DataFrame:
    return first_by(latest_runs(runs, n), ["source"], F.col("ran_at").desc(), F.col("id").desc())


def run_anomalies(runs: DataFrame, ref, n: int = 200, floor: float = 2.0, share: float = 0.5) -> DataFrame:
    """Sources whose latest run found nothing, or far less than their weekly average."""
    avg = runs.where(since("ran_at", ref, 7)).groupBy("source").agg(
        F.avg("events_processed").alias("avg_7d")
    )
    latest = latest_per_source(runs, n).select("source", F.col("events_processed").alias("latest"))
    joined = latest.join(avg, "source", "left").withColumn("avg_7d", F.coalesce("avg_7d", F.lit(0.0)))
    low = (F.col("avg_7d") >= floor) & (F.col("latest") < F.col("avg_7d") * share)
    return joined.withColumn(
        "reason", F.when(F.col("latest") == 0, F.lit("zero")).when(low, F.lit("drop"))
    ).where(F.col("reason").isNotNull())


def run_outcomes(runs: DataFrame, ref, hours: int = 24, days: int = 7) -> DataFrame:
    """Per source seen in ``days``: ran, failed and zero flags of the last ``hours``."""
    day = F.col("ran_at") >= instant(ref) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return runs.where(since("ran_at", ref, days)).groupBy("source").agg(
        F.max(day).alias("ran"),
        F.max(day & ~succeeded()).alias("failed"),
        F.max(day & succeeded() & (F.coalesce("events_processed", F.lit(0)) == 0)).alias("zero"),
    )


def run_health(runs: DataFrame, ref, exempt: Sequence[str] = (), hours: int = 24) -> DataFrame:
    """Issue rows (failed, zero, missing); exempt sources are never reported as missing."""
    o = run_outcomes(runs, ref, hours)
    issues = F.array_compact(
        F.array(
            F.when(F.col("failed"), F.lit("failed")),
            F.when(F.col("zero"), F.lit("zero")),
            F.when(~F.col("ran") & ~F.col("source").isin(*exempt), F.lit("missing")),
        )
    )
    return o.select("source", F.explode(issues).alias("issue"))


def run_health_counts(runs: DataFrame, ref) -> DataFrame:
    """Sources that ran and the healthy rest; one that both failed and was empty counts off twice."""
    o = run_outcomes(runs, ref)
    return o.agg(
        F.count_if("ran").alias("ran"),
        (F.count_if("ran") - F.count_if("failed") - F.count_if("zero")).alias("ok"),
    )


def latest_run_summary(runs: DataFrame, minutes: int = 2) -> DataFrame:
    """Events per source of the runs around the newest one; its time is a scalar subquery."""
    newest = runs.agg(F.max("ran_at")).scalar()
    from_ = newest - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return (
        runs.where(F.col("ran_at") >= from_)
        .groupBy("source")
        .agg(F.sum("events_processed").alias("events"))
    )


def common_tags(df: DataFrame, column: str = "category", key: str = "id") -> DataFrame:
    """Tags every row has, in the order of the first row."""
    n = df.agg(count_rows()).scalar()
    tags = df.select(key, F.posexplode(F.array_distinct(column)).alias("pos", "tag"))
    return (
        tags.groupBy("tag")
        .agg(count_rows("_n"), F.min_by("pos", key).alias("pos"))
        .where(F.col("_n") == n)
        .select("tag", "pos")
    )


def by_language(subs: DataFrame, languages: Sequence[str], c: str = "lang") -> DataFrame:
    """Subscriber counts per known language; others are dropped."""
    return subs.where(F.col(c).isin(*languages)).groupBy(c).agg(count_rows())


def usage_cost(runs: DataFrame, per_m_in: str = "0.15", per_m_out: str = "0.60", keys: Sequence[str] = ()) -> DataFrame:
    """Token cost at prices per million tokens, in exact decimals, six places."""
    price = lambda p: F.lit(p).cast("decimal(10,4)")
    tokens = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(20,0)")
    cost = (tokens("tokens_in") * price(per_m_in) + tokens("tokens_out") * price(per_m_out)) / F.lit(1_000_000).cast("decimal(8,0)")
    return runs.groupBy(*keys).agg(
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.bround(cost, 6).cast("double").alias("cost_usd"),
    )


def merged_keywords(results: DataFrame, n: int = 8) -> DataFrame:
    """First-seen order of distinct keywords over all results, the first n."""
    words = results.select("ord", F.posexplode("keywords").alias("pos", "keyword"))
    return (
        words.groupBy("keyword")
        .agg(F.min(F.struct("ord", "pos")).alias("first"))
        .orderBy("first")
        .limit(n)
        .select("keyword", "first.ord", "first.pos")
    )


def merged_news(results: DataFrame, n: int = 5) -> DataFrame:
    """The first n news lines in result order."""
    lines = results.select("ord", F.posexplode("news").alias("pos", "line"))
    return lines.orderBy("ord", "pos").limit(n)


def merge_reports(results: DataFrame) -> DataFrame:
    """Counts of results run and failed."""
    return results.agg(count_rows("agents_run"), F.count_if(F.col("error")).alias("agents_failed"))


def class_counts(classified: DataFrame, c: str = "class") -> DataFrame:
    return classified.groupBy(c).agg(count_rows())


def distinct_sources(df: DataFrame, c: str = "source_name") -> DataFrame:
    return df.select(c).distinct().orderBy(c)


def run_span(df: DataFrame, keys: Sequence[str], c: str = "start_date") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(c).alias("first_date"), F.max(c).alias("last_date"))
