"""Weekly messages: one text per language over a handful of picked events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.base import instant
from almanack.functions.dates import short_day
from almanack.functions.localized import broadcast_title
from almanack.functions.text import report_head, report_line
from almanack.operators.aggregates import weekly_by_source, weekly_totals

LANGUAGES = ("zh", "ja", "en")


def _lines(section: str, locale: Column, languages: Sequence[str], base_url: str) -> Column:
    title = F.coalesce(*[F.when(locale == x, broadcast_title(x)) for x in languages])
    start, end = short_day(F.col("start_date")), short_day(F.col("end_date"))
    if section == "week":
        head = F.concat(F.lit("• "), title, F.lit("　"), F.coalesce(start, F.lit("")))
    else:
        span = F.when(end.isNotNull() & (end != start), F.concat(start, F.lit("–"), end)).otherwise(F.coalesce(start, F.lit("")))
        head = F.concat(F.lit("• "), title, F.lit("（"), span, F.lit("）"))
    return F.concat(head, F.lit(f"\n  {base_url}/r/"), F.col("id").cast("string"))


def broadcast(
    weekly: DataFrame,
    monthly: DataFrame,
    ref,
    base_url: str,
    headings: Mapping[str, tuple[str, str, str]],
    footers: Mapping[str, str],
    languages: Sequence[str] = LANGUAGES,
) -> DataFrame:
    """(lang, message). ``weekly`` and ``monthly`` are limited picks with a ``pos``.

    ``headings`` gives title, week heading and month heading per language. Each language
    gathers only the picked rows, so a message is built from a fixed number of lines.
    """
    per_lang = lambda df: df.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in languages])))
    part = lambda df, s, n: per_lang(df).select(
        "lang", F.struct(F.lit(n).alias("sec"), F.col("pos").alias("pos"), _lines(s, F.col("lang"), languages, base_url).alias("line")).alias("l")
    )
    rows = part(weekly, "week", 0).unionByName(part(monthly, "month", 1))
    grouped = rows.groupBy("lang").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    text = lambda n: F.array_join(F.transform(F.filter("ls", lambda x: x["sec"] == n), lambda x: x["line"]), "\n")
    pick = lambda i: F.coalesce(*[F.when(F.col("lang") == x, F.lit(headings[x][i])) for x in languages])
    foot = F.coalesce(*[F.when(F.col("lang") == x, F.lit(footers[x])) for x in languages])
    days = F.concat(short_day(instant(ref)), F.lit(" ～ "), short_day(instant(ref) + F.expr("interval 6 days")))
    month = F.when(text(1) != "", F.concat(F.lit("\n\n"), pick(2), F.lit("\n"), text(1))).otherwise(F.lit(""))
    return grouped.select(
        "lang", F.concat(pick(0), F.lit("\n"), days, F.lit("\n\n"), pick(1), F.lit("\n"), text(0), month, F.lit("\n\n"), foot).alias("message")
    )


def weekly_report(runs: DataFrame, events: DataFrame, since, title: str) -> DataFrame:
    """The weekly message as one row: totals, then a line per source in order.

    ``since`` is UTC and shown as the day in Japan. The lines are as many as there are sources.
    """
    lines = weekly_by_source(runs, since).select(
        "source", report_line(F.col("source"), F.col("total_events"), F.col("runs"), F.col("success_rate")).alias("line")
    )
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "line"))), lambda x: x["line"]), "\n").alias("body"))
    day = F.date_format(instant(since) + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd")
    totals = weekly_totals(runs, events, since)
    head = report_head(day, F.col("new_events"), F.col("pending_annotation"), F.col("total_cost_usd"), F.col("total_runs"))
    one = totals.select(F.lit(0).alias("_k"), head.alias("head")).join(body.select(F.lit(0).alias("_k"), "body"), "_k")
    return one.select(F.concat_ws("\n", F.lit(title), "head", F.nullif("body", F.lit(""))).alias("message"))
