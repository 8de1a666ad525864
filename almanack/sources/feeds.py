"""Landing of nested JSON feeds, RSS/Atom items and REST pages, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names and layouts of the landed formats.
HALL_EVENT = (
    "struct<id:long,eventName:string,eventStartDate:string,eventEndDate:string,"
    "displayDate:string,eventUrl:string,comment1:string,comment2:string>"
)
HALL_FEED = f"largeEventHallName string, eventHalls array<struct<eventHallName:string,events:array<{HALL_EVENT}>>>"
RSS_ITEM = "title string, link string, guid string, pubDate string, description string"
ATOM_ENTRY = "title string, id string, updated string, summary string, link struct<_href:string>"
API_EVENT = "struct<id:long,title:string,description:string,start_date:string,end_date:string,url:string>"
API_PAGE = f"total long, events array<{API_EVENT}>"
RFC822 = "d MMM yyyy HH:mm:ss"


def land_nested_json(spark: SparkSession, path: str, schema: str = HALL_FEED, multi_line: bool = False) -> DataFrame:
    """Halls to events: one row per event with its hall names; empty halls give none."""
    feed = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    halls = feed.select("largeEventHallName", F.explode("eventHalls").alias("hall"))
    return halls.select("largeEventHallName", "hall.eventHallName", F.explode("hall.events").alias("e")).select(
        "largeEventHallName", "eventHallName", "e.*"
    )


def land_feed(spark: SparkSession, path: str, tag: str = "item", schema: str = RSS_ITEM) -> DataFrame:
    """Feed items (``item`` of RSS, ``entry`` of Atom); files are split by item."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def land_api_pages(spark: SparkSession, path: str, schema: str = API_PAGE) -> DataFrame:
    """Saved REST pages, one row per event."""
    return spark.read.schema(schema).json(path).select(F.explode("events").alias("e")).select("e.*")


def feed_time(c: Column) -> Column:
    """Publish time of an RSS item (RFC 822) or Atom entry (ISO 8601) as UTC wall time; null when it does not parse."""
    iso = F.try_to_timestamp(F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}T"), F.trim(c))).cast("timestamp_ntz")
    text = F.regexp_extract(F.trim(c), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(RFC822)).cast("timestamp_ntz"), iso)
