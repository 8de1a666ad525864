"""Streams with state of their own per key: subscribers, silent sources, rolling popularity.

One small value per key is kept, whatever the number of rows, and event-time timers emit what
is due when the watermark passes. State lies in the store that such operators need and survives
a restart with the query's checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from almanack.functions.tags import LANGUAGE_COMMANDS, parse_command
from almanack.operators.upsert import upsert
from almanack.streaming.kept import KeptTable
from almanack.streaming.streams import run_versions

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; it is read when a query starts."""
    spark.conf.set(STORE, ROCKS)


def _ms(days: float) -> int:
    return int(days * 86_400_000)


def _stamp(ms: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)


# ---- subscribers ----------------------------------------------------------------------------

FIELDS = ("status", "language", "tags")
SUBSCRIBER_STATE = "follow_at long, follow_id long, last_at long, last_id long, " + ", ".join(
    f"{f} {'array<string>' if f == 'tags' else 'string'}, {f}_at long, {f}_id long" for f in FIELDS)
SUBSCRIBER_ROW = "user_id long, status string, language string, tags array<string>, updated_us long"


class SubscriberState(StatefulProcessor):
    """A user's newest status, language and tags, each with the place (time, id) of its event.

    A follow makes a user known from its place on; what was sent before counts for nothing. As
    each field keeps its newest event and the user its first follow, a field counts when the one is
    not before the other, in whatever order and batches the events arrive.
    """

    def init(self, handle) -> None:
        self.state = handle.getValueState("subscriber", SUBSCRIBER_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SUBSCRIBER_STATE.split(", ")]
        held = dict(zip(names, self.state.get() if self.state.exists() else [None] * len(names)))
        before = self.visible(held)
        for frame in rows:
            for r in frame.to_dict("records"):
                self.take(held, r)
        self.state.update(tuple(held[n] for n in names))
        after = self.visible(held)
        if after and after != before:
            yield pd.DataFrame([(key[0], *after)], columns=["user_id", *FIELDS, "updated_us"])

    @staticmethod
    def take(held: dict, r: dict) -> None:
        place = (int(r["at"]), int(r["id"]))
        at = lambda name: (held[f"{name}_at"], held[f"{name}_id"]) if held[f"{name}_at"] is not None else None
        put = lambda name: held.update({f"{name}_at": place[0], f"{name}_id": place[1]})
        if r["kind"] == "follow" and (at("follow") is None or place < at("follow")):
            put("follow")
        told = [f for f in FIELDS if not (r[f] is None or r[f] is pd.NA or isinstance(r[f], float))]
        for f in told:
            if at(f) is None or place >= at(f):
                held[f] = list(r[f]) if f == "tags" else r[f]
                put(f)
        if told and (at("last") is None or place > at("last")):
            put("last")

    @staticmethod
    def visible(held: dict) -> tuple | None:
        if held["follow_at"] is None:
            return None
        start = (held["follow_at"], held["follow_id"])
        live = [held[f] if held[f"{f}_at"] is not None and (held[f"{f}_at"], held[f"{f}_id"]) >= start else None for f in FIELDS]
        return (*live, held["last_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def subscriber_rows(stream: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Changed subscriber rows of a stream of user_id, kind, body, at, id."""
    body = F.coalesce("body", F.lit(""))
    cmd = parse_command(body, labels)
    post = F.regexp_extract(body, "^lang:(.+)$", 1)
    kind = F.col("kind")
    facts = stream.where("user_id IS NOT NULL").select(
        "user_id", "kind", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "id",
        F.when(kind == "follow", F.lit("active")).when(kind == "unfollow", F.lit("blocked")).alias("status"),
        F.when((kind == "postback") & post.isin(*sorted(set(LANGUAGE_COMMANDS.values()))), post)
        .when((kind == "message") & (cmd["kind"] == "lang"), cmd["lang"]).alias("language"),
        F.when((kind == "message") & (cmd["kind"] == "category"), cmd["tags"]).alias("tags"),
    )
    told = facts.where("status IS NOT NULL OR language IS NOT NULL OR tags IS NOT NULL")
    return told.groupBy("user_id").transformWithStateInPandas(SubscriberState(), SUBSCRIBER_ROW, "Update", "None")


def stream_subscriber_state(stream: DataFrame, table: KeptTable, labels: Mapping[str, str], state: str, first: int = 0) -> int:
    """Keep ``table`` (layout ``SUBSCRIBERS``) at the users' newest rows; returns its newest version."""
    with_store(stream.sparkSession)
    at = F.timestamp_micros("updated_us").cast("timestamp_ntz").alias("updated_at")

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert(old, batch.select("user_id", *FIELDS, at), ["user_id"])

    return run_versions(subscriber_rows(stream, labels), table, merge, state, first, mode="update")


# ---- silent sources -------------------------------------------------------------------------


def stream_silent(src: DataFrame, hours: float = 24, memory: float = 7, step: float = 1, delay: str = "1 hour", exempt: Sequence[str] = ()) -> DataFrame:
    """Sources missing at each check time, one every ``step`` days: the stream form of the missing list of run health.

    A check time ends a window of ``memory`` days (one ``step`` at least); a source is missing if its newest
    run there is older than ``hours``. State is one time per source and open window, whatever the number
    of runs, and rows are combined before the shuffle.
    """
    runs = src.where(F.col("source").isNotNull() & F.col("ran_at").isNotNull() & ~F.col("source").isin(*exempt))
    with_store(src.sparkSession)
    slide = _ms(step)
    span = max(_ms(memory), slide)
    ends = F.window("ran_at", f"{span} milliseconds", f"{slide} milliseconds", f"{-span % slide} milliseconds")  # at whole steps
    newest = runs.withWatermark("ran_at", delay).groupBy(ends.alias("w"), "source").agg(F.max(F.date_trunc("millisecond", "ran_at")).alias("last_run"))
    age = F.unix_millis(F.col("w.end")) - F.unix_millis("last_run")
    return newest.where((age > _ms(hours / 24)) & (age <= _ms(memory))).select(F.col("w.end").alias("checked_at"), "source", "last_run")


# ---- rolling popularity ---------------------------------------------------------------------

ROLLING = "start timestamp, end timestamp, event_id long, view_count long"


class RollingCount(StatefulProcessor):
    """Counts over the last ``panes`` panes of ``step`` days, renewed at the end of every pane.

    A row is counted once, in its pane. The count of a window is that of the one before, plus the
    pane that came in, less the one that went out.
    """

    def __init__(self, panes: int, step: float):
        self.panes, self.step = panes, _ms(step)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("panes", "next long, total long, places array<long>, counts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, total, places, counts = self.state.get() if self.state.exists() else (None, 0, [], [])
        held = dict(zip(places, counts))
        for frame in rows:
            for pane, n in (frame["ms"] // self.step).value_counts().items():
                held[int(pane)] = held.get(int(pane), 0) + int(n)
        if due is None or not any(True for _ in self.handle.listTimers()):
            due, total = min(held) + 1, 0  # the end of the first pane, numbered by the pane that starts there
            self.handle.registerTimer(due * self.step)
        self.keep(due, total, held)
        return iter(())

    def keep(self, due: int, total: int, held: dict[int, int]) -> None:
        panes = sorted(p for p in held if p >= due - 1 - self.panes)
        self.state.update((due, total, panes, [held[p] for p in panes]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, total, places, counts = self.state.get()
        held, found = dict(zip(places, counts)), []
        watermark = timerValues.getCurrentWatermarkInMs()
        while due * self.step <= watermark:
            total += held.get(due - 1, 0) - held.get(due - 1 - self.panes, 0)
            if total:
                found.append((_stamp((due - self.panes) * self.step), _stamp(due * self.step), key[0], total))
            elif not any(p >= due for p in held):
                break  # nothing left to count; the next row starts anew
            due += 1
        else:
            self.handle.registerTimer(due * self.step)
        self.keep(due, total, held)
        if found:
            yield pd.DataFrame(found, columns=["start", "end", "event_id", "view_count"])

    def close(self) -> None:
        pass


def stream_rolling(src: DataFrame, panes: int = 30, step: float = 1, delay: str = "1 day") -> DataFrame:
    """Views per event over ``panes`` panes of ``step`` days: as ``stream_popularity``, each row counted once."""
    with_store(src.sparkSession)
    marked = src.where("event_id IS NOT NULL AND viewed_at IS NOT NULL").withWatermark("viewed_at", delay)
    rows = marked.select(F.col("event_id").cast("long").alias("event_id"), "viewed_at", F.unix_millis("viewed_at").alias("ms"))
    return rows.groupBy("event_id").transformWithStateInPandas(RollingCount(panes, step), ROLLING, "Append", "EventTime")
