"""Joins between listings, reports, people, sources and their registries."""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.base import has_text, instant
from almanack.functions.titles import bracketed, report_fragment
from almanack.functions.urls import host_or_raw
from almanack.session import durable

PROTECTED = ("researched", "recommended", "implemented", "not-viable")


def override(df: DataFrame, human: DataFrame, key: str = "id", column: str = "category") -> DataFrame:
    """Human labels win over machine labels; an empty human array is no override."""
    h = human.select(F.col(key), F.col(column).alias("_human")).where(F.size("_human") > 0)
    return df.join(h, key, "left").withColumn(column, F.coalesce("_human", column)).drop("_human")


# Partitions' worth of rows without a key are dealt over so many second keys.
KEYLESS = 1024


def left_by_key(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``side`` on ``key``; rows without one are dealt over all tasks.

    In a plain outer join all of them have the same key, null, and meet in one task.
    """
    told = ["id"] if "id" in rows.columns else [c for c, t in rows.dtypes if "map<" not in t]
    own = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*told), F.lit(KEYLESS))).otherwise(F.lit(-1))
    # of the side's key, not a literal: the optimizer would take a constant out of the join
    other = F.when(F.col(key).isNull(), F.lit(-2)).otherwise(F.lit(-1)).cast("long")
    return rows.withColumn("_dealt", own).join(side.withColumn("_dealt", other), [key, "_dealt"], "left").drop("_dealt")


def with_parent(rows: DataFrame, events: DataFrame, label: Column, parent: str = "parent_event_id") -> DataFrame:
    """Add ``parent_name``: the label of the parent row, null for top-level rows."""
    names = events.select(F.col("id").alias(parent), label.alias("parent_name"))
    return left_by_key(rows, names, parent).select(*rows.columns, "parent_name")


def children(df: DataFrame, parent_id=None, parent: str = "parent_event_id") -> DataFrame:
    """Active children of one parent (or of all parents), in start order."""
    out = df.where(F.col("is_active") & F.col(parent).isNotNull())
    if parent_id is not None:
        out = out.where(F.col(parent) == parent_id)
    return out.orderBy(F.asc_nulls_last("start_date"), "id")


def users_roles(users: DataFrame, roles: DataFrame, key: str = "user_id", default: str = "user") -> DataFrame:
    """All users with their role, newest account first."""
    return (
        users.join(roles, key, "left")
        .withColumn("role", F.coalesce("role", F.lit(default)))
        .orderBy(F.col("created_at").desc(), key)
    )


def reports_with_event(reports: DataFrame, events: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each report with its event embedded as a struct; null where the event is gone."""
    e = events.select(F.col("id").alias("_eid"), F.struct(*fields).alias("event"))
    return reports.join(e, reports["event_id"] == e["_eid"], "left").drop("_eid")


def saved_by(user, saves: DataFrame, events: DataFrame) -> DataFrame:
    """One user's saved events, newest save first."""
    mine = saves.where(F.col("user_id") == user).select("event_id", "saved_at")
    return (
        mine.join(events, mine["event_id"] == events["id"])
        .drop("event_id")
        .orderBy(F.col("saved_at").desc(), "id")
    )


def name_top(top: DataFrame, names: DataFrame, key: str = "event_id") -> DataFrame:
    """Attach names to an already limited ranking; Spark knows its size from the limit."""
    return names.join(top, names["id"] == top[key]).drop(key)


def source_counts(sources: DataFrame, events: DataFrame, name: str = "scraper_source_name") -> DataFrame:
    """Registry rows with the number of events of their source, zero when none."""
    n = events.groupBy(F.col("source_name").alias("_s")).agg(F.count(F.lit(1)).alias("n_events"))
    joined = sources.join(n, sources[name] == n["_s"], "left").drop("_s")
    return joined.withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def url_status(found: DataFrame, registry: DataFrame, url: str = "url", order: str = "id") -> DataFrame:
    """Status of each found URL by host name; of several registry rows the last one counts."""
    by_host = registry.groupBy(host_or_raw(F.col(url)).alias("_h")).agg(
        F.max_by("status", order).alias("current_status")
    )
    keyed = found.withColumn("_h", host_or_raw(F.col(url)))
    return keyed.join(by_host, "_h", "left").drop("_h")


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """First row per key; the group limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_registry(registry: DataFrame, found: DataFrame, ref) -> DataFrame:
    """Merge verified finds by URL. Rows past ``candidate`` only get ``last_seen_at``.

    ``first_seen_at`` is set once. Columns of ``found`` replace those of open rows.
    """
    f = first_by(found.where(F.col("url_verified")), ["url"], F.col("ord").desc()).drop("ord", "url_verified")
    fields = [c for c in f.columns if c != "url"]
    f = f.select("url", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = registry.join(f, "url", "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    guarded = F.coalesce(F.col("status").isin(*PROTECTED), F.lit(False))
    write = hit & ~guarded
    out = {c: F.when(write, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    out["status"] = F.when(write, F.lit("candidate")).otherwise(F.col("status"))
    out["last_seen_at"] = F.when(hit, instant(ref)).otherwise(F.col("last_seen_at"))
    out["first_seen_at"] = F.when(
        hit & F.col("status").isNull(), instant(ref)
    ).otherwise(F.col("first_seen_at"))
    return joined.withColumns(out).select(*registry.columns)


def only_new(found: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    return found.join(registry.select(url), url, "left_anti")


def archive_children(child: DataFrame, parents: DataFrame, reason: str, ref, key: str = "event_id") -> DataFrame:
    """Archive copies of the child rows of the given parents."""
    if not reason or not reason.strip():
        raise ValueError("an archive reason is required")
    ids = parents.select(F.col("id").alias("_pid"))
    return child.join(ids, child[key] == ids["_pid"], "left_semi").select(
        F.col(key).alias("source_event_id"),
        F.lit(reason).alias("archive_reason"),
        instant(ref).alias("archived_at"),
        F.col("id").alias("original_id"),
        *[c for c in child.columns if c != "id"],
    )


def purge_orphans(child: DataFrame, survivors: DataFrame, key: str = "event_id") -> DataFrame:
    """Children whose parent still exists."""
    ids = survivors.select(F.col("id").alias("_pid"))
    return child.join(ids, child[key] == ids["_pid"], "left_semi")


def orphans(child: DataFrame, survivors: DataFrame, key: str = "event_id") -> DataFrame:
    """The rows a cascade removes."""
    ids = survivors.select(F.col("id").alias("_pid"))
    return child.join(ids, child[key] == ids["_pid"], "left_anti")


def force_keys(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Upsert keys of the given ids."""
    return events.join(ids.select("id"), "id", "left_semi").select("source_name", "source_id")


def pick_ordered(events: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows in selection order (``pos``, ``id``); unknown ids drop out."""
    return picks.join(events, "id").orderBy("pos")


def creator_events(creators: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Link table joined to both ends."""
    return links.join(creators, "creator_id").join(events, "event_id")


def seed_union(seed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Seed rows win; stored rows are added only for unknown keys."""
    return seed.unionByName(stored.join(seed.select(key), key, "left_anti"))


def not_merged(df: DataFrame, merged: DataFrame, url: str = "source_url", urls: str = "secondary_source_urls") -> DataFrame:
    """Drop rows whose URL is already listed as a merged secondary somewhere."""
    seen = merged.select(F.explode(urls).alias(url)).where(F.col(url) != "").distinct()
    return df.join(seen, url, "left_anti")


# Text of a source's terms that one automaton holds, and of its names that one task streams past it.
TERM_BYTES = 2 << 20
NAME_BYTES = 16 << 20
# Up to so many sources (a short row each) are broadcast; beyond, Spark picks the join.
FEW_SOURCES = 100_000

HITS = "source_name string, term string, id {id}, is_report boolean"


def _pieces(term: str) -> list[str]:
    return [p for p in term.split("%") if p]


def _contains(name: str, pieces: list[re.Pattern]) -> bool:
    """Whether the pieces stand in ``name`` in turn, each found leftmost after the one before."""
    at = 0
    for p in pieces:
        found = p.search(name, at)
        if not found:
            return False
        at = found.end()
    return True


class TermIndex:
    """All terms that a name contains, in one pass over the name.

    In a term, % stands for any text and _ for any character. A term is looked up by its longest
    run without them; one that has wildcards is then tested in full, and one without such a run
    is tested on every name.
    """

    def __init__(self, terms: list[str]):
        self.tests, self.loose = {}, []
        runs: dict[str, list[int]] = {}
        for k, term in enumerate(terms):
            run = max(re.split("[%_]", term), key=len)
            if run != term:
                self.tests[k] = [re.compile("(?s)" + "".join("." if c == "_" else re.escape(c) for c in p)) for p in _pieces(term)]
            if run:
                runs.setdefault(run, []).append(k)
            else:
                self.loose.append(k)
        self.automaton = ahocorasick.Automaton()
        for run, ks in runs.items():
            self.automaton.add_word(run, ks)
        if runs:
            self.automaton.make_automaton()

    def found(self, name: str) -> set[int]:
        hit = {k for _, ks in self.automaton.iter(name) for k in ks} if len(self.automaton) else set()
        hit.update(self.loose)
        return {k for k in hit if k not in self.tests or _contains(name, self.tests[k])}


def _substring_hits(terms: DataFrame, events: DataFrame, first: int) -> DataFrame:
    """For each (source_name, term): the ``first`` smallest event ids whose name contains it.

    The terms of a source make one automaton for every ``TERM_BYTES`` of them, and its names, dealt
    into stretches of ``NAME_BYTES``, are streamed past each of these once. A task hands on a
    term's first ids only, so a term that stands in every name gives ``first`` rows per stretch.
    """
    names = events.where((F.col("name_ja") != "") & F.col("source_name").isNotNull()).select("source_name", "id", "is_report", F.lower("name_ja").alias("name"))
    known = terms.where("source_name IS NOT NULL")
    parts = lambda total, most: F.ceil(F.sum(F.octet_length(total)) / F.lit(most)).cast("int")
    cut = known.groupBy("source_name").agg(F.greatest(parts("term", TERM_BYTES), F.lit(1)).alias("shards"))
    long = names.groupBy("source_name").agg(parts("name", NAME_BYTES).alias("stretches"))
    sizes = durable(cut.join(long, "source_name"))
    if sizes.count() <= FEW_SOURCES:
        sizes = F.broadcast(sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    piece = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    left = known.join(sizes, "source_name").select("source_name", "term", piece("term", F.col("shards")).alias("shard"), every(F.col("stretches")).alias("stretch"))
    right = names.join(sizes, "source_name").select(*names.columns, piece("id", F.col("stretches")).alias("stretch"), every(F.col("shards")).alias("shard"))

    def look_up(held: pa.Table, streamed: pa.Table) -> pa.Table:
        texts = held.column("term").to_pylist()
        found: list[list[int]] = [[] for _ in texts]
        streamed = streamed.sort_by("id")
        if texts and streamed.num_rows:
            index = TermIndex(texts)
            for row, name in enumerate(streamed.column("name").to_pylist()):
                for k in index.found(name):
                    if len(found[k]) < first:
                        found[k].append(row)
        terms_at = pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64())
        names_at = pa.array([row for rows in found for row in rows], pa.int64())
        return pa.table({
            "source_name": streamed.column("source_name").take(names_at), "term": held.column("term").take(terms_at),
            "id": streamed.column("id").take(names_at), "is_report": streamed.column("is_report").take(names_at),
        })

    by = ["source_name", "shard", "stretch"]
    kind = dict(events.dtypes)["id"]
    own = lambda d: d.toDF(*d.columns).groupBy(*by)  # both sides may stem from one table
    hits = own(left).cogroup(own(right)).applyInArrow(look_up, HITS.format(id=kind))
    w = Window.partitionBy("source_name", "term").orderBy("id")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first)


def find_parent(reports: DataFrame, events: DataFrame, first: int = 10) -> DataFrame:
    """Parent event of each report: by its bracketed title, else by its stripped title.

    ``first`` hits by id are looked at, and the first that is no report itself is the parent.
    """
    ev = events.withColumn("is_report", F.coalesce(F.array_contains("category", "report"), F.lit(False)))
    bracket = bracketed(F.col("name_ja"))
    by_bracket = F.when(F.length(bracket) >= 3, F.lower(bracket))
    by_strip = F.lower(report_fragment(F.col("name_ja")))
    both = reports.select("id", "source_name", by_bracket.alias("t1"), by_strip.alias("t2"))
    long = both.select(
        "id", "source_name",
        F.posexplode(F.array("t1", "t2")).alias("strategy", "term"),
    ).where(F.col("term").isNotNull())
    long = durable(long)
    terms = durable(long.select("source_name", "term").distinct())
    parent = (
        _substring_hits(terms, ev, first)
        .where(~F.col("is_report"))
        .groupBy("source_name", "term")
        .agg(F.min("id").alias("parent_id"))
    )
    best = long.join(parent, ["source_name", "term"]).groupBy("id").agg(
        F.min_by("parent_id", "strategy").alias("parent_id")
    )
    return reports.select("id").join(best, "id", "left")


def named(df: DataFrame, c: str = "name") -> DataFrame:
    return df.where(has_text(c))
