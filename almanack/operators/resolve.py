"""Cross-source entity resolution: similar names, primary choice, news matching, audit.

Rows with the same block and the same normalised name form one *class*. Everything up to the
similarity test works on classes, so copies cost one comparison however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions.alike import alike
from almanack.functions.base import let
from almanack.functions.places import venue_tokens
from almanack.functions.similarity import both_ratios, length_steps, letter_masks, norm_name
from almanack.operators.numbering import running_sum
from almanack.operators.segments import block, render, segments
from almanack.session import durable

# Source ranks (lower wins), the rank of all others, and the news sources.
SOURCE_RANK = {
    "taiwan_cultural_center": 1,
    "taiwan_kyokai": 2,
    "taioan_dokyokai": 3,
    "koryu": 4,
    "taiwan_festival_tokyo": 5,
    "taiwan_matsuri": 6,
    "taiwanbunkasai": 7,
    "peatix": 8,
    "connpass": 9,
    "doorkeeper": 10,
    "iwafu": 11,
    "arukikata": 12,
    "ide_jetro": 13,
}
OTHER_RANK = 99
NEWS_SOURCES = ("google_news_rss", "prtimes", "nhk_rss")
SIMILAR = 0.85
AUDIT_SIMILAR = 0.80
LOOKBACK_DAYS = 90

# Names of one block and length step beyond this number, or these letters, are dealt into several
# tiles, and every two tiles are compared. Any size gives the same pairs.
TILE_NAMES = 8192
TILE_LETTERS = 1 << 22

# Tasks per core among which pairs of tiles, and pairs of names, are dealt.
TASKS = 8


def source_rank(c: Column, ranks: dict[str, int] | None = None, other: int = OTHER_RANK) -> Column:
    ranks = SOURCE_RANK if ranks is None else ranks
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.element_at(table, c), F.lit(other)).cast("int")


def mergeable(df: DataFrame) -> DataFrame:
    """Active, named, dated rows that are no sub-rows."""
    return df.where(
        F.col("is_active")
        & F.col("start_date").isNotNull()
        & F.col("name_ja").isNotNull()
        & ~F.coalesce(F.col("source_id").contains("_sub"), F.lit(False))
    )


def name_classes(df: DataFrame, block: Column, name: str = "name_ja") -> DataFrame:
    """Distinct (block, normalised name) with a short key; made durable, as it is read often.

    The distinct rows are spread evenly, since the work per name in Python is the costly part.
    """
    classes = df.select(block.alias("block"), norm_name(F.col(name)).alias("norm")).distinct()
    return durable(classes.withColumn("cid", F.sha2("norm", 256)).withColumn("len", F.length("norm")).hint("rebalance"))


def _tiles(numbered: DataFrame, threshold: float, days: int) -> DataFrame:
    """Names dealt into tiles of one block and length step, a copy for each pair of tiles that may hold similar names.

    Similar lengths lie in one step or in two that follow one another. Columns of a pair: the key
    of its block ``_k``, the longer step ``step``, whether the other tile is of the step ``below``, and
    the tiles' numbers ``i`` and ``j``; ``side`` tells the tile of a name (0: ``i``).
    """
    starts, _ = length_steps(threshold)
    named = numbered.where("len > 0 AND block IS NOT NULL").withColumn("step", F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("len"))) - 1)
    if days:
        # a pair meets in the bucket of its later day; of an earlier bucket, names meet this bucket's only
        bucket = F.floor(F.unix_date("block") / F.lit(days + 1))
        named = named.withColumn("day", F.unix_date("block")).withColumn("_b", F.explode(F.array(F.struct(bucket.alias("k"), F.lit(False).alias("old")), F.struct((bucket + 1).alias("k"), F.lit(True).alias("old")))))
        named = named.select("n", "norm", "len", "step", "day", F.col("_b.k").alias("_k"), F.col("_b.old").alias("old"))
    else:
        named = named.select("n", "norm", "len", "step", F.lit(0).alias("day"), F.col("block").alias("_k"), F.lit(False).alias("old"))
    sizes = durable(named.groupBy("_k", "step").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_NAMES), F.ceil(F.sum("len") / TILE_LETTERS)).cast("int").alias("tiles")))
    near = lambda d, name: sizes.select("_k", (F.col("step") + d).alias("step"), F.col("tiles").alias(name))
    counted = named.join(sizes, ["_k", "step"]).join(near(1, "below"), ["_k", "step"], "left").join(near(-1, "above"), ["_k", "step"], "left")
    tile = F.pmod(F.xxhash64("n"), F.col("tiles")).cast("int")
    numbers = lambda c: F.filter(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(0))), lambda x: x < F.coalesce(F.col(c), F.lit(0)))
    pair = lambda step, below, i, j, side: F.struct(step.alias("step"), F.lit(below).alias("below"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    t, step = F.col("tile"), F.col("step")
    copies = F.concat(
        F.transform(numbers("tiles"), lambda x: pair(step, False, F.least(t, x), F.greatest(t, x), t > x)),
        F.transform(numbers("above"), lambda x: pair(step + 1, True, t, x, F.lit(0))),
        F.transform(numbers("below"), lambda x: pair(step, True, x, t, F.lit(1))),
    )
    return counted.withColumn("tile", tile).select("_k", "n", "norm", "day", "old", F.explode(copies).alias("_p")).select("_k", "n", "norm", "day", "old", "_p.*")


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is long for its bytes, which would be joined by size otherwise."""
    return max(TASKS * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _compared(numbered: DataFrame, threshold: float, days: int) -> DataFrame:
    """(n_a, n_b): candidates.

    A pair of tiles is compared where it lies; what leaves the task is pairs alone, so no
    shared gram is shuffled.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("side")
        names, n, day, old = (group.column(c).to_numpy() if c != "norm" else group.column(c).to_pylist() for c in ("norm", "n", "day", "old"))
        split = int((group.column("side").to_numpy() == 0).sum())
        _, below, i, j = (x.as_py() for x in key[1:])
        out = [np.empty((2, 0), np.int64)]
        if split and (split < len(names) or (i == j and not below)):
            for x, y in alike(names, split, threshold, lambda x, y: ~(old[x] & old[y]) & (np.abs(day[x] - day[y]) <= days)):
                turn = (day[x] > day[y]) | ((day[x] == day[y]) & (n[x] > n[y]))
                out.append(n[[np.where(turn, y, x), np.where(turn, x, y)]])
        first, second = np.concatenate(out, axis=1)
        return pa.table([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["n_a", "n_b"])

    pair = ["_k", "step", "below", "i", "j"]
    return _tiles(numbered, threshold, days).repartition(_tasks(numbered), *pair).groupBy(*pair).applyInArrow(run, "n_a long, n_b long")


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    """(n_a, n_b, sim_ab, sim_ba) of the similar ones among ``pairs`` of names, dealt out singly: a tile may hold very many."""

    def run(batches):
        masks = lru_cache(maxsize=1_000)(letter_masks)
        for batch in batches:
            both = [both_ratios(p, q, threshold, masks) for p, q in zip(batch.column("norm_a").to_pylist(), batch.column("norm_b").to_pylist())]
            kept = [k for k, s in enumerate(both) if max(s) >= threshold]
            columns = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("n_a", "n_b")] + [pa.array([both[k][s] for k in kept], pa.float64()) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["n_a", "n_b", "sim_ab", "sim_ba"])

    return pairs.select("n_a", "n_b", "norm_a", "norm_b").repartition(_tasks(pairs), "n_a", "n_b").mapInArrow(run, "n_a long, n_b long, sim_ab double, sim_ba double")


def candidates(classes: DataFrame, threshold: float, days: int = 0) -> DataFrame:
    """(n_a, n_b): classes that share as many grams or letters, where they may stand, as similar names must."""
    return _compared(classes, threshold, days)


def near_classes(classes: DataFrame, threshold: float = SIMILAR, days: int = 0) -> DataFrame:
    """Pairs of distinct classes whose names reach ``threshold`` in at least one direction.

    With ``days`` = 0 blocks must be equal; otherwise the block is a date and may differ by up
    to ``days``: names are compared in their own and in the next bucket of ``days + 1`` days, so
    each pair meets in the bucket of its later day.
    """
    numbered = classes.withColumn("n", F.monotonically_increasing_id())  # fixed: classes are durable
    names = lambda s: numbered.select(*[F.col(c).alias(f"{c}_{s}") for c in ("n", "block", "cid", "norm")])
    named = lambda pairs: pairs.join(names("a"), "n_a").join(names("b"), "n_b")
    near = named(durable(_scored(named(_compared(numbered, threshold, days)), threshold)))
    return near.select(*[f"{c}_{s}" for s in "ab" for c in ("block", "cid", "norm")], "sim_ab", "sim_ba")


def similar_pairs(df: DataFrame, block: Column, name: str = "name_ja", source: str = "source_name", threshold: float = SIMILAR) -> DataFrame:
    """Similar names inside a block that occur in different sources, one row per name pair.

    Equal names are one row with both sides alike. ``n_a`` and ``n_b`` count the rows behind a
    name; the row pairs themselves are never listed.
    """
    classes = name_classes(df, block, name)
    per = df.select(block.alias("block"), norm_name(F.col(name)).alias("norm"), F.col(source).alias("_s")).groupBy("block", "norm").agg(
        F.count(F.lit(1)).alias("n"), F.min("_s").alias("lo"), F.max("_s").alias("hi")
    )
    side = lambda s: per.select(F.col("block"), F.col("norm").alias(f"norm_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "lo", "hi")])
    near = near_classes(classes, threshold).select(F.col("block_a").alias("block"), "norm_a", "norm_b", "sim_ab", "sim_ba")
    one_source = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))
    cross = near.join(side("a"), ["block", "norm_a"]).join(side("b"), ["block", "norm_b"]).where(~one_source)
    same = per.where("lo <> hi").select(
        "block", F.col("norm").alias("norm_a"), F.col("norm").alias("norm_b"),
        F.lit(1.0).alias("sim_ab"), F.lit(1.0).alias("sim_ba"), F.col("n").alias("n_a"), F.col("n").alias("n_b"),
    )
    return cross.select(*same.columns).unionByName(same)


def _members(df: DataFrame, block: Column, order: Sequence[str], ranks) -> DataFrame:
    return df.select(
        "id",
        block.alias("block"),
        F.sha2(norm_name(F.col("name_ja")), 256).alias("cid"),
        F.col("source_name").alias("src"),
        source_rank(F.col("source_name"), ranks).alias("rank"),
        F.struct(*order, "id").alias("ord"),
    )


def _directed(classes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(block, first class, second class, similarity) with the first name as first argument."""
    near = near_classes(classes, threshold)
    ab = near.select(F.col("block_a").alias("block"), F.col("cid_a").alias("cx"), F.col("cid_b").alias("cy"), F.col("sim_ab").alias("sim"))
    ba = near.select(F.col("block_a").alias("block"), F.col("cid_b").alias("cx"), F.col("cid_a").alias("cy"), F.col("sim_ba").alias("sim"))
    own = (
        members.groupBy("block", "cid").agg(F.min("src").alias("lo"), F.max("src").alias("hi")).where("lo <> hi")
        .select("block", F.col("cid").alias("cx"), F.col("cid").alias("cy"), F.lit(1.0).alias("sim"))
    )
    return durable(ab.unionByName(ba).where(F.col("sim") >= threshold).unionByName(own))


def _meet(directed: DataFrame, first: DataFrame, second: DataFrame, cond: Column) -> DataFrame:
    """Join earlier rows to later rows of similar classes in other sources."""
    x = first.select("block", F.col("cid").alias("cx"), *[F.col(c).alias(f"{c}_x") for c in first.columns if c not in ("block", "cid")])
    y = second.select("block", F.col("cid").alias("cy"), *[F.col(c).alias(f"{c}_y") for c in second.columns if c not in ("block", "cid")])
    return (
        directed.join(x, ["block", "cx"]).join(y, ["block", "cy"])
        .where((F.col("ord_x") < F.col("ord_y")) & (F.col("src_x") != F.col("src_y")) & cond)
    )


def _settle(edges: DataFrame) -> DataFrame:
    """Ids that stay active: a row is out as soon as an active earlier row reaches it.

    Each round decides every row whose earlier neighbours are all decided. Only open rows and
    the edges that lead to them are carried on; a round decides at least the first open row of
    each day, so the rounds end by themselves.
    """
    open_edges = edges
    waiting = edges.select(F.col("y").alias("n")).distinct()
    active = durable(edges.select(F.col("x").alias("n")).distinct().join(waiting, "n", "left_anti"))
    done = [active]
    while not active.isEmpty():
        hit = durable(open_edges.join(active.select(F.col("n").alias("x")), "x", "left_semi").select(F.col("y").alias("n")).distinct())
        gone_x, gone_y = hit.select(F.col("n").alias("x")), hit.select(F.col("n").alias("y"))
        just = active.select(F.col("n").alias("x"))
        # rows that were hit are out: what leads to them, and from them, is settled
        open_edges = durable(open_edges.join(gone_y, "y", "left_anti").join(just, "x", "left_anti"))
        free = open_edges.join(gone_x, "x", "left_anti")
        heads = open_edges.select(F.col("y").alias("n")).unionByName(free.select(F.col("x").alias("n"))).distinct()
        active = durable(heads.join(free.select(F.col("y").alias("n")).distinct(), "n", "left_anti"))
        open_edges = free
        done.append(active)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct()


@dataclass
class Decisions:
    """Merge decisions in the size of the table, whatever the number of pairs.

    ``absorbed`` has a row per absorbed row: id, by_id, by_ord, sim. ``links`` has a row per two
    groups of rows, each of one class and source, between which the earlier, worse-ranked row
    loses: every pair of them with ``ord`` (of the earlier) below ``until`` (of the later) is a
    decision. ``members`` are the rows with their group, their order and their ``until``: their
    own order or that of the row that absorbed them.
    """

    members: DataFrame
    absorbed: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """All decisions (primary_id, secondary_id, sim), listed: quadratic for copies in two sources."""
        forward = self.absorbed.select(F.col("by_id").alias("primary_id"), F.col("id").alias("secondary_id"), "sim")
        x = self.members.where("own_turn").select("block", F.col("cid").alias("cx"), F.col("src").alias("src_x"), F.col("id").alias("secondary_id"), "ord")
        y = self.members.select("block", F.col("cid").alias("cy"), F.col("src").alias("src_y"), F.col("id").alias("primary_id"), "until")
        met = self.links.join(x, ["block", "cx", "src_x"]).join(y, ["block", "cy", "src_y"]).where("ord < until")
        return forward.unionByName(met.select("primary_id", "secondary_id", "sim"))

    def rows(self) -> DataFrame:
        """(id, absorbed_by, secondaries, lost) of every row, without listing pairs.

        How many rows of a linked group come before a row's ``until`` is a running count over the
        rows of both groups in order; it is taken over ranges of that order, not per group.
        """
        key = ["block", "cy", "src_y"]
        y = self.members.select("block", F.col("cid").alias("cy"), F.col("src").alias("src_y"), F.col("until").alias("at"), "id", F.lit(0).alias("n"))
        x = self.members.where("own_turn").select("block", F.col("cid").alias("cx"), F.col("src").alias("src_x"), "ord", "id")
        losers = self.links.join(x, ["block", "cx", "src_x"])
        before = losers.select(*key, F.col("ord").alias("at"), F.lit(None).cast(dict(y.dtypes)["id"]).alias("id"), F.lit(1).alias("n"))
        reached = y.join(self.links.select(*key).distinct(), key, "left_semi")
        # of equal places, the row that asks stands first: only earlier ones count
        counted = running_sum(reached.unionByName(before), key, ["at", "n", "id"], "n", "secondaries").where("id IS NOT NULL").select("id", "secondaries")
        taken = self.absorbed.groupBy(F.col("by_id").alias("id")).agg(F.count(F.lit(1)).alias("_taken"))
        lost = losers.where("ord < last_until").select("id").unionByName(self.absorbed.select("id")).distinct().withColumn("lost", F.lit(True))
        return (
            self.members.select("id").join(self.absorbed.select("id", F.col("by_id").alias("absorbed_by")), "id", "left")
            .join(counted, "id", "left").join(taken, "id", "left").join(lost, "id", "left")
            .select("id", "absorbed_by", (F.coalesce("secondaries", F.lit(0)) + F.coalesce("_taken", F.lit(0))).alias("secondaries"), F.coalesce("lost", F.lit(False)).alias("lost"))
        )


def decide(
    df: DataFrame,
    block: Column,
    order: Sequence[str] = ("start_date",),
    ranks: dict[str, int] | None = None,
    threshold: float = SIMILAR,
) -> Decisions:
    """Merge decisions as a sequential scan in order makes them, kept by groups of rows.

    The scan visits rows by (start, id); a row already absorbed is skipped, otherwise it meets
    every later similar row of another source, and the lower rank (the earlier row on a tie)
    becomes primary. A row that loses keeps meeting later rows until its own turn ends.

    So a row is absorbed by the first earlier row of no worse rank that is still standing. That
    is a fixed point over "reaches" edges, which :func:`_settle` finds in rounds. Of one class
    and source only the first row can be the absorber, so edges start at those rows only.
    """
    members = durable(_members(df, block, order, ranks))
    classes = name_classes(df, block)
    directed = _directed(classes, members, threshold)
    heads = durable(
        members.groupBy("block", "cid", "src").agg(F.min_by("id", "ord").alias("id"), F.first("rank").alias("rank"), F.min("ord").alias("ord"))
    )
    no_worse = F.col("rank_x") <= F.col("rank_y")
    edges = durable(_meet(directed, heads, heads, no_worse).select(F.col("id_x").alias("x"), F.col("id_y").alias("y")).distinct())
    active = _settle(edges)
    linked = edges.select(F.col("y").alias("n")).distinct()
    free = heads.join(linked, heads["id"] == linked["n"], "left_anti")
    standing = free.unionByName(heads.join(active, heads["id"] == active["n"], "left_semi"))
    reached = _meet(directed, standing, members, no_worse)
    absorbed = durable(
        reached.groupBy(F.col("id_y").alias("id")).agg(
            F.min("ord_x").alias("by_ord"), F.min_by("id_x", "ord_x").alias("by_id"), F.min_by("sim", "ord_x").alias("sim")
        )
    )
    placed = durable(
        members.join(absorbed.select("id", "by_ord"), "id", "left")
        .withColumn("own_turn", F.col("by_ord").isNull()).withColumn("until", F.coalesce("by_ord", "ord")).drop("by_ord")
    )
    groups = placed.groupBy("block", "cid", "src", "rank").agg(F.min(F.when(F.col("own_turn"), F.col("ord"))).alias("first"), F.max("until").alias("last"))
    side = lambda s, bound: groups.select("block", F.col("cid").alias(f"c{s}"), F.col("src").alias(f"src_{s}"), F.col("rank").alias(f"rank_{s}"), bound)
    links = (
        directed.join(side("x", F.col("first").alias("first_ord")), ["block", "cx"]).join(side("y", F.col("last").alias("last_until")), ["block", "cy"])
        .where("rank_x > rank_y AND first_ord < last_until")
    )
    return Decisions(placed, absorbed, durable(links.select("block", "cx", "src_x", "cy", "src_y", "sim", "first_ord", "last_until")))


def assign_primary(
    df: DataFrame,
    block: Column,
    order: Sequence[str] = ("start_date",),
    ranks: dict[str, int] | None = None,
    threshold: float = SIMILAR,
) -> DataFrame:
    """The decisions of :func:`decide` as pairs (primary_id, secondary_id, sim)."""
    return decide(df, block, order, ranks, threshold).pairs()


# Levels of the day grid used by the interval join: blocks of 1, 2, 4, ... 256 days. Longer
# periods take several of the largest blocks.
DAY_LEVELS = 8


def _covering(lo: Column, hi: Column) -> Column:
    """Aligned day blocks that tile [lo, hi] exactly, at most two per level."""

    def level(k: Column) -> Column:
        size = F.pow(F.lit(2), k)
        a = F.ceil(lo / size).cast("long")
        b = F.floor((hi + 1) / size).cast("long")
        top = k == F.lit(DAY_LEVELS)
        node = lambda i: F.named_struct(F.lit("lv"), k, F.lit("ix"), i)
        spread = F.when(top & (a < b), F.transform(F.sequence(a, b - 1), node))
        ends = F.array_compact(
            F.array(
                F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), node(a)),
                F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), node(b - 1)),
            )
        )
        return F.coalesce(spread, F.when(top, F.slice(ends, 1, 0)).otherwise(F.array_distinct(ends)))

    levels = F.sequence(F.lit(0), F.lit(DAY_LEVELS))
    tiled = F.flatten(F.transform(levels, level))
    return F.when(lo <= hi, tiled).otherwise(F.slice(tiled, 1, 0))


def match_news(
    news: DataFrame,
    official: DataFrame,
    lookback: int = LOOKBACK_DAYS,
    ranks: dict[str, int] | None = None,
) -> DataFrame:
    """Best official row per news row: published from ``lookback`` days before the start to the
    end, with a shared venue token, lowest rank, then earliest.

    Each official period is tiled by aligned day blocks and only the best row per (token, block)
    is kept, so the join is an equi-join whose official side is already reduced: a token that
    occurs everywhere costs one row per block, not one per pair.
    """
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    end = F.coalesce("end_date", "start_date")
    blocks = (
        official.where(F.col("start_date").isNotNull())
        .select(
            F.struct(source_rank(F.col("source_name"), ranks).alias("rank"), F.col("start_date").alias("start"), F.col("id").alias("id")).alias("best"),
            venue_tokens(F.col("location_name")).alias("_toks"),
            let(F.struct((day("start_date") - lookback).alias("lo"), day(end).alias("hi")), lambda p: _covering(p["lo"], p["hi"])).alias("_b"),
        )
        .select("best", "_toks", F.explode("_b").alias("_b"))
        .select("best", "_b", F.explode("_toks").alias("tok"))
        .groupBy("tok", "_b.lv", "_b.ix")
        .agg(F.min("best").alias("best"))
    )
    level = F.explode(F.sequence(F.lit(0), F.lit(DAY_LEVELS)))
    probes = (
        news.where(F.col("start_date").isNotNull())
        .select(F.col("id").alias("news_id"), day("start_date").alias("_d"), F.explode(venue_tokens(F.col("location_name"))).alias("tok"))
        .select("news_id", "tok", "_d", level.alias("lv"))
        .withColumn("ix", F.floor(F.col("_d") / F.pow(F.lit(2), F.col("lv"))).cast("long"))
        .drop("_d")
    )
    best = probes.join(blocks, ["tok", "lv", "ix"]).groupBy("news_id").agg(F.min("best").alias("best"))
    return best.select("news_id", F.col("best.id").alias("official_id"), F.col("best.rank").alias("rank"))


def audit_pairs(df: DataFrame, days: int = 3, threshold: float = AUDIT_SIMILAR, k: int = 50) -> DataFrame:
    """The k most similar cross-source row pairs at most ``days`` apart; ties by ids.

    Rows whose URL is already merged are left out first. A pair is (earlier row, later row) by
    start and id. A row is a *starter* towards a class if a later row of another source exists
    there, which the two latest sources of the class tell. Every starter has a pair, so only the
    k first starters by similarity and id, with all that tie with the last of them, can be in the
    result; only they meet rows. One small read of the k-th starter happens here.
    """
    merged = df.select(F.explode("secondary_source_urls").alias("source_url")).where("source_url <> ''").distinct()
    open_rows = df.join(merged, "source_url", "left_anti")
    rows = durable(open_rows.select(
        "id", F.to_date("start_date").alias("block"), F.struct("start_date", "id").alias("ord"),
        F.sha2(norm_name(F.col("name_ja")), 256).alias("cid"), F.col("source_name").alias("src"),
    ))
    near = durable(near_classes(name_classes(open_rows, F.to_date("start_date")), threshold, days).select("block_a", "cid_a", "block_b", "cid_b", "sim_ab", "sim_ba"))
    way = lambda x, y, sim: [F.col(f"block_{x}").alias("bx"), F.col(f"cid_{x}").alias("cx"), F.col(f"block_{y}").alias("by"), F.col(f"cid_{y}").alias("cy"), F.col(sim).alias("sim")]
    latest = rows.groupBy("block", "cid", "src").agg(F.max("ord").alias("last"))
    nth = F.row_number().over(Window.partitionBy("block", "cid").orderBy(F.desc("last")))
    tops = latest.withColumn("_n", nth).where("_n <= 2").groupBy("block", "cid").agg(
        F.max(F.when(F.col("_n") == 1, F.struct("last", "src"))).alias("one"), F.max(F.when(F.col("_n") == 2, F.col("last"))).alias("two"))
    own = tops.where("two IS NOT NULL").select(F.col("block").alias("bx"), F.col("cid").alias("cx"), F.col("block").alias("by"), F.col("cid").alias("cy"), F.lit(1.0).alias("sim"))
    directed = (
        near.select(*way("a", "b", "sim_ab"))
        .unionByName(near.where("block_a = block_b").select(*way("b", "a", "sim_ba")))
        .where(F.col("sim") >= threshold).unionByName(own)
    )
    x = rows.select(F.col("block").alias("bx"), F.col("cid").alias("cx"), F.col("id").alias("id_a"), F.col("ord").alias("ox"), F.col("src").alias("sx"))
    y = rows.select(F.col("block").alias("by"), F.col("cid").alias("cy"), F.col("id").alias("id_b"), F.col("ord").alias("oy"), F.col("src").alias("sy"))
    ends = tops.select(F.col("block").alias("by"), F.col("cid").alias("cy"), "one", "two")
    until = F.when(F.col("one.src") != F.col("sx"), F.col("one.last")).otherwise(F.col("two"))
    starters = directed.join(x, ["bx", "cx"]).join(ends, ["by", "cy"]).where(F.col("ox") < until).drop("one", "two")
    best = [F.col("sim").desc(), F.col("id_a")]
    first = starters.select("sim", "id_a").orderBy(*best).limit(k).collect()
    if len(first) == k and k:
        sim, last = first[-1]
        starters = starters.where((F.col("sim") > sim) | ((F.col("sim") == sim) & (F.col("id_a") <= last)))
    met = starters.join(y, ["by", "cy"]).where((F.col("ox") < F.col("oy")) & (F.col("sx") != F.col("sy")))
    return met.select("sim", "id_a", "id_b").orderBy(*best, "id_b").limit(k)


def append_desc(primary: Column, secondary: Column, label: Column) -> Column:
    """Primary text plus a labelled block, unless the secondary is empty or already contained."""
    grown = F.concat(primary, block(label, secondary))
    return F.when((secondary != "") & ~primary.contains(secondary), grown).otherwise(primary)


# A primary with more different texts, or more text in bytes, than this is merged by segments.
MANY_TEXTS = 64
MUCH_TEXT = 1 << 20


def apply_merge(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Write merge decisions into the table: URLs, official URL, text, status, activity.

    All secondaries of a primary are applied in order. Only a first merge adds text and
    re-queues the row, so a second run changes nothing but inactive flags already set.

    Secondaries are reduced before they meet their primary: to the first of each URL and of each
    text (a later equal text would be contained already), combined before the shuffle. What a
    primary's row gathers is its own value, a list of distinct URLs and of the texts it takes; of a
    primary with many or long texts, :func:`~almanack.operators.segments.segments` finds these.
    """
    tidy = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    urls = F.coalesce("secondary_source_urls", F.array().cast("array<string>"))
    s = events.select(
        F.col("id").alias("secondary_id"), F.struct("start_date", "id").alias("ord"), F.col("source_url").alias("url"),
        F.nullif("official_url", F.lit("")).alias("official"), tidy("raw_description").alias("text"), F.col("source_name").alias("label"),
    )
    secs = pairs.select(F.col("primary_id").alias("id"), "secondary_id").join(s, "secondary_id").drop("secondary_id")
    had = events.select("id", urls.alias("_had")).join(pairs.select(F.col("primary_id").alias("id")).distinct(), "id", "left_semi")
    known = had.select("id", F.explode("_had").alias("url")).distinct().withColumn("_old", F.lit(True))
    marked = secs.join(known, ["id", "url"], "left").withColumn("fresh", F.col("_old").isNull()).drop("_old")
    whole = marked.groupBy("id").agg(
        F.min_by("official", F.when(F.col("official").isNotNull(), F.col("ord"))).alias("_official"), F.max("fresh").alias("_fresh"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", *c))), lambda x: x.dropFields("ord"))
    lists = marked.groupBy("id", "url").agg(F.min("ord").alias("ord")).groupBy("id").agg(in_order(["url"]).alias("_urls"))
    distinct = durable(marked.where("fresh AND text <> ''").groupBy("id", "text").agg(F.min("ord").alias("ord"), F.min_by("label", "ord").alias("label")))
    large = durable(distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).where((F.col("n") > MANY_TEXTS) | (F.col("size") > MUCH_TEXT)).select("id"))
    texts = distinct.join(large, "id", "left_anti").groupBy("id").agg(in_order(["text", "label"]).alias("_texts"))
    lost = pairs.select(F.col("secondary_id").alias("id")).distinct().withColumn("_lost", F.lit(True))
    base = tidy("raw_description")
    text = F.aggregate(F.coalesce("_texts", F.array().cast("array<struct<text:string,label:string>>")), base, lambda acc, x: append_desc(acc, x["text"], x["label"]))
    primary = F.col("_urls").isNotNull()
    if not large.isEmpty():
        mine = events.select("id", base.alias("text"))
        whole = whole.join(render(mine, segments(mine, distinct.join(large, "id", "left_semi"))).withColumnRenamed("text", "_rendered"), "id", "left")
        text = F.coalesce("_rendered", text)
    return (
        events.join(whole, "id", "left").join(lists, "id", "left").join(texts, "id", "left").join(lost, "id", "left")
        .withColumns(
            {
                "secondary_source_urls": F.when(primary, F.array_distinct(F.concat(urls, F.transform("_urls", lambda x: x["url"])))).otherwise(F.col("secondary_source_urls")),
                "official_url": F.when(primary, F.coalesce(F.nullif("official_url", F.lit("")), F.col("_official"), F.col("official_url"))).otherwise(F.col("official_url")),
                "raw_description": F.when(primary & (text != base), text).otherwise(F.col("raw_description")),
                "annotation_status": F.when(primary & F.col("_fresh"), F.lit("pending")).otherwise(F.col("annotation_status")),
                "is_active": F.col("is_active") & F.col("_lost").isNull(),
            }
        )
        .select(*events.columns)
    )
