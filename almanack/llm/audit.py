"""Filter interaction audit: what each quality filter removes under every order of the filters.

Five failure conditions make a mask of five bits per document. Four are read off the text in
the scan. The fifth, a text that a smaller id has too, needs the corpus:

1. A *counting Bloom sketch* of all texts: a text has ``PROBES`` cells in one block of ``CELLS``
   cells, tasks count their cells and Spark merges the counts by adding. The sketch is sized by
   the number of rows and stays a table of blocks, so no task and no driver holds it whole.
2. A text with a cell that was counted once is unique, beyond doubt. Its row is cleared.
3. Only possible repeats send their texts, grouped by the full text for its smallest id. A
   frequent text is reduced to one row in each task first.
4. Rows whose id is the smallest of their text pass; the other possible repeats fail.

Masks are then counted per part. Every figure of the report is a sum of mask counts: a filter
removes the documents that fail it and none of the filters before it.

Null texts are empty texts. Rows with a null id never fail for being a copy and make no other
row one; repeated ids with equal texts are no copies of each other. Label rows of one document
count together (quality 1 if any of them says so); null labels say nothing. An empty table has
no part and gives an empty report.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import settle

FILTERS = "ABCDE"
FEWEST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"

CELLS = 1024
PROBES = 4
CELLS_A_TEXT = 16
SALTS = 16
#: Up to so many ids (8 bytes each) of possible repeats are broadcast to the scan of the texts.
FEW_IDS = 2_000_000


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the failure conditions that a text alone decides: words, variety, capitals, symbols."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {
        "A": n < FEWEST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }
    total = F.lit(0)
    for name, condition in fails.items():
        total = total + F.when(condition, F.lit(_bit(name))).otherwise(F.lit(0))
    return total


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, h): all that later steps need of a document besides a repeat's text."""
    text = F.coalesce("text", F.lit(""))
    return settle(
        docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
        .withColumn("words", F.array_remove(F.split("text", SPACES), ""))
        .select("doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"), F.xxhash64("text").alias("h"))
    )


def _probes(h: Column, blocks: int) -> tuple[Column, Column]:
    """A text's block in the sketch and its cells inside it."""
    bits = F.xxhash64(h, F.lit(11))
    width = int(math.log2(CELLS))
    cells = [F.shiftrightunsigned(bits, i * width).bitwiseAND(CELLS - 1).cast("int") for i in range(PROBES)]
    return F.pmod(h, F.lit(blocks)), F.array_distinct(F.array(*cells))


def possible_repeats(rows: DataFrame, n: int) -> DataFrame:
    """Rows of (doc_id, h, ...) whose text the merged sketch can't tell to be unique.

    Rows meet only the cells counted more than once, block by block; a block that holds a frequent
    text has its rows dealt over ``SALTS`` copies of those few cells.
    """
    blocks = max(1, -(-n * CELLS_A_TEXT // CELLS))
    block, cells = _probes(F.col("h"), blocks)
    placed = rows.withColumns({"_block": block, "_cells": cells})
    sketch = placed.select("_block", F.explode("_cells").alias("cell")).groupBy("_block", "cell").agg(F.count(F.lit(1)).alias("counter"))
    shared = sketch.where("counter > 1").groupBy("_block").agg(F.collect_set("cell").alias("_shared"))
    copies = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = placed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, ["_block", "_salt"]).where(F.size(F.array_except("_cells", "_shared")) == 0).select(*rows.columns)


def copies_of_smaller(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, h) of the rows whose full text occurs under a smaller id, found as the module says."""
    known = rows.where("doc_id IS NOT NULL").select("doc_id", "h")
    maybe = settle(possible_repeats(known, rows.count()))
    ids = maybe.select("doc_id").distinct()
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    few = maybe.count() <= FEW_IDS
    meant = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    first = meant.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.xxhash64("text").alias("h"))
    return maybe.distinct().join(first.distinct(), ["doc_id", "h"], "left_anti")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, and how many of them are labelled so."""
    rows = _scanned(docs)
    copied = copies_of_smaller(docs, rows).withColumn("_copy", F.lit(True))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    named = rows.where("doc_id IS NOT NULL").join(said, "doc_id", "left").join(copied, ["doc_id", "h"], "left")
    mask = F.col("mask") + F.when(F.col("_copy"), F.lit(_bit("E"))).otherwise(F.lit(0))
    flagged = named.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = rows.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return flagged.unionByName(nameless).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the step's own)."""
    found = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            found.append(("".join(order), step, before, _bit(name)))
            before |= _bit(name)
    return found


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts that the module's text names.

    ``shapley``: among the s filters that a document fails, each comes first in one of s orders, so
    over all orders a filter removes it (number of orders) / s times.
    """
    counts = mask_counts(docs, labels)
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_masks"))  # 32 at most
    plan = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, ("filter_order", "step", "before", "own"))]) for s in _steps()])
    every = held.select("part", "_masks", F.explode(plan).alias("s")).select("part", "_masks", "s.*")

    def total(of: str, condition) -> Column:
        start = F.lit(0).cast("long")
        return F.aggregate("_masks", start, lambda acc, m: acc + F.when(condition(m["mask"]), m[of]).otherwise(F.lit(0)).cast("long"))

    hits = lambda bits: lambda m: m.bitwiseAND(F.col(bits)) != 0
    misses = lambda bits: lambda m: m.bitwiseAND(F.col(bits)) == 0
    both = lambda p, q: lambda m: p(m) & q(m)
    here = both(hits("own"), misses("before"))
    orders = math.factorial(len(FILTERS))
    share = lambda m: (F.lit(orders) / F.bit_count(m["mask"])).cast("long") * m["n"]
    shapley = F.aggregate("_masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(hits("own")(m["mask"]), share(m)).otherwise(F.lit(0)).cast("long"))
    passed = lambda m: misses("before")(m) & misses("own")(m)
    return every.select(
        "part", "filter_order", "step", total("n", passed).alias("kept"), total("n", here).alias("removed"),
        total("n", both(hits("own"), hits("before"))).alias("redundant"), total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), shapley.alias("shapley"),
    )
