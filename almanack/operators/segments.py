"""Merged text as a child table of segments: which texts a primary takes, without folding them.

A primary takes its secondaries' texts in order, each unless what it has taken so far contains it.
Containment is transitive, so a text is out as soon as *any* earlier text of the primary contains
it, taken or not; no text waits for another's turn. Who contains whom is found by automata
over a stretch of each text, cut by bytes, with all texts of the primary streamed past; a hit
is then compared in full.

Blocks have a heading between them. The few texts that could match a part of a heading, or
across one, are decided last, in turn, against the rendered text of their primary.
"""

from __future__ import annotations

import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.operators.numbering import running_sum
from almanack.session import durable

# The block that a merged description adds.
APPENDED = "\n\n---\n別来源補足 ({})\n{}"
BEFORE, BETWEEN, AFTER = APPENDED.split("{}")

#: Characters of a text that stand for it in an automaton, and text that one of them holds or a task streams past it.
STRETCH = 192
NEEDLE_BYTES = 2 << 20
TEXT_BYTES = 16 << 20


def block(label: Column, text: Column) -> Column:
    return F.concat(F.lit(BEFORE), label, F.lit(BETWEEN), text, F.lit(AFTER))


def may_cross(text: Column, labels: Column) -> Column:
    """Whether a text could be found in a heading with one of ``labels``, or across one: on one side of it, or with the whole of it."""
    ends = [BEFORE[:k] for k in range(1, len(BEFORE) + 1)]
    crosses_start = F.lit(False)
    for e in ends:
        crosses_start = crosses_start | text.endswith(e)
    first = F.substring_index(text, "\n", 1)
    closes = text.contains("\n") & ((first == "") | first.endswith(BETWEEN[:-1]) | first.isin("-", "--", "---"))
    inside = F.exists(labels, lambda x: F.concat(F.lit(BEFORE), x, F.lit(BETWEEN)).contains(text))
    return crosses_start | closes | text.contains(BEFORE) | inside


def _stretch(text: str) -> tuple[int, str]:
    """A part of a text, at a place that the text itself decides, so texts with one opening differ in it."""
    if len(text) <= STRETCH:
        return 0, text
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(text) - STRETCH + 1)
    return at, text[at : at + STRETCH]


def _first_holders(needles: pa.Table, texts: pa.Table) -> pa.Table:
    """(id, seq, holder): the first text of the stretch that contains the needle."""
    texts = texts.sort_by("seq")
    words, seqs = needles.column("text").to_pylist(), needles.column("seq").to_pylist()
    parts: dict[str, list[tuple[int, int]]] = {}
    for k, w in enumerate(words):
        at, part = _stretch(w)
        parts.setdefault(part, []).append((k, at))
    automaton = ahocorasick.Automaton()
    for part, held in parts.items():
        automaton.add_word(part, (len(part), held))
    found: dict[int, int] = {}
    if parts:
        automaton.make_automaton()
        for seq, text in zip(texts.column("seq").to_pylist(), texts.column("text").to_pylist()):
            for end, (width, held) in automaton.iter(text):
                for k, at in held:
                    if k not in found and seq < seqs[k] and text.startswith(words[k], max(end + 1 - width - at, 0)) and end + 1 - width >= at:
                        found[k] = seq
    rows = pa.array(list(found), pa.int64())
    return pa.table({"id": needles.column("id").take(rows), "seq": needles.column("seq").take(rows), "holder": pa.array(list(found.values()), pa.int64())})


def contained(texts: DataFrame) -> DataFrame:
    """(id, seq) of texts (id, seq, text) that an earlier text of the same id contains."""
    cut = lambda size, most: F.greatest(F.ceil(F.sum(size) / F.lit(most)).cast("int"), F.lit(1))
    width = F.octet_length("text")
    sizes = durable(texts.groupBy("id").agg(
        cut(F.least(width, F.lit(4 * STRETCH)), NEEDLE_BYTES).alias("shards"), cut(width, TEXT_BYTES).alias("stretches")))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    piece = lambda n, salt: F.pmod(F.xxhash64("seq", F.lit(salt)), n).cast("int")
    whole = texts.join(sizes, "id")
    needles = whole.where("seq > 0 AND text <> ''").select("id", "seq", "text", piece(F.col("shards"), 1).alias("shard"), every(F.col("stretches")).alias("stretch"))
    streamed = whole.select("id", "seq", "text", piece(F.col("stretches"), 2).alias("stretch"), every(F.col("shards")).alias("shard"))
    by = ["id", "shard", "stretch"]
    own = lambda d: d.toDF(*d.columns).groupBy(*by)
    kind = dict(texts.dtypes)["id"]
    found = own(needles).cogroup(own(streamed)).applyInArrow(_first_holders, f"id {kind}, seq long, holder long")
    return found.select("id", "seq").distinct()


def _in_turn(rows: pa.Table) -> pa.Table:
    """Of one primary: the texts that stay when those that may cross a heading are tested in turn."""
    rows = rows.sort_by("seq")
    grown, kept = "", []
    for k, (seq, label, text, odd) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("seq", "label", "text", "odd")))):
        if seq == 0:
            grown = text
        elif not odd or text not in grown:
            grown += f"{BEFORE}{label}{BETWEEN}{text}{AFTER}"
            kept.append(k)
    return rows.select(["id", "seq", "label", "text"]).take(pa.array(kept, pa.int64()))


def segments(base: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, seq, label, text): the blocks that each primary takes, in order of ``seq``.

    ``base`` has a primary's own (id, text), ``texts`` its secondaries' distinct (id, ord, label,
    text), none of them empty. Only primaries with a text that may cross a heading are looked at as
    a whole, which is no more than their row.
    """
    numbered = running_sum(texts.withColumn("_one", F.lit(1)), ["id"], ["ord", "text"], "_one", "seq").select("id", F.col("seq").cast("long").alias("seq"), "label", "text")
    first = base.join(texts.select("id").distinct(), "id", "left_semi").select("id", F.lit(0).cast("long").alias("seq"), F.lit("").alias("label"), "text")
    every = durable(first.unionByName(numbered))
    labels = texts.groupBy("id").agg(F.collect_set("label").alias("_labels"))  # sources of a primary
    stay = every.join(contained(every.drop("label")), ["id", "seq"], "left_anti").join(labels, "id")
    left = durable(stay.withColumn("odd", (F.col("seq") > 0) & may_cross(F.col("text"), F.col("_labels"))).drop("_labels"))
    asked = left.where("odd").select("id").distinct()
    kind = dict(every.dtypes)["id"]
    turn = left.join(asked, "id", "left_semi").groupBy("id").applyInArrow(_in_turn, f"id {kind}, seq long, label string, text string")
    return left.join(asked, "id", "left_anti").where("seq > 0").select("id", "seq", "label", "text").unionByName(turn)


def render(base: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, text): base and blocks joined, for those primaries that took any."""
    blocks = taken.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", block(F.col("label"), F.col("text")).alias("b")))).alias("_b"))
    return base.join(blocks, "id").select("id", F.concat("text", F.array_join(F.transform("_b", lambda x: x["b"]), "")).alias("text"))
