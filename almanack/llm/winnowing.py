"""Document fingerprints by winnowing, in column expressions only.

A text is a sequence of tokens: each ideograph, kana, hangul or Thai character by itself, other
runs without white space as they are (over 32 characters in pieces). Every ``K`` tokens in a
row give a hash; of each ``WINDOW`` hashes in a row the smallest is kept, the rightmost among
equals, with its position. Two texts that share ``K + WINDOW - 1`` tokens in a row therefore
share a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import number_rows

K = 3
WINDOW = 8

_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}"
TOKEN = rf"[{_SINGLE}]|[^\s{_SINGLE}]{{1,32}}"
_PLACES = (1 << 30) - 1
NO_ID = -(1 << 63)


def with_marks(df: DataFrame, text: str, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with ``name``: the marks of ``text`` in order of position.

    A mark is a long: 33 bits of hash above 30 bits of ``2**30 - 1 - position``, so the smallest
    long of a window is its smallest hash and, among equals, the rightmost. A text of fewer than
    ``k`` tokens is one gram, one of fewer than ``window`` grams one window; no tokens, no marks;
    null gives null.
    """
    hashes, grams = f"_{name}_hashes", f"_{name}_grams"
    out = df.withColumn(hashes, F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    at = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.greatest(F.size(hashes) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def gram(i: Column) -> Column:
        mixed = F.xxhash64(*(F.get(F.col(hashes), i + j) for j in range(k)))
        return F.shiftleft(F.shiftrightunsigned(mixed, 31), 30).bitwiseOR((F.lit(_PLACES) - i).cast("long"))

    out = out.withColumn(grams, F.when(F.col(text).isNotNull(), F.transform(at, gram)))
    starts = F.sequence(F.lit(1), F.greatest(F.size(grams) - window + 1, F.lit(1)))
    lowest = F.transform(starts, lambda s: F.array_min(F.slice(F.col(grams), s, window)))
    kept = F.when(F.size(grams) > 0, F.array_distinct(lowest)).otherwise(F.col(grams))
    return out.withColumn(name, kept).drop(hashes, grams)


def mark_hashes(marks: Column) -> Column:
    """The distinct hashes of marks, as 32-bit numbers in a long."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftrightunsigned(m, 31)))


def mark_positions(marks: Column) -> Column:
    """For each mark the number of the token where its gram begins."""
    return F.transform(marks, lambda m: (F.lit(_PLACES) - m.bitwiseAND(_PLACES)).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two hash sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either).cast("double")


def fingerprint(hashes: Column) -> Column:
    """The hashes as one string, 8 hexadecimal digits each, in order of position."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id, hashes, positions`` of every row; a null text counts as empty."""
    text = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = with_marks(text, "text", "marks", k, window)
    hashes = F.transform("marks", lambda m: F.shiftrightunsigned(m, 31))
    return marked.select("doc_id", hashes.alias("hashes"), mark_positions(F.col("marks")).alias("positions"))


def edits(docs: DataFrame) -> DataFrame:
    """Every text, the same with its last third replaced, and how alike fingerprints are.

    The last floor(n / 3) code points give way to the first as many (or all) of the next document
    in descending ``doc_id``; the first follows the last. Null ids come last, equal ids in order
    of a hash of their texts; rows equal in id and text are one document, given once per row.

    Texts move twice: once to meet the number of characters that their taker needs, and a third
    of them to the taker.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    known = rows.select("doc", "tie", F.length("text").alias("n")).dropDuplicates(["doc", "tie"])
    numbered, n = number_rows(known, [F.desc("doc"), F.col("tie")], "row")
    giver = numbered.select(F.col("row").alias("_row"), "doc", "tie")
    taker = numbered.select(
        F.when(F.col("row") + 1 < n, F.col("row") + 1).otherwise(F.lit(0)).alias("_row"),
        F.col("doc").alias("to_doc"), F.col("tie").alias("to_tie"), F.call_function("div", F.col("n"), F.lit(3)).cast("int").alias("need"),
    )
    wanted = giver.join(taker, "_row").drop("_row")

    full = with_marks(rows, "text", "marks").select("doc", "tie", "text", mark_hashes(F.col("marks")).alias("hashes"))
    given = (
        full.join(wanted, ["doc", "tie"])
        .select(
            F.col("to_doc").alias("doc"), F.col("to_tie").alias("tie"),
            F.expr("substring(text, 1, need)").alias("piece"), F.col("hashes").alias("next_hashes"), "need",
        )
        .dropDuplicates(["doc", "tie"])
    )
    edited = (
        full.join(given, ["doc", "tie"])
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - need)"), "piece"))
        .select("doc", "n_chars", "edited", "hashes", "next_hashes")
    )
    marked = with_marks(edited, "edited", "edited_marks").withColumn("edited_hashes", mark_hashes(F.col("edited_marks")))
    return marked.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_chars", "edited", "hashes", "edited_hashes", "edited_marks",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
