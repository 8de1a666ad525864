import itertools
import re

import pytest
from pyspark.sql import functions as F

from almanack.llm import audit

from .conftest import ROWS

MORE = [
    (20, "A|B " * 60, None), (21, "A|B " * 60, ""), (22, "LOUD WORDS " * 70, "de"), (23, "calm words only here", "de"), (24, "calm words only here", "de"),
    (25, " ".join(f"w{i}" for i in range(120)), "fr"), (26, " ".join(f"w{i}" for i in range(120)), "fr"), (27, " ".join(f"W{i % 99}" for i in range(125)), "fr"),
    (28, "Ä É Ü", "fr"), (28, "Ä É Ü", "fr"), (28, None, "fr"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (7, 1, 1), (20, None, 1), (21, 1, None), (24, 1, 1), (26, 1, 0), (None, 1, 1), (999, 1, 1), (28, 1, 1)]


def plain(rows, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    flagged = []
    for i, text, lang in rows:
        text = text or ""
        w = word.findall(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        mine = [l for l in labels if l[0] == i and i is not None]
        flagged.append((lang or "", {k for k, v in fails.items() if v}, any(l[1] == 1 for l in mine), any(l[2] == 1 for l in mine)))
    out = {}
    for part in {p for p, *_ in flagged}:
        own = [x for x in flagged if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in own if f in x[1] and not before & x[1]]
                out[part, "".join(order), step] = [
                    sum(not (before | {f}) & x[1] for x in own), len(here), sum(f in x[1] and bool(before & x[1]) for x in own),
                    sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here),
                ]
    for (part, order, step), row in list(out.items()):
        f = order[step - 1]
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == f))
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en" if k % 3 else "ja") for k, (i, t) in enumerate(ROWS)] + MORE


def frames(spark, rows):
    docs = spark.createDataFrame([(*r, "src", 0, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, mask int, part int, quality int")
    labels = spark.createDataFrame([(*l, "x", "y") for l in LABELS], "doc_id long, quality int, toxic int, text string, part string")
    return docs.repartition(3), labels


def figures(df):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[c] for c in cols] for r in df.collect()}


@pytest.mark.parametrize("few", [audit.FEW_IDS, 0])
def test_equals_plain_counting(spark, rows, monkeypatch, few):
    monkeypatch.setattr(audit, "FEW_IDS", few)
    assert figures(audit.interactions(*frames(spark, rows))) == plain(rows, LABELS)


def test_sketch_clears_only_unique_texts(spark):
    n = 3000
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.xxhash64(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.col("id") - 1).otherwise(F.col("id"))).alias("h"))
    maybe = {r.doc_id for r in audit.possible_repeats(texts, n).collect()}
    count = {}
    for r in texts.collect():
        count.setdefault(r.h, []).append(r.doc_id)
    repeats = {i for ids in count.values() if len(ids) > 1 for i in ids}
    assert repeats <= maybe
    assert len(maybe - repeats) < 0.02 * n


def test_equal_hashes_of_differing_texts(spark, monkeypatch):
    """The sketch may take any texts for one; only full texts decide."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    rows = [(1, "a", "en"), (2, "b", "en"), (3, "a", "en"), (4, "c", "en")]
    found = figures(audit.interactions(*frames(spark, rows)))
    assert found["en", "EABCD", 1][:2] == [3, 1]


def test_empty_tables(spark, rows):
    docs, labels = frames(spark, rows)
    assert audit.interactions(docs.limit(0), labels).count() == 0
    without = figures(audit.interactions(docs, labels.limit(0)))
    assert all(r[4] == r[5] == 0 for r in without.values()) and len(without) == 600 * 5
