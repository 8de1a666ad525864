"""Merged text by segments against folding the texts in turn."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanack.operators import resolve as r
from almanack.operators import segments as sg


def fold(base, texts):
    grown = base
    for label, text in texts:
        if text not in grown:
            grown += sg.APPENDED.replace("{}", label, 1).replace("{}", text, 1)
    return grown


def distinct(texts):
    seen = set()
    return [(l, t) for l, t in texts if t and not (t in seen or seen.add(t))]


def merged(spark, primaries):
    base = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(primaries)], "id long, text string")
    rows = [(i, k, l, t) for i, (_, ts) in enumerate(primaries) for k, (l, t) in enumerate(ts)]
    texts = spark.createDataFrame(rows, "id long, ord long, label string, text string")
    found = {x.id: x.text for x in sg.render(base, sg.segments(base, texts)).collect()}
    return [found.get(i, b) for i, (b, _) in enumerate(primaries)]


def primaries(seed, n=40):
    rng = random.Random(seed)
    words = ["lantern", "film talk", "(b)", "src", "\n", "\n\n---", "---", ")", "別来源補足", "a)\nlantern", "x", "Taipei night market"]
    out = []
    for _ in range(n):
        text = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 5))).strip(" ")
        texts = [(rng.choice(["src", "a", "(b"]), text()) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.3:  # a text that is itself a merged one
            texts.append(("src", fold(texts[0][1], distinct(texts[1:4]))))
            rng.shuffle(texts)
        out.append((text(), distinct(texts)))
    return out


@pytest.mark.parametrize("seed,needle,text,stretch", [(1, sg.NEEDLE_BYTES, sg.TEXT_BYTES, sg.STRETCH), (2, 40, 60, 5), (3, 1, 1, 3)])
def test_equals_the_fold(spark, monkeypatch, seed, needle, text, stretch):
    monkeypatch.setattr(sg, "NEEDLE_BYTES", needle)
    monkeypatch.setattr(sg, "TEXT_BYTES", text)
    monkeypatch.setattr(sg, "STRETCH", stretch)
    made = primaries(seed)
    assert merged(spark, made) == [fold(b, ts) for b, ts in made]


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n-)(", max_size=8), st.lists(st.text("ab\n-)(", min_size=1, max_size=8), max_size=6, unique=True))
def test_texts_that_hit_a_heading_are_told(base, texts):
    """Whatever is found in the rendered text, but in none of the texts, may cross a heading."""
    grown = fold(base, [("ab", t) for t in texts])
    assert all(any(t in x for x in [base, *texts]) for t in texts)
    for t in {grown[i:j] for i in range(len(grown)) for j in range(i + 1, min(i + 9, len(grown)) + 1)}:
        if not any(t in x for x in [base, *texts]):
            first = t.split("\n")[0]
            assert (
                any(t.endswith(sg.BEFORE[:k]) for k in range(1, len(sg.BEFORE) + 1)) or sg.BEFORE in t or t in sg.BEFORE
                or ("\n" in t and (first in ("", "-", "--", "---") or first.endswith(sg.BETWEEN[:-1]))) or t in f"{sg.BEFORE}ab{sg.BETWEEN}"
            )


@pytest.mark.parametrize("ending", [" of the long list of a very busy place", " of the long list of."])
def test_one_primary_with_100_000_different_texts(spark, ending):
    n = 100_000
    line = F.concat(F.lit("event number "), F.col("id").cast("string"), F.lit(ending))
    texts = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("id"), F.col("id").alias("ord"), F.lit("src").alias("label"),
                                         F.when(F.col("id") % 100 == 0, F.expr("'number ' || cast(id - 1 as string) || ' of the long list of'")).otherwise(line).alias("text"))
    base = spark.createDataFrame([(0, "the place")], "id long, text string")
    taken = sg.segments(base, texts)
    assert taken.count() == n - n // 100
    assert taken.where("seq % 100 = 0").count() == 0


@pytest.mark.parametrize("many", [r.MANY_TEXTS, 0])
def test_apply_merge_by_either_way(spark, monkeypatch, many):
    monkeypatch.setattr(r, "MANY_TEXTS", many)
    made = primaries(5, 12)
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    rows, pairs = [], []
    for i, (b, ts) in enumerate(made):
        rows.append((100 * i, 0, "p", f"u{i}", b, None, "annotated", True, []))
        for k, (l, t) in enumerate(ts, 1):
            rows.append((100 * i + k, k, l, f"u{i}_{k}", t, None, "annotated", True, []))
            pairs.append((100 * i, 100 * i + k))
    ev = spark.createDataFrame(rows, "id long, k int, source_name string, source_url string, raw_description string, official_url string, annotation_status string, is_active boolean, secondary_source_urls array<string>")
    ev = ev.withColumn("start_date", start + F.make_dt_interval(mins=F.col("k"))).drop("k")
    out = {x.id: x for x in r.apply_merge(ev, spark.createDataFrame(pairs, "primary_id long, secondary_id long")).collect()}
    for i, (b, ts) in enumerate(made):
        assert out[100 * i].raw_description == fold(b.strip(" "), [(l, t.strip(" ")) for l, t in ts]) or out[100 * i].raw_description == b
        assert out[100 * i].secondary_source_urls == [f"u{i}_{k}" for k in range(1, len(ts) + 1)]
