"""Pairs that may be similar, against the library's ratio of every two names."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanack.functions import alike as a
from almanack.functions.similarity import length_steps
from almanack.operators import resolve as r

SYLLABLES = [x + y + z for x in "tnrskmbd" for y in "aeio" for z in ["", "n", "l", "sh"]]


def edited(rng, name, letters, most):
    out = list(name)
    for _ in range(rng.randrange(1, max(2, int(len(name) * most)))):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = rng.choice(["", rng.choice(letters), rng.choice(letters) * 2])
        out = out or [rng.choice(letters)]
    return "".join(out)


def names_of(kind, rng, n=24):
    if kind == "syllables":
        letters, names = "abdeiklmnorstqxyz", ["".join(rng.choice(SYLLABLES) for _ in range(rng.choice([3, 30, 70, 75, 90, 160]))) for _ in range(n)]
    elif kind == "many letters":
        letters = "".join(chr(0x4E00 + k) for k in range(900))
        names = ["".join(rng.choices(letters, [1 / (k + 1) for k in range(900)], k=rng.choice([5, 40, 190, 210, 400]))) for _ in range(n)]
    else:
        letters = "abcdefghijklmnopqrstuvwxyz0123456789"
        names = ["".join(rng.choices(letters, [1 / (k + 1) for k in range(36)], k=rng.choice([20, 180, 199, 200, 201, 330]))) for _ in range(n)]
    names += [edited(rng, x, letters, most) for x in names for most in (0.05, 0.14)]
    names += [x[len(x) // 9 :] + x[: len(x) // 9] for x in names[:n]] + [x[: len(x) * 9 // 10] + edited(rng, x, letters, 0.2)[len(x) * 9 // 10 :] for x in names[:n]]
    return sorted(set(names), key=lambda x: rng.random())


@pytest.mark.parametrize("together", [0, 8])
@pytest.mark.parametrize("kind", ["syllables", "many letters", "rare letters"])
@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_no_similar_pair_is_lost(monkeypatch, kind, threshold, together):
    monkeypatch.setattr(a, "TOGETHER", together)
    monkeypatch.setattr(a, "BATCH", 500)
    rng = random.Random(int(threshold * 10) + together)
    names = names_of(kind, rng)
    steps = np.searchsorted(length_steps(threshold)[0], [len(x) for x in names], "right") - 1
    found = []
    for step in range(max(steps) + 1):
        own, below = np.flatnonzero(steps == step), np.flatnonzero(steps == step - 1)
        for ids, split in ((own, len(own)), (np.r_[below, own], len(below))):
            if split and len(own):
                for i, j in a.alike([names[k] for k in ids], split, threshold, lambda i, j: (ids[i] + ids[j]) % 7 > 0):
                    found += [frozenset(p) for p in zip(ids[i].tolist(), ids[j].tolist())]
    assert len(found) == len(set(found))
    near = lambda x, y: 3 * min(len(x), len(y)) > max(len(x), len(y)) and max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio()) >= threshold
    # a pair of which not even the letters suffice is left out without a look
    want = {frozenset((i, j)) for i, x in enumerate(names) for j, y in enumerate(names[:i]) if (i + j) % 7 and SequenceMatcher(None, x, y).quick_ratio() >= threshold and near(x, y)}
    assert want <= set(found) and len(want) > 15


def test_long_names_are_measured_by_few(spark):
    """Names of one set of syllables, as long as sentences: hardly any pair but the similar ones gets the exact ratio."""
    rng = random.Random(4)
    names = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(20, 150))) for _ in range(300)]
    names += [n[:30] + "q" + n[31:] for n in names[:10]]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name_ja string")
    classes = r.name_classes(df, F.lit("x")).withColumn("n", F.monotonically_increasing_id())
    want = sum(max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio()) >= 0.8 for x, y in zip(names, names[300:]))
    assert want <= r.candidates(classes, 0.8).count() < 200  # of 47,895 pairs
    assert r.near_classes(classes.drop("n"), 0.8).count() == want > 0


def test_pairs_of_tiles_are_dealt_out(spark):
    """Tiles are small in bytes, so tasks are not joined by size: one for each core at the least."""
    df = spark.createDataFrame([(i, f"name {i}", i % 40) for i in range(400)], "id long, name_ja string, b int")
    classes = r.name_classes(df, F.col("b")).withColumn("n", F.monotonically_increasing_id())
    assert r.candidates(classes, 0.8).rdd.getNumPartitions() >= r.TASKS * spark.sparkContext.defaultParallelism


def test_ratios_of_a_tile_are_dealt_out(spark):
    """A tile whose names are all similar: its pairs get their ratios in many tasks."""
    names = [f"one name of very many, number {k:02d}" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name_ja string")
    near = r.near_classes(r.name_classes(df, F.lit("x")), 0.85)
    assert near.count() == 435
    numbered = r.name_classes(df, F.lit("x")).withColumn("n", F.monotonically_increasing_id())
    side = lambda s: numbered.select(F.col("n").alias(f"n_{s}"), F.col("norm").alias(f"norm_{s}"))
    scored = r._scored(r.candidates(numbered, 0.85).join(side("a"), "n_a").join(side("b"), "n_b"), 0.85)
    assert scored.select(F.spark_partition_id()).distinct().count() > 8
