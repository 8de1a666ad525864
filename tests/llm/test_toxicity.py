import random
import zlib

import numpy as np
import pytest

from almanack.llm import toxicity

BAD = ["blorgface", "snivelrat", "dungwit"]


def corpus(n=900):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "ing", "sha", "un", "o"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (None, "no id"), (5002, BAD[0]), (5002, BAD[0])]
    labels += [(5001, None), (None, 1), (3, labels[3][1]), (7777, 1)]
    return (
        spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, toxic int").repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
        dict(labels[:900]),
    )


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hit = np.mean([p == t for p, t in held])
    assert len(held) > 100 and hit > 0.95


def test_stage_drops_what_scores_high(tables):
    docs, labels, truth = tables
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i, t in truth.items() if not t]
    assert np.mean([i in ids for i in clean]) > 0.97
    assert np.mean([i in ids for i, t in truth.items() if t]) < 0.1
    assert None in ids and 5000 in ids and 5001 in ids


def test_held_out_labels_are_not_seen(tables, spark):
    docs, labels, _ = tables
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id or -1, r.score) for r in toxicity.score_documents(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("labels, share", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1), (3, 1)], 1.0)])
def test_too_few_labels(tables, spark, labels, share):
    docs, _, _ = tables
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs.limit(20), table).collect()} <= {share, 0.0}


def test_empty(tables):
    docs, labels, _ = tables
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_long_words_are_cut():
    assert toxicity.words("A" * 70 + " b") == ["a" * 32, "a" * 32, "a" * 6, "b"]
    assert toxicity.words(None) == []
