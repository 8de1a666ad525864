import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from almanack.llm import bilinear

from .conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 7


def plain(rows):
    split = [(i, WORD.findall(lower(t)) + [""]) for i, t in rows]
    c = Counter(w for i, ws in split if fold(i) not in (2, None) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(
        (i or 0, fold(i) == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in split
    )


def found(df):
    return sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


@pytest.mark.parametrize("listed", [bilinear.LISTED, 5])
def test_counts_and_base(docs, monkeypatch, listed):
    """Words reach their counts by the list or by the join."""
    monkeypatch.setattr(bilinear, "LISTED", listed)
    scored = bilinear.score_documents(docs)
    assert found(scored) == plain(ROWS)
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored.collect())


def test_probabilities_add_up(spark, docs):
    counts = bilinear.word_counts(docs)
    words = bilinear.lexicon(counts)
    model = bilinear.train(bilinear.encode(docs, words), words)
    contexts = np.random.default_rng(1).integers(0, bilinear.CLASSES + 1, (3, bilinear.CONTEXT))
    for row in contexts:
        logs = model.log_probabilities(np.repeat(row[None], bilinear.CLASSES, axis=0), np.arange(bilinear.CLASSES))
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    inside = np.zeros(bilinear.CLASSES)
    for r in counts.where("c > 0").collect():
        w = r.word.encode()
        inside[words.class_of(w) if w else 0] += r.c + 1
    shared = np.arange(bilinear.CLASSES) > bilinear.SINGLES
    assert np.allclose(inside[shared] + 1, words.mass[shared])


def test_score_is_the_models(spark, docs):
    """The query's score against token by token sums."""
    words = bilinear.lexicon(bilinear.word_counts(docs))
    encoded = bilinear.encode(docs, words)
    row = encoded.where("doc_id = 8").collect()[0]
    classes = np.frombuffer(row.classes, "<u2")
    text = bilinear.tokens(dict(ROWS)[8].encode())
    assert classes.tolist() == [words.class_of(w) for w in text] + [0]
    contexts, targets, doc = bilinear.contexts_of([row.classes, row.classes])
    assert targets.tolist() == classes.tolist() * 2
    start = bilinear.CLASSES
    for k in range(len(classes)):
        want = [int(classes[k - j]) if k >= j else start for j in range(1, bilinear.CONTEXT + 1)]
        assert contexts[k].tolist() == contexts[len(classes) + k].tolist() == want


def test_arrow_splits_as_the_contract():
    texts = [t for _, t in ROWS] + ["a\x0bB\x0cc\r\n\td  e", " x", "x ", "İ É", "\x00 \x1c\x1d \x85", "W" * 70 + " y"]
    words, place, doc = bilinear.words_of(pa.array(texts, pa.string()))
    split = [[] for _ in texts]
    for p, d in zip(place, doc):
        split[d].append(words[int(p)].as_py())
    assert split == [[w.encode() for w in WORD.findall(lower(t))] for t in texts]
    assert split == [bilinear.tokens((t or "").encode()) for t in texts]
    assert bilinear.keys_of(words).to_pylist() == [bilinear.key(w) for w in words.to_pylist()]


def test_texts_are_scored_as_their_contexts_are():
    rng = np.random.default_rng(6)
    model = bilinear.Model.fresh(rng.integers(0, 50, bilinear.CLASSES))
    texts = [rng.integers(0, bilinear.CLASSES, n).astype("<u2").tobytes() for n in (1, 3, 40, 2000)]
    contexts, targets, doc = bilinear.contexts_of(texts)
    want = np.bincount(doc, weights=model.log_probabilities(contexts, targets))
    assert np.allclose(model.text_log_probabilities(texts, model.tables()), want, rtol=1e-4)


def test_learns_order(spark):
    """Held-out text of a cyclic language scores far above its word counts, shuffled words don't."""
    cycle = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        words = [cycle[(i + k) % 12] for k in range(60)]
        rows.append((i, " ".join(words if i % 10 else rng.permutation(words).tolist())))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = [r for r in bilinear.score_documents(df).collect() if r.held_out]
    gain = lambda keep: np.mean([(r.score - r.base_score) / r.n_tokens for r in held if keep(r.doc_id)])
    assert gain(lambda i: i % 10) > 0.5
    assert gain(lambda i: i % 10) > gain(lambda i: not i % 10) + 0.5


def test_steps_follow_the_slope():
    """A step against the contrastive loss lowers it."""
    rng = np.random.default_rng(4)
    model = bilinear.Model.fresh(np.ones(bilinear.CLASSES))
    share = np.full(bilinear.CLASSES, 1 / bilinear.CLASSES)
    contexts = rng.integers(0, 20, (256, bilinear.CONTEXT))
    targets = (contexts[:, 0] + 1) % 20
    before = model.log_probabilities(contexts, targets).mean()
    for _ in range(60):
        model.learn(contexts, targets, share, rng)
    assert model.log_probabilities(contexts, targets).mean() > before + 1.5


def test_parameters_survive_flattening():
    model = bilinear.Model.fresh(np.arange(bilinear.CLASSES))
    again = model.filled(model.flat())
    assert all((a == b).all() for a, b in zip(model.parts + model.squares, again.parts + again.squares))


def test_empty_and_no_training_rows(spark, docs, no_docs):
    assert bilinear.score_documents(no_docs).count() == 0
    held = docs.where(F.col("doc_id").isNull())
    rows = bilinear.score_documents(held).collect()
    assert {(r.held_out, r.train_tokens, r.n_known, r.base_score) for r in rows} == {(False, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in rows)
