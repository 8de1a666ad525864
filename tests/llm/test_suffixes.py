import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanack.llm import suffixes

from .conftest import PASSAGE, ROWS


def brute(texts, k):
    """(kept, removed, runs) of each text in order."""
    seen, out = set(), []
    for b in texts:
        gone = [False] * len(b)
        new = []
        for s in range(len(b) - k + 1):
            if b[s : s + k] in seen:
                gone[s : s + k] = [True] * k
            else:
                seen.add(b[s : s + k])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(x for x, g in zip(b, gone) if not g), sum(gone), runs))
    return out


def compare(spark, texts, k, anchor, crowded=50_000, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in suffixes.drop_repeats(df, k, anchor, crowded).collect()}
    want = brute([t.encode() for t in texts], k)
    assert [got[i] for i in range(len(texts))] == want


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        for s in rng.sample(shared, rng.randint(0, 2)):
            cut = rng.randint(0, 20)
            t = t[: len(t) // 2] + s[cut : len(s) - rng.randint(0, 20)] + t[len(t) // 2 :]
        texts.append(t)
    return texts + [texts[0], texts[1] + "x", "ab" * 200, "ab" * 150, "a" * 300]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k, anchor", [(30, 8), (20, 20), (25, 1)])
def test_equals_brute_force(spark, seed, k, anchor):
    compare(spark, corpus(seed), k, anchor)


def test_crowded_anchors(spark):
    compare(spark, corpus(7), 30, 8, crowded=2)


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    texts = corpus(3, 30)
    parts = list(suffixes._anchor_rows([t.encode() for t in texts], 30, 8))
    monkeypatch.setattr(suffixes, "SEGMENT", 1 << 20)
    whole = list(suffixes._anchor_rows([t.encode() for t in texts], 30, 8))
    flat = lambda rows: sorted({(int(t), int(p), int(h)) for a in rows for t, p, h in zip(*a)})
    assert flat(parts) == flat(whole)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15)), max_size=8))
def test_cut(spans):
    body = bytes(range(60))
    spans = [(a, a + n) for a, n in spans]
    gone = {x for a, b in spans for x in range(a, b)}
    kept, removed, runs = suffixes.cut_spans(body, spans)
    assert kept == bytes(x for x in body if x not in gone)
    assert removed == len(gone) and runs == sum(x - 1 not in gone for x in gone)


def test_documents(docs, no_docs):
    rows = suffixes.drop_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(r.n_bytes for r in by[None]) == [0, len(("no id here, but " + PASSAGE).encode())]
    assert all(r.n_removed == 0 for r in by[None])  # null ids come first
    assert [r.n_removed for r in by[9]] == [len(PASSAGE.encode())]
    assert len({(r.n_removed, bytes(r.kept)) for r in by[10]}) == 1  # repeated rows are one document
    assert by[13][0].n_removed == 4999 and bytes(by[13][0].kept) == b"a"
    assert suffixes.drop_repeats(no_docs).count() == 0


def test_stage_keeps_rows_and_columns(docs):
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == sum(t is None for _, t in ROWS)
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    assert out.where("doc_id = 9").first().text == " and then it goes on in its own way"
