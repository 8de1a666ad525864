import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from almanack.llm import packing
from almanack.llm.words import pretokens

from .conftest import ROWS


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=25))
def test_plan_uses_every_length_once(counts):
    patterns = packing.plan_patterns(counts, 40)
    used = Counter()
    for lengths, times in patterns:
        assert 0 < sum(lengths) <= 40 and times > 0
        for n in lengths:
            used[n] += times
    assert dict(used) == counts
    assert len(patterns) <= 4 * 40


def test_plan_finds_singles_pairs_and_triples():
    assert packing.plan_patterns({30: 2, 10: 2}, 40) == [((30, 10), 2)]
    assert packing.plan_patterns({30: 1, 6: 1, 4: 1}, 40) == [((30, 6, 4), 1)]
    assert packing.plan_patterns({30: 1, 5: 1, 3: 1, 2: 1}, 40) == [((30, 5, 3, 2), 1)]
    assert packing.plan_patterns({20: 5}, 40) == [((20, 20), 2), ((20,), 1)]
    assert packing.plan_patterns({}, 40) == []
    with pytest.raises(ValueError):
        packing.plan_patterns({41: 1}, 40)


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    counts = Counter(min(2048, int(rng.lognormvariate(6.5, 1))) or 1 for _ in range(20_000))
    sequences = sum(t for _, t in packing.plan_patterns(counts, 2048))
    assert sequences <= -(-sum(n * c for n, c in counts.items()) // 2048) * 1.002 + 1


@pytest.mark.parametrize("few", [packing.FEW_STARTS, 0])
def test_pieces_and_places(docs, monkeypatch, few):
    monkeypatch.setattr(packing, "FEW_STARTS", few)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed_documents(docs, capacity=64).collect()
    want = Counter()
    for i, text in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, n in enumerate(x for x in [len(ids) % 64, *[64] * (len(ids) // 64)] if x):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64


ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x1c\x1f\x85\xa0\u3000\u200b\u2028éè漢字🎉\u0301²½'sdtm")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_ranks_give_the_tokenizers_ids(texts):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    t = Tokenizer.from_file(paths[0])
    found = packing._encoder(*paths).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ranks_give_the_tokenizers_ids_on_documents(spark, sf):
    """Every text of the small table, and very long words."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["ab" * 40_000, "é" * 30_000]
    t = Tokenizer.from_file(paths[0])
    for text, ids in zip(texts, packing._encoder(*paths).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_digests_are_of_the_ids(docs):
    whole = {(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in packing.token_pieces(docs, capacity=50).collect()}
    assert {tuple(r)[:5] for r in packing.token_pieces(docs, capacity=50, digests=True).collect()} == whole


def test_pieces_without_ranks_are_ranked(spark):
    """Lengths from elsewhere: every piece has a place of its own, without gaps."""
    rng = random.Random(2)
    rows = [(i, 0, rng.choice([1, 7, 20, 33, 40])) for i in range(400)]
    placed = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(4), 40).collect()
    assert len(placed) == 400
    parts = {}
    for r in placed:
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in parts.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:])) and min(held)[0] == 0 and sum(n for _, n in held) <= 40


def test_special_token_text_is_as_the_tokenizer_has_it(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "before <|endoftext|> after"
    row = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_empty(no_docs):
    assert packing.packed_documents(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_pretokens_are_the_pattern(text):
    import regex

    assert pretokens(text) == regex.findall(public_tokenizers.PATTERN, text)
