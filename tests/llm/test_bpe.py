import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from almanack.llm import bpe

from .conftest import ROWS

TOKENS = bpe.load_ranks()
RANKS = {t: r for r, t in enumerate(TOKENS) if t}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ranks_file():
    lines = [line.split() for line in open(public_tokenizers.path(bpe.RANKS), "rb")]
    assert {base64.b64decode(t): int(r) for t, r in lines} == RANKS


def test_slots_hold_every_token():
    table = bpe.slot_table(TOKENS)
    for token, rank in RANKS.items():
        assert rank in [table[p] for p in bpe._places(token.hex().upper().encode())]


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1))
def test_heap_merges(text):
    words = bpe.pretokens(text)
    assert [i for w in words for i in bpe.merge_word(w.encode("utf-8", "surrogatepass"), RANKS)] == LIBRARY.encode_ordinary(text)


def test_decoder():
    d = bpe._Decoder(TOKENS)
    lists = [LIBRARY.encode_ordinary(t or "") for _, t in ROWS]
    assert d.decode([np.array(i, "<u4").tobytes() for i in lists]) == [(t or "").encode() for _, t in ROWS]
    assert d.decode([]) == []


def test_documents(docs, no_docs):
    rows = bpe.round_trips(docs).collect()
    want = []
    for i, t in ROWS:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert bpe.round_trips(no_docs).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in ROWS)


@pytest.mark.parametrize("longest", [1, 6])
def test_words_left_to_the_heap(docs, monkeypatch, longest):
    monkeypatch.setattr(bpe, "LONGEST", longest)
    assert sorted(r.n_tokens for r in bpe.round_trips(docs).collect()) == sorted(len(LIBRARY.encode_ordinary(t or "")) for _, t in ROWS)


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.round_trips(df).collect()) == [(i, 0, hashlib.sha256(b"").hexdigest()) for i in (1, 2)]
