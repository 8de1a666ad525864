import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from almanack.llm import simhash

from .conftest import ROWS


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"])))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def close(values, radius=2):
    n = len(values)
    return {(i, j) for i in range(n) for j in range(i + 1, n) if bin(int(values[i]) ^ int(values[j])).count("1") <= radius}


def test_planes_find_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = [base]
    for flips in (1, 2, 3):
        moved = base.copy()
        for _ in range(flips):
            moved ^= np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
        values.append(moved)
    values = np.concatenate(values)
    for radius in (0, 1, 2):
        found = {(int(a), int(b)) for i, j in simhash.near_pairs(values, radius) for a, b in zip(i, j)}
        assert found == close(values, radius)


def components_of(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_links_with_crowded_keys(spark):
    """Chains and near copies around few centres, with keys divided at any size."""
    rng = np.random.default_rng(5)
    prints = {}
    for c in range(6):
        at = int(rng.integers(0, 1 << 62))
        for _ in range(40):
            prints[len(prints)] = at
            if rng.random() < 0.8:
                for b in rng.choice(64, size=rng.integers(1, 4), replace=False):
                    at ^= 1 << int(b)
    first = {}
    for i, p in prints.items():
        first.setdefault(p, i)
    rows = [(p - (1 << 64) if p >> 63 else p, i) for p, i in first.items()]
    df = spark.createDataFrame(rows, "fp long, first long")
    from almanack.llm.components import components

    want = components_of({i: p for p, i in first.items()})
    for full in (1, 10, 4096):
        got = {r.node: r.root for r in components(simhash.links(df, full), "a", "b").collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_documents(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id or 0, r.fp & (1 << 64) - 1) for r in rows) == sorted((i or 0, plain(t)) for i, t in ROWS)
    prints = {}
    for i, t in ROWS:
        if i is not None:
            prints.setdefault(plain(t), []).append(i)
    want = components_of({min(v): p for p, v in prints.items()})
    for r in rows:
        p = r.fp & (1 << 64) - 1
        assert r.component_id == (want[min(prints[p])] if p in prints else None)


def test_stage_keeps_one_of_each(docs, no_docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids))
    assert 1 in ids and 2 in ids and 3 not in ids and 4 not in ids
    assert kept.where("doc_id is null").count() == 2
    assert simhash.drop_near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
