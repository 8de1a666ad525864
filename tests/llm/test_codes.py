import hashlib
import math

import numpy as np
import pytest

from almanack.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string, _salt int"


def plain(rows, parts, entries, rounds):
    """The same by comparing every part with every entry."""
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    width = len(first[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((gap(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                held[nearest(v, p)[1]].append(cut(v, p))
            moved.append([[sum(x) // len(h) for x in zip(*h)] if h else e for h, e in zip(held, books[p])])
        books = moved
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, bytes(nearest(v, p)[1] for p in range(parts)), sum(nearest(v, p)[0] for p in range(parts)), l) for i, v, l in kept]
    totals = {}
    for _, _, e, l in coded:
        totals[l] = totals.get(l, 0) + e
    return sorted(((i if i is not None else -1), c, e, totals[l], digest) for i, c, e, l in coded)


def found(df, **how):
    rows = codes.with_label_error(codes.compress(df, **how)).collect()
    return sorted(((r.vec_id if r.vec_id is not None else -1), bytes(r.code), r.error, r.label_error, r.codebooks_sha256) for r in rows)


def vectors(n=150, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, dim) / 256], int(rng.integers(0, 3))) for i in rng.permutation(n)]
    rows += [(n, None, 1), (n + 1, [0.1, None] + [0.0] * (dim - 2), 1), (n + 2, [float("nan")] + [0.0] * (dim - 1), 1)]
    rows += [(n + 3, [float("-inf")] + [0.0] * (dim - 1), 0), (n + 4, [], 0), (n + 5, [0.5] * dim, None), (n + 6, [-0.5] * dim, None)]
    rows += [(None, [0.25] * dim, 2), (7, [0.125] * dim, 1), (7, [0.125] * dim, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 2), (8, 5, 3), (2, 250, 1), (1, 1, 2)])
def test_equals_comparing_all(spark, parts, entries, rounds):
    rows = vectors()
    assert found(frame(spark, rows), parts=parts, entries=entries, rounds=rounds) == plain(rows, parts, entries, rounds)


def test_many_labels_are_joined_by_salted_key(spark, monkeypatch):
    rows = vectors(60)
    monkeypatch.setattr(codes, "FEW_LABELS", 0)
    assert found(frame(spark, rows), parts=4, entries=8) == plain(rows, 4, 8, 2)


def test_search_finds_the_lowest_nearest_and_skips_entries():
    rng = np.random.default_rng(5)
    for span in (2, 5, 1000):
        entries = rng.integers(-span, span + 1, (1, 64, 4))
        entries[0, 9] = entries[0, 40]  # equal entries
        books = codes.Codebooks(entries)
        parts = rng.integers(-span, span + 1, (500, 4))
        index, least = books.assign(parts)
        gaps = ((parts[:, None] - entries[0][None]) ** 2).sum(axis=2)
        assert (index[:, 0] == gaps.argmin(axis=1)).all() and (least[:, 0] == gaps.min(axis=1)).all()
    far = codes.Codebooks(np.arange(64).reshape(1, 64, 1) * 100)
    compared = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                compared.append(len(key))
            return super().__getitem__(key)

    codes._orchard(np.array([[310]]), far.entries[0].view(Watched), far.between[0], far.lists[0])
    assert sum(compared) < 32


def test_empty_and_odd_shapes(spark):
    assert found(frame(spark, []).limit(0)) == []
    assert found(frame(spark, [(1, None, 1), (None, [1.0] * 16, 1)])) == []
    with pytest.raises(ValueError):
        found(frame(spark, [(1, [1.0] * 10, 1)]), parts=4)
    short = [(1, [0.5] * 8, 1), (2, [0.5] * 4, 1), (3, [0.25] * 8, 1)]
    assert [r[0] for r in found(frame(spark, short), parts=4)] == [1, 3]
    with pytest.raises(Exception, match="compared exactly"):
        found(frame(spark, [(1, [0.5] * 8, 1), (2, [1e30] * 8, 1)]), parts=4)
