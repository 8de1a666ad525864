import math

import numpy as np
import pytest

from almanack.llm import neighbours


def brute(rows, threshold):
    n = len(rows)
    units = []
    for _, v, label in rows:
        ok = label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
        x = np.array(v, float) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), root, root == rows[i][0]))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out, i = [], 0
    for label in (0, 1):
        for _ in range(150):
            out.append((i := i + 1, rng.standard_normal(16).tolist(), label))
        centre = rng.standard_normal(16)
        for _ in range(120):  # more than a list can hold
            out.append((i := i + 1, (centre + 0.02 * rng.standard_normal(16)).tolist(), label))
        for _ in range(20):
            a = rng.standard_normal(16)
            out.append((i := i + 1, a.tolist(), label))
            out.append((i := i + 1, (3 * a).tolist(), label))
            out.append((i := i + 1, (a + 0.08 * rng.standard_normal(16)).tolist(), label))
    copied = out[5][1]
    out += [(i + 1, None, 0), (i + 2, [], 0), (i + 3, [0.0] * 16, 0), (i + 4, [float("nan")] + [1.0] * 15, 0), (i + 5, [None] + [1.0] * 15, 0)]
    out += [(i + 6, copied, None), (i + 7, copied, 1), (i + 8, copied, 0), (i + 9, copied[:8], 0), (i + 10, copied[:8], 0), (i + 11, [float("inf")] + [1.0] * 15, 0)]
    return out


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "FULL_BLOCK", 32)
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], "vec_id long, embedding array<float>, label int, node int, m int").repartition(3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect())
    assert got == brute(single, 0.98)


def test_repeated_rows_null_ids_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [2.0, 0.0], 0), (None, None, None)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in neighbours.near_duplicates(df).collect())
    assert got == [(0, 0, 0, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_components_linked_beyond_their_lists(spark):
    """Two groups, each larger than a list, whose cross links are all weaker than those inside."""
    rng = np.random.default_rng(4)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    turn = np.arccos(0.985)
    centres = [a, np.cos(turn) * a + np.sin(turn) * b]
    made = [(100 * c + i, (centres[c] + 0.022 / 8 * rng.standard_normal(64)).astype(np.float32).tolist(), 0) for c in (0, 1) for i in range(100)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect())
    assert got == brute(made, 0.98)
    assert {r[2] for r in got} == {0}


def test_bridges_join_what_any_link_joins(spark, monkeypatch):
    """Components given in pieces, singles among them, are joined as by comparing all nodes."""
    monkeypatch.setattr(neighbours, "FULL_BLOCK", 8)
    rng = np.random.default_rng(6)
    nodes = []
    for c in range(12):
        at = rng.standard_normal(8)
        for i in range(14):
            at = at + 0.05 * rng.standard_normal(8)
            nodes.append((len(nodes), at / np.linalg.norm(at), c % 2))
    rows = [(14 * (n // 14) + (n % 14) // 5 * 5 if n % 14 < 10 else n, n, label, 8, bytearray(x.astype("<f8").tobytes())) for n, x, label in nodes]
    df = spark.createDataFrame(rows, "root long, node long, label int, dim int, unit binary")
    pieces = df.select("node", "root")
    got = {r.node: r.root for r in neighbours._joined(pieces, neighbours.bridges(df, 0.98)).collect()}
    root = {n: r for r, n, *_ in rows}
    for _ in range(len(nodes)):
        was = dict(root)
        for n, x, label in nodes:
            for m, y, other in nodes:
                if label == other and (x @ y >= 0.98 or rows[n][0] == rows[m][0]):
                    root[n] = root[m] = min(root[n], root[m])
        if root == was:
            break
    assert {n: got.get(n, n) for n in root} == root


def test_a_hot_group_hides_no_scattered_pairs(spark, monkeypatch):
    """Signs that tell little lose most pairs in the first rounds; a large group has nearly all links."""
    monkeypatch.setattr(neighbours, "TABLES", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.default_rng(8)
    made, centre = [], rng.standard_normal(32)
    for _ in range(300):
        made.append((len(made), (centre + 0.02 * rng.standard_normal(32)).astype(np.float32).tolist(), 0))
    for _ in range(300):
        x = rng.standard_normal(32)
        for _ in range(2):
            made.append((len(made), (x + 0.12 * rng.standard_normal(32)).astype(np.float32).tolist(), 0))
    want = brute(made, 0.98)
    assert sum(r[1] for r in want if r[0] < 300) > 0.99 * sum(r[1] for r in want)
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect())
    missed = sum(g != w for g, w in zip(got, want))
    assert missed <= 0.01 * sum(r[0] >= 300 and r[1] > 0 for r in want)


def test_audit_weighs_nodes_not_links(spark):
    """A hundred nodes with all their links connected don't make up for ten pairs that aren't."""
    hot = [(q, v, 1.0) for q in range(100) for v in range(100) if q != v]
    pairs = [(q, q + 1, 1.0) for q in range(200, 220, 2)]
    truth = spark.createDataFrame(hot + pairs, "q long, v long, stands double")
    member = spark.createDataFrame([(n, 0) for n in range(100)], "node long, root long")
    assert neighbours._recall(truth, member) < neighbours.RECALL
    assert neighbours._recall(truth.where("q < 100"), member) == 1.0
