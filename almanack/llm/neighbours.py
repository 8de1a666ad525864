"""Embedding near-duplicates by NN-descent on a neighbour graph.

Equal directions are one node. First lists of neighbours come from blocks of nodes with similar
signs on random hyperplanes; each round then compares the neighbours of a node, and the nodes
that have it as neighbour, with each other, and keeps the best. A list of which every entry
passes the threshold is saturated and doubles. Every pair that was ever compared and passes is an
edge, whether or not a list keeps it, and components with saturated nodes are joined by an exact
comparison of those. An audit compares a bounded sample of nodes, drawn inside and outside large
components, with all others and asks for more rounds and further hyperplanes while nodes with few,
some or many links have too few of them connected; if it is never content, all components are
compared exactly. Last, links are counted in full inside each component, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.common import number_rows, settle
from almanack.llm.components import components

THRESHOLD = 0.98
LIST = 10
LONGEST = 80
TABLES = 4
BITS = 20
ROUNDS = 2
MOST_ROUNDS = 8
#: Nodes inside and outside large components that the audit compares with all others.
AUDIT = 400
AUDIT_APART = 2000
#: The share of a node's links to be connected, as the mean over the nodes with about as many.
RECALL = 0.99
DEGREES = (2, 10, 80)
BLOCK = 128
FULL_BLOCK = 512

NODE = "node long, label int, dim int, unit binary"


# ---- nodes ----------------------------------------------------------------------------------


def unit_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, unit``; ``unit`` (double precision, as bytes) is null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            units, dims = [], []
            for vector, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
                unit = None
                if label is not None and vector and None not in vector:
                    x = np.array(vector, dtype=np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        unit = (x / np.sqrt(x @ x)).astype("<f8").tobytes()
                units.append(unit)
                dims.append(len(vector) if vector else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                ["vec_id", "label", "dim", "unit"],
            )

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("int"))
    return rows.mapInArrow(run, "vec_id long, label int, dim int, unit binary")


def _units(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Sorted rows as one table per run of equal ``keys``, in portions of at most ``most`` rows."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]) if held is not None else now
        parts = [held.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([p[1:] != p[:-1] for p in parts])) + 1
        at = 0
        for stop in change.tolist():
            for start in range(at, stop, most):
                yield held.slice(start, min(most, stop - start))
            at = stop
        while held.num_rows - at > most:
            yield held.slice(at, most)
            at += most
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


# ---- lists ----------------------------------------------------------------------------------


def _signed(tables: range, bits: int):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                x = _units(rows.column("unit"))
                for t in tables:
                    planes = np.random.default_rng([t, int(dim)]).standard_normal((int(dim), bits))
                    sign = ((x @ planes > 0) @ (1 << np.arange(bits)[::-1])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), rows.column("label"), rows.column("dim"), pa.array(sign), rows.column("node"), rows.column("unit")],
                        ["turn", "label", "dim", "sign", "node", "unit"],
                    )

    return run


def _best_in_block(k: int):
    """Each row's ``k`` nearest among its neighbours in sort order."""

    def run(batches):
        for block in _runs(batches, ["turn", "label", "dim"], BLOCK):
            x, node = _units(block.column("unit")), block.column("node").to_numpy()
            if len(node) < 2:
                continue
            s = x @ x.T
            np.fill_diagonal(s, -2)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            top = top[:, : len(node) - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node, top.shape[1])), pa.array(node[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], ["u", "v", "s"]
            )

    return run


def _trimmed(found: DataFrame, threshold: float) -> DataFrame:
    """The best of each list: ``LIST`` of them, twice what passes the threshold, ``LONGEST`` at most."""
    own = found.repartition("u").dropDuplicates(["u", "v"])
    best = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    # more than LONGEST never stay, which Spark applies before it counts
    near = own.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= LONGEST)
    passing = F.count(F.when(F.col("s") >= threshold, 1)).over(Window.partitionBy("u"))
    return near.withColumn("_k", F.greatest(F.lit(LIST), 2 * passing)).where("_n <= _k").select("u", "v", "s")


def first_found(nodes: DataFrame, turn: int = 0) -> DataFrame:
    """Each node's nearest among nodes with similar signs, on hyperplanes of this turn's own."""
    signed = nodes.select("node", "label", "dim", "unit").mapInArrow(_signed(range(turn * TABLES, (turn + 1) * TABLES), BITS), "turn int, label int, dim int, sign long, node long, unit binary")
    order = ["turn", "label", "dim", "sign", "node"]
    dealt = signed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_best_in_block(LIST), "u long, v long, s double")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a list compared with each other; what improves a list is proposed."""
    for block in _runs(batches, ["c", "salt"], BLOCK):
        n = block.num_rows
        if n < 2:
            continue
        x, member, worst = _units(block.column("unit")), block.column("m").to_numpy(), block.column("worst").to_numpy()
        s = x @ x.T
        better = s > worst[:, None]
        np.fill_diagonal(better, False)
        for i, known in enumerate(block.column("known").to_pylist()):
            better[i] &= ~np.isin(member, known)
        if n > LIST + 1:  # the best of them; the others meet again in other lists, and links are counted in full later
            best = np.argpartition(np.where(better, -s, 3.0), LIST, axis=1)[:, :LIST]
            chosen = np.zeros_like(better)
            np.put_along_axis(chosen, best, True, axis=1)
            better &= chosen
        i, j = np.nonzero(better)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(member[i]), pa.array(member[j]), pa.array(s[i, j])], ["u", "v", "s"])


def descend(lists: DataFrame, nodes: DataFrame, turn: int, threshold: float) -> DataFrame:
    """What one round proposes: neighbours of a common neighbour meet."""
    forward = lists.select(F.col("u").alias("c"), F.col("v").alias("m"))
    pairs = forward.unionByName(forward.select(F.col("m").alias("c"), F.col("c").alias("m"))).distinct()
    pairs = settle(pairs)
    hubs = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    parts = F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / BLOCK)
    salted = pairs.join(hubs, "c", "left").withColumn("salt", F.pmod(F.xxhash64("m", F.lit(turn)), parts)).select("c", "m", "salt")
    state = lists.groupBy("u").agg(F.min("s").alias("_worst"), F.collect_list("v").alias("known"))
    full = (F.size("known") >= LIST) & (F.size("known") < LONGEST)
    state = state.select(
        F.col("u").alias("m"), "known",
        # a saturated list takes whatever passes the threshold
        F.when(full | (F.size("known") >= LONGEST), F.least("_worst", F.lit(threshold - 1e-9))).otherwise(F.lit(-2.0)).alias("worst"),
    )
    attached = salted.join(nodes.select(F.col("node").alias("m"), "unit").join(state, "m"), "m")
    dealt = attached.repartition("c", "salt").sortWithinPartitions("c", "salt", "m")
    return dealt.select("c", "salt", "m", "unit", "worst", "known").mapInArrow(_meet, "u long, v long, s double")


# ---- components -----------------------------------------------------------------------------


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre of each block of a component, and the angle that holds all of the block."""
    for group in _runs(batches, ["root", "block"], 1 << 30):
        x = _units(group.column("unit"))
        centre = x.sum(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-9 else x[0]
        angle = np.arccos(np.clip(x @ centre, -1, 1)).max()
        first = group.slice(0, 1)
        yield pa.RecordBatch.from_arrays(
            [first.column(k).combine_chunks() for k in ("label", "dim", "root", "block")] + [pa.array([centre.astype("<f8").tobytes()]), pa.array([angle])],
            ["label", "dim", "root", "block", "centre", "angle"],
        )


def _cell_pairs(threshold: float):
    """Cells of two components that angles allow to hold a link."""

    def run(batches):
        for group in _runs(batches, ["label", "dim", "i", "j"], 1 << 30):
            x, own, root, block, angle = _units(group.column("centre")), *(group.column(k).to_numpy() for k in ("chunk", "root", "block", "angle"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(a) or not len(b):
                continue
            apart = np.arccos(np.clip(x[a] @ x[b].T, -1, 1))
            # the slack is far above the rounding of an angle near zero
            near = (apart <= angle[a][:, None] + angle[b][None, :] + np.arccos(threshold) + 1e-6) & (root[a][:, None] != root[b][None, :])
            if i == j:
                near = np.triu(near)
            p, q = a[np.nonzero(near)[0]], b[np.nonzero(near)[1]]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (root[p], block[p], root[q], block[q])], ["ra", "ba", "rb", "bb"])

    return run


def _first_link(threshold: float):
    """One link between the two blocks of a pair, if there is any."""

    def run(batches):
        for group in _runs(batches, ["pair"], 1 << 30):
            x, node, side = _units(group.column("unit")), group.column("node").to_numpy(), group.column("side").to_numpy()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = x[a] @ x[b].T >= threshold
            if near.any():
                i, j = np.unravel_index(near.argmax(), near.shape)
                yield pa.RecordBatch.from_arrays([pa.array([node[a[i]]]), pa.array([node[b[j]]])], ["u", "v"])

    return run


def _in_chunks(df: DataFrame, keys: list[str], spread, name: str, most: int) -> DataFrame:
    """``df`` once for each pair (i, j) of chunks of its key that it belongs to."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chunks = F.ceil(F.col("_n") / most).cast("long")
    placed = df.join(sizes, keys).withColumn(name, F.pmod(spread, chunks))
    ends = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda o: F.struct(F.least(name, o).alias("i"), F.greatest(name, o).alias("j")))
    return placed.withColumn("_e", F.explode(ends)).select("*", "_e.i", "_e.j").drop("_e", "_n")


def bridges(members: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links that join the components of ``members`` exactly as all of its links do.

    ``members``: root, node, label, dim, unit. Blocks of components, as centre and angle, are
    compared with each other; two whose angles allow a link are compared in full, and one link
    says that their components are one.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / FULL_BLOCK).cast("long")
    placed = settle(members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).select("root", "block", "node", "label", "dim", "unit"))
    dealt = placed.repartition("root", "block").sortWithinPartitions("root", "block")
    cells = settle(dealt.mapInArrow(_cells, "label int, dim int, root long, block long, centre binary, angle double"))
    several = cells.groupBy("label", "dim").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("label", "dim")
    paired = _in_chunks(cells.join(several, ["label", "dim"]), ["label", "dim"], F.xxhash64("root", "block"), "chunk", FULL_BLOCK)
    paired = paired.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j")
    pairs = paired.select("label", "dim", "i", "j", "chunk", "root", "block", "centre", "angle").mapInArrow(_cell_pairs(threshold), "ra long, ba long, rb long, bb long")
    pairs = settle(pairs.withColumn("pair", F.monotonically_increasing_id()))
    sides = pairs.select("pair", F.lit(0).alias("side"), F.col("ra").alias("root"), F.col("ba").alias("block")).unionByName(
        pairs.select("pair", F.lit(1).alias("side"), F.col("rb").alias("root"), F.col("bb").alias("block"))
    )
    facing = sides.join(placed, ["root", "block"]).select("pair", "side", "node", "unit")
    return facing.repartition("pair").sortWithinPartitions("pair").mapInArrow(_first_link(threshold), "u long, v long")


def _joined(member: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what ``member`` (node, root) connects and ``links`` (u, v) add."""
    return settle(components(member.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links.select("u", "v")), "u", "v"))


def _with_roots(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """A node without links is its own component."""
    return nodes.join(member, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", "label", "dim", "unit")


def _saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """Nodes of which every entry passes, so that there may be more than the list holds."""
    ends = lists.groupBy("u").agg(F.min("s").alias("_worst"), F.count(F.lit(1)).alias("_n"))
    return ends.where((F.col("_worst") >= threshold) & (F.col("_n") >= LIST)).select(F.col("u").alias("node"))


# ---- audit and links ------------------------------------------------------------------------


def _drawn(nodes: DataFrame, member: DataFrame) -> list[tuple]:
    """Nodes to audit, with the number of nodes that each stands for.

    Nodes of large components and the others, isolated ones among them, are drawn apart, so
    that a hot group takes no more than its own part of the draw.
    """
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    placed = nodes.join(member.join(sizes, "root").select("node", "_n"), "node", "left").withColumn("_large", F.coalesce("_n", F.lit(1)) > LIST)
    out = []
    for large, most in ((True, AUDIT), (False, AUDIT_APART)):
        part = placed.where(F.col("_large") == large)
        rows = part.orderBy(F.xxhash64("node"), "node").limit(most).select("node", "label", "dim", "unit").collect()
        stands = part.count() / len(rows) if rows else 0.0
        out += [(r["node"], r["label"], r["dim"], r["unit"], stands) for r in rows]
    return out


def _audit_links(nodes: DataFrame, threshold: float, drawn: list[tuple]) -> DataFrame:
    """All links of the drawn nodes, by comparison with every node."""
    by_kind: dict[tuple[int, int], list] = {}
    for node, label, dim, unit, stands in drawn:
        by_kind.setdefault((label, dim), []).append((node, unit, stands))
    kinds = {k: (np.array([r[0] for r in v]), np.stack([np.frombuffer(r[1], "<f8") for r in v]), np.array([r[2] for r in v])) for k, v in by_kind.items()}

    def run(batches):
        for batch in batches:
            label, dim, node = (batch.column(k).to_numpy() for k in ("label", "dim", "node"))
            for (a, d), (queries, q, stands) in kinds.items():
                mine = np.flatnonzero((label == a) & (dim == d))
                if len(mine):
                    hit = _units(batch.column("unit").take(pa.array(mine))) @ q.T >= threshold
                    i, j = np.nonzero(hit)
                    keep = node[mine[i]] != queries[j]
                    yield pa.RecordBatch.from_arrays([pa.array(queries[j][keep]), pa.array(node[mine[i]][keep]), pa.array(stands[j][keep])], ["q", "v", "stands"])

    return nodes.select("node", "label", "dim", "unit").mapInArrow(run, "q long, v long, stands double")


def _recall(truth: DataFrame, member: DataFrame) -> float:
    """Share of a node's true links whose ends are in one component.

    It is the mean over nodes, not links, and the least of the means of the classes of nodes
    with about as many links.
    """
    of = lambda name, out: member.select(F.col("node").alias(name), F.col("root").alias(out))
    joined = truth.join(of("q", "_a"), "q", "left").join(of("v", "_b"), "v", "left")
    nodes = joined.groupBy("q", "stands").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("_hit"))
    degree = sum(((F.col("_n") > most).cast("int") for most in DEGREES), F.lit(0))
    classes = nodes.groupBy(degree.alias("_degree")).agg((F.sum(F.col("stands") * F.col("_hit") / F.col("_n")) / F.sum("stands")).alias("recall"))
    return min((r["recall"] for r in classes.collect()), default=1.0)


def _count_links(threshold: float):
    """Weighted links of each node of two blocks of one component."""

    def run(batches):
        for group in _runs(batches, ["root", "i", "j"], 1 << 30):
            x, node, own, weight = _units(group.column("unit")), *(group.column(k).to_numpy() for k in ("node", "block", "m"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(a) or not len(b):
                continue
            near = x[a] @ x[b].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                out, count = node[a], near @ weight[b]
            else:
                out, count = np.r_[node[a], node[b]], np.r_[near @ weight[b], weight[a] @ near]
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(count.astype(np.int64))], ["node", "links"])

    return run


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``node, links``: rows of other nodes linked to it, in full, inside each component.

    Components go as pairs of blocks of about ``FULL_BLOCK`` nodes, each pair a task's work;
    what leaves a pair is a count per node.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / FULL_BLOCK).cast("long")
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    ends = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    paired = placed.withColumn("_e", F.explode(ends)).select("root", "_e.i", "_e.j", "node", "block", "m", "unit")
    dealt = paired.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return dealt.mapInArrow(_count_links(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Vectors link if labels are equal and not null and the cosine reaches ``threshold``. A null or
    zero vector, one with a null or non-finite component, or one of another length links with
    nothing. Equal rows link with each other. A null id leads no component and is never kept.
    """
    rows = settle(unit_rows(vectors))
    grouped = (
        rows.where("unit IS NOT NULL")
        .groupBy("label", "dim", "unit")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m"))
    )
    numbered, n = number_rows(grouped, [F.col("first").asc_nulls_last(), F.xxhash64("label", "unit")], "node")
    nodes = settle(numbered)
    found = settle(first_found(nodes))
    edges = found.where(F.col("s") >= threshold)
    lists = settle(_trimmed(found, threshold))
    truth = None
    member = nodes.select("node", F.col("node").alias("root")).limit(0)
    for turn in range(MOST_ROUNDS):
        found = descend(lists, nodes, turn, threshold)
        if turn >= ROUNDS:  # lists improve only near what they know, so pairs far from it need other hyperplanes
            found = found.unionByName(first_found(nodes, turn - ROUNDS + 1))
        found = settle(found)
        edges = edges.unionByName(found.where(F.col("s") >= threshold))
        lists = settle(_trimmed(lists.unionByName(found), threshold))
        if turn + 1 >= ROUNDS:
            member, edges = _joined(member, edges), edges.limit(0)
            crowded = _with_roots(nodes.join(_saturated(lists, threshold), "node"), member)
            member = _joined(member, bridges(crowded, threshold))
            if truth is None:
                truth = settle(_audit_links(nodes, threshold, _drawn(nodes, member)))
            if _recall(truth, member) >= RECALL:
                break
    else:  # the search is at its end, and the result still has to be whole
        member = _joined(member, bridges(_with_roots(nodes, member), threshold))
    counts = link_counts(member.join(nodes, "node").select("root", "node", "m", "unit"), threshold)
    leads = nodes.select(F.col("node").alias("root"), F.col("first").alias("component_id"))
    linked = (
        nodes.select("label", "dim", "unit", "node", "m", "first")
        .join(counts, "node", "left")
        .join(member, "node", "left")
        .join(leads, "root", "left")
        .select(
            "label", "dim", "unit",
            (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"),
        )
    )
    out = rows.join(linked, ["label", "dim", "unit"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("unit").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
