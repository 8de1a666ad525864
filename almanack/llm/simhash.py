"""SimHash near-duplicates: banded candidates, compared on vertical bit planes.

Fingerprints within ``RADIUS`` = 2 bits agree in two of four 16-bit bands at least, so the six
pairs of bands are six lossless keys of 32 bits. Fingerprints under one key are compared bit
plane by bit plane, 64 of them in a machine word, with a carry-save counter of three planes;
a comparison ends as soon as every distance left exceeds the radius. A key with very many
fingerprints is divided again by the same rule on its 32 free bits, after which 16 bits are
free and no key can hold more than 65,536.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.common import settle, slices
from almanack.llm.components import components

RADIUS = 2
SEED = 42
SHINGLE = 3
#: Fingerprints under one key above which the key is divided further; no effect on the result.
FULL = 4096
_BLOCK = 1024
_AT_ONCE = 1 << 21  # comparisons in one call of the kernel
_SHINGLES_AT_ONCE = 1 << 16


# ---- fingerprints ---------------------------------------------------------------------------


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; 0 without words.

    Words are runs without ASCII white space, A-Z lowered. A text of fewer than ``width`` words
    is one shingle. A bit is set if more than half of the hashes have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    width = min(width, len(words))
    spans = list(zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()))
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), _SHINGLES_AT_ONCE):
        part = np.array([digest(line[i:j], SEED) for i, j in spans[at : at + _SHINGLES_AT_ONCE]], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""

    def run(batches):
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---- comparison on bit planes ---------------------------------------------------------------


def near_pairs(prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of ``prints`` at most ``radius`` (0 to 2) bits apart, in portions."""
    m = len(prints)
    words = -(-m // 64)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    padded = np.zeros((64, words * 64), dtype=np.uint8)
    padded[:, :m] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    step = max(1, _AT_ONCE // max(m, 1))
    columns = np.arange(words * 64)
    for at in range(0, m, step):
        rows = np.arange(at, min(at + step, m))
        out = (columns[None, :] <= rows[:, None]) | (columns[None, :] >= m)
        over = np.packbits(out, axis=1, bitorder="little").view("<u8")
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        flip = (np.uint64(0) - bits[rows].astype(np.uint64)).T
        far = over
        for plane in range(64):
            differ = planes[plane][None, :] ^ flip[plane][:, None]
            carry = ones & differ
            ones = ones ^ differ
            over = over | (twos & carry)
            twos = twos ^ carry
            if plane % 8 == 7:
                far = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
                alive = ~(far == ~np.uint64(0)).all(axis=1)
                if not alive.any():
                    rows = rows[:0]
                    break
                if not alive.all():
                    rows, over, ones, twos, far, flip = rows[alive], over[alive], ones[alive], twos[alive], far[alive], flip[:, alive]
        if len(rows):
            near = np.unpackbits((~far).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            yield rows[i], j


def _roots(prints: np.ndarray) -> np.ndarray:
    """For each print the smallest index that it reaches by links."""
    root = np.arange(len(prints))
    for i, j in near_pairs(prints):
        while True:
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while (root[root] != root).any():
                root = root[root]
    while (root[root] != root).any():
        root = root[root]
    return root


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (which, key, fp, first) to links (first, root) inside each key."""

    def groups() -> Iterator[tuple[np.ndarray, ...]]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            if len(change):
                yield tuple(x[: change[-1]] for x in held)
                held = [x[change[-1] :] for x in held]
        if held and len(held[0]):
            yield tuple(held)

    for which, key, fp, first in groups():
        starts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        several = np.repeat(sizes > 1, sizes)
        fp, first, sizes = fp[several].view(np.uint64), first[several], sizes[sizes > 1]
        ends, at = np.cumsum(sizes), 0
        while at < len(fp):
            stop = int(ends[min(np.searchsorted(ends, at + _BLOCK), len(ends) - 1)])
            root = _roots(fp[at:stop])
            moved = np.flatnonzero(root != np.arange(stop - at))
            if len(moved):
                part = first[at:stop]
                yield pa.RecordBatch.from_arrays([pa.array(part[moved]), pa.array(part[root[moved]])], ["a", "b"])
            at = stop


def _part(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)


def _key(fp: Column, spans: list[tuple[int, int]]) -> Column:
    key = F.lit(0).cast("long")
    for at, width in spans:
        key = F.shiftleft(key, width).bitwiseOR(_part(fp, at, width))
    return key


BANDS = [(0, 16), (16, 16), (32, 16), (48, 16)]


def _coarse() -> list[list[tuple[int, int]]]:
    return [list(x) for x in itertools.combinations(BANDS, 2)]


def _fine() -> list[list[tuple[int, int]]]:
    """Each coarse key with two of the four bytes that it leaves free: 48 of 64 bits."""
    out = []
    for fixed in _coarse():
        free = [(at + k, 8) for at, _ in BANDS if (at, 16) not in fixed for k in (0, 8)]
        out += [[*fixed, *x] for x in itertools.combinations(free, 2)]
    return out


def _keyed(prints: DataFrame, specs: list[list[tuple[int, int]]], ids: list[int]) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(k).alias("which"), _key(F.col("fp"), specs[k]).alias("key")) for k in ids))
    return prints.select(F.explode(keys).alias("_k"), "fp", "first").select("_k.which", "_k.key", "fp", "first")


def links(prints: DataFrame, full: int = FULL) -> DataFrame:
    """Links (a, b) that connect exactly what pairs within the radius connect.

    ``prints``: distinct ``fp`` with ``first``, its id. Inside a key every member is linked to
    one root, so no key emits more links than it has members.
    """
    coarse, fine = _coarse(), _fine()
    keyed = _keyed(prints, coarse, range(len(coarse)))
    crowded = settle(keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > full).drop("_n"))
    plain = keyed
    hot = not crowded.isEmpty()
    if hot:
        plain = keyed.join(crowded, ["which", "key"], "left_anti")
    found = _compare(plain)
    if hot:
        inside = keyed.join(crowded, ["which", "key"], "left_semi")
        parts = [
            _keyed(inside.where(F.col("which") == k), fine, range(6 * k, 6 * k + 6)) for k in range(len(coarse))
        ]
        for part in parts:
            found = found.unionByName(_compare(part))
    return found


def _compare(keyed: DataFrame) -> DataFrame:
    dealt = keyed.repartition("which", "key").sortWithinPartitions("which", "key")
    return dealt.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, full: int = FULL) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``.

    Fingerprints link at ``RADIUS`` or fewer differing bits; ``component_id`` is the smallest
    ``doc_id`` reachable. Null and wordless texts have fingerprint zero, linked like any other.
    Rows with a null id belong to the component of their fingerprint, which is null if no row
    with that fingerprint has an id. Rows that repeat an id are rows of one document.
    """
    rows = settle(fingerprints(docs))
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(prints.where(F.col("first").isNotNull()), full), "a", "b")
    named = prints.join(found, F.col("first") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "first").alias("component_id")
    )
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of rows that repeat an id the one with the smallest text stays (nulls first). Rows without
    an id can't be told apart by it and stay.
    """
    judged = near_duplicates(docs.select("doc_id", "text"))
    keep = judged.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    order = Window.partitionBy("doc_id").orderBy("text")
    kept = (
        docs.where(F.col("doc_id").isNotNull())
        .join(keep, F.col("doc_id") == F.col("_kept"))
        .withColumn("_nth", F.row_number().over(order))
        .where("_nth = 1")
        .select(*docs.columns)
    )
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
