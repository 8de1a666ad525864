"""Suffix-array dedup by a depth-limited radix sort.

Two places repeat each other when the suffixes that start there agree in their first
``THRESHOLD`` bytes; a suffix array need be sorted no deeper. The sort goes by digits, most
significant first, and drops a group as soon as it holds a single suffix:

1. *Anchor.* Of the ``ANCHOR``-byte strings inside each window of ``THRESHOLD`` bytes the one with
   the smallest hash (rightmost among equals) is its anchor. The choice depends on the window's
   bytes alone, so equal windows meet under equal anchors and only one suffix in about forty
   enters the sort.
2. *Context.* Under one anchor, places with equal bytes as far as any window through the anchor
   reaches are one class. All but the first of a class repeat it in full length. Classes that
   agree with no other for half of what a window has beside its anchor are singles and leave.
3. *Depth.* The first place of each class left is expanded to its windows, which are grouped at
   full depth; equal groups are exactly the repeated windows. Anchors with few classes are
   settled side by side inside a task, those with very many by one row per window.

A byte goes if a repeated window that isn't the first of its group covers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.common import settle, slices

THRESHOLD = 100
ANCHOR = 24
#: Bytes looked at together; longer texts are cut into overlapping segments.
SEGMENT = 1 << 20

_LOW = np.uint64((1 << 24) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint64)
#: Stands for a null id, which sorts first.
NO_ID = -(1 << 63)
#: Classes under one anchor above which windows are grouped by Spark; no effect on the result.
CROWDED = 50_000
_TOGETHER = 4096


# ---- anchors --------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all ``width``-byte strings, built by doubling."""
    out, have, done = None, _BYTES[data], 1
    power, at = np.array([_BASE]), 0
    left = width
    while left:
        if left & 1:
            if out is None:
                out, at = have, done
            else:
                n = len(data) - at - done + 1
                out, at = out[:n] * power + have[at : at + n], at + done
        left >>= 1
        if left:
            n = len(have) - done
            have = have[:n] * power + have[done : done + n]
            power, done = power * power, done * 2
    return out


def _mixed(hashes: np.ndarray) -> np.ndarray:
    x = hashes ^ (hashes >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, room: np.ndarray, threshold: int = THRESHOLD, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows; ``room`` says how many bytes of the same text follow a position, itself included."""
    if len(data) < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _mixed(gram_hashes(data, anchor))
    span = threshold - anchor + 1
    place = _LOW - np.arange(len(hashes), dtype=np.uint64)
    lowest = (hashes & ~_LOW) | place
    width = 1
    while 2 * width <= span:
        lowest = np.minimum(lowest[:-width], lowest[width:])
        width *= 2
    if width < span:
        lowest = np.minimum(lowest[: width - span], lowest[span - width :])
    chosen = lowest[room[: len(lowest)] >= threshold]
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
    at = (_LOW - (chosen & _LOW)).astype(np.int64)
    return at, hashes[at]


def _segments(texts: list[bytes], threshold: int) -> Iterator[list[tuple[int, int, int]]]:
    """Portions of about ``SEGMENT`` bytes as lists of (text, from, to); long texts overlap so that each window lies in one part."""
    part, held = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - threshold + 1), SEGMENT):
            to = min(len(text), at + SEGMENT + threshold - 1)
            if part and held + to - at > SEGMENT + threshold:
                yield part
                part, held = [], 0
            part.append((k, at, to))
            held += to - at
    if part:
        yield part


def _anchor_rows(texts: list[bytes], threshold: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position, hash) of all anchors, by portion."""
    for part in _segments(texts, threshold):
        lengths = np.array([to - at for _, at, to in part])
        data = np.frombuffer(b"".join(texts[k][at:to] for k, at, to in part), dtype=np.uint8)
        ends = np.cumsum(lengths)
        room = np.repeat(ends, lengths) - np.arange(len(data))
        at, hashes = anchors(data, room, threshold, anchor)
        which = np.searchsorted(ends, at, side="right")
        text = np.array([k for k, _, _ in part])[which]
        shift = np.array([a for _, a, _ in part]) - (ends - lengths)
        yield text, at + shift[which], hashes


ROWS = "doc long, tie long, pos long, l int, r int, h long, c long, cl int, cr int, again boolean"


def _candidates(threshold: int, anchor: int):
    """Per anchor its class; ``again``: an earlier place of the same batch has the same class."""
    reach = threshold - anchor
    half = -(-reach // 2)

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "body", 4 << 20):
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = [b or b"" for b in batch.column(2).to_pylist()]
            found = list(_anchor_rows(texts, threshold, anchor))
            text, pos, h = (np.concatenate([f[k] for f in found]) for k in range(3))
            if not len(text):
                continue
            # both parts of a long text may choose the same anchor near their border
            order = np.lexsort((pos, text))
            text, pos, h = text[order], pos[order], h[order]
            own = np.r_[True, (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])]
            text, pos, h = text[own], pos[own], h[own].astype(np.uint64)
            l = np.minimum(pos, reach)
            r = np.minimum(np.array([len(t) for t in texts])[text] - pos, threshold)
            c, cl, cr = np.empty(len(text), np.uint64), [], []
            for i, (k, p, a, b) in enumerate(zip(text.tolist(), pos.tolist(), l.tolist(), r.tolist())):
                body = texts[k]
                c[i] = digest(body[p - a : p + b], (a << 16) + b)
                cl.append(digest(body[p - half : p]) & 0xFFFF if a >= half else None)
                cr.append(digest(body[p + anchor : p + anchor + half]) & 0xFFFF if b >= anchor + half else None)
            d, t = doc[text], tie[text]
            order = np.lexsort((pos, t, d, c, h))
            d, t, p, hh, cc = d[order], t[order], pos[order], h[order], c[order]
            first = np.r_[True, (hh[1:] != hh[:-1]) | (cc[1:] != cc[:-1])]
            head = np.flatnonzero(first)[np.cumsum(first) - 1]
            again = (d != d[head]) | (t != t[head]) | (p != p[head])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(d), pa.array(t), pa.array(p), pa.array(l[order].astype(np.int32)), pa.array(r[order].astype(np.int32)),
                    pa.array(hh.view(np.int64)), pa.array(cc.view(np.int64)),
                    pa.array(cl, pa.int32()).take(pa.array(order)), pa.array(cr, pa.int32()).take(pa.array(order)), pa.array(again),
                ],
                ["doc", "tie", "pos", "l", "r", "h", "c", "cl", "cr", "again"],
            )

    return run


def _classes(found: DataFrame) -> DataFrame:
    """Places that share their anchor with another: covered by a class, or worth a closer look."""
    # an ``again`` row needs no partner; it travels under a key of its own
    rows = found.withColumn("h", F.when(F.col("again"), F.xxhash64("doc", "pos")).otherwise(F.col("h"))).repartition("h")
    together = Window.partitionBy("h")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(together)).where("_n > 1 OR again")
    nth = F.dense_rank().over(Window.partitionBy("h", "c").orderBy("doc", "tie", "pos"))
    rows = rows.withColumn("covered", F.col("again") | (nth > 1))
    for side in ("cl", "cr"):
        alike = Window.partitionBy("h", side)
        rows = rows.withColumn(f"_{side}", F.col(side).isNotNull() & (F.min("c").over(alike) != F.max("c").over(alike)))
    return rows.where("covered OR _cl OR _cr").select("doc", "tie", "pos", "l", "r", "h", "covered")


# ---- full depth -----------------------------------------------------------------------------

CONTEXTS = "h long, doc long, tie long, pos long, l int, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each place of a text."""
    for batch in slices(batches, "body", 4 << 20):
        rows = []
        for doc, tie, body, places in zip(*(batch.column(k).to_pylist() for k in range(4))):
            rows += [(p["h"], doc, tie, p["pos"], p["l"], body[p["pos"] - p["l"] : p["pos"] + p["r"]]) for p in places]
        for at in range(0, len(rows), 50_000):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows[at : at + 50_000]), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc", "tie", "pos", "l", "context"])


def _settle_groups(threshold: int, anchor: int):
    """Contexts sorted by anchor and place to the spans of windows that repeat earlier ones."""
    reach, wide = threshold - anchor, 2 * threshold - anchor

    def resolve(rows: pa.Table) -> pa.RecordBatch:
        h, doc, tie, pos, l = (rows.column(k).to_numpy() for k in range(5))
        contexts = rows.column(5).to_pylist()
        sizes = np.array([len(x) for x in contexts])
        l = l.astype(np.int64)
        block = b"".join(bytes(reach - a) + x + bytes(wide - (reach - a) - len(x)) for a, x in zip(l.tolist(), contexts))
        m = len(h)
        data = np.frombuffer(block, np.uint8)
        windows = _mixed(gram_hashes(data, threshold))
        starts = np.arange(m)[:, None] * wide + np.arange(reach + 1)[None, :]
        group = np.cumsum(np.r_[False, h[1:] != h[:-1]]).astype(np.uint64)
        # windows are compared under one anchor and at one distance from it
        own = windows[starts] ^ _mixed((group[:, None] * np.uint64(reach + 1) + np.arange(reach + 1, dtype=np.uint64)) * _BASE)
        column = np.arange(reach + 1)[None, :]
        whole = (column >= (reach - l)[:, None]) & (column + threshold <= (reach - l + sizes)[:, None])
        at, where = np.nonzero(whole)
        key = own[at, where]
        order = np.argsort(key, kind="stable")
        key, at, where = key[order], at[order], where[order]
        first = np.r_[True, key[1:] != key[:-1]]
        head = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
        same = (doc[at] == doc[head]) & (tie[at] == tie[head]) & (pos[at] == pos[head])
        at, where = at[~same], where[~same]
        order = np.lexsort((where, at))
        at, where = at[order], where[order]
        begin = np.r_[True, (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)] if len(at) else np.zeros(0, bool)
        end = np.r_[begin[1:], True] if len(at) else begin
        a, lo, hi = at[begin], where[begin], where[end] + threshold
        lo, hi = pos[a] - reach + lo, pos[a] - reach + hi
        return pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(tie[a]), pa.array(lo), pa.array(hi)], ["doc", "tie", "lo", "hi"])

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, now]) if held is not None else now
            h = held.column(0).to_numpy()
            change = np.flatnonzero(h[1:] != h[:-1]) + 1
            while len(change) and change[-1] >= _TOGETHER:
                cut = int(change[np.searchsorted(change, _TOGETHER)])
                yield resolve(held.slice(0, cut))
                held = held.slice(cut)
                change = change[change > cut] - cut
        if held is not None and held.num_rows:
            yield resolve(held)

    return run


def _window_rows(threshold: int):
    """One row per window of a context, for anchors with too many classes for one task."""

    def run(batches):
        for batch in batches:
            for h, doc, tie, pos, l, context in zip(*(batch.column(k).to_pylist() for k in range(6))):
                starts = range(0, min(l, len(context) - threshold) + 1)
                hashes = [xxhash.xxh3_128_intdigest(context[s : s + threshold]) for s in starts]
                if hashes:
                    n = len(hashes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x >> 65 for x in hashes]), pa.array([x & (1 << 63) - 1 for x in hashes]),
                            pa.array([doc] * n), pa.array([tie] * n), pa.array([pos - l + s for s in starts]),
                        ],
                        ["w1", "w2", "doc", "tie", "start"],
                    )

    return run


def _deep(contexts: DataFrame, threshold: int, anchor: int, crowded: int) -> DataFrame:
    heavy = settle(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded).select("h"))
    if heavy.isEmpty():
        few, many = contexts, None
    else:
        few, many = contexts.join(heavy, "h", "left_anti"), contexts.join(heavy, "h", "left_semi")
    dealt = few.repartition("h").sortWithinPartitions("h", "doc", "tie", "pos")
    spans = dealt.select("h", "doc", "tie", "pos", "l", "context").mapInArrow(_settle_groups(threshold, anchor), "doc long, tie long, lo long, hi long")
    if many is None:
        return spans
    each = many.select("h", "doc", "tie", "pos", "l", "context").mapInArrow(_window_rows(threshold), "w1 long, w2 long, doc long, tie long, start long")
    each = settle(each)
    place = F.struct("doc", "tie", "start")
    first = each.groupBy("w1", "w2").agg(F.min(place).alias("_first"))
    later = each.join(first, ["w1", "w2"]).where(F.col("_first") < place)
    return spans.unionByName(later.select("doc", "tie", F.col("start").alias("lo"), (F.col("start") + threshold).alias("hi")))


def repeated_spans(bodies: DataFrame, threshold: int = THRESHOLD, anchor: int = ANCHOR, crowded: int = CROWDED) -> DataFrame:
    """``doc, tie, lo, hi``: byte ranges covered by windows that also start earlier; they may overlap.

    ``bodies`` has ``doc``, ``tie`` (together they name a text; no nulls) and ``body`` (bytes).
    Earlier means smaller ``doc``, then ``tie``, then start.
    """
    found = bodies.select("doc", "tie", "body").mapInArrow(_candidates(threshold, anchor), ROWS)
    classes = settle(_classes(found))
    covered = classes.where("covered").select("doc", "tie", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r")).alias("hi"))
    open_ = classes.where("NOT covered").groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "pos", "l", "r")).alias("places"))
    with_text = bodies.join(open_, ["doc", "tie"]).select("doc", "tie", "body", "places")
    contexts = settle(with_text.mapInArrow(_contexts, CONTEXTS))
    return covered.unionByName(_deep(contexts, threshold, anchor, crowded))


# ---- removal --------------------------------------------------------------------------------


def cut_spans(body: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``body``, how many bytes went, and in how many maximal runs."""
    kept, removed, runs, at = [], 0, 0, 0
    last = -1
    for lo, hi in sorted(spans):
        if lo > last:
            kept.append(body[at:lo])
            runs += 1
            removed += hi - lo
            last = at = hi
        elif hi > last:
            removed += hi - last
            last = at = hi
    kept.append(body[at:])
    return b"".join(kept), removed, runs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "body", 4 << 20):
        rows = [
            cut_spans(body, [(x["lo"], x["hi"]) for x in spans or ()])
            for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist())
        ]
        kept, removed, runs = zip(*rows)
        more = [batch.column(n) for n in batch.schema.names if n not in ("body", "spans")]
        names = [n for n in batch.schema.names if n not in ("body", "spans")]
        yield pa.RecordBatch.from_arrays(
            [*more, pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            [*names, "kept", "n_removed", "n_spans"],
        )


def _bodies(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("tie"),
        text.cast("binary").alias("body"),
    )


def drop_repeats(docs: DataFrame, threshold: int = THRESHOLD, anchor: int = ANCHOR, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, n_bytes, kept, n_removed, n_spans`` per row: the text without repeated windows.

    Strings are judged on the input, overlaps count, and no match crosses documents. A null text
    counts as empty; a text shorter than ``threshold`` bytes keeps all. Null ids sort first.
    Texts that share an id are ordered by a hash; rows equal in id and text are one document,
    given once per row.
    """
    bodies = _bodies(docs)
    spans = settle(repeated_spans(bodies, threshold, anchor, crowded))
    by_text = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = bodies.join(by_text, ["doc", "tie"], "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), F.octet_length("body").cast("long").alias("n_bytes"), "body", "spans"
    )
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated windows cut out of ``text``; every row and column stays.

    Where a cut splits a character its other bytes go too. ``n_chars``, where present, follows
    the new text.
    """
    spans = settle(repeated_spans(_bodies(docs)))
    by_text = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    @F.pandas_udf("string")
    def rest(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or s is None else cut_spans(t.encode(), [(x["lo"], x["hi"]) for x in s])[0].decode("utf-8", "ignore"))

    joined = docs.join(
        by_text,
        (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("doc")) & (F.xxhash64(text) == F.col("tie")),
        "left",
    ).withColumn("text", rest("text", "_spans"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
