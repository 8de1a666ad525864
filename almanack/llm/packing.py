"""Best-fit packing of token sequences by exact complements.

Lengths are at most ``capacity``, so the histogram of lengths has at most that many entries at
any corpus size. The packing is planned on the histogram: a *pattern* is a list of lengths that
share one sequence, used as often as the counts allow. Every pattern uses up at least one
length, so the plan is bounded too. Only the plan reaches the driver and the tasks; pieces
find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanack.llm.common import settle, slices

CAPACITY = 2048
END_OF_TEXT = 0
#: Starts of ranks (24 bytes per task and length) are broadcast up to so many.
FEW_STARTS = 500_000


# ---- tokens ---------------------------------------------------------------------------------


class _Encoder:
    """Ids of whole texts as the tokenizer gives them, found by its ranks.

    The ranks are the same vocabulary, and their library the faster one. A text that spells a special
    token goes to the tokenizer itself, which gives it that token's id.
    """

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if any(s in text for s in self.special):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text)
            yield np.asarray(ids, dtype="<u4").tobytes()


_ENCODERS: dict[tuple[str, str], _Encoder] = {}


def _encoder(path: str, ranks: str) -> _Encoder:
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = _Encoder(path, ranks)
    return _ENCODERS[path, ranks]


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole capacities, the shorter rest first."""
    start = n % capacity
    if start:
        yield 0, start
    for at in range(start, n, capacity):
        yield at, capacity


def token_pieces(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, digests: bool = False
) -> DataFrame:
    """One row per piece: its document's ids (and the end id 0) cut to at most ``capacity``.

    A null text counts as empty and gives the end id alone. ``ids`` holds little-endian unsigned
    32-bit numbers; with ``digests`` their CRC-32 stands instead, as ``ids_crc32``. ``ranks`` must be
    the vocabulary of ``tokenizer``. Rows with equal or null ``doc_id`` are documents of their own.
    """
    paths = public_tokenizers.path(tokenizer), public_tokenizers.path(ranks)
    end = np.asarray([END_OF_TEXT], dtype="<u4").tobytes()
    last, kind, made = ("ids_crc32", pa.int64(), zlib.crc32) if digests else ("ids", pa.binary(), bytes)

    def run(batches):
        encoder, part, seen = _encoder(*paths), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids += end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((doc, piece, start, length, made(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind, pa.int32(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", last, "_part", "_rank"])

    layout = f"doc_id long, piece int, start long, length long, {last} {'long' if digests else 'binary'}, _part int, _rank long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, layout)


# ---- plan -----------------------------------------------------------------------------------


def _best_pair(left: list[int], bits: int, mirror: int, total: int, capacity: int, most: int) -> tuple[int, int] | None:
    """Two lengths left that sum to ``total``, the first as large as possible and at most ``most``."""
    if total < 2:
        return None
    found = bits & (mirror >> (capacity - total)) & ((1 << (min(most, total - 1) + 1)) - 2)
    while found:
        a = found.bit_length() - 1
        if a < total - a:
            return None
        if a != total - a or left[a] >= 2:
            return a, total - a
        found ^= 1 << a
    return None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often) so that each length is used exactly as often as ``counts`` says.

    From the longest length down: a single, a pair or a triple of other lengths that fills the
    gap exactly is used as often as the counts allow. What finds no exact complement goes to
    best fit: the fullest open sequence that still has room.
    """
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    bits = sum(1 << n for n, c in counts.items() if c)
    mirror = sum(1 << (capacity - n) for n, c in counts.items() if c)

    def take(n: int, times: int) -> None:
        nonlocal bits, mirror
        left[n] -= times
        if not left[n]:
            bits &= ~(1 << n)
            mirror &= ~(1 << (capacity - n))

    patterns: list[tuple[tuple[int, ...], int]] = []
    rest: dict[int, int] = {}
    for n in range(capacity, 0, -1):
        while left[n]:
            gap = capacity - n
            take(n, 1)  # the one that opens the sequence
            if gap == 0:
                fill: tuple[int, ...] | None = ()
            elif left[gap]:
                fill = (gap,)
            else:
                fill = _best_pair(left, bits, mirror, gap, capacity, gap)
                firsts = bits & ((1 << gap) - 1)
                while fill is None and firsts:
                    a = firsts.bit_length() - 1
                    firsts ^= 1 << a
                    if 3 * a < gap:
                        break
                    take(a, 1)
                    pair = _best_pair(left, bits, mirror, gap - a, capacity, a)
                    left[a] += 1
                    bits |= 1 << a
                    mirror |= 1 << (capacity - a)
                    fill = (a, *pair) if pair else None
            left[n] += 1
            bits |= 1 << n
            mirror |= 1 << (capacity - n)
            if fill is None:
                rest[n] = left[n]
                take(n, left[n])
                break
            pattern = (n, *fill)
            times = min(left[x] // pattern.count(x) for x in set(pattern))
            for x in pattern:
                take(x, times)
            patterns.append((pattern, times))
    return patterns + _best_fit(rest, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on groups of sequences with equal contents."""
    done: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = 0  # bit g: a sequence with room for g is open

    def put(pattern: tuple[int, ...], times: int) -> None:
        nonlocal gaps
        room = capacity - sum(pattern)
        if room:
            open_.setdefault(room, []).append((pattern, times))
            gaps |= 1 << room
        else:
            done.append((pattern, times))

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            fitting = gaps >> n
            if not fitting:
                each = capacity // n
                if todo >= each:
                    put((n,) * each, todo // each)
                    todo %= each
                if todo and not gaps >> n:
                    put((n,) * todo, 1)
                    todo = 0
                continue
            room = n + (fitting & -fitting).bit_length() - 1
            pattern, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                gaps ^= 1 << room
            used = min(times, todo)
            if times > used:
                put(pattern, times - used)
            put((*pattern, n), used)
            todo -= used
    return done + [x for group in open_.values() for x in group]


def place_table(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, per sequence, offset), ordered by length and rank."""
    seen: dict[int, int] = {}
    rows, first = [], 0
    for pattern, times in patterns:
        at = 0
        for n in sorted(set(pattern), reverse=True):
            each = pattern.count(n)
            rows.append((n, seen.get(n, 0), first, each, at))
            seen[n] = seen.get(n, 0) + each * times
            at += each * n
        first += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ---- placement ------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id``, ``piece`` and ``length``.

    Other columns are carried. Sequences have no gaps and hold at most ``capacity`` tokens. An
    empty table gives an empty result; a length outside 1..capacity is an error. Equal lengths
    are ranked inside the task that wrote them, so a frequent length is never gathered; pieces that
    bring their ranks (``_part``, ``_rank``) move no more, as long as the ranks' starts can be broadcast.
    """
    ranked = "_rank" in pieces.columns
    fixed = settle(pieces if ranked else pieces.withColumn("_part", F.spark_partition_id()))
    here = settle(fixed.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = place_table(plan_patterns(counts, capacity))

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = here.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    if not ranked:
        inside = F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "piece"))
        fixed = fixed.withColumn("_rank", inside - 1)
    few = here.count() <= FEW_STARTS
    ranked_rows = fixed.join(F.broadcast(starts) if few else starts, ["_part", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        # (length, rank) as one number: no rank reaches 2**46
        row = places[np.searchsorted((places[:, 0] << 46) + places[:, 1], (n << 46) + r, side="right") - 1]
        turn = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + turn // row[:, 3], "offset": row[:, 4] + turn % row[:, 3] * n})

    placed = ranked_rows.withColumn("_place", place("length", F.col("_from") + F.col("_rank")))
    return placed.select(*[c for c in pieces.columns if c not in ("_part", "_rank")], "_place.sequence_id", "_place.offset")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, **tokens) -> DataFrame:
    """Every piece of every document with its ids and its place; ``tokens`` go to :func:`token_pieces`."""
    return pack(token_pieces(docs, capacity=capacity, **tokens), capacity)
