"""Byte-level BPE as a fold over the bytes of each distinct word.

Words are found once per partition and encoded once in the corpus. A word's bytes, written as
pairs of hexadecimal digits, are folded: each step merges the leftmost of the adjacent pairs of
lowest rank. Ranks are two literal arrays, the tokens in order of rank and a table of
``2**SLOT_BITS`` slots in which each token has one of two places given by its hash, so a lookup
reads two slots and compares the tokens found there.

Encoded words go back to the partitions that hold them, where texts are joined from them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import settle, slices
from almanack.llm.words import pretokens

RANKS = "byte_bpe_multi_50k.tiktoken"
SLOT_BITS = 17
#: Longer words (in bytes) are merged with a heap where they occur, not folded.
LONGEST = 64
NONE = (1 << 31) - 1
#: ``public_tokenizers.PATTERN`` with the character classes of the whole of Unicode.
PATTERN = "(?U)" + public_tokenizers.PATTERN


def load_ranks(name: str = RANKS) -> list[bytes]:
    """Tokens in order of rank."""
    with open(public_tokenizers.path(name), "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


# ---- literals -------------------------------------------------------------------------------


def _places(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key, 42)
    return h & ((1 << SLOT_BITS) - 1), h >> 32 & ((1 << SLOT_BITS) - 1)


def slot_table(tokens: list[bytes]) -> list[int]:
    """Each rank in one of its token's two slots, by displacement; free slots hold 0."""
    table = [-1] * (1 << SLOT_BITS)
    keys = [t.hex().upper().encode() for t in tokens]
    for rank, token in enumerate(tokens):
        if not token:
            continue
        at, moving = _places(keys[rank])[0], rank
        for _ in range(1000):
            table[at], moving = moving, table[at]
            if moving < 0:
                break
            a, b = _places(keys[moving])
            at = b if at == a else a
        else:
            raise ValueError("more slots are needed")
    return [max(x, 0) for x in table]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), 0)


def fold_words(word: Column, tokens: list[bytes]) -> Column:
    """The ids of ``word`` (binary, not empty).

    Each literal stands in the expression once, bound to a variable: tasks get one copy.
    """
    digits = F.split(F.lit(",".join(t.hex().upper() for t in tokens)), ",")
    slots = F.split(F.lit(",".join(map(str, slot_table(tokens)))), ",").cast("array<int>")
    return _let(digits, lambda t: _let(slots, lambda s: _Fold(t, s).encode(word)))


class _Fold:
    """Column expressions over the two rank arrays."""

    def __init__(self, tokens: Column, slots: Column):
        self.tokens, self.slots = tokens, slots

    def rank(self, key: Column) -> Column:
        """The rank of a token in hexadecimal digits, ``NONE`` if it has none. ``key`` is read several times: pass a variable."""
        low = (1 << SLOT_BITS) - 1
        slot = lambda h: F.get(self.slots, h.bitwiseAND(low).cast("int"))
        one, two = slot(F.xxhash64(key)), slot(F.shiftrightunsigned(F.xxhash64(key), 32))
        return F.when(F.get(self.tokens, one) == key, one).when(F.get(self.tokens, two) == key, two).otherwise(F.lit(NONE))

    def _merge(self, state: Column, low: Column) -> Column:
        parts, ranks = state["parts"], state["ranks"]
        empty, most = F.array().cast("array<string>"), F.lit(1 << 20)

        def at(p: Column) -> Column:
            merged = F.get(self.tokens, low)
            pairs = F.concat(
                F.when(p > 1, F.array(F.concat(F.get(parts, p - 2), merged))).otherwise(empty),
                F.when(p + 1 < F.size(parts), F.array(F.concat(merged, F.get(parts, p + 1)))).otherwise(empty),
            )
            return F.struct(
                F.concat(F.slice(parts, 1, p - 1), F.array(merged), F.slice(parts, p + 2, most)).alias("parts"),
                F.concat(F.slice(ranks, 1, F.greatest(p - 2, F.lit(0))), F.transform(pairs, self.rank), F.slice(ranks, p + 2, most)).alias("ranks"),
            )

        return _let(F.array_position(ranks, low).cast("int"), at)

    def encode(self, word: Column) -> Column:
        def fold(parts: Column) -> Column:
            pairs = F.transform(F.slice(parts, 2, F.size(parts)), lambda b, i: F.concat(F.get(parts, i), b))
            state = F.aggregate(
                F.slice(parts, 2, F.size(parts)),
                F.struct(parts.alias("parts"), F.transform(pairs, self.rank).alias("ranks")),
                lambda s, _: _let(
                    F.coalesce(F.array_min(s["ranks"]), F.lit(NONE)),
                    lambda low: F.when(low == NONE, s).otherwise(self._merge(s, low)),
                ),
            )
            return F.transform(state["parts"], self.rank)

        def ids(digits: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.substring(digits, i, F.lit(2)))
            return F.when(self.rank(digits) != NONE, F.array(self.rank(digits))).otherwise(_let(parts, fold))

        return _let(F.hex(word), ids)


# ---- long words -----------------------------------------------------------------------------


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a word of any length, with a heap of pairs: n log n steps."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


# ---- texts ----------------------------------------------------------------------------------


def _as_bytes(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed together, about 1 MB a row, for the way to their words."""
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in slices(batches, "text", 1 << 20):
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        ends = np.cumsum([len(t) for t in texts]).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("part")[:1], pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([ends], pa.list_(pa.int64())), pa.array([squeeze.compress(b"".join(texts))], pa.binary()),
            ],
            ["part", "doc_ids", "ends", "packed"],
        )


_TOKENS: dict[str, tuple[list[bytes], dict[bytes, int]]] = {}


def _vocabulary(name: str) -> tuple[list[bytes], dict[bytes, int]]:
    if name not in _TOKENS:
        tokens = load_ranks(name)
        _TOKENS[name] = tokens, {t: r for r, t in enumerate(tokens) if t}
    return _TOKENS[name]


def _joined(name: str, finish: Callable[[list[bytes]], dict[str, pa.Array]]):
    """Texts of one partition and the ids of its words to what ``finish`` makes of the ids of texts."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        _, ranks = _vocabulary(name)
        spread = zstandard.ZstdDecompressor()
        ids = words.column("ids").combine_chunks()
        flat, at = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        known = {w: flat[i:j] for w, i, j in zip(words.column("word").to_pylist(), at, at[1:])}

        def encode(text: str) -> bytes:
            parts = pretokens(text)
            try:
                return b"".join(map(known.__getitem__, parts))
            except KeyError:  # long words, or found in another partition by an earlier run of the scan
                for w in parts:
                    if w not in known:
                        known[w] = _as_bytes(merge_word(w.encode("utf-8", "surrogatepass"), ranks))
                return b"".join(map(known.__getitem__, parts))

        out = []
        for row in range(texts.num_rows):
            body = spread.decompress(texts.column("packed")[row].as_py())
            ends = texts.column("ends")[row].as_py()
            every = [encode(body[i:j].decode("utf-8", "surrogatepass")) for i, j in zip([0, *ends], ends)]
            out.append(pa.table({"doc_id": texts.column("doc_ids")[row].values, **finish(every)}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), **finish([])})

    return run


def _encoded(docs: DataFrame, ranks: str, finish, schema: str) -> DataFrame:
    texts = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.select("part", F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("word"))
    held = found.where(F.octet_length("word") <= LONGEST).distinct()
    # a word once, with the partitions that hold it: nothing is joined back by word
    by_word = held.groupBy("word").agg(F.collect_list("part").alias("parts"))
    ids = fold_words(F.col("word").cast("binary"), load_ranks(ranks))
    encoded = settle(settle(by_word).select("word", "parts", ids.alias("ids")))
    words = encoded.select(F.explode("parts").alias("part"), "word", "ids")
    packed = texts.mapInArrow(_squeezed, "part int, doc_ids array<long>, ends array<long>, packed binary")
    return packed.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(_joined(ranks, finish), f"doc_id long, {schema}")


def encode_texts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id, ids`` of every row: all ids of its text as little-endian unsigned 32-bit numbers.

    Each match of the pattern is encoded by itself, without special tokens. A null or empty text
    has no ids. Rows are independent, so repeated or null ids need no rule.
    """
    return _encoded(docs, ranks, lambda ids: {"ids": pa.array(ids, pa.binary())}, "ids binary")


class _Decoder:
    """Token bytes end to end, with where each begins and how long it is."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Each list of ids to the bytes of its tokens, put together for all lists at once."""
        every = np.frombuffer(b"".join(ids), "<u4")
        sizes = self.sizes[every]
        ends = np.cumsum(sizes)
        data = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[every] - ends + sizes, sizes)].tobytes()
        stops = np.r_[0, ends][np.cumsum([len(b) // 4 for b in ids], dtype=np.int64)].tolist()
        return [data[i:j] for i, j in zip([0, *stops], stops)]


_DECODERS: dict[str, _Decoder] = {}


def _decoder(name: str) -> _Decoder:
    if name not in _DECODERS:
        _DECODERS[name] = _Decoder(_vocabulary(name)[0])
    return _DECODERS[name]


def decode_ids(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded``: the tokens of ``ids`` put together (bytes); null gives null."""

    @F.pandas_udf("binary")
    def back(ids):
        import pandas as pd

        decoded = _decoder(ranks).decode([b or b"" for b in ids])
        return pd.Series([None if b is None else d for b, d in zip(ids, decoded)], dtype=object)

    return encoded.withColumn("decoded", back("ids"))


def round_trips(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, decoded and digested where the ids are made."""

    def digest(ids: list[bytes]) -> dict[str, pa.Array]:
        back = _decoder(ranks).decode(ids)
        sha = lambda data: pa.array([hashlib.sha256(b).hexdigest() for b in data], pa.string())
        return {"n_tokens": pa.array([len(b) // 4 for b in ids], pa.int64()), "ids_sha256": sha(ids), "decoded_sha256": sha(back)}

    return _encoded(docs, ranks, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
