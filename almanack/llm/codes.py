"""Product quantisation of integer vectors, nearest entries found by Orchard's search.

A vector's components are scaled to integers and cut into equal consecutive parts. Each part
position has a codebook: it starts as that part of the first vectors by id and is moved in a
few rounds to the floor of the mean of the parts nearest to each entry. Only codebooks
(entries x dimension integers) and their sums reach the driver.

Orchard's search: every entry holds the list of all entries by distance from it. From a
current entry the list is walked; an entry nearer to the part becomes current and its list is
walked from the start; entries already compared are marked. An entry further from the current
one than twice the current distance can't be nearer than it (triangle inequality), so there
the walk ends. One *exactly* that far can still tie, so it is compared. All parts of a batch
take their steps side by side.

Rows whose vector is null or empty, holds a null or non-finite component, or has another length
than the first kept vector by id are dropped. Rows with a null id are coded but start no entry;
repeated ids start one entry a row, in order of their vectors. Fewer rows than entries: the
codebooks are that much shorter. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import settle

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Scaled components up to here keep squared distances of a part exact in 64 bits.
LARGEST = 1 << 26
#: Label sums up to so many rows (16 bytes each) are broadcast; beyond, they are joined by salted key.
FEW_LABELS = 200_000
SALTS = 16


@dataclasses.dataclass
class Codebooks:
    """entries[part, index, component], with each entry's list of entries by distance."""

    entries: np.ndarray

    def __post_init__(self):
        gaps = self.entries[:, :, None, :] - self.entries[:, None, :, :]
        self.between = (gaps * gaps).sum(axis=3)
        self.lists = np.argsort(self.between, axis=2, kind="stable")

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every part; the lower index on a tie."""
        found = [
            _orchard(vectors[:, p * self.width : (p + 1) * self.width], self.entries[p], self.between[p], self.lists[p])
            for p in range(len(self.entries))
        ]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _orchard(parts: np.ndarray, entries: np.ndarray, between: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, k = len(parts), len(entries)
    best = np.zeros(n, np.int64)
    gap = parts - entries[0]
    least = (gap * gap).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    place = np.zeros(n, np.int64)
    going = np.arange(n)
    while len(going):
        going = going[place[going] < k]
        current = best[going]
        other = lists[current, place[going]]
        near = between[current, other] <= 4 * least[going]  # beyond twice the distance nothing is nearer
        going, other = going[near], other[near]
        place[going] += 1
        new = ~seen[going, other]
        rows, other = going[new], other[new]
        seen[rows, other] = True
        gap = parts[rows] - entries[other]
        far = (gap * gap).sum(axis=1)
        better = (far < least[rows]) | ((far == least[rows]) & (other < best[rows]))
        rows, other = rows[better], other[better]
        best[rows], least[rows], place[rows] = other, far[better], 0
    return best, least


def whole_vectors(df: DataFrame, vector: str = "embedding") -> Column:
    """True where a vector is neither null nor empty and all its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(F.col(vector), finite), F.lit(False))


def _scaled(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values * SCALE)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} can't be compared exactly")
    return scaled.astype(np.int64)


def _integers(column: pa.Array, dimension: int) -> np.ndarray:
    return _scaled(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension))


def _update(kept: DataFrame, books: Codebooks, dimension: int) -> Codebooks:
    """Entries moved to the floor of their parts' mean. A task adds up what it holds, Spark adds the tasks' sums."""
    parts, size, width = books.entries.shape
    cells = parts * size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((cells, width), np.int64), np.zeros(cells, np.int64)
        for batch in batches:
            vectors = _integers(batch.column("embedding"), dimension)
            index, _ = books.assign(vectors)
            for p in range(parts):
                at = p * size + index[:, p]
                np.add.at(total, at, vectors[:, p * width : (p + 1) * width])
                count += np.bincount(at, minlength=cells)
        used = np.flatnonzero(count)
        yield pa.record_batch({
            "cell": np.repeat(used, width), "place": np.tile(np.arange(width), len(used)),
            "total": total[used].ravel(), "n": np.repeat(count[used], width),
        })

    moved = (
        kept.select("embedding").mapInArrow(sums, "cell long, place long, total long, n long")
        .groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    entries = books.entries.copy().reshape(cells, width)
    for r in moved.collect():  # entries x dimension rows
        entries[r["cell"], r["place"]] = r["total"] // r["n"]
    return Codebooks(entries.reshape(parts, size, width))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the whole vectors ``kept`` (vec_id, embedding); None without any with an id."""
    named = kept.where("vec_id IS NOT NULL").select("vec_id", "embedding").orderBy("vec_id", "embedding")
    first = named.limit(1).collect()
    if not first:
        return None
    dimension = len(first[0]["embedding"])
    if dimension % parts:
        raise ValueError(f"{dimension} components can't be cut into {parts} equal parts")
    first = named.where(F.size("embedding") == dimension).limit(entries).collect()
    start = _scaled(np.array([r["embedding"] for r in first], np.float64)).reshape(-1, parts, dimension // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _update(kept.where(F.size("embedding") == dimension), books, dimension)
    return books


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256): every whole vector of ``df`` by its parts' nearest entries.

    ``code`` is binary, one byte a part; ``error`` the squared distances added up.
    """
    if entries > 256:
        raise ValueError("a code has one byte a part")
    kept = df.select("vec_id", "embedding", "label").where(whole_vectors(df))
    out = "vec_id long, label int, code binary, error long, codebooks_sha256 string"
    books = train(kept, parts, entries, rounds)
    if books is None:
        return df.sparkSession.createDataFrame([], out)
    dimension, digest = books.width * parts, books.digest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, least = books.assign(_integers(batch.column("embedding"), dimension))
            code = [row.tobytes() for row in index.astype(np.uint8)]
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").cast(pa.int64()), "label": batch.column("label").cast(pa.int32()),
                "code": pa.array(code, pa.binary()), "error": least.sum(axis=1),
                "codebooks_sha256": pa.array([digest] * batch.num_rows, pa.string()),
            })

    return kept.where(F.size("embedding") == dimension).mapInArrow(encode, out)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels, null labels together.

    A label is read from rows already written. Its sum is one row: few sums are broadcast, many
    are joined with rows dealt over ``SALTS`` copies of them, so a frequent label is no one task's.
    """
    fixed = settle(coded)
    sums = fixed.groupBy("label").agg(F.sum("error").alias("label_error"))
    key = lambda d: d.withColumn("_label", F.coalesce("label", F.lit(0))).withColumn("_none", F.col("label").isNull())
    sums = settle(key(sums).drop("label"))
    if sums.count() <= FEW_LABELS:
        return key(fixed).join(F.broadcast(sums), ["_label", "_none"]).drop("_label", "_none")
    dealt = key(fixed).withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    copies = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["_label", "_none", "_salt"]).drop("_label", "_none", "_salt")
