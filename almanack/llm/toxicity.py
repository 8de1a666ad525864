"""Toxicity by compression distance: zstandard with an ordinary and with a toxic dictionary.

The ordinary dictionary is text of frequent words of ordinary documents. The toxic one is the
same text preceded by the words of toxic documents that ordinary ones lack, so a window that
is shorter under the toxic dictionary owes it to toxic text alone. Windows are one word wide
(a long word is cut) and written in UTF-16, in which a short word outweighs the cost of a
match. Each window gives two relative savings, one for lazy and one for optimal parsing; how
many windows of a document pass each of a row of thresholds is calibrated to a probability by
a logistic regression on labelled documents that the dictionaries didn't see.

Fit on a bounded sample of labelled rows, at most ``SAMPLE`` of either label, whole texts. Rows with crc32(doc_id) mod 5 = 0 are held
out, 1 and 2 train the dictionaries, 3 and 4 calibrate.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import settle, slices

SAMPLE = 6000
ORDINARY_WORDS = 1500
TOXIC_WORDS = 3000
#: A word is toxic text's own if so many toxic documents have it, and its log odds exceed ...
LEAST_DOCUMENTS = 3
LEAST_LOG_ODDS = 2.0
WIDEST = 32
THRESHOLDS = np.round(np.arange(0.10, 0.75, 0.05), 2)
REMEMBERED = 400_000
_BINS = len(THRESHOLDS) + 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_fold(doc_id) == 0, F.lit(False))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def words(text: str | None) -> list[str]:
    """Lower-case words; one over ``WIDEST`` characters is cut into pieces of that length."""
    out = (text or "").lower().split()
    if any(len(w) > WIDEST for w in out):
        out = [w[i : i + WIDEST] for w in out for i in range(0, len(w), WIDEST)]
    return out


def _bytes(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


def _parameters(strategy: int, shortest: int) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, chain_log=16, hash_log=16, search_log=6,
        min_match=shortest, target_length=64, strategy=strategy,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )


PARSERS = ((zstandard.STRATEGY_LAZY2, 5), (zstandard.STRATEGY_BTOPT, 4))


class _Meter:
    """Saving classes of windows under a pair of dictionaries; remembers windows already met."""

    def __init__(self, ordinary: str, toxic: str):
        self.pairs = []
        for strategy, shortest in PARSERS:
            how = _parameters(strategy, shortest)
            pair = []
            for content in (ordinary, toxic + ordinary):
                held = zstandard.ZstdCompressionDict(_bytes(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=how)
                pair.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))
            self.pairs.append(pair)
        self.known: dict[str, int] = {}

    @staticmethod
    def _lengths(compressor, data: bytes, segments: bytes, n: int) -> np.ndarray:
        out = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments))
        return np.fromiter((len(out[i]) for i in range(n)), np.int64, n)

    def _measure(self, new: list[str]) -> None:
        windows = [_bytes(f" {w} ") for w in new]
        sizes = np.array([len(w) for w in windows], dtype="<u8")
        starts = np.cumsum(sizes, dtype="<u8") - sizes
        data, segments = b"".join(windows), np.stack([starts, sizes], axis=1).astype("<u8").tobytes()
        classes = []
        for ordinary, toxic in self.pairs:
            saved = self._lengths(ordinary, data, segments, len(new)) - self._lengths(toxic, data, segments, len(new))
            classes.append(np.searchsorted(THRESHOLDS, saved / sizes.astype(float) + 1e-9, side="right"))
        self.known.update(zip(new, (classes[0] * _BINS + classes[1]).tolist()))

    def features(self, texts: list[str | None]) -> np.ndarray:
        rows = []
        for text in texts:
            ws = words(text)
            new = list({w for w in ws if w not in self.known})
            if new:
                if len(self.known) + len(new) > REMEMBERED:
                    self.known.clear()
                    new = list(set(ws))
                self._measure(new)
            counts = np.bincount(np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)), minlength=_BINS * _BINS)
            grid = counts.reshape(_BINS, _BINS)
            above = [np.cumsum(grid.sum(axis=k)[::-1])[::-1][1:] for k in (1, 0)]
            rows.append(np.log1p(np.concatenate([*above, [len(ws)]])))
        return np.array(rows).reshape(len(texts), 2 * len(THRESHOLDS) + 1)


_METERS: dict[str, _Meter] = {}


@dataclasses.dataclass
class Model:
    """Dictionaries and calibration; small, and all that the tasks need."""

    name: str
    ordinary: str
    toxic: str
    base: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def features(self, texts: list[str | None]) -> np.ndarray:
        if self.name not in _METERS:
            _METERS.clear()
            _METERS[self.name] = _Meter(self.ordinary, self.toxic)
        return _METERS[self.name].features(texts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        x = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, ...]:
    """Weighted ridge logistic regression by Newton steps: centre, scale, weights."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = np.zeros(z.shape[1])
    penalty = ridge * np.r_[1e-6, np.ones(len(w) - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (weight * (p - y)) + penalty * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            if own := set(words(text)):
                yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([toxic] * len(own), pa.int32())], ["word", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of ``docs`` that aren't held out.

    Labels other than 0 and 1 and rows without an id are left out; of several labels of a
    document the largest counts. With one class or none the model answers the share of toxic
    rows, 0 if there are none.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("calibrates", _fold(F.col("doc_id")) >= 3)
    )
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample))
    # at most twice ``sample`` ids, so that texts stay where they are
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id"))

    seen = rows.where("NOT calibrates")
    n = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if not n.get(0) or not n.get(1):
        return Model(uuid.uuid4().hex, "", "", share)
    counts = settle(
        seen.select("text", "toxic").mapInArrow(_distinct_words, "word string, toxic int")
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    )
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("o") + 0.5) / (n[0] + 1))
    own = counts.where((F.col("t") >= LEAST_DOCUMENTS) & (odds > LEAST_LOG_ODDS)).orderBy(F.desc("t"), "word").limit(TOXIC_WORDS)
    common = counts.where("o > 0").orderBy(F.desc("o"), "word").limit(ORDINARY_WORDS)
    # the most frequent last: the shorter the way back, the shorter a match
    toxic, ordinary = (" " + " ".join([r["word"] for r in x.collect()][::-1]) + " " for x in (own, common))

    model = Model(uuid.uuid4().hex, ordinary, toxic, share)
    width = 2 * len(THRESHOLDS) + 1

    def measure(batches):
        for batch in slices(batches, "text"):
            x = model.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    found = rows.where("calibrates").select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in found], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(uuid.uuid4().hex, "", "", share)
    x = np.array([r["x"] for r in found]).reshape(-1, width)
    # either label is sampled on its own; weights restore their shares
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    order_ = np.lexsort((*x.T[::-1], y))
    model.centre, model.scale, model.weights = calibrate(x[order_], y[order_], (weight * len(y) / weight.sum())[order_])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1; a null text counts as empty."""

    @F.pandas_udf("double")
    def rated(texts):
        import pandas as pd

        return pd.Series(model.scores([None if t is None else str(t) for t in texts]), dtype="float64")

    return docs.withColumn("score", rated(F.col("text").cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    rated = score(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text")), fit(docs, labels))
    return rated.where("score < 0.5").select("_row.*")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; only the text decides the score."""
    rated = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), fit(docs, labels))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
