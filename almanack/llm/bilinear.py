"""Language-model scores by a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Tokens are a text's words in lower case (A to Z only) and one end. A token's probability is

    P(token | context) = P(class | classes of the last CONTEXT tokens) * (c + 1) / (mass of the class)

with c the token's count in training documents. The end and the ``SINGLES`` most frequent words
are classes of their own; other words share the class of their last two characters (the
``ENDINGS`` most frequent of them, one class for the rest). A shared class keeps one unit of
mass for unknown words, so over known words and the unknown word of each class the
probabilities add up to one.

The first factor is the neural model: the context's class vectors, each times the matrix of its
place, add up to a predicted vector; its products with the output vectors, plus biases, are the
scores of all classes. Training takes each token of each training document once: the documents
are dealt into ``ROUNDS`` rounds, every task walks its rows in small batches (Adagrad, shared
noise drawn by class frequency), and Spark averages the tasks' parameters between rounds, by
tokens. Scoring multiplies batches of predicted vectors with all output vectors and normalises.

What grows with the corpus stays distributed: the table of word counts, and each document's
classes (two bytes a token). Only the ``LISTED`` most frequent words, of at most 64 bytes each,
go to every task with their counts; a document's other words are joined with the counts. None
of those is frequent, as the list is by occurrences in all documents. Longer words are known
by their digest.

Null texts are empty: one end. Rows with a null id are no training rows (and not held out);
repeated ids count as often as they stand. Without any training document all counts are 0. An
empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import settle, slices

FOLDS = 7
HELD_OUT = 2
CONTEXT = 5
WIDTH = 16
SINGLES = 127
ENDINGS = 191
CLASSES = 1 + SINGLES + ENDINGS + 1
LISTED = 200_000
ROUNDS = 4
NOISE = 32
BATCH = 1024
RATE = 0.15
SEED = 20

END = b""
_LONGEST = 64
_PIECE = 8 << 20  # bytes of text that are split at a time
_BUFFER = 1 << 16  # tokens that are shuffled together
_CHUNK = 4096
_ROWS = 1024
_LANES = 64


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case; the end is not among them."""
    return (text or b"").lower().split()  # of bytes: A to Z, and the white space \x20 and \x09 to \x0D


def key(word: bytes) -> bytes:
    """The word, or what stands for one of over 64 bytes; no word holds a space."""
    return word if len(word) <= _LONGEST else b" " + hashlib.sha256(word).hexdigest().encode()


def ending(word: bytes) -> str:
    return key(word).decode("utf-8", "replace")[-2:]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each token's place among them, each token's text) of a column of texts.

    What :func:`tokens` gives, split and told apart by Arrow, so that only distinct words are ever objects.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = split.flatten().cast(pa.binary()).dictionary_encode()
    place = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    words = coded.dictionary
    empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)  # before leading white space
    if len(empty):
        whole = place != empty[0]
        place, text = place[whole], text[whole]
    return words, place, text


def keys_of(words: pa.Array) -> pa.Array:
    """:func:`key` of a column of words."""
    long = pc.greater(pc.binary_length(words), _LONGEST)
    if not pc.any(long).as_py():
        return words
    return pc.replace_with_mask(words, long, pa.array([key(w) for w in words.filter(long).to_pylist()], pa.binary()))


# ---- counts ---------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    kind = F.coalesce(fold(F.col("doc_id")), F.lit(-1)).cast("int")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), kind.alias("fold"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, seen): occurrences in training documents and in all, the end being the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _joined(batches):
            words, place, text = words_of(piece.column("text"))
            learnt = ~np.isin(piece.column("fold").to_numpy(), (HELD_OUT, -1))
            held = np.bincount(place, minlength=len(words))
            c = np.bincount(place[learnt[text]], minlength=len(words))
            met = np.flatnonzero(held)
            words = keys_of(words.take(pa.array(met)))
            yield pa.record_batch({
                "word": pa.concat_arrays([words, pa.array([END], pa.binary())]),
                "c": np.append(c[met], learnt.sum()), "seen": np.append(held[met], len(learnt)),
            })

    return (
        _texts(docs).mapInArrow(count, "word binary, c long, seen long")
        .groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, about ``_PIECE`` bytes of text at a time: small batches are put together, large ones cut."""
    held, size = [], 0
    for piece in slices(batches, "text", _PIECE):
        held.append(piece)
        size += piece.column("text").nbytes
        if size >= _PIECE:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(pieces) if len(pieces) > 1 else pieces[0]


@dataclasses.dataclass
class Lexicon:
    """Classes of words, the listed words' counts, and the mass of each class."""

    words: dict[bytes, int]  # listed word: place in the arrays below
    classes: np.ndarray
    counts: np.ndarray
    singles: dict[bytes, int]
    endings: dict[str, int]
    mass: np.ndarray
    frequency: np.ndarray  # of classes among training tokens
    tokens: int
    distinct: int

    def class_of(self, word: bytes) -> int:
        return self.singles.get(word) or self.endings.get(ending(word), CLASSES - 1)


def lexicon(counts: DataFrame) -> Lexicon:
    """Read from settled counts. The driver gets ``LISTED`` words and a row per class."""
    spark = counts.sparkSession
    known = counts.where("c > 0 AND word <> ''")
    singles = {r["word"].encode(): i for i, r in enumerate(known.orderBy(F.desc("c"), "word").limit(SINGLES).collect(), 1)}
    alone = spark.createDataFrame([(w.decode(), i) for w, i in singles.items()] + [("", 0)], "word string, single int")
    tail = counts.join(F.broadcast(alone), "word", "left").withColumn("ending", F.substring("word", -2, 2))
    most = tail.where("single IS NULL AND c > 0").groupBy("ending").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "ending").limit(ENDINGS)
    endings = {r["ending"]: i for i, r in enumerate(most.collect(), SINGLES + 1)}
    shared = spark.createDataFrame([*endings.items()] or [("", 0)], "ending string, shared int")
    placed = tail.join(F.broadcast(shared), "ending", "left").withColumn("class", F.coalesce("single", "shared", F.lit(CLASSES - 1)))
    mass, frequency = np.ones(CLASSES), np.zeros(CLASSES)
    distinct = 0
    for r in placed.where("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        frequency[r["class"]] = r["n"]
        distinct += r["v"]
        mass[r["class"]] += r["n"] + r["v"]
    top = _most_seen(placed).select("word", "c", "class").toArrow()
    words = {w.encode(): i for i, w in enumerate(top.column("word").to_pylist())}
    return Lexicon(
        words, top.column("class").to_numpy().astype(np.int64), top.column("c").to_numpy().astype(np.int64),
        singles, endings, mass, frequency, int(frequency.sum()), distinct,
    )


def _most_seen(counts: DataFrame) -> DataFrame:
    """At most ``LISTED`` words: all that are seen more often than some limit, found on a bounded histogram."""
    step = F.when(F.col("seen") < 1024, F.col("seen")).otherwise(F.floor(F.log2("seen") * 16) + 1024 - 160).cast("long")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    total = list(itertools.accumulate(r["n"] for r in steps))
    fits = [r["step"] for r, n in zip(steps, total) if n <= LISTED]
    return counts.where(step >= fits[-1]) if fits else counts.limit(0)


# ---- documents as classes -------------------------------------------------------------------

ENCODED = (
    "rid long, doc_id long, fold int, n_tokens long, n_known long, log_counts double, log_inside double, "
    "classes binary, rare array<binary>, times array<int>"
)


def encode(docs: DataFrame, words: Lexicon) -> DataFrame:
    """A row per document with its classes and what its listed words add to either score.

    ``log_counts`` adds up log10(c + 1) of listed tokens; ``log_inside`` that of listed tokens in
    shared classes, less the log mass of the class of every token in a shared class.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        logs = np.log10(lex.counts + 1.0)
        log_mass = np.where(np.arange(CLASSES) > SINGLES, np.log10(lex.mass), 0.0)
        inside = np.where(lex.classes > SINGLES, logs, 0.0)
        ends = lex.frequency[0]  # the end is a class of its own
        for piece in _joined(batches):
            n = piece.num_rows
            words, place, doc = words_of(piece.column("text"))
            names = words.to_pylist()
            at = np.fromiter((lex.words.get(w, -1) for w in names), np.int64, len(names))
            listed = at >= 0
            # of distinct words; what isn't listed counts later
            of_class = np.where(listed, lex.classes[at], 0)
            of_class[~listed] = [lex.class_of(w) for w in itertools.compress(names, ~listed)]
            known = np.where(listed, lex.counts[at] > 0, False)
            log = np.where(listed, logs[at], 0.0)
            within = np.where(listed, inside[at], 0.0) - log_mass[of_class]
            add = lambda values: np.bincount(doc, weights=values[place], minlength=n).astype(float)
            sizes = np.bincount(doc, minlength=n)
            ids, cut = of_class.astype("<u2")[place], np.concatenate([[0], np.cumsum(sizes)])
            rest = ~listed[place]
            pairs, times = np.unique(doc[rest] * max(len(names), 1) + place[rest], return_counts=True)
            of_doc, of_word = np.divmod(pairs, max(len(names), 1))
            offsets = pa.array(np.searchsorted(of_doc, np.arange(n + 1)).astype(np.int32))
            yield pa.record_batch({
                "rid": piece.column("rid"), "doc_id": piece.column("doc_id"), "fold": piece.column("fold"),
                "n_tokens": sizes + 1, "n_known": add(known).astype(np.int64) + int(ends > 0),
                "log_counts": add(log) + np.log10(ends + 1), "log_inside": add(within),
                "classes": pa.array([ids[a:b].tobytes() + b"\0\0" for a, b in zip(cut, cut[1:])], pa.binary()),
                "rare": pa.ListArray.from_arrays(offsets, keys_of(words.take(pa.array(of_word)))),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            })

    numbered = _texts(docs).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "fold", "text")
    return numbered.mapInArrow(rows, ENCODED)


# ---- the model ------------------------------------------------------------------------------


@dataclasses.dataclass
class Model:
    """inputs[class or start], places[place before], outputs[class], bias[class], and Adagrad's sums."""

    inputs: np.ndarray
    places: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    squares: list[np.ndarray]

    @classmethod
    def fresh(cls, frequency: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        share = (frequency + 1) / (frequency + 1).sum()
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        near = np.stack([np.eye(WIDTH, dtype=np.float32) / (j + 1) for j in range(CONTEXT)])
        parts = [draw(CLASSES + 1, WIDTH), near, draw(CLASSES, WIDTH), np.log(share).astype(np.float32)]
        return cls(*parts, [np.full_like(p, 0.05) for p in parts])

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.places, self.outputs, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts + self.squares])

    def filled(self, values: np.ndarray) -> Model:
        found, at = [], 0
        for p in self.parts + self.squares:
            found.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*found[:4], found[4:])

    def tables(self) -> np.ndarray:
        """[place, class]: what a class at a place adds to the predicted vector."""
        return np.matmul(self.inputs[None], self.places)

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        """Natural log probabilities of target classes, normalised over all classes."""
        return self._normalised(_predicted(self.tables() if tables is None else tables, contexts), targets)

    def text_log_probabilities(self, texts: list[bytes], tables: np.ndarray) -> np.ndarray:
        """The sum of every document's natural log probabilities, from its classes."""
        line, at, doc = _line(texts)
        predicted = np.zeros((len(line), WIDTH), np.float32)
        for j in range(1, CONTEXT + 1):
            predicted[j:] += tables[j - 1][line[:-j]]
        return np.bincount(doc, weights=self._normalised(predicted[at], line[at]), minlength=len(texts)).astype(float)

    def _normalised(self, predicted: np.ndarray, targets: np.ndarray) -> np.ndarray:
        out = np.empty(len(targets), np.float32)
        outputs = np.ascontiguousarray(np.concatenate([self.outputs, self.bias[:, None]], axis=1).T)
        for a in range(0, len(targets), _ROWS):
            chosen = targets[a : a + _ROWS]
            with_one = np.ones((len(chosen), WIDTH + 1), np.float32)
            with_one[:, :WIDTH] = predicted[a : a + _ROWS]
            scores = with_one @ outputs
            top = max(scores.max() - 60, 0)  # exp() stays in range
            own = scores[np.arange(len(chosen)), chosen] - top
            if top:
                scores -= top
            np.exp(scores, out=scores)
            out[a : a + _ROWS] = own - np.log(scores.sum(axis=1))
        return out

    def learn(self, contexts: np.ndarray, targets: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> None:
        """One Adagrad step on a batch of tokens against ``NOISE`` shared noise classes."""
        n = np.float32(len(targets))
        noise = rng.choice(CLASSES, NOISE, p=share)
        tables = self.tables()
        predicted = _predicted(tables, contexts)
        odds = np.log(NOISE * share).astype(np.float32)
        own = self.outputs[targets]
        data = _sigmoid(np.einsum("ij,ij->i", predicted, own) + self.bias[targets] - odds[targets]) - 1
        fake = _sigmoid(predicted @ self.outputs[noise].T + (self.bias[noise] - odds[noise]))
        to_predicted = data[:, None] * own + fake @ self.outputs[noise]
        to_outputs = _scatter(targets, data[:, None] * predicted, CLASSES)
        np.add.at(to_outputs, noise, fake.T @ predicted)
        to_bias = np.bincount(targets, weights=data, minlength=CLASSES)
        np.add.at(to_bias, noise, fake.sum(axis=0))
        to_inputs, to_places = np.zeros_like(self.inputs), np.empty_like(self.places)
        for j in range(CONTEXT):
            to_table = _scatter(contexts[:, j], to_predicted, CLASSES + 1)
            to_inputs += to_table @ self.places[j].T
            to_places[j] = self.inputs.T @ to_table
        for part, square, slope in zip(self.parts, self.squares, (to_inputs, to_places, to_outputs, to_bias)):
            slope = (slope / n).astype(np.float32) * np.float32(_STEP)
            square += slope * slope
            part -= np.float32(RATE) * slope / np.sqrt(square)


#: Slopes are means over a batch; this brings frequent classes' to about one.
_STEP = 20.0


def _predicted(tables: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    out = tables[0][contexts[:, 0]]
    for j in range(1, CONTEXT):
        out += tables[j][contexts[:, j]]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """values added up by row, as a table of n rows."""
    cells = rows[:, None] * values.shape[1] + np.arange(values.shape[1])
    return np.bincount(cells.ravel(), weights=values.ravel(), minlength=n * values.shape[1]).reshape(n, -1).astype(np.float32)


def _line(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' classes in a row, with the start ``CONTEXT`` times before each; the tokens' places in it, and their documents."""
    start = np.full(CONTEXT, CLASSES, np.int64)
    line = np.concatenate([x for t in texts for x in (start, np.frombuffer(t, "<u2").astype(np.int64))] or [start])
    doc = np.repeat(np.arange(len(texts)), np.array([len(t) // 2 for t in texts], np.int64))
    return line, np.arange(len(doc)) + (doc + 1) * CONTEXT, doc


def contexts_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, targets, document) of documents' classes; the class before position j stands in column j - 1.

    Before a document's first token stands the start, which has the number after the last class.
    """
    line, at, doc = _line(texts)
    return np.stack([line[at - j] for j in range(1, CONTEXT + 1)], axis=1), line[at], doc


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Documents' classes, about ``_BUFFER`` tokens at a time."""
    held, size = [], 0
    for piece in slices(batches, "classes", 2 * _BUFFER):
        for t in piece.column("classes").to_pylist():
            held.append(t)
            size += len(t) // 2
        if size >= _BUFFER:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(encoded: DataFrame, words: Lexicon) -> Model:
    """The model after one pass over all training documents, averaged over tasks ``ROUNDS`` times."""
    spark = encoded.sparkSession
    model = Model.fresh(words.frequency)
    share = (words.frequency + 1) / (words.frequency + 1).sum()
    learnable = encoded.where(~F.col("fold").isin(HELD_OUT, -1))
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def walk(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            own = sent.value.filled(sent.value.flat())
            part = TaskContext.get().partitionId()
            rng = np.random.default_rng([SEED, number, part])
            taken = 0
            for texts in _groups(batches):
                contexts, targets, _ = contexts_of(texts)
                order = rng.permutation(len(targets))
                for a in range(0, len(order), BATCH):
                    own.learn(contexts[order[a : a + BATCH]], targets[order[a : a + BATCH]], share, rng)
                taken += len(targets)
            if taken:
                values = own.flat()
                chunks = [values[a : a + _CHUNK] for a in range(0, len(values), _CHUNK)]
                yield pa.record_batch({
                    "chunk": pa.array(range(len(chunks)), pa.int32()), "lane": pa.array([part % _LANES] * len(chunks), pa.int32()),
                    "weight": pa.array([float(taken)] * len(chunks)),
                    "total": pa.array([(c.astype(np.float64) * taken).tobytes() for c in chunks], pa.binary()),
                })

        dealt = learnable.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == number).select("classes")
        walked = dealt.mapInArrow(walk, "chunk int, lane int, weight double, total binary")
        lanes = walked.groupBy("chunk", "lane").applyInArrow(_added, "chunk int, lane int, weight double, total binary")
        whole = lanes.withColumn("lane", F.lit(0)).groupBy("chunk").applyInArrow(_added, "chunk int, lane int, weight double, total binary")
        found = sorted(whole.collect(), key=lambda r: r["chunk"])  # the parameters once
        if found:
            model = model.filled(np.concatenate([np.frombuffer(r["total"], np.float64) / r["weight"] for r in found]))
    return model


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(t, np.float64) for t in rows.column("total").to_pylist())
    first = rows.slice(0, 1)
    return pa.table({
        "chunk": first.column("chunk"), "lane": first.column("lane"),
        "weight": pa.array([sum(rows.column("weight").to_pylist())]), "total": pa.array([total.tobytes()], pa.binary()),
    })


# ---- scores ---------------------------------------------------------------------------------


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, log base 10."""
    counts = settle(word_counts(docs))
    words = lexicon(counts)
    encoded = settle(encode(docs, words))
    model = train(encoded, words)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def classes_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables()
        for piece in slices(batches, "classes", 4 * _BUFFER):
            total = own.text_log_probabilities(piece.column("classes").to_pylist(), tables) / np.log(10)
            kept = piece.drop_columns(["classes"])
            yield kept.append_column("log_classes", pa.array(total))

    narrow = "rid long, doc_id long, fold int, n_tokens long, n_known long, log_counts double, log_inside double"
    scored = encoded.drop("rare", "times").select(*[c.split()[0] for c in narrow.split(", ")], "classes").mapInArrow(
        classes_score, f"{narrow}, log_classes double")
    pairs = encoded.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", "x.rare", "x.times")
    pairs = pairs.withColumn("rare", F.col("rare").cast("string"))
    met = pairs.join(counts.where("c > 0").select(F.col("word").alias("rare"), "c"), "rare")
    rest = met.groupBy("rid").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_logs"))
    both = scored.join(rest, "rid", "left").fillna({"_known": 0, "_logs": 0.0})
    floor = float(np.log10(words.tokens + words.distinct + 1))
    return both.select(
        "doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("_known")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("_logs") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("log_classes") + F.col("log_inside") + F.col("_logs")).alias("score"),
    )
