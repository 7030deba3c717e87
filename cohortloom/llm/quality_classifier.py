"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Every word gets a vector: the sum of the sparse ternary index vectors of its neighbours over all documents. Words live in a
hashed table of fixed size (``ROWS`` x ``DIMS``), which bounds what tasks share. The sums are integers, so they do not depend on
how the table is partitioned. A document is the mean of its words' vectors; a network of two layers learns from a bounded
sample of labelled rows and its temperature from a part of that sample which the network has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.texts import Key, fold_is_zero, give_back, labelled_sample, mix64, slices, split_words

ROWS = 1 << 15
DIMS = 64
NONZERO = 4
WINDOW = 2
CHUNK = 1024
TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
CACHE = 100_000
FAN = 16
GATHERED = 1 << 16


SIGNS = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
REPEATS = re.compile(rb"(.)\1+", re.DOTALL)


def shape_of(word: bytes) -> bytes:
    """Runs of capitals, other letters and digits as X, x and 9; other signs stay, repeats once."""
    return REPEATS.sub(rb"\1", word.translate(SIGNS))


class WordRows(dict):
    """Word -> row of the word and row of its shape, packed; emptied when it has grown to ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        row = xxhash.xxh64_intdigest(word, 1) % ROWS | xxhash.xxh64_intdigest(b"\0" + shape_of(word), 1) % ROWS << 32
        self[word] = row
        return row


_rows = WordRows()  # one per worker: words repeat from task to task


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of every row's index vector."""
    at = np.arange(ROWS * NONZERO).reshape(ROWS, NONZERO)
    code = mix64(at + 1)
    return (code % np.uint64(DIMS)).astype(np.int64), np.where(code >> np.uint64(63), 1.0, -1.0)


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, shape row) of every word of the texts, and words per text."""
    parts, counts = split_words(texts)
    packed = np.fromiter(map(_rows.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
    return packed & 0xFFFFFFFF, packed >> 32, counts


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The table of word vectors from all documents: tasks sum their part, and chunks of the table are summed in a tree.

    Null and empty texts add nothing; repeated rows count each; texts of any length are read whole, slice by slice of documents.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(ROWS * DIMS)
        for _, texts in slices(batches):
            word, shape, counts = word_rows(texts)
            row = np.repeat(np.arange(len(texts)), counts)
            for step in range(1, WINDOW + 1):
                same = np.flatnonzero(row[step:] == row[:-step])
                pairs = [(word[same], word[same + step]), (word[same + step], word[same])]
                if step == 1:
                    pairs += [(shape[same], shape[same + step]), (shape[same + step], shape[same])]
                for own, near in pairs:
                    at = (own[:, None] * DIMS + place[near]).ravel()
                    total += np.bincount(at, weights=sign[near].ravel(), minlength=ROWS * DIMS)  # whole numbers, so exact
        total = total.astype(np.int64)
        chunks = total.reshape(-1, CHUNK * DIMS)
        task = TaskContext.get().partitionId()
        for i in np.flatnonzero(chunks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([chunks[i].tobytes()])], ["chunk", "part", "sums"])

    def merge(key: Key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK * DIMS, np.int64)
        for b in batches:  # streamed: one chunk of one task at a time
            for sums in b.column("sums").to_pylist():
                total += np.frombuffer(sums, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()])], ["chunk", "part", "sums"])

    texts = documents.select("text")
    parts = texts.mapInArrow(gather, "chunk int, part int, sums binary")
    # A tree: groups of FAN parts are added up until one is left, so no task reads what all tasks send.
    many = texts.rdd.getNumPartitions()
    while many > 1:
        many = -(-many // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("chunk", "part").applyInArrow(merge, "chunk int, part int, sums binary")
    table = np.zeros((ROWS * DIMS // (CHUNK * DIMS), CHUNK * DIMS), np.float64)
    for chunk, _, sums in parts.collect():  # bounded: the table itself
        table[chunk] = np.frombuffer(sums, np.int64)
    vectors = table.reshape(ROWS, DIMS)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(norm, 1)
    seen = norm[:, 0] > 0
    vectors[seen] -= vectors[seen].mean(axis=0) if seen.any() else 0
    return vectors.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector and log length of every text (zeros for an empty text)."""
    word, shape, counts = word_rows(texts)
    out = np.zeros((len(texts), 2 * DIMS + 1), np.float32)
    row = np.repeat(np.arange(len(texts)), counts)
    for i in range(0, len(word), GATHERED):  # a bounded matrix of gathered vectors, also for very long texts
        part = row[i:i + GATHERED]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[starts], :DIMS] += np.add.reduceat(vectors[word[i:i + GATHERED]], starts, axis=0)
    used = np.flatnonzero(np.bincount(shape, minlength=ROWS))  # shapes are few: count them per text
    place = np.zeros(ROWS, np.int64)
    for i in range(0, len(used), 512):
        some = used[i:i + 512]
        place[:] = -1
        place[some] = np.arange(len(some))
        at = place[shape]
        has = at >= 0
        often = np.bincount(row[has] * len(some) + at[has], minlength=len(texts) * len(some)).reshape(len(texts), len(some))
        out[:, DIMS:2 * DIMS] += often @ vectors[some]
    out[:, :2 * DIMS] /= np.maximum(counts, 1)[:, None]
    out[:, -1] = np.log1p(counts) / 10
    return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the log loss; every fifth row is left for the temperature, found on a grid."""
    p = x.shape[1]
    random = np.random.default_rng(seed)
    center = x.mean(axis=0) if len(x) else np.zeros(p)
    scale = x.std(axis=0) + 1e-4 if len(x) else np.ones(p)
    net = Network(center, scale, random.normal(0, 1 / np.sqrt(p), (p, hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    own = np.arange(len(x)) % 5 != 0
    a, b = (x[own] - center) / scale, y[own]
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (net.w1, net.b1, net.w2, np.zeros(1))]
    step = 0
    for _ in range(epochs if len(b) else 0):
        order = random.permutation(len(b))
        for i in range(0, len(b), 256):
            at, step = order[i:i + 256], step + 1
            layer = np.tanh(a[at] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(layer @ net.w2 + net.b2, -30, 30))) - b[at]) / len(at)
            back = np.outer(error, net.w2) * (1 - layer**2)
            gradients = (a[at].T @ back + decay * net.w1, back.sum(axis=0), layer.T @ error + decay * net.w2, np.array([error.sum()]))
            moves = []
            for s, g in zip(state, gradients):
                s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
                moves.append(rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    if len(x) and (~own).sum() > 20:
        z = net.logit(x[~own])
        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: log_loss(z / t, y[~own])))
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network


def train(documents: DataFrame, labels: DataFrame, folds: int | None = FOLDS, limit: int = TRAIN_ROWS) -> Classifier:
    """Word vectors from every document; the network from at most about ``limit`` labelled rows outside the held-out fold.

    Null texts count as empty; labels without id or quality teach nothing, several labels of one id count as their mean, and copies of a document
    teach each. Without any label the score is that of an untrained network.
    """
    vectors = word_vectors(documents)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("_target"), b.column("doc_id"), pa.array(list(pooled(texts, vectors)))], ["target", "doc_id", "x"])

    table = labelled_sample(documents, labels, folds, limit).mapInArrow(measure, "target double, doc_id long, x array<float>").toArrow().sort_by("doc_id")
    x = table["x"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, 2 * DIMS + 1)  # no list of numbers: the driver has little room
    model = Classifier(vectors, fit(x, table["target"].to_numpy()))
    give_back()
    return model


def score(documents: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and the probability of label 1 for every whole text.

    Null and empty texts score as documents of no words (a defined value of the network); repeated rows score alike; an empty
    table gives no rows; columns that are not kept are not read.
    """
    fields = [documents.schema[c] for c in keep]
    kept = documents.select(*[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(fields)], F.col("text").alias("_text"))
    schema = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "score double"])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 8 MB by construction

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b, texts in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*b.columns[:len(fields)], pa.array(m.network.probability(pooled(texts, m.vectors)))], [*(f"_{i}" for i in range(len(fields))), "score"])

    return kept.mapInArrow(scored, schema).select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(fields)], "score")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score the quality of every document."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(documents, train(documents, labels)).select("doc_id", fold_is_zero("doc_id", FOLDS).alias("held_out"), "score",
                                                             (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
