"""Quality rules: statistics of whole documents, hard limits, and gradient-boosted trees over the statistics.

Statistics are array arithmetic on Arrow batches, one pass, no shuffle. The trees learn from a bounded sample of the labelled
rows, with monotonic constraints: repeated words, repeated lines and symbols can only lower a document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import boosting
from cohortloom.llm.texts import SPACES, Numbering, give_back, labelled_sample, mix64, number_words, segment_sums, slices, split_words

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?.,;:"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
TRAIN_ROWS = 20_000
THRESHOLD = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Feature and its monotonic sign (of the chance that a document is good).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "top_word": -1, "distinct": 0,
            "upper": 0, "digits": 0, "exclaims": -1, "marks": 0, "line_words": 0}


def repeated_words(ids: np.ndarray, counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text the words that lie in a window of ``width`` words found twice or more in the same text."""
    many = len(ids) - width + 1
    if many <= 0:
        return np.zeros(len(counts), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    code, spread = mix64(row[:many] + 1), mix64(ids + 1)
    for k in range(width):
        code = code * np.uint64(0x9E3779B97F4A7C15) + spread[k:k + many]
    start = np.flatnonzero(row[:many] == row[width - 1:])
    order = start[np.argsort(code[start], kind="stable")]
    same = code[order][1:] == code[order][:-1]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, order[hit], 1)
    np.add.at(edge, order[hit] + width, -1)
    return segment_sums((np.cumsum(edge)[:-1] > 0).astype(np.int64), counts)


def without(text: bytes, drop: bytes) -> int:
    """How many bytes of ``text`` are in ``drop``."""
    return len(text) - len(text.translate(None, drop))


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the contract, and the feature matrix of the trees."""
    parts, counts = split_words(texts)
    ids = number_words(parts, counts, Numbering())
    row = np.repeat(np.arange(len(texts)), counts)
    each = lambda f: np.fromiter((f(t) for t in texts), np.int64, len(texts))
    lines = [[line for line in t.split(b"\n") if line.strip(SPACES)] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, len(texts))
    out = {
        "n_words": counts,
        "word_chars": each(lambda t: len(t) - without(t, CONTINUATION) - without(t, SPACES)),
        "n_symbols": each(lambda t: without(t, SYMBOLS)),
        "n_dup_lines": n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(texts)),
        "n_repeat_words": repeated_words(ids, counts),
    }
    pair, often = np.unique(row << 32 | ids, return_counts=True)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, pair >> 32, often)
    w, c = np.maximum(counts, 1), np.maximum(out["word_chars"], 1)
    x = np.stack([np.log1p(counts), out["word_chars"] / w, out["n_symbols"] / w, out["n_dup_lines"] / np.maximum(n_lines, 1), out["n_repeat_words"] / w,
                  top / w, np.bincount(pair >> 32, minlength=len(texts)) / w, each(lambda t: without(t, UPPER)) / c, each(lambda t: without(t, DIGITS)) / c,
                  each(lambda t: t.count(b"!")) / w, each(lambda t: without(t, MARKS)) / w, counts / np.maximum(n_lines, 1)], axis=1)
    return out, x


def fits_base(out: dict[str, np.ndarray]) -> np.ndarray:
    return (out["n_words"] >= LEAST_WORDS) & (100 * out["n_repeat_words"] <= REPEAT_PERCENT * out["n_words"])


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, folds: int | None = None, **options) -> boosting.Forest:
    """Trees from at most about ``limit`` labelled rows (bounded by that parameter); features are computed where the rows are."""
    sample = labelled_sample(documents, labels, folds, limit)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches):
            _, x = statistics(texts)
            yield pa.RecordBatch.from_arrays([b.column("_target"), b.column("doc_id"), pa.array(list(x))], ["target", "doc_id", "x"])

    table = sample.mapInArrow(measure, "target double, doc_id long, x array<double>").toArrow().sort_by("doc_id")
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    forest = boosting.fit(x, table["target"].to_numpy(), np.array(list(FEATURES.values())), **options)
    give_back()
    return forest


def assess(documents: DataFrame, forest: boosting.Forest, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in ``keep``, the counts, base_failed, quality and kept.

    Null and empty texts have zero counts and fail the base rule (too few words); a text of any length is read whole; repeated
    rows are judged alike; an empty table gives no rows. Columns of the table that share a name with a result are replaced
    unless they are kept.
    """
    fields = [documents.schema[c] for c in keep]
    kept = documents.select(*[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(fields)], F.col("text").alias("_text"))
    schema = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), *(f"{c} long" for c in COUNTS),
                        "base_failed boolean, quality double, kept boolean"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, "_text"):
            out, x = statistics(texts)
            good, chance = fits_base(out), forest.probability(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(fields)], *(pa.array(out[c]) for c in COUNTS), pa.array(~good), pa.array(chance), pa.array(good & (chance >= threshold))],
                                             [*(f"_{i}" for i in range(len(fields))), *COUNTS, "base_failed", "quality", "kept"])

    judged_rows = kept.mapInArrow(judged, schema)
    return judged_rows.select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(fields)], *COUNTS, "base_failed", "quality", "kept")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Judge every document by the rules."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return assess(documents, train(documents, labels))
