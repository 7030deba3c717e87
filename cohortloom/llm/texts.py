"""Shared text kernel: words of whole texts in Arrow batches, and the rules for who may teach a model."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = tuple[pa.Scalar, ...]  # of a group in applyInArrow
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SLICE_BYTES = 2 << 20


def fold_is_zero(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 0; a null id is in no held-out fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(folds) == 0, F.lit(False))


def may_teach(doc_id: Column | str, folds: int) -> Column:
    """True where the remainder is known and not 0 (a null id teaches nothing)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(folds) != 0, F.lit(False))


def n_words(text: Column | str) -> Column:
    """Number of words of a whole text (null: 0), in the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


class Numbering(dict):
    """Numbers keys in the order in which they are first seen."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library, where there is one


def give_back() -> None:
    """Return freed memory to the machine: a worker lives on, and its next task may be of another stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into runs of whole rows with about ``size`` bytes of text, so that a worker's memory does not depend on
    the rows per batch; a longer text is a run of its own."""
    for batch in batches:
        column = batch.column(text)
        begin = total = 0
        for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
            if total and total + n > size:
                yield batch.slice(begin, i - begin), byte_texts(column.slice(begin, i - begin))
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin), byte_texts(column.slice(begin))
    give_back()


def split_words(texts: list[bytes], lower: bool = False) -> tuple[list[list[bytes]], np.ndarray]:
    """Words per text and their counts; bytes.split() cuts at exactly the six ASCII spaces."""
    parts = [t.translate(LOWER).split() if lower else t.split() for t in texts]
    return parts, np.fromiter(map(len, parts), np.int64, len(parts))


def number_words(parts: list[list[bytes]], counts: np.ndarray, numbering: Numbering) -> np.ndarray:
    return np.fromiter(map(numbering.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (0 for empty runs)."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:], values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads small integers over 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_sample(documents: DataFrame, labels: DataFrame, folds: int | None, limit: int) -> DataFrame:
    """(text, target) of at most about ``limit`` labelled rows, chosen by the hash of their id.

    Rows of the held-out fold never teach. Several labels of one id count as their mean; rows without a label, id or quality
    are left out. The labels are thinned before the join, so the joined side has a proven size bound.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if folds:
        ids = ids.where(may_teach("doc_id", folds))
    ids = ids.groupBy("doc_id").agg(F.avg("quality").alias("_target"))
    many = ids.count()
    if many > limit:
        ids = ids.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * limit / many))
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "_target", "doc_id")
