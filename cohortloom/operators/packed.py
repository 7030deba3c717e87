"""Sums of arrays over tasks: every task sends its array per key as a few packed pieces, which are added up by key and position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import TooLarge, local_table

PIECE = 1 << 16  # numbers that travel together
PIECES = "key string, piece int, numbers binary"
Key = tuple[pa.Scalar, ...]


def add_up(parts: DataFrame) -> DataFrame:
    """Sums of packed arrays: (key, piece, numbers) with doubles as bytes; one array is in memory at a time."""

    def add(key: Key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for numbers in b.column("numbers"):
                part = np.frombuffer(numbers.as_buffer(), float)
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         ["key", "piece", "numbers"])

    return parts.groupBy("key", "piece").applyInArrow(add, PIECES)


def pieces(key: str | None, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(flat), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([i // PIECE], pa.int32()), pa.array([flat[i:i + PIECE].tobytes()], pa.binary())],
                                         ["key", "piece", "numbers"])


def collected(parts: DataFrame, size: int, max_keys: int) -> dict[str, np.ndarray]:
    """The sums per key; the driver gets at most ``max_keys`` arrays of ``size`` numbers."""
    rows = add_up(parts).take(max_keys * -(-size // PIECE) + 1)
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["key"], np.zeros(size))[r["piece"] * PIECE:(r["piece"] + 1) * PIECE] = np.frombuffer(r["numbers"], float)
    if len(out) > max_keys:
        raise TooLarge(f"more than {max_keys} keys")
    return out


def typed_keys(df: DataFrame, by: Sequence[str], texts: Sequence[str]) -> dict[str, tuple]:
    """Keys travel as one JSON text and get their own types back at the end, NULL included."""
    if not by or not texts:
        return dict.fromkeys(texts, ())
    kind = T.StructType([T.StructField(b, df.schema[b].dataType) for b in by])
    table = local_table(df.sparkSession, [(k,) for k in texts], "_key string")
    return {r["_key"]: tuple(r["_k"]) for r in table.select("_key", F.from_json("_key", kind).alias("_k")).collect()}
