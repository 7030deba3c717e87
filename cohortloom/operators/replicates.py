"""Bootstrap statistics in one scan: a matrix of weights per Arrow batch instead of copies of rows.

The weights of all replicates for the rows of a batch are a rows x replicates matrix; times the rows' products it gives the partial
sums of every replicate at once. The unweighted statistics come from the same pass, as one more replicate. Tasks send packed sums, which
are added up by key and position, so that neither a task nor the driver sees rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.functions.hashing import POISSON_CUTS, REPLICATE_PRIME, with_replicate_hashes
from cohortloom.operators.packed import PIECES, collected, pieces, typed_keys
from cohortloom.operators.suffstats import MAX_NUMBERS, Moments
from cohortloom.session import local_table

PLAIN = -1  # the replicate in which every row counts once
ROWS = 1024


def weights_of(h1: np.ndarray, h2: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weights, rows x replicates, the same numbers as ``resample.poisson_weight``."""
    number = (h1[:, None] + h2[:, None] * np.arange(replicates, dtype=np.int64)[None, :]) % REPLICATE_PRIME
    return np.searchsorted(np.array(POISSON_CUTS, np.int64), number, side="right").astype(float)


def weight_of(h1: np.ndarray, h2: np.ndarray, replicate: int) -> np.ndarray:
    """The column of ``weights_of`` for one replicate."""
    return np.searchsorted(np.array(POISSON_CUTS, np.int64), (h1 + h2 * replicate) % REPLICATE_PRIME, side="right").astype(float)


def replicate_sums(df: DataFrame, key: str | Column, x: Sequence[Column], by: Sequence[str], replicates: int, seed: int, products, width: int, max_keys: int) -> tuple[list[tuple], np.ndarray]:
    """Weighted sums per (replicate, *by) of the ``width`` columns that ``products`` makes of a rows x columns matrix (NaN where missing)."""
    label = F.to_json(F.struct(*map(col, by)), {"ignoreNullFields": "false"}) if by else F.lit("")
    slim = with_replicate_hashes(df, key, seed).select(label.alias("_key"), "_h1", "_h2", *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)])
    many, size = len(x), (replicates + 1) * width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                made = products(np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(many)], axis=1))
                w = np.hstack([weights_of(b.column("_h1").to_numpy(), b.column("_h2").to_numpy(), replicates), np.ones((len(made), 1))])
                keys = b.column("_key").dictionary_encode()
                codes = keys.indices.to_numpy()
                for c, k in enumerate(keys.dictionary.to_pylist()):
                    rows = codes == c
                    part = (w[rows].T @ made[rows]).ravel()
                    sums[k] = part if k not in sums else sums[k] + part
        for k, flat in sums.items():
            yield from pieces(k, flat)

    bound = min(max_keys, max(1, MAX_NUMBERS // size))
    got = collected(slim.mapInArrow(partial, PIECES), size, bound)
    typed = typed_keys(df, by, list(got))
    order = sorted(got, key=lambda k: tuple(map(str, typed[k])))
    flat = np.concatenate([got[k].reshape(replicates + 1, width) for k in order]) if order else np.zeros((0, width))
    return [(rep, *typed[k]) for k in order for rep in [*range(replicates), PLAIN]], flat


def bootstrap_moments(
    df: DataFrame, key: str | Column, columns: Sequence[str], by: Sequence[str], replicates: int, seed: int = 42, indicators: Sequence[str] = (),
    max_keys: int = 10_000,
) -> Moments:
    """Moments per (replicate, *by) over one scan; replicate ``PLAIN`` has every row once.

    A missing value in one of the ``indicators`` counts as its column's shift and sets a further column, named ``name?``, to 1, so that
    filling it with any other value later is a linear map of the statistics. Rows missing another column are left out.
    """
    columns, by, indicators = list(columns), list(by), list(indicators)
    names = columns + [f"{c}?" for c in indicators]
    p = len(names)
    known = df.na.drop(how="any", subset=[c for c in columns if c not in indicators])
    first = known.agg(*[F.avg(col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([*(float(v) if v is not None else 0.0 for v in first), *[0.0] * len(indicators)])
    upper = np.triu_indices(p)
    place = [columns.index(c) for c in indicators]

    def products(x: np.ndarray) -> np.ndarray:
        gone = np.isnan(x)
        x = np.hstack([np.where(gone, 0.0, x - shift[:len(columns)]), gone[:, place].astype(float)])
        return np.hstack([np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]])

    keys, flat = replicate_sums(known, key, [col(c) for c in columns], by, replicates, seed, products, 1 + p + len(upper[0]), max_keys)
    g = np.zeros((len(flat), p, p))
    g[:, upper[0], upper[1]] = g[:, upper[1], upper[0]] = flat[:, 1 + p:]
    return Moments(names, shift, keys, flat[:, 0], flat[:, 1:1 + p], g)


def bootstrap_means(df: DataFrame, key: str | Column, columns: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """Number of drawn rows and weighted mean of every column (over the cells that are there) per replicate; one scan."""
    columns = list(columns)

    def products(x: np.ndarray) -> np.ndarray:
        gone = np.isnan(x)
        return np.hstack([np.ones((len(x), 1)), np.where(gone, 0.0, x), ~gone])

    keys, sums = replicate_sums(df, key, [col(c) for c in columns], [], replicates, seed, products, 1 + 2 * len(columns), 1)
    p = len(columns)
    rows = [(k[0], round(r[0]), *[float(r[1 + i] / r[1 + p + i]) if r[1 + p + i] else None for i in range(p)]) for k, r in zip(keys, sums) if k[0] != PLAIN and r[0]]
    return local_table(df.sparkSession, rows, "rep int, n long, " + ", ".join(f"`{c}` double" for c in columns))
