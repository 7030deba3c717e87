"""Sufficient statistics: counts, sums and cross products per key from one distributed pass.

Ridge over a thousand penalties, elastic net, PLS, PCA, LDA, MANOVA, normative regressions and harmonisation all need only
``n``, the sums and the p x p cross products per fold, group or site.  A pass over the data gives them; the solves are
then p x p work on the driver.  Sums are taken about a fixed shift near the mean to keep the arithmetic well conditioned;
the shift cancels out of every result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.operators.packed import PIECES, collected, pieces, typed_keys
from cohortloom.session import TooLarge, small_rows

NATIVE_WIDTH = 12
MAX_NUMBERS = 50_000_000
ROWS = 4096  # that are multiplied at once


@dataclass
class Moments:
    """Statistics per key.  ``s`` and ``g`` are about ``shift``; keys are tuples in the order of ``by``."""

    columns: list[str]
    shift: np.ndarray
    keys: list[tuple]
    n: np.ndarray
    s: np.ndarray
    g: np.ndarray

    def of(self, key: tuple) -> Moments:
        return self.pick([self.keys.index(key)])

    def pick(self, rows: Sequence[int]) -> Moments:
        """Several keys merged into one."""
        rows = list(rows)
        return Moments(self.columns, self.shift, [()], self.n[rows].sum(keepdims=True),
                       self.s[rows].sum(0, keepdims=True), self.g[rows].sum(0, keepdims=True))

    def only(self, test) -> Moments:
        """Keys whose position passes the test, each still on its own."""
        rows = [i for i in range(len(self.keys)) if test(i)]
        return Moments(self.columns, self.shift, [self.keys[i] for i in rows], self.n[rows], self.s[rows], self.g[rows])

    def total(self) -> Moments:
        return self.pick(range(len(self.keys)))

    def without(self, key: tuple) -> Moments:
        return self.pick([i for i, k in enumerate(self.keys) if k != key])

    def where(self, test) -> Moments:
        return self.pick([i for i, k in enumerate(self.keys) if test(k)])

    # Single-key views -----------------------------------------------------------------
    @property
    def size(self) -> float:
        return float(self.n[0])

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.s[0] / self.n[0]

    @property
    def scatter(self) -> np.ndarray:
        """Centred cross products (divide by n for the population covariance)."""
        return self.g[0] - np.outer(self.s[0], self.s[0]) / self.n[0]

    def about(self, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and cross products about another centre."""
        d = self.shift - centre
        s = self.s[0] + self.n[0] * d
        g = self.g[0] + np.outer(self.s[0], d) + np.outer(d, self.s[0]) + self.n[0] * np.outer(d, d)
        return s, g

    def correlation(self) -> np.ndarray:
        c = self.scatter
        sd = np.sqrt(np.diag(c))
        with np.errstate(divide="ignore", invalid="ignore"):
            return c / np.outer(sd, sd)


def _guard(keys: int, width: int) -> None:
    if keys * width * width > MAX_NUMBERS:
        raise TooLarge(f"{keys} keys x {width} columns squared does not fit the driver")


def moments(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None, max_keys: int = 100_000,
    shift: dict[str, float] | None = None,
) -> Moments:
    """Moments of numeric columns over complete rows, per combination of ``by``.

    Up to a dozen columns are plain SQL sums inside generated code; wider tables send Arrow batches to numpy, where each
    task returns one partial matrix per key.  ``shift`` fixes the shift of single columns.
    """
    columns = list(columns)
    x = df.select(*map(col, by), *([col(weight)] if weight else []), *[col(c).cast("double").alias(c) for c in columns])
    x = x.na.drop(how="any", subset=columns)
    if len(columns) > NATIVE_WIDTH:
        packed = x.select(*map(col, by), *([col(weight)] if weight else []), F.array(*map(col, columns)).alias("_v"))
        return vector_moments(packed, "_v", by, weight, max_keys, columns)
    first = x.agg(*[F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    fixed = shift or {}
    shift = np.array([float(fixed.get(c, v if v is not None else 0.0)) for c, v in zip(columns, first)])
    w = col(weight).cast("double") if weight else F.lit(1.0)
    d = [col(c) - F.lit(float(shift[i])) for i, c in enumerate(columns)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    stats = x.groupBy(*map(col, by)).agg(
        F.sum(w).alias("_n"), *[F.sum(w * d[i]).alias(f"_s{i}") for i in range(len(columns))],
        *[F.sum(w * d[i] * d[j]).alias(f"_g{i}_{j}") for i, j in pairs])
    rows = [r for r in small_rows(stats, max_keys, "statistics per key") if r["_n"]]
    _guard(len(rows), len(columns))
    rows.sort(key=lambda r: tuple(str(r[b]) for b in by))
    n = np.array([float(r["_n"]) for r in rows])
    s = np.array([[r[f"_s{i}"] for i in range(len(columns))] for r in rows]).reshape(len(rows), len(columns))
    g = np.zeros((len(rows), len(columns), len(columns)))
    for k, r in enumerate(rows):
        for i, j in pairs:
            g[k, i, j] = g[k, j, i] = r[f"_g{i}_{j}"]
    return Moments(columns, shift, [tuple(r[b] for b in by) for r in rows], n, s, g)


def vector_moments(
    df: DataFrame, vector: str, by: Sequence[str] = (), weight: str | None = None, max_keys: int = 100_000,
    names: Sequence[str] | None = None,
) -> Moments:
    """Moments of an array column.  Each task adds up ``X'X`` per key; the partial triangles are summed by a shuffle on
    (key, piece), so no single task or the driver sees rows, and the driver gets packed arrays."""
    by = list(by)
    head = [r[0] for r in df.select(col(vector).cast("array<double>")).where(col(vector).isNotNull()).take(200)]
    if not head:
        raise ValueError("no complete rows")
    shift = np.mean(np.array(head), axis=0)
    p = len(shift)
    upper = np.triu_indices(p)
    # Keys travel as one JSON text and get their own types back at the end, NULL included.
    key = F.to_json(F.struct(*map(col, by)), {"ignoreNullFields": "false"}) if by else F.lit("")
    slim = df.where(col(vector).isNotNull()).select(
        key.alias("_key"), (col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"), col(vector).cast("array<double>").alias("_v"))

    size = 1 + p + len(upper[0])
    _guard(1, p)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = b.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - shift
                w = b.column("_w").to_numpy(zero_copy_only=False)
                keys = b.column("_key").dictionary_encode()
                codes = keys.indices.to_numpy()
                for c, key in enumerate(keys.dictionary.to_pylist()):
                    rows = codes == c
                    xw = x[rows] * w[rows, None]
                    part = np.concatenate([[w[rows].sum()], xw.sum(0), (x[rows].T @ xw)[upper]])
                    sums[key] = part if key not in sums else sums[key] + part
        for key, flat in sums.items():
            yield from pieces(key, flat)

    table = collected(slim.mapInArrow(partial, PIECES), size, min(max_keys, max(1, MAX_NUMBERS // size)))
    table = {k: v for k, v in table.items() if v[0]}  # keys of zero weight have no moments
    typed = typed_keys(df, by, list(table))
    keys = sorted(table, key=lambda k: tuple(map(str, typed[k])))
    flat = np.array([table[k] for k in keys]).reshape(len(keys), size)
    g = np.zeros((len(keys), p, p))
    g[:, upper[0], upper[1]] = flat[:, 1 + p:]
    g[:, upper[1], upper[0]] = flat[:, 1 + p:]
    return Moments(list(names) if names else [f"d{i}" for i in range(p)], shift, [typed[k] for k in keys], flat[:, 0], flat[:, 1:1 + p], g)


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Correlation matrix in which every pair uses the rows that have both values; one pass, p x p partial sums per task.

    Pairs with fewer than two rows or without variation are NaN.
    """
    columns = list(columns)
    p = len(columns)
    _guard(4, p)
    means = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([float(v) if v is not None else 0.0 for v in means])
    slim = df.select(F.array(*[col(c).cast("double") for c in columns]).alias("_v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, p, p))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                x = whole.column("_v").slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p) - shift
                known = np.isfinite(x).astype(float)
                x = np.where(known > 0, x, 0.0)
                sums += [known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x]
        yield from pieces("", sums.ravel())

    flat = collected(slim.mapInArrow(partial, PIECES), 4 * p * p, 1).get("", np.zeros(4 * p * p))
    n, s, q, xy = flat.reshape(4, p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (n * xy - s * s.T) / np.sqrt((n * q - s * s) * (n * q.T - s.T * s.T))


def with_target(df: DataFrame, vector: str, target: Column | str, out: str = "_v") -> DataFrame:
    """Append the target as the last position of the vector."""
    y = col(target).cast("double")
    return df.where(y.isNotNull()).withColumn(out, F.concat(col(vector).cast("array<double>"), F.array(y)))
