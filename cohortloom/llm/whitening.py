"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

X is the matrix of centred rows. From a start block V1 the method alternates two distributed products: U_j spans X V_j without what lies
in U_1 .. U_{j-1}, and V_{j+1} spans X'U_j without what lies in V_1 .. V_j. Both sides are reorthogonalised in full, twice. Then
U'XV is a small block-bidiagonal matrix; its singular vectors, turned by V, are the principal components and its singular values
give the deviations. Blocks of several vectors need fewer passes over the rows than single ones and find equal values as well;
``block=1`` is the classical form.

A column of U has as many entries as there are rows, but it always is X q with a short q. So U is never stored: each
pass rebuilds the rows' part of it from q, and only sums of products of a few columns leave the tasks. Nothing is kept in an executor between
passes; a pass reads the stored rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.topk import spread
from cohortloom.session import cut_lineage

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
VECTORS = 16  # of a block
LOST = 1e-11  # of the largest deviation: directions below are rounding
SETTLED = 1e-13  # of the largest deviation: what is still outside the space
Sums = Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part: no null and no non-finite entry; x = floor(64 c) + 1000000."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + F.lit(OFFSET))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(v.isNotNull() & fine)


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """Whole numbers of a list column; a shorter vector ends in entries of zero (that is OFFSET)."""
    counts = np.diff(column.offsets.to_numpy())
    out = np.full((len(counts), dims), OFFSET, np.int64)
    out[np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = column.flatten().to_numpy()
    return out


def totals(rows: DataFrame, dims: int) -> list[int]:
    """Exact sums per dimension."""
    at = F.posexplode("x").alias("d", "c")
    sums = rows.select(at).groupBy("d").agg(F.sum(F.col("c").cast("decimal(28,0)")).alias("s"), F.count("*").alias("n")).collect()  # a row per dimension
    n = rows.count()
    out = [n * OFFSET] * dims
    for r in sums:
        out[r["d"]] = int(r["s"]) + (n - r["n"]) * OFFSET
    return out


def summed(rows: DataFrame, dims: int, centre: np.ndarray) -> Sums:
    """``sums(f)`` adds up the matrices f(block of centred rows) over all rows: a pass; one row per task and entry is shuffled."""
    def run(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        shape = f(np.zeros((0, dims))).shape

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in spread(batches):
                total += f((rows_of(b.column("x"), dims) - OFFSET) - centre)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

        cells = rows.select("x").mapInArrow(part, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        got = cells.toArrow()  # as many rows as the matrix has entries
        out = np.zeros(int(np.prod(shape)))
        out[got.column("cell").to_numpy()] = got.column("value").to_numpy()
        return out.reshape(shape)
    return run


def independent(gram: np.ndarray, least: float) -> np.ndarray:
    """T with T' gram T = I, for the directions whose length exceeds ``least``."""
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > max(least, 0.0) ** 2
    return vector[:, keep] / np.sqrt(value[keep])


def orthonormal(new: np.ndarray, old: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to ``old``, reorthogonalised twice."""
    for _ in range(2):
        new = new - old @ (old.T @ new)
    q, s, _ = np.linalg.svd(new, full_matrices=False)
    q = q[:, s > least]
    for _ in range(2):
        q = q - old @ (old.T @ q)
        q = np.linalg.qr(q)[0]
    return q


def bidiagonalise(sums: Sums, dims: int, scale: float, wanted: int, block: int = VECTORS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, singular values) of the centred rows, largest first.

    ``scale`` is the Frobenius norm of the rows. Stops when the space holds all directions, or when ``wanted`` triplets
    leave no more outside it than rounding.
    """
    random = np.random.default_rng(seed)
    v_all, q_all, z_all = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))  # V; U = X q_all; X'U
    v = np.linalg.qr(random.normal(size=(dims, min(block, dims))))[0]
    tiny = LOST * scale
    while True:
        v_all = np.hstack([v_all, v])
        old = q_all.shape[1]

        def products(w: np.ndarray, transposed: bool):
            def f(x: np.ndarray) -> np.ndarray:
                u = x @ w
                pieces = [u.T @ u, (x @ q_all).T @ u]
                return np.vstack([*pieces, x.T @ u]) if transposed else np.vstack(pieces)
            return f

        # X v, orthogonal to U and normed; the second pass repeats both on the result, and brings X'u.
        many = v.shape[1]
        got = sums(products(v, False))
        gram, inside = got[:many], got[many:]
        turn = independent(gram - inside.T @ inside, tiny)
        w = (v - q_all @ inside) @ turn
        many = w.shape[1]
        if many:
            got = sums(products(w, True))
            gram, inside, z = got[:many], got[many:many + old], got[many + old:]
            turn = independent(gram - inside.T @ inside, 0.5)
            w, z = (w - q_all @ inside) @ turn, (z - z_all @ inside) @ turn
            q_all, z_all = np.hstack([q_all, w]), np.hstack([z_all, z])
            rest = z - v_all @ (v_all.T @ z)
        else:
            rest = np.zeros((dims, 0))
        left, singular, right = np.linalg.svd(z_all.T @ v_all, full_matrices=False)  # the block-bidiagonal matrix
        # What X'U has outside V, seen from the wanted left vectors: 0 up to rounding once they are singular vectors of X.
        outside = (z_all - v_all @ (v_all.T @ z_all)) @ left[:, :wanted]
        new = orthonormal(rest, v_all, tiny)
        if not new.shape[1] and v_all.shape[1] < dims:
            # The space is closed. What is orthogonal to it may still hold directions (equal values, an unlucky start).
            new = orthonormal(random.normal(size=(dims, min(block, dims - v_all.shape[1]))), v_all, 1e-8)
            if singular.size and len(singular) >= wanted and block > 1 and np.abs(outside).max(initial=0) <= SETTLED * scale and closed(sums, new, singular[wanted - 1]):
                break
        elif len(singular) >= wanted and np.abs(outside).max(initial=0) <= SETTLED * scale and closed(sums, orthonormal(random.normal(size=(dims, min(block, dims))), v_all, 1e-8), singular[wanted - 1]):
            break
        if not new.shape[1]:
            break
        v = new[:, :dims - v_all.shape[1]]
    keep = singular > tiny
    return (v_all @ right.T)[:, keep][:, :wanted], singular[keep][:wanted]


def closed(sums: Sums, probe: np.ndarray, least: float) -> bool:
    """Whether random directions outside the space carry less than the last wanted value (a missed one would show)."""
    if not probe.shape[1]:
        return True
    size = np.sqrt(np.maximum(np.linalg.eigvalsh(sums(lambda x: (x @ probe).T @ (x @ probe))), 0))
    return bool(size[-1] < 0.5 * least)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, block: int = VECTORS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Null vectors and vectors with a null or non-finite entry take no part; a null id is kept, and repeated rows count and return each. Shorter
    vectors count as ending in zeros. Directions in which the rows do not vary (deviation 0 up to rounding) have no whitened
    value and are no components, so there may be fewer; an empty table, or one without any variation, gives no rows. Equal values make
    components that are any basis of their space. An entry of 2^56 and more does not fit the whole numbers and raises an error. ``deviation`` is a
    decimal, since it may exceed a long. Columns other than vec_id and embedding are not read.
    """
    rows = cut_lineage(usable(embeddings))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c - OFFSET)))).alias("most")).first()
    n, dims = size["n"], max(1, size["dims"] or 0)
    if (size["most"] or 0) >= 1 << 62:
        raise OverflowError("an entry is too large for 64 c to be a whole number")
    total = totals(rows, dims)
    # Centred from the offset, where whole numbers are small and exact.
    centre = np.array([(t - n * OFFSET) / max(n, 1) for t in total])
    sums = summed(rows, dims, centre)
    spread_ = sums(lambda x: np.array([[(x * x).sum()]]))[0, 0]  # n times the trace of the covariance
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not spread_ > 0:
        return rows.sparkSession.createDataFrame([], schema)
    axes, singular = bidiagonalise(sums, dims, float(np.sqrt(spread_)), min(components, dims), block)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    turn = axes * (np.sqrt(n) / singular)
    explained = singular**2 / spread_

    def second(x: np.ndarray) -> np.ndarray:
        y = x @ turn
        return np.vstack([y.T @ y, y.sum(axis=0)[None, :]])

    moments = sums(second) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(singular))).max())
    fits = (n * (size["most"] + 1) * 2) ** 2 * dims < 2**62  # else Python's whole numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spread(batches):
            x = rows_of(b.column("x"), dims)
            y = ((x - OFFSET) - centre) @ turn
            apart = ((x - OFFSET) if fits else (x - OFFSET).astype(object)) * n - np.array([t - n * OFFSET for t in total], np.int64 if fits else object)
            deviation = (apart * apart).sum(axis=1)
            deviation = pa.array(deviation).cast(pa.decimal128(38, 0)) if fits else decimals(deviation)
            many, rows_ = y.shape[1], len(x)
            each = pa.array(np.repeat(np.arange(rows_), many))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * many, n)), deviation.take(each),
                                              pa.array(y.ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * many, error))],
                                             ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def decimals(values: np.ndarray) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Every vector on the 32 leading components, whitened."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
