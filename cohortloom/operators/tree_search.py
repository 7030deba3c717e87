"""Random search over Spark ML's boosted trees when the draws look at single rows (samples of rows, least rows in a leaf).

The recipe is Spark's: cuts from the training rows (32 bins), the first tree on the target and the others on twice the residual, variance gain per row,
a random subset of features per node. What differs is where the samples come from: key hashes instead of the generators of partitions, so a row is in the sample of a
tree or not, whatever the partitions.

A model only needs, per tree, how many rows of every cell (a fold and one set of bins) are in its sample, and the sum of their targets. One scan adds these up for
a few trees and all draws at once, a row being hashed once per tree; a block is as many such scans as there are cores. Then every draw grows its trees of the
block in one task, for all folds. Predictions
so far are numbers per cell and go from block to block through the driver, so neither memory nor disk grows with the number of trees. Few rows go to the draws as they are.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.cleaning import col
from cohortloom.functions.hashing import with_replicate_hashes
from cohortloom.operators.boosting import sampled, values, whole
from cohortloom.session import cut_lineage

MAX_BINS = 32  # Spark's default
MAX_VALUES = 200_000  # of all features and folds, counted one by one for the cuts; beyond, quantiles
MAX_CELLS = 500_000  # beyond, Spark ML fits the rows
BLOCK_NUMBERS = 16_000_000  # sums that a task holds
STATE_NUMBERS = 8_000_000  # predictions that the driver holds
SCAN_ROWS = 1 << 18  # of a scan that are added up together
TASK_ROWS = 1_000_000  # that the tasks of draws hold; more are scanned
SCAN_TASK_ROWS = 32_000_000  # beyond, the rows of a scan are shared out too, and not only the trees
PART_ROWS = 1 << 16  # of those, looked at together


def cuts_of(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Spark's cuts between sorted values: all midpoints, or those nearest to equal shares of the rows."""
    most = min(MAX_BINS, int(counts.sum())) - 1
    between = (found[:-1] + found[1:]) / 2
    if len(between) <= most:
        return between
    stride = counts.sum() / (most + 1)
    out, at, goal = [], np.cumsum(counts), stride
    for i in range(1, len(found)):
        if abs(at[i - 1] - goal) < abs(at[i] - goal):
            out.append(between[i - 1])
            goal += stride
    return np.array(out)


def _cuts(rows: DataFrame, p: int, cv: int) -> tuple[float, list[list[np.ndarray]]]:
    """Mean target, and per fold and feature the cuts of the rows outside the fold."""
    cells = rows.select("fold", "y", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col("x")[j].alias("v")) for j in range(p)])).alias("c"))
    counted = cells.groupBy("fold", "c.j", "c.v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).limit(MAX_VALUES + 1).toArrow()
    if counted.num_rows <= MAX_VALUES:
        fold, j, v, n, s = (counted.column(i).to_numpy() for i in range(5))
        if np.isnan(v).any():
            raise ValueError("missing features have to be imputed before a search")
        mean = float(s[j == 0].sum() / max(1, n[j == 0].sum()))
        out = []
        for f in range(cv):
            own = []
            for k in range(p):
                some = (j == k) & (fold != f)
                found, at = np.unique(v[some], return_inverse=True)
                own.append(cuts_of(found, np.bincount(at, n[some])) if len(found) else np.zeros(0))
            out.append(own)
        return mean, out
    share = [(i + 1) / (8 * MAX_BINS) for i in range(8 * MAX_BINS)]
    missing = F.sum(sum((F.col("x")[j].isNull() | F.isnan(F.col("x")[j])).cast("int") for j in range(p)))
    row = rows.agg(missing, F.avg("y"), *[F.percentile_approx(F.when(F.col("fold") != f, F.col("x")[j]), share, 10_000) for f in range(cv) for j in range(p)]).first()
    if row[0]:
        raise ValueError("missing features have to be imputed before a search")
    lists = [cuts_of(*np.unique(np.array(q or [], float), return_counts=True)) if q else np.zeros(0) for q in row[2:]]
    return float(row[1]), [lists[f * p:(f + 1) * p] for f in range(cv)]


@dataclass
class Cells:
    """Cells with the sums of their rows, and for every fold the sets of its own bins: ``own[f]`` (sets x features) and ``place[f]``, the set of every cell."""

    fold: np.ndarray
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    own: list[np.ndarray]
    place: list[np.ndarray]

    def begin(self) -> np.ndarray:
        return np.zeros(sum(len(o) for o in self.own))

    def parts(self, state: np.ndarray) -> list[np.ndarray]:
        return np.split(state, np.cumsum([len(o) for o in self.own])[:-1])

    def r2(self, state: np.ndarray) -> float:
        """Mean over the folds."""
        out = []
        for f, g in enumerate(self.parts(state)):
            held = self.fold == f
            n, s, q, g = self.n[held], self.s[held], self.q[held], g[self.place[f][held]]
            spread = q.sum() - s.sum() ** 2 / n.sum() if n.sum() else 0.0
            out.append(1 - (q - 2 * g * s + g * g * n).sum() / spread if spread > 0 else math.nan)
        return float(np.mean(out))


def _coded(x: np.ndarray, fold: np.ndarray, edges: list[np.ndarray], factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins between all cuts, and a number per fold and bins."""
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint16)
    return bins, (bins.astype(np.uint64) * factors[1:] + 0).sum(axis=1, dtype=np.uint64).astype(np.int64) ^ ((fold.astype(np.uint64) + np.uint64(1)) * factors[0]).astype(np.int64)


def gather(df: DataFrame, key: str | Column, features: Sequence[str], target: str, fold: str, cv: int, seed: int, sample: bool) -> tuple[Cells, DataFrame | None] | None:
    """The cells, and with ``sample`` the rows as (cell, z, h1, h2); None if there are too many cells."""
    p = len(features)
    hashed = with_replicate_hashes(df, key, seed)
    rows = hashed.select(col(fold).cast("int").alias("fold"), col(target).cast("double").alias("y"), F.array(*[col(f).cast("double") for f in features]).alias("x"),
                         *[F.coalesce(F.col(f"_{h}"), F.lit(0)).cast("int").alias(h) for h in ("h1", "h2")])
    mean, cuts = _cuts(rows, p, cv)
    edges = [np.unique(np.concatenate([own[j] for own in cuts])) for j in range(p)]

    def counted(factors: np.ndarray) -> pa.Table:
        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    fold = b.column("fold").to_numpy()
                    bins, number = _coded(values(b.column("x"), p), fold, edges, factors)
                    ends = np.arange(len(bins) + 1, dtype=np.int32) * 2 * p
                    packed = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins).tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(fold), packed, pa.array(b.column("y").to_numpy() - mean)], ["code", "fold", "bins", "z"])

        coded = rows.select("fold", "y", "x").mapInArrow(code, "code long, fold int, bins binary, z double")
        return coded.groupBy("code", "fold", "bins").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q")).limit(MAX_CELLS + 1).toArrow()

    for turn in range(5):  # until no two cells have the same number
        factors = np.random.default_rng([seed, turn]).integers(0, 1 << 63, p + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        got = counted(factors)
        if got.num_rows > MAX_CELLS:
            return None
        codes = got.column("code").to_numpy()
        if len(np.unique(codes)) == len(codes):
            break
    else:
        raise RuntimeError("no numbers tell the cells apart")
    order = np.argsort(codes)
    got, codes = got.take(order), codes[order]
    bins = np.frombuffer(b"".join(got.column("bins").to_pylist()), np.uint16).reshape(len(codes), p)
    own, place = [], []
    for f in range(cv):
        mine = np.zeros(bins.shape, np.int64)
        for j, e in enumerate(edges):
            # A bin between all cuts lies within one bin of the fold; beyond the last cut, in the last.
            mine[:, j] = np.append(np.searchsorted(cuts[f][j], e, side="left"), len(cuts[f][j]))[bins[:, j]]
        sets, at = np.unique(mine, axis=0, return_inverse=True)
        own.append(sets)
        place.append(at.ravel())
    cells = Cells(*(got.column(c).to_numpy() for c in ("fold", "n", "s", "q")), own, place)
    if not sample:
        return cells, None

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, number = _coded(values(b.column("x"), p), b.column("fold").to_numpy(), edges, factors)
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(codes, number).astype(np.int32)), pa.array(b.column("y").to_numpy() - mean), b.column("h1"), b.column("h2")], ["cell", "z", "h1", "h2"])

    return cells, cut_lineage(rows.mapInArrow(numbered, "cell int, z double, h1 int, h2 int"))


def grow(bins: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int, least: int, gain_least: float, chosen: np.ndarray | None, noise: float = 0.0) -> np.ndarray:
    """The value of a tree's leaf for every set of bins, given number and sum of the sampled rows; ``chosen`` has the features each node may use.

    Gains up to ``noise`` are none: they come from the order of additions.
    """
    p = bins.shape[1]
    width = MAX_BINS * p
    base = bins + MAX_BINS * np.arange(p)
    node, open_, out = np.zeros(len(bins), np.int64), np.arange(len(bins)), np.zeros(len(bins))
    total_n, total_s = np.array([n.sum()]), np.array([s.sum()])
    if total_n[0] <= 0:
        return out
    out[:] = total_s[0] / total_n[0]
    first = 0
    for _ in range(depth):
        many = len(total_n)
        at = (node[open_, None] * width + base[open_]).ravel()
        ln = np.cumsum(np.bincount(at, np.repeat(n[open_], p), many * width).reshape(many, p, MAX_BINS), axis=2)
        ls = np.cumsum(np.bincount(at, np.repeat(s[open_], p), many * width).reshape(many, p, MAX_BINS), axis=2)
        rn, rs = total_n[:, None, None] - ln, total_s[:, None, None] - ls
        fine = (ln >= least) & (rn >= least)
        gain = (ls * ls / np.maximum(ln, 1) + rs * rs / np.maximum(rn, 1) - (total_s * total_s / total_n)[:, None, None]) / total_n[:, None, None]
        if chosen is not None:
            fine &= chosen[first:first + many, :, None]
        first += many
        gain = np.where(fine, gain, -np.inf).reshape(many, width)
        best = np.argmax(gain, axis=1)
        top = gain[np.arange(many), best]
        split = (top >= gain_least) & (top > noise)
        if not split.any():
            break
        feature, last = best // MAX_BINS, best % MAX_BINS
        open_ = open_[split[node[open_]]]
        mine = node[open_]
        right = bins[open_, feature[mine]] > last[mine]
        number = np.cumsum(split) - 1
        node[open_] = 2 * number[mine] + right
        which = np.flatnonzero(split)
        flat_n, flat_s = ln.reshape(many, width)[which, best[which]], ls.reshape(many, width)[which, best[which]]
        total_n, total_s = (np.stack([a, b[which] - a], axis=1).ravel() for a, b in ((flat_n, total_n), (flat_s, total_s)))
        out[open_] = (total_s / total_n)[node[open_]]
    return out


def step(cells: Cells, state: np.ndarray, draw: Mapping, tree: int, n: np.ndarray, s: np.ndarray, seed: int) -> np.ndarray:
    """Predictions (about the mean) of a draw's models of all folds after one more tree, from number and sum of the sampled rows per cell."""
    p, depth = cells.own[0].shape[1], int(draw["maxDepth"])
    chosen, share = None, draw["featureSubsetStrategy"]
    if share < 1 and math.ceil(share * p) < p:
        lot = np.random.default_rng([seed, tree]).random((2 ** depth, p))
        chosen = lot.argsort(axis=1).argsort(axis=1) < math.ceil(share * p)
    out, noise = [], 1e-12 * cells.q.sum() / cells.n.sum()
    for f, g in enumerate(cells.parts(state)):
        learns = cells.fold != f
        at, many = cells.place[f][learns], len(g)
        own_n, own_s = np.bincount(at, n[learns], many), np.bincount(at, s[learns], many)
        if tree:
            own_s = 2 * (own_s - own_n * g)
        out.append(g + (draw["stepSize"] if tree else 1.0) * grow(cells.own[f], own_n, own_s, depth, draw["minInstancesPerNode"], draw["minInfoGain"], chosen, noise))
    return np.concatenate(out)


def _alone(spark, cells: Cells, rows: DataFrame | None, draws: dict[int, dict], seed: int) -> dict[int, np.ndarray]:
    """All trees of draws whose tasks can do without a scan: those without samples, or with ``rows`` that a task holds; the longest first."""
    if not draws:
        return {}
    many, held = len(cells.n), None
    if rows is not None:
        table = rows.toArrow()
        cell, z, h1, h2 = (table.column(c).to_numpy() for c in ("cell", "z", "h1", "h2"))
        held = spark.sparkContext.broadcast((cell, z, whole(h1), whole(h2)))

    def run(i: int) -> tuple[int, bytes]:
        state, share = cells.begin(), draws[i]["subsamplingRate"] * (1 << 24)
        for tree in range(draws[i]["maxIter"]):
            n, s = cells.n, cells.s
            if held is not None:
                n, s = np.zeros(many), np.zeros(many)
                for at in range(0, len(held.value[0]), PART_ROWS):
                    cell, z, h1, h2 = (a[at:at + PART_ROWS] for a in held.value)
                    some = np.flatnonzero(sampled(h1, h2, seed, tree) < share)
                    n += np.bincount(cell[some], None, many)
                    s += np.bincount(cell[some], z[some], many)
            state = step(cells, state, draws[i], tree, n, s, seed)
        return i, state.tobytes()

    order = sorted(draws, key=lambda i: -draws[i]["maxIter"])
    out = {i: np.frombuffer(b) for i, b in spark.sparkContext.parallelize(order, len(order)).map(run).collect()}
    if held is not None:
        held.destroy()
    return out


class Steps:
    """How many of sorted numbers are at most a whole number below 2**24: by its leading 12 bits, and by search where these do not tell."""

    def __init__(self, sorted_: np.ndarray):
        begin = np.arange(1 << 12) << 12
        self.sorted, self.least = sorted_, np.searchsorted(sorted_, begin, side="right")
        self.tells = self.least == np.searchsorted(sorted_, begin + (1 << 12) - 1, side="right")

    def count(self, u: np.ndarray) -> np.ndarray:
        at = u.astype(np.int64) >> 12
        out = self.least[at]
        open_ = np.flatnonzero(~self.tells[at])
        out[open_] = np.searchsorted(self.sorted, u[open_], side="right")
        return out


def _block(rows: DataFrame, cells: Cells, draws: dict[int, dict], states: dict[int, np.ndarray], groups: list[range], seed: int, tasks: int) -> dict[int, np.ndarray]:
    """The trees of all ``groups`` (or as many as a draw has) of all draws; the trees of a group are sampled in ``tasks`` tasks."""
    many = len(cells.n)
    order = sorted(draws, key=lambda i: draws[i]["subsamplingRate"])
    share = np.array([draws[i]["subsamplingRate"] for i in order]) * (1 << 24)

    def partial(group: range):
        alive = {t: [k for k, i in enumerate(order) if draws[i]["maxIter"] > t] for t in group}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = {t: np.zeros((2, len(alive[t]) + 1, many)) for t in alive}
            steps = {t: Steps(share[alive[t]]) for t in alive}
            waiting: list = []

            def added() -> None:
                b = pa.Table.from_batches(waiting)
                cell, z, h1, h2 = (b.column(c).to_numpy() for c in ("cell", "z", "h1", "h2"))
                h1, h2 = whole(h1), whole(h2)
                for t, total in totals.items():
                    # A row counts for every share above its number: sums up to each share.
                    first = steps[t].count(sampled(h1, h2, seed, t))
                    some = np.flatnonzero(first < len(alive[t]))
                    at = first[some] * many + cell[some]
                    total[0] += np.bincount(at, None, total[0].size).reshape(total[0].shape)
                    total[1] += np.bincount(at, z[some], total[1].size).reshape(total[1].shape)

            for b in batches:
                waiting.append(b)
                if sum(w.num_rows for w in waiting) >= SCAN_ROWS:
                    added()
                    waiting.clear()
            if waiting:
                added()
            for total in totals.values():
                np.cumsum(total, axis=1, out=total)
            for k, i in enumerate(order):
                own = [total[:, alive[t].index(k)] for t, total in totals.items() if k in alive[t]]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([group.start], pa.int32()), pa.array([np.stack(own).tobytes()], pa.binary())], ["draw", "tree", "numbers"])

        return sums

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        state, totals = None, {}
        for tree, numbers in zip(table.column("tree").to_pylist(), table.column("numbers")):
            part = np.frombuffer(numbers.as_buffer())
            if tree < 0:
                state = part
            else:
                totals[tree] = part if tree not in totals else totals[tree] + part
        for group in groups:
            if group.start in totals:
                for k, (n, s) in enumerate(totals[group.start].reshape(-1, 2, many)):
                    state = step(cells, state, draws[i], group.start + k, n, s, seed)
        return pa.table({"draw": pa.array([i], pa.int32()), "numbers": pa.array([state.tobytes()], pa.binary())})

    spark = rows.sparkSession
    given = pa.table({"draw": pa.array(order, pa.int32()), "tree": pa.array([-1] * len(order), pa.int32()), "numbers": pa.array([states[i].tobytes() for i in order], pa.binary())})
    kind = T.StructType.fromDDL("draw int, tree int, numbers binary")
    parts = spark.createDataFrame(given, kind)
    for group in groups:
        parts = parts.unionByName(rows.coalesce(tasks).mapInArrow(partial(group), kind))
    got = parts.repartition(2 * spark.sparkContext.defaultParallelism, "draw").groupBy("draw").applyInArrow(grown, "draw int, numbers binary").collect()
    return {r["draw"]: np.frombuffer(r["numbers"]) for r in got}


def trial_scores(df: DataFrame, key: str | Column, features: Sequence[str], target: str, fold: str, draws: Sequence[Mapping], cv: int, seed: int) -> list[float] | None:
    """Mean R squared over the folds per draw of Spark's parameters; None if the rows have too many sets of bins."""
    plain = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "minInfoGain": 0.0, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": 1.0}
    full = {i: plain | {k: (1.0 if v == "all" else float(v)) if k == "featureSubsetStrategy" else v for k, v in d.items()} for i, d in enumerate(draws)}
    samples = {i: d for i, d in full.items() if d["subsamplingRate"] < 1}
    found = gather(df, key, features, target, fold, cv, seed, bool(samples))
    if found is None:
        return None
    cells, rows = found
    spark = df.sparkSession
    states = _alone(spark, cells, None, {i: d for i, d in full.items() if i not in samples}, seed)
    if cells.n.sum() <= TASK_ROWS:
        states |= _alone(spark, cells, rows, samples, seed)
    elif samples:
        many, cores = len(cells.n), spark.sparkContext.defaultParallelism
        tasks = int(-(-cells.n.sum() // SCAN_TASK_ROWS))
        abreast = max(1, cores // tasks)
        order = sorted(samples, key=lambda i: samples[i]["maxIter"])
        most = max(1, STATE_NUMBERS // max(1, len(cells.begin())))
        for at in range(0, len(order), most):
            own = {i: samples[i] for i in order[at:at + most]}
            states |= {i: cells.begin() for i in own}
            begin = 0
            while own:
                last = max(d["maxIter"] for d in own.values())
                size = min(max(1, BLOCK_NUMBERS // (2 * max(1, many) * max(len(own) + 1, tasks * abreast))), -(-(last - begin) // abreast))
                groups = [range(t, min(t + size, last)) for t in range(begin, min(begin + abreast * size, last), size)]
                states |= _block(rows, cells, own, states, groups, seed, tasks)
                gc.collect()
                spark.sparkContext._jvm.System.gc()  # else what the block shuffled stays on disk
                begin = groups[-1].stop
                own = {i: d for i, d in own.items() if d["maxIter"] > begin}
    return [cells.r2(states[i]) for i in range(len(draws))]
