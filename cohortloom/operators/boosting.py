"""Boosted trees for many models at once, from histograms that share their scans.

Bootstrap replicates, folds and candidate parameters give hundreds of models over the same rows. Features are cut into bins once; then one
pass over the rows per tree level adds up, for every model and open node, weight and weighted residual per feature and bin. Replicates are
weights from key hashes (see ``replicates``), folds are masks, so nothing is copied. Splits are found on the driver from sums whose size does
not depend on the number of rows. The recipe is second-order boosting for squared error: gain G^2 / (H + lambda), shrinkage,
least child weight, least gain, row and column sampling, and for missing values the side that gains more.

Where many rows share fold and features, a scan first adds them up per cell (a fold and one set of features), with a sum of weights and of
weighted targets for every weighting that the models of some trees use; the passes then read cells, whose number does not depend on that of the rows.
On their way a cell's sums cost as much as some hundred rows, so a task sends whichever is smaller; where the sums of all tasks are, a few tasks keep
those of all cells to the end. A table of sums far larger than that of the rows is not made: the passes then read rows.

Models are fitted in batches that bound the sums of a task and the driver. Predictions so far are stored with the rows every
``KEEP`` trees, so later passes only add the newer trees.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.functions.hashing import with_replicate_hashes
from cohortloom.operators.harmonize import harmonize_split
from cohortloom.operators.packed import PIECES, collected, pieces
from cohortloom.operators.replicates import PLAIN, bootstrap_moments, weight_of, weights_of
from cohortloom.operators.resample import assign_folds, regression_metrics
from cohortloom.operators.site_ridge import _fitted
from cohortloom.operators.trees import SEARCH_SPACE, draw_params
from cohortloom.session import cut_lineage, local_table, small_rows
from cohortloom.sources.sinks import append_run_record

BINS = 64
KEEP = 16
ROWS = 8192
BATCH_NUMBERS = 4_000_000
REPEATS = 4  # rows per cell from which cells are worth their scan
WEIGHTINGS = 256  # that one scan adds up, unless a tree needs more
CELL_ROWS = 1 << 18  # of a scan that are added up together
CELL_NUMBERS = 16_000_000  # that a task of such a scan holds
CELL_BYTES = 256 << 20  # of a table of cells; it may have more if the rows have
ROW_BYTES = 32  # of a row on its way to its cell
TASK_BYTES = 128 << 20  # that a task reads of rows on their way
SENT = np.dtype([("y", "<f8"), ("h1", "<i4"), ("h2", "<i4")])  # a row on its way
NOBODY = -1  # no fold is held out


@dataclass(frozen=True)
class Model:
    """What one model sees and how it learns. ``rep`` PLAIN weighs rows alike; rows of ``fold`` are held out."""

    rep: int = PLAIN
    fold: int = NOBODY
    n_estimators: int = 50
    max_depth: int = 2
    eta: float = 0.3
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    seed: int = 0

    def weighting(self, tree: int | None) -> tuple:
        """Models with the same one weigh rows alike (folds aside)."""
        return (self.rep, 1.0, 0, NOBODY) if tree is None or self.subsample >= 1 else (self.rep, self.subsample, self.seed, tree)


@dataclass
class Tree:
    """Nodes in heap order: a feature (or -1 for a leaf), the last bin that goes left, the side of missing values, the leaf's value."""

    feature: np.ndarray
    last: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def walk(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node of every row after ``depth`` levels (bin 0 is a missing value)."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[node]
            own = bins[rows, np.maximum(f, 0)]
            left = np.where(own == 0, self.missing_left[node], own <= self.last[node])
            node = np.where(f >= 0, 2 * node + 2 - left, node)
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.walk(bins, int(np.log2(len(self.value) + 1)) - 1)]


@dataclass
class Booster:
    model: Model
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def importances(self, p: int) -> np.ndarray:
        """Mean gain of a feature's splits, as a share of all features'."""
        total, count = np.zeros(p), np.zeros(p)
        for t in self.trees:
            split = t.feature >= 0
            np.add.at(total, t.feature[split], t.gain[split])
            np.add.at(count, t.feature[split], 1)
        mean = np.divide(total, count, out=np.zeros(p), where=count > 0)
        return mean / mean.sum() if mean.sum() > 0 else mean


@dataclass
class Coder:
    """Values to bins. With ``adjust`` (per (rep, fold) a scale and an offset per site) a model's values are adjusted first."""

    features: list[str]
    edges: list[np.ndarray]
    adjust: dict | None = None

    def coded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.minimum(np.searchsorted(e, x[:, j], side="left"), max(len(e) - 1, 0)) + 1)
        return out


@dataclass
class Binned:
    """Rows ready for training: y, fold, h1, h2, and either bins or (site, x). With ``repeats`` they share few cells (about so many)."""

    table: DataFrame
    coder: Coder
    repeats: bool = False
    rows: int = 0
    cells: int = 0

    @property
    def features(self) -> list[str]:
        return self.coder.features


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of bins: values of about equal rank distance, so columns of few values have a bin for each."""
    at = [(i + 1) / (4 * bins) for i in range(4 * bins)]
    row = df.agg(*[F.percentile_approx(col(f).cast("double"), at, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    out = []
    for values in row:
        values = np.unique(np.array(values if values is not None else [], float))
        out.append(values if len(values) <= bins else values[np.unique(np.linspace(0, len(values) - 1, bins).round().astype(int))])
    return out


def bin_rows(df: DataFrame, key: str | Column, features: Sequence[str], target: str, fold: str | None, seed: int = 42, bins: int = BINS, site: str | None = None) -> Binned:
    """Rows that have the target, with their bins, fold (NOBODY without one) and the hashes that replicates need."""
    known = df.where(col(target).isNotNull())
    features = list(features)
    coder = Coder(features, quantile_edges(known, features, bins))
    slim = with_replicate_hashes(known, key, seed).select(
        col(target).cast("double").alias("y"), (col(fold).cast("int") if fold else F.lit(NOBODY)).alias("fold"), *[F.col(f"_{h}").cast("int").alias(h) for h in ("h1", "h2")],
        *([col(site).cast("string").alias("site")] if site else []), F.array(*[col(f).cast("double") for f in features]).alias("x"))
    # Every row costs work for every model, so few rows are spread over all cores too.
    cores = slim.sparkSession.sparkContext.defaultParallelism
    if slim.rdd.getNumPartitions() < cores:
        slim = slim.repartition(cores)
    if not site:
        slim = slim.mapInArrow(_code(coder), "y double, fold int, h1 int, h2 int, bins binary")
    table = cut_lineage(slim)
    cell = F.xxhash64("fold", "site", F.to_json("x")) if site else F.xxhash64("fold", "bins")
    size = table.agg(F.count("*").alias("rows"), F.approx_count_distinct(cell).alias("cells")).first()
    return Binned(table, coder, size["rows"] >= REPEATS * size["cells"] > 0, size["rows"], size["cells"])


def values(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def _code(coder: Coder):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = coder.coded(values(b.column("x"), len(coder.features)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("y", "fold", "h1", "h2")), pa.array([r.tobytes() for r in bins], pa.binary())], ["y", "fold", "h1", "h2", "bins"])
    return code


def whole(h: np.ndarray) -> np.ndarray:
    """Hashes wide enough for products; those of a missing key stay NaN."""
    return h.astype(np.int64) if h.dtype.kind == "i" else h


def sampled(h1: np.ndarray, h2: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number below 2**24 per row and tree, from the row's hashes."""
    code = (h1.astype(np.uint64) << np.uint64(28) ^ h2.astype(np.uint64)) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + (seed + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    code = (code ^ code >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    code = (code ^ code >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (code >> np.uint64(40)).astype(float)


def packed(column: pa.Array, kind, width: int) -> np.ndarray:
    """Rows of equal length that travel as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Batch:
    """Rows (or cells, with the ``weightings`` whose sums they hold) of one Arrow batch, with the parts that several models share."""

    def __init__(self, b: pa.RecordBatch, coder: Coder, models: Sequence[Model], weightings: Sequence[tuple] | None = None):
        self.coder, p = coder, len(coder.features)
        self.fold, self.place = b.column("fold").to_numpy(zero_copy_only=False), None
        if weightings is None:
            self.y, self.h1, self.h2 = (whole(b.column(c).to_numpy(zero_copy_only=False)) for c in ("y", "h1", "h2"))
            self.weights = weights_of(self.h1, self.h2, max([m.rep for m in models], default=PLAIN) + 1)
        else:
            many = len(weightings)
            sums = packed(b.column("sums"), float, 3 + 2 * many)
            self.plain, self.w, self.wy = sums[:, :3].T, sums[:, 3:3 + many], sums[:, 3 + many:]
            self.place = {w: i for i, w in enumerate(weightings)}
        if coder.adjust is None:
            self.shared = packed(b.column("bins" if weightings is None else "cell"), np.uint8, p)
        else:
            self.x = values(b.column("x"), p) if weightings is None else packed(b.column("cell"), float, p)
            self.site, self.own = b.column("site").to_pylist(), {}
        self.stored = np.frombuffer(b"".join(b.column("f").to_pylist()), float).reshape(len(self.fold), -1) if "f" in b.schema.names else None

    def bins(self, m: Model) -> np.ndarray:
        if self.coder.adjust is None:
            return self.shared
        if (m.rep, m.fold) not in self.own:
            scale, offset = self.coder.adjust[m.rep, m.fold]
            gone = np.full(self.x.shape[1], np.nan)  # a site that the training rows lack
            a = np.array([scale.get(s, gone) for s in self.site]).reshape(self.x.shape)
            c = np.array([offset.get(s, gone) for s in self.site]).reshape(self.x.shape)
            self.own = {(m.rep, m.fold): self.coder.coded(self.x * a + c)}  # models of one training set come in a row
        return self.own[m.rep, m.fold]

    def train(self, m: Model, tree: int | None = None) -> np.ndarray:
        """Training weights; with ``tree``, rows that its sample leaves out weigh nothing."""
        w = np.where(self.fold != m.fold, self.weights[:, m.rep] if m.rep != PLAIN else 1.0, 0.0)
        if tree is not None and m.subsample < 1:
            w = np.where(sampled(self.h1, self.h2, m.seed, tree) < m.subsample * (1 << 24), w, 0.0)
        return w

    def sums(self, m: Model, tree: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Training weight, and weight times target, of every row or cell."""
        if self.place is None:
            w = self.train(m, tree)
            return w, w * self.y
        at, learns = self.place[m.weighting(tree)], self.fold != m.fold
        return np.where(learns, self.w[:, at], 0.0), np.where(learns, self.wy[:, at], 0.0)

    def errors(self, booster: Booster, mean: float) -> list[float]:
        """Number, squared error, sum and sum of squares (of the target less ``mean``, as in the cells) of the held-out rows."""
        held = self.fold == booster.model.fold
        f = self.predicted(booster, 0, 0)[held]
        if self.place is None:
            y = self.y[held] - mean
            return [held.sum(), ((self.y[held] - f) ** 2).sum(), y.sum(), (y * y).sum()]
        n, y, yy = self.plain[:, held]
        f = f - mean
        return [n.sum(), (yy - 2 * f * y + f * f * n).sum(), y.sum(), yy.sum()]

    def predicted(self, booster: Booster, at: int, done: int) -> np.ndarray:
        """Prediction after all trees; ``done`` trees of model number ``at`` are stored with the rows."""
        out = self.stored[:, at].copy() if self.stored is not None else np.full(len(self.fold), booster.base)
        for t in booster.trees[done:]:
            out += t.predict(self.bins(booster.model))
        return out


def most_weightings(binned: Binned) -> int:
    """Of a table of cells that stays within ``CELL_BYTES``, or within the bytes of the rows."""
    return int(max(CELL_BYTES, ROW_BYTES * binned.rows) // (8 * max(1, binned.cells)) - 3) // 2


def weightings_from(models: Sequence[Model], tree: int, most: int = WEIGHTINGS) -> list[tuple]:
    """The weightings of ``tree`` and as many later trees as one scan takes; with the first tree's come those without sampling."""
    out = dict.fromkeys(m.weighting(None) for m in models) if tree == 0 else {}
    for t in range(tree, max(m.n_estimators for m in models)):
        more = [m.weighting(t) for m in models if m.n_estimators > t]
        if t > tree and len({*out, *more}) > min(WEIGHTINGS, most):
            break
        out |= dict.fromkeys(more)
    return list(out)


def cells(binned: Binned, weightings: Sequence[tuple], mean: float, before: DataFrame | None = None) -> DataFrame:
    """One row per fold (and site) and features: fold, (site,) cell, sums, and the stored predictions f of the cells ``before``, if there are any.

    The sums are the number of rows, the sum and the sum of squares of the target less ``mean``, the weights per weighting, and the weighted targets.
    """
    p, by_site, many = len(binned.features), binned.coder.adjust is not None, len(weightings)
    size = 3 + 2 * many
    keys = ["fold", *(["site"] if by_site else []), "cell"]
    kinds = {"fold": pa.int32(), "site": pa.string(), "cell": pa.binary()}
    alike: dict[tuple, list[int]] = {}  # weightings that differ in the share of rows only
    for i, (rep, _, seed, tree) in enumerate(weightings):
        alike.setdefault((rep, seed, tree), []).append(i)

    few = binned.table.sparkSession.sparkContext.defaultParallelism
    hold = binned.cells * size <= CELL_NUMBERS and few * binned.cells * size * 8 <= binned.rows * ROW_BYTES
    expected, room = binned.cells, CELL_NUMBERS // size if hold else 0
    columns = [*keys, "sums", "f", "rows"]

    def add_up(y: np.ndarray, h1: np.ndarray, h2: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
        """Adds rows to sums (numbers x cells); ``at`` has the cell of every row."""
        n, z = total.shape[1], y - mean
        for i, v in enumerate((None, z, z * z)):
            total[i] += np.bincount(at, v, n)
        for (rep, seed, tree), some in alike.items():
            w = weight_of(h1, h2, rep) if rep != PLAIN else np.ones(len(y))
            shares = np.array([weightings[i][1] for i in some])
            order = np.argsort(shares, kind="stable")
            many_shares = len(some)
            if tree == NOBODY and many_shares == 1:
                total[3 + some[0]] += np.bincount(at, w, n)
                total[3 + many + some[0]] += np.bincount(at, w * y, n)
                continue
            # A row counts for every share above its number: sums up to each share.
            first = np.zeros(len(y), np.int64) if tree == NOBODY else np.searchsorted(shares[order] * (1 << 24), sampled(h1, h2, seed, tree), side="right")
            for offset, v in ((3, w), (3 + many, w * y)):
                sums = np.bincount(at * (many_shares + 1) + first, v, n * (many_shares + 1)).reshape(n, -1)
                total[offset + np.array(some)[order]] += np.cumsum(sums, axis=1)[:, :many_shares].T

    def handed_on(raw: Sequence[bytes], names: list, total: np.ndarray | None, rows: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        """Cells (fold, place of the site, features) with their sums, or with their rows."""
        step = max(1, (1 << 20) // size) if total is not None else 1 << 16
        for i in range(0, len(raw), step):
            some = raw[i:i + step]
            head = np.frombuffer(b"".join(r[:8] for r in some), np.int32).reshape(-1, 2)
            sums = None if total is None else [t.tobytes() for t in np.ascontiguousarray(total[:, i:i + step].T)]
            cell = {"fold": head[:, 0], "site": [names[k] for k in head[:, 1]] if by_site else None, "cell": [r[8:] for r in some]}
            yield pa.RecordBatch.from_arrays([*(pa.array(cell[k], kinds[k]) for k in keys), pa.nulls(len(some), pa.binary()) if sums is None else pa.array(sums, pa.binary()),
                                              pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary()) if rows is None else rows.slice(i, step)], columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites, held, total = {}, {}, np.zeros((size, min(room, expected * 11 // 10)))

        def added(b: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal total
            y, fold, h1, h2 = (b.column(c).to_numpy() for c in ("y", "fold", "h1", "h2"))
            own = values(b.column("x").combine_chunks(), p) if by_site else packed(b.column("bins"), np.uint8, p)
            own = np.ascontiguousarray(own).view(np.uint8).reshape(len(y), -1)
            place = np.array([sites.setdefault(s, len(sites)) for s in b.column("site").to_pylist()] if by_site else np.zeros(len(y)), np.int32)
            fold = np.where(np.isnan(fold), np.iinfo(np.int32).min, fold).astype(np.int32)  # in no fold: learned from, never held out
            raw = np.concatenate([fold[:, None].view(np.uint8), place[:, None].view(np.uint8), own], axis=1)
            code, at, count = np.unique(np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").ravel(), return_inverse=True, return_counts=True)
            code = code.tolist()
            to = np.array([held.setdefault(c, len(held)) if len(held) < room else held.get(c, -1) for c in code], np.int64)
            if len(held) > total.shape[1]:
                total = np.concatenate([total, np.zeros((size, min(room, max(len(held), total.shape[1] * 3 // 2)) - total.shape[1]))], axis=1)
            stay, many_rows = to >= 0, count * ROW_BYTES >= size * 8
            for sent in (stay, ~stay & many_rows):
                rows = sent[at]
                if not rows.any():
                    continue
                if sent is stay:
                    add_up(y[rows], whole(h1[rows]), whole(h2[rows]), to[at[rows]], total)
                    continue
                sums = np.zeros((size, int(sent.sum())))
                add_up(y[rows], whole(h1[rows]), whole(h2[rows]), (np.cumsum(sent) - 1)[at[rows]], sums)
                yield from handed_on([c for c, k in zip(code, sent) if k], list(sites), sums)
            sent = ~stay & ~many_rows
            if sent.any():
                order = np.flatnonzero(sent[at])
                order = order[np.argsort(at[order], kind="stable")]
                body = np.empty(len(order), SENT)
                body["y"] = y[order]
                for name, h in (("h1", h1[order]), ("h2", h2[order])):
                    body[name] = np.where(np.isnan(h), -1, h)
                ends = np.concatenate([[0], np.cumsum(count[sent])]) * SENT.itemsize
                rows = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body.tobytes())])
                yield from handed_on([c for c, k in zip(code, sent) if k], list(sites), None, rows)

        waiting = []
        for b in batches:
            waiting.append(b)
            if sum(w.num_rows for w in waiting) >= CELL_ROWS:
                yield from added(pa.Table.from_batches(waiting))
                waiting = []
        if waiting:
            yield from added(pa.Table.from_batches(waiting))
        yield from handed_on(list(held), list(sites), total[:, :len(held)])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; the last cell of a batch goes on in the next."""
        last, carried, stored = None, None, None

        def closed(cells_: list, total: np.ndarray, fs: list) -> pa.RecordBatch:
            parts = list(zip(*cells_)) or [[]] * len(keys)
            return pa.RecordBatch.from_arrays([*(pa.array(c, kinds[k]) for k, c in zip(keys, parts)), pa.array([t.tobytes() for t in np.ascontiguousarray(total.T)], pa.binary()),
                                               pa.array(fs, pa.binary())], [*keys, "sums", "f"])

        def steps() -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 21) // size)
            for b in batches:
                for i in range(0, b.num_rows, step):
                    yield b.slice(i, step)

        for b in steps():
            found, at, fs = [] if last is None else [last], [], [] if last is None else [stored]
            for *key, f in zip(*(b.column(c).to_pylist() for c in [*keys, "f"])):
                if not found or key != found[-1]:
                    found.append(key)
                    fs.append(None)
                fs[-1] = f if f is not None else fs[-1]
                at.append(len(found) - 1)
            at, total = np.array(at, np.int64), np.zeros((size, len(found)))
            if last is not None:
                total[:, 0] = carried
            sums, rows = b.column("sums"), b.column("rows")
            summed = sums.is_valid().to_numpy(zero_copy_only=False)
            if summed.any():
                np.add.at(total.T, at[summed], packed(sums.drop_null(), float, size))
            sent = rows.is_valid().to_numpy(zero_copy_only=False)
            if sent.any():
                bodies = rows.drop_null().to_pylist()
                body = np.frombuffer(b"".join(bodies), SENT)
                h1, h2 = (np.where(body[h] < 0, np.nan, body[h]) if (body[h] < 0).any() else body[h].astype(np.int64) for h in ("h1", "h2"))
                add_up(body["y"], h1, h2, np.repeat(at[sent], [len(r) // SENT.itemsize for r in bodies]), total)
            yield closed(found[:-1], total[:, :-1], fs[:-1])
            last, carried, stored = found[-1], total[:, -1].copy(), fs[-1]
        if last is not None:
            yield closed([last], carried[:, None], [stored])

    schema = ", ".join([*(f"{k} {({'fold': 'int', 'site': 'string', 'cell': 'binary'})[k]}" for k in keys), "sums binary, f binary"])
    parts = (binned.table.coalesce(few) if hold else binned.table).mapInArrow(partial, schema + ", rows binary")
    if before is not None:
        nothing = F.lit(None).cast("binary")
        parts = parts.unionByName(before.select(*keys, nothing.alias("sums"), "f", nothing.alias("rows")))
    tasks = few if hold else max(few, -(-2 * ROW_BYTES * binned.rows // TASK_BYTES))
    out = parts.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)
    return cut_lineage(out if before is not None else out.drop("f"))


def _mean(binned: Binned) -> float:
    return binned.table.agg(F.avg("y")).first()[0] or 0.0


def _pass(table: DataFrame, coder: Coder, models: Sequence[Model], shape: tuple[int, ...], add, weightings: Sequence[tuple] | None = None) -> np.ndarray:
    """``add(batch, total)`` over all rows (or cells), summed over all tasks."""
    size = int(np.prod(shape))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                add(Batch(whole.slice(at, ROWS), coder, models, weightings), total)
        yield from pieces("", total.ravel())

    got = collected(table.mapInArrow(partial, PIECES), size, 1)
    return got.get("", np.zeros(size)).reshape(shape)


def columns_of(m: Model, tree: int, p: int) -> np.ndarray:
    """The features a tree may use."""
    many = max(1, round(m.colsample_bytree * p))
    return np.arange(p) if many >= p else np.sort(np.random.default_rng([m.seed, tree]).choice(p, many, replace=False))


def best_split(g: np.ndarray, h: np.ndarray, m: Model, allowed: np.ndarray) -> tuple | None:
    """(feature, last bin left, missing left, gain, sums of both sides) for sums (features x bins); the first of equal gains."""
    total_g, total_h = g[allowed[0]].sum(), h[allowed[0]].sum()
    if total_h <= 0:
        return None
    left_g, left_h = np.cumsum(g[allowed, 1:], axis=1), np.cumsum(h[allowed, 1:], axis=1)
    best = None
    for missing_left in (False, True):
        lg, lh = (left_g + g[allowed, :1], left_h + h[allowed, :1]) if missing_left else (left_g, left_h)
        rg, rh = total_g - lg, total_h - lh
        fine = (lh >= max(m.min_child_weight, 1e-9)) & (rh >= max(m.min_child_weight, 1e-9))
        gain = np.where(fine, lg**2 / (np.maximum(lh, 0) + m.reg_lambda) + rg**2 / (np.maximum(rh, 0) + m.reg_lambda) - total_g**2 / (total_h + m.reg_lambda), -np.inf)
        at = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[at] > max(m.gamma, 1e-12) and (best is None or gain[at] > best[3]):
            best = (int(allowed[at[0]]), int(at[1]) + 1, missing_left, float(gain[at]), (lg[at], lh[at]), (rg[at], rh[at]))
    return best


def fit_many(binned: Binned, models: Sequence[Model]) -> list[Booster]:
    """All models, in batches whose histograms stay within ``BATCH_NUMBERS``."""
    p, width = len(binned.features), max([len(e) for e in binned.coder.edges], default=0) + 1
    each = 2 ** max([m.max_depth for m in models], default=1) * p * width
    many = max(1, BATCH_NUMBERS // each)
    order = sorted(range(len(models)), key=lambda i: (models[i].n_estimators, models[i].rep, models[i].fold))
    out: dict[int, Booster] = {}
    for i in range(0, len(order), many):
        some = order[i:i + many]
        out |= dict(zip(some, _fit_batch(binned, [models[k] for k in some], p, width)))
    return [out[i] for i in range(len(models))]


def _fit_batch(binned: Binned, models: list[Model], p: int, width: int) -> list[Booster]:
    table, coder, stored, weightings, mean = binned.table, binned.coder, 0, None, 0.0
    most = most_weightings(binned)
    if binned.repeats and len(weightings_from(models, 0, 0)) <= most:
        weightings, mean = weightings_from(models, 0, most), _mean(binned)
        table = cells(binned, weightings, mean)

    def means(b: Batch, total: np.ndarray) -> None:
        for i, m in enumerate(models):
            w, wy = b.sums(m)
            total[i] += [w.sum(), wy.sum()]

    sums = _pass(table, coder, models, (len(models), 2), means, weightings)
    boosters = [Booster(m, float(s[1] / s[0]) if s[0] else 0.0) for m, s in zip(models, sums)]
    for tree in range(max(m.n_estimators for m in models)):
        active = [i for i, m in enumerate(models) if m.n_estimators > tree]
        growing = {i: Tree.empty(models[i].max_depth) for i in active}
        if weightings is not None and any(models[i].weighting(tree) not in weightings for i in active):
            if tree > stored:
                table, stored = _stored(table, coder, models, boosters, stored, weightings), tree
            weightings = weightings_from(models, tree, most)
            table = cells(binned, weightings, mean, table if stored else None)
        for level in range(max(models[i].max_depth for i in active)):
            own = [i for i in active if models[i].max_depth > level and (level == 0 or (growing[i].feature[2 ** (level - 1) - 1:2**level - 1] >= 0).any())]
            if not own:
                break
            first, nodes = 2**level - 1, 2**level

            def histograms(b: Batch, total: np.ndarray) -> None:
                for k, i in enumerate(own):
                    m = models[i]
                    (w, wy), bins = b.sums(m, tree), b.bins(m)
                    node = growing[i].walk(bins, level) - first
                    rows = np.flatnonzero((w > 0) & (node >= 0))
                    if not len(rows):
                        continue
                    r = wy[rows] - w[rows] * b.predicted(boosters[i], i, stored)[rows]
                    cell = (node[rows, None] * p + np.arange(p)[None, :]) * width + bins[rows]
                    size = nodes * p * width
                    total[k, 0] += np.bincount(cell.ravel(), weights=np.repeat(r, p), minlength=size).reshape(nodes, p, width)
                    total[k, 1] += np.bincount(cell.ravel(), weights=np.repeat(w[rows], p), minlength=size).reshape(nodes, p, width)

            got = _pass(table, coder, models, (len(own), 2, nodes, p, width), histograms, weightings)
            for k, i in enumerate(own):
                m, t = models[i], growing[i]
                allowed = columns_of(m, tree, p)
                for n in range(nodes):
                    g, h = got[k, 0, n], got[k, 1, n]
                    if level == 0:
                        t.value[0] = m.eta * g[0].sum() / (h[0].sum() + m.reg_lambda)
                    split = best_split(g, h, m, allowed)
                    if split is None:
                        continue
                    at = first + n
                    t.feature[at], t.last[at], t.missing_left[at], t.gain[at] = split[:4]
                    for side, (sg, sh) in enumerate(split[4:]):
                        t.value[2 * at + 1 + side] = m.eta * sg / (sh + m.reg_lambda)
        for i in active:
            boosters[i].trees.append(growing[i])
        if (tree + 1) % KEEP == 0 and any(m.n_estimators > tree + 1 for m in models):
            table, stored = _stored(table, coder, models, boosters, stored, weightings), tree + 1
    return boosters


def _stored(table: DataFrame, coder: Coder, models: list[Model], boosters: list[Booster], done: int, weightings: Sequence[tuple] | None) -> DataFrame:
    """Rows (or cells) with the predictions so far of every model of the batch."""
    names = [c for c in table.columns if c != "f"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                b = Batch(part, coder, models, weightings)
                f = np.stack([b.predicted(x, i, done) for i, x in enumerate(boosters)], axis=1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([r.tobytes() for r in f], pa.binary())], [*names, "f"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name != "f")
    return cut_lineage(table.mapInArrow(keep, kinds + ", f binary"))


def score_many(binned: Binned, boosters: Sequence[Booster]) -> np.ndarray:
    """Per model over its held-out rows: number, sum of squared errors, sum and sum of squares of the target (about its mean over all rows)."""
    mean, models = _mean(binned), [b.model for b in boosters]
    table, weightings = (cells(binned, [], mean), []) if binned.repeats else (binned.table, None)

    def errors(b: Batch, total: np.ndarray) -> None:
        for i, x in enumerate(boosters):
            total[i] += b.errors(x, mean)

    return _pass(table, binned.coder, models, (len(models), 4), errors, weightings)


def pooled_r2(scores: np.ndarray) -> float | None:
    n, sse, s, q = scores.sum(axis=0)
    spread = q - s * s / n if n else 0.0
    return float(1 - sse / spread) if spread > 0 else None


def predict_rows(df: DataFrame, booster: Booster, binned: Binned, out: str = "prediction") -> DataFrame:
    """``df`` with the model's prediction for every row."""
    coder = binned.coder

    @F.pandas_udf("double")
    def predicted(x):
        import pandas as pd

        bins = coder.coded(np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), -1))
        total = np.full(len(x), booster.base)
        for t in booster.trees:
            total += t.predict(bins)
        return pd.Series(total)

    return df.withColumn(out, predicted(F.array(*[col(f).cast("double") for f in binned.features])))


def _folds(binned: Binned) -> list[int]:
    return sorted(r[0] for r in small_rows(binned.table.select("fold").distinct(), 10_000, "folds"))


def site_adjustments(df: DataFrame, key: str | Column, features: Sequence[str], passive: Sequence[str], target: str, fold: str, site: str, replicates: int, seed: int, eb: bool) -> dict:
    """Per (rep, fold): scale and offset per site from the training rows, after filling gaps with the training means; all from one scan."""
    active = [f for f in features if f not in passive]
    m = bootstrap_moments(df.where(col(target).isNotNull()).withColumn(site, col(site).cast("string")), key, [*active, target], [fold, site], replicates, seed, active)
    by: dict = {}
    for i, k in enumerate(m.keys):
        if m.n[i]:
            by.setdefault((k[0], int(k[1])), {}).setdefault(k[2], []).append(i)
    out = {}
    folds = sorted({f for _, f in by})
    for rep in range(replicates) if replicates else [PLAIN]:
        for f in folds:
            train: dict = {}
            for g in folds:
                if g != f:
                    for s, rows in by.get((rep, g), {}).items():
                        train.setdefault(s, []).extend(rows)
            _, _, _, model, sites, _ = _fitted(m, train, active, [], target, eb)
            scale, offset = {}, {}
            place = [features.index(c) for c in active]
            for s, i in sites.items():
                root = np.sqrt(model.delta[i])
                scale[s], offset[s] = np.ones(len(features)), np.zeros(len(features))
                scale[s][place] = 1 / root
                offset[s][place] = model.grand - (model.grand + model.gamma[i] * model.sd) / root
            out[rep, f] = (scale, offset)
    return out


def gbt_bootstrap(
    df: DataFrame, key: str | Column, features: Sequence[str], target: str, fold: str, params: Mapping, replicates: int = 100, seed: int = 42,
    site: str | None = None, passive: Sequence[str] = (), eb: bool = True, bins: int = BINS,
) -> tuple[DataFrame, DataFrame]:
    """R squared over bootstrap replicates of boosted trees: every (replicate, fold) is a model, and all share their scans.

    With ``replicates`` 0 every row counts once (rep is -1). With ``site``, features other than the ``passive`` ones lose the site effects that the
    weighted training rows of the (replicate, fold) show; missing cells stay missing, and a site without two training rows counts as missing.
    Returns (rep, r2) and the mean and spread of the importances over all models.
    """
    features = list(features)
    binned = bin_rows(df, key, features, target, fold, seed, bins, site)
    if site:
        binned = replace(binned, coder=replace(binned.coder, adjust=site_adjustments(df, key, features, passive, target, fold, site, replicates, seed, eb)))
    reps = list(range(replicates)) or [PLAIN]
    models = [Model(rep=r, fold=f, seed=seed, **params) for r in reps for f in _folds(binned)]
    boosters = fit_many(binned, models)
    scores = score_many(binned, boosters)
    rows = [(r, pooled_r2(scores[[i for i, m in enumerate(models) if m.rep == r]])) for r in reps]
    shares = np.array([b.importances(len(features)) for b in boosters])
    spark = df.sparkSession
    return (local_table(spark, rows, "rep int, r2 double"),
            local_table(spark, [(f, float(v), float(s)) for f, v, s in zip(features, shares.mean(axis=0), shares.std(axis=0))], "feature string, mean_importance double, std_importance double"))


def search_shared(
    df: DataFrame, key: str | Column, features: Sequence[str], target: str, space: Mapping = SEARCH_SPACE, n_iter: int = 50, cv: int = 3, seed: int = 42,
) -> tuple[dict, DataFrame]:
    """Random search over all ranges: candidates x folds are models that share their scans. Mean held-out R squared per trial."""
    draws = draw_params(space, n_iter, seed)
    binned = bin_rows(assign_folds(df, key, cv, f"search:{seed}", "_cv"), key, features, target, "_cv", seed)
    models = [Model(fold=f, seed=seed, **d) for d in draws for f in range(cv)]
    scores = score_many(binned, fit_many(binned, models))
    r2 = [float(np.mean([v for v in (pooled_r2(scores[[i * cv + f]]) for f in range(cv)) if v is not None] or [np.nan])) for i in range(n_iter)]
    rows = [(i, s, {k: str(v) for k, v in d.items()}) for i, (d, s) in enumerate(zip(draws, r2))]
    return draws[int(np.nanargmax(r2))], local_table(df.sparkSession, rows, "trial int, r2 double, params map<string,string>")


def nested_cv_shared(
    df: DataFrame, key: str | Column, features: Sequence[str], target: str, site: str | None = None, space: Mapping = SEARCH_SPACE,
    outer: int = 10, n_iter: int = 50, inner: int = 3, seed: int = 42, passive: Sequence[str] = (), holdout: DataFrame | None = None,
    covariance: bool = True, level: float = 0.95, record: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested cross-validation: per outer fold harmonise on the training part, search, refit the best draw, score the held-out part.

    The candidates x inner folds of an outer fold share their scans. Missing cells stay missing. Returns a row per outer fold (fold, r2, params),
    the importances (fold, feature, importance), and one row (mean_r2, best_r2, ci_low, ci_high, r2_holdout): the interval holds the share ``level``
    of the folds' R squared, by linear interpolation, and the holdout is predicted by the best fold's draw, fitted on everything.
    ``record`` is a folder that gets a run record.
    """
    begin = time.time()
    features = list(features)
    active = [f for f in features if f not in passive]
    known = assign_folds(df.where(col(target).isNotNull()), key, outer, f"outer:{seed}", "_outer")

    def prepare(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        if site is None:
            return train, test
        done = harmonize_split(train, test, site, active, covariance)
        return cut_lineage(done[0]), cut_lineage(done[1])

    def fitted(train: DataFrame, test: DataFrame, draw: Mapping) -> tuple[float | None, np.ndarray]:
        """Score on ``test`` of one model fitted on all of ``train``; the bins are those of the training rows."""
        own = bin_rows(train, key, features, target, None, seed)
        booster = fit_many(own, [Model(seed=seed, **draw)])[0]
        held = predict_rows(test.where(col(target).isNotNull()), booster, own)
        return regression_metrics(held, target, "prediction").first()["r2"], booster.importances(len(features))

    folds, shares = [], []
    for f in range(outer):
        train, test = prepare(known.where(F.col("_outer") != f), known.where(F.col("_outer") == f))
        draw, _ = search_shared(train, key, features, target, space, n_iter, inner, seed + f)
        r2, share = fitted(train, test, draw)
        folds.append((f, r2, draw))
        shares += [(f, c, float(v)) for c, v in zip(features, share)]
    scores = np.array([r for _, r, _ in folds if r is not None])
    best = max(folds, key=lambda r: -np.inf if r[1] is None else r[1])
    r2_holdout = None
    if holdout is not None:
        r2_holdout, _ = fitted(*prepare(known.drop("_outer"), holdout), best[2])
    low, high = (float(np.quantile(scores, q)) if len(scores) else None for q in ((1 - level) / 2, (1 + level) / 2))
    spark = df.sparkSession
    summary = (float(scores.mean()) if len(scores) else None, best[1], low, high, r2_holdout)
    if record:
        append_run_record(spark, record, {
            "run_at": datetime.now(), "target": target, "metric": "r2", "features": features, "quick_run": False, "bootstrap": False, "params": {k: str(v) for k, v in space.items()},
            "best_params": {k: str(v) for k, v in best[2].items()}, "r2_test": summary[0], "ci_low": low, "ci_high": high, "run_minutes": (time.time() - begin) / 60})
    return (local_table(spark, [(f, r, {k: str(v) for k, v in d.items()}) for f, r, d in folds], "fold int, r2 double, params map<string,string>"),
            local_table(spark, shares, "fold int, feature string, importance double"),
            local_table(spark, [summary], "mean_r2 double, best_r2 double, ci_low double, ci_high double, r2_holdout double"))
