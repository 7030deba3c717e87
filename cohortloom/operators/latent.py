"""Principal components, partial least squares, discriminant and covariance axes from cross products."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.operators.linear import LinearModel, _parts, held_out_sse
from cohortloom.operators.suffstats import Moments
from cohortloom.session import local_table


def pack(df: DataFrame, columns: Sequence[str], out: str = "_v") -> DataFrame:
    """Number columns into one array column (missing if any of them is)."""
    whole = F.array(*[col(c).cast("double") for c in columns])
    ok = None
    for c in columns:
        ok = col(c).isNotNull() if ok is None else ok & col(c).isNotNull()
    return df.withColumn(out, F.when(ok, whole))


def unpack(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    gone = {vector, *names}
    kept = [col(c) for c in df.columns if c not in gone]
    return df.select(*kept, *[col(vector)[i].alias(n) for i, n in enumerate(names)])


def spread(here: np.ndarray, rows: Sequence) -> pd.Series:
    """Arrays for the marked rows, None for the others."""
    it = iter(rows)
    return pd.Series([next(it) if h else None for h in here], dtype=object)


def project(vector: str | Column, centre: np.ndarray, weights: np.ndarray) -> Column:
    """Array of scores ``(x - centre) @ weights`` with numpy over Arrow batches; a NULL vector gives NULL."""
    centre, weights = np.asarray(centre, float), np.asarray(weights, float)

    @F.pandas_udf("array<double>")
    def scores(v: pd.Series) -> pd.Series:
        here = v.notna().to_numpy()
        return spread(here, (np.stack(v[here].to_numpy()) - centre) @ weights if here.any() else ())

    return scores(col(vector).cast("array<double>"))


@dataclass
class Components:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray  # features x components
    ratio: np.ndarray

    def score(self, vector: str | Column) -> Column:
        return project(vector, self.mean, self.loadings / self.scale[:, None])

    def score_expressions(self, prefix: str = "PC") -> list[Column]:
        """Plain SQL expressions for wide tables."""
        out = []
        for k in range(self.loadings.shape[1]):
            total = F.lit(0.0)
            for j, c in enumerate(self.columns):
                total = total + F.lit(float(self.loadings[j, k] / self.scale[j])) * (col(c) - F.lit(float(self.mean[j])))
            out.append(total.alias(f"{prefix}{k + 1}"))
        return out

    def table(self, spark) -> DataFrame:
        rows = [(c, k + 1, float(self.loadings[j, k]), float(self.ratio[k]))
                for k in range(self.loadings.shape[1]) for j, c in enumerate(self.columns)]
        return local_table(spark, rows, "feature string, component int, loading double, explained double")


def principal_components(m: Moments, k: int | None = None, standardise: bool = False) -> Components:
    """Components of the covariance (or correlation) matrix; the largest loading of each is made positive."""
    cov = m.scatter / m.size
    scale = np.sqrt(np.diag(cov)) if standardise else np.ones(len(cov))
    scale = np.where(scale == 0, 1.0, scale)
    lam, v = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-lam)
    lam, v = np.clip(lam[order], 0, None), v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    k = len(lam) if k is None else k
    return Components(m.columns, m.mean, scale, v[:, :k], (lam / lam.sum())[:k])


def fit_pls(m: Moments, components: int, scale: bool = True) -> tuple[LinearModel, np.ndarray]:
    """One-target partial least squares from cross products; returns the model and the weight vectors.

    ``scale`` divides features and target by their sample std first, as is usual.
    """
    xx, xy, yy, mx, my = _parts(m)
    sx = np.sqrt(np.diag(xx) / (m.size - 1)) if scale else np.ones(len(xy))
    sx = np.where(sx == 0, 1.0, sx)
    sy = np.sqrt(yy / (m.size - 1)) if scale and yy > 0 else 1.0
    s, b = xx / np.outer(sx, sx), xy / (sx * sy)
    gram, target = s.copy(), b.copy()
    ws, ps, qs = [], [], []
    for _ in range(components):
        norm = np.linalg.norm(target)
        if norm < 1e-12:
            break
        w = target / norm
        tt = w @ gram @ w
        load, q = gram @ w / tt, (w @ target) / tt
        gram = gram - tt * np.outer(load, load)
        target = target - tt * q * load
        ws.append(w), ps.append(load), qs.append(q)
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs)
    coef = (w @ np.linalg.solve(p.T @ w, q)) * sy / sx
    return LinearModel(m.columns[:-1], coef, my - mx @ coef), w


def choose_pls_components(m: Moments, most: int, scale: bool = True) -> tuple[int, list[float]]:
    """Number of components with the lowest pooled squared error over the folds of ``m``."""
    errors = []
    for k in range(1, most + 1):
        sse = 0.0
        for key in m.keys:
            train = m.without(key)
            model, _ = fit_pls(train, k, scale)
            sse += float(held_out_sse(m.of(key), model.coef[None, :], train)[0])
        errors.append(sse / m.n.sum())
    return int(np.argmin(errors)) + 1, errors


def lda_axis(groups: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-class discriminant: coefficients, the axis scaled to unit within-class variance, and the overall mean."""
    if len(groups.keys) != 2:
        raise ValueError("two classes are needed")
    a, b = groups.pick([0]), groups.pick([1])
    total = groups.total()
    within = (a.scatter + b.scatter) / (total.size - 2)
    coef = np.linalg.solve(within, b.mean - a.mean)
    return coef, coef / np.sqrt(coef @ within @ coef), total.mean


def covariance_axis(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Direction of the covariances of the features with the last column, unit length; and the feature means."""
    _, xy, _, mx, _ = _parts(m)
    return xy / np.linalg.norm(xy), mx


def weights_table(spark, names: Sequence[str], weights: np.ndarray, top: int | None = None) -> DataFrame:
    """Signed weights, largest magnitude first."""
    order = np.argsort(-np.abs(weights), kind="stable")[:top]
    return local_table(spark, [(i + 1, names[j], float(weights[j])) for i, j in enumerate(order)], "place int, feature string, weight double")
