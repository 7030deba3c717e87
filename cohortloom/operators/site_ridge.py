"""Ridge on harmonised features, tuned and bootstrapped without a second look at the rows.

Filling with means, removing site effects and ridge all work on sums and cross products. Statistics are taken once per (replicate, fold,
site), with a column per feature that marks missing cells. Then, for any training set:

* filling a missing cell with the training mean is a linear map of (value, mark);
* the site effects come from the statistics of the sites, and removing them is an affine map per site;
* training sums are sums over folds and sites, and the held-out error is a quadratic form of held-out sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame

from cohortloom.operators.harmonize import SiteModel, fit_sites
from cohortloom.operators.linear import DEFAULT_ALPHAS, held_out_r2, held_out_sse, ridge_path, solve_ridge
from cohortloom.operators.replicates import PLAIN, bootstrap_moments
from cohortloom.operators.suffstats import Moments
from cohortloom.session import local_table


def mapped(m: Moments, rows: Sequence[int], matrix: np.ndarray, offset: np.ndarray, names: Sequence[str]) -> Moments:
    """Moments, about zero, of ``matrix @ x + offset`` for the merged keys ``rows``."""
    part = m.pick(rows)
    if not part.size:
        p = len(offset)
        return Moments(list(names), np.zeros(p), [()], np.zeros(1), np.zeros((1, p)), np.zeros((1, p, p)))
    mean = matrix @ part.mean + offset
    return Moments(list(names), np.zeros(len(offset)), [()], part.n, (mean * part.size)[None], (matrix @ part.scatter @ matrix.T + part.size * np.outer(mean, mean))[None])


def merged(parts: Sequence[Moments], keys: Sequence[tuple] | None = None) -> Moments:
    """Statistics side by side (with keys) or added up."""
    first = parts[0]
    out = Moments(first.columns, first.shift, list(keys or [()] * len(parts)), np.concatenate([p.n for p in parts]), np.concatenate([p.s for p in parts]), np.concatenate([p.g for p in parts]))
    return out if keys else out.total()


def filling(m: Moments, features: Sequence[str], passive: Sequence[str], target: str, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(matrix, offset, names) that fill marked cells with ``means``: a marked cell holds its column's shift."""
    names = [*features, *passive, target]
    at = {c: i for i, c in enumerate(m.columns)}
    matrix = np.zeros((len(names), len(m.columns)))
    for i, c in enumerate(names):
        matrix[i, at[c]] = 1.0
        if f"{c}?" in at:
            matrix[i, at[f"{c}?"]] = means[i] - m.shift[at[c]]
    return matrix, np.zeros(len(names)), names


def known_means(m: Moments, names: Sequence[str]) -> np.ndarray:
    """Means over the cells that are there."""
    at = {c: i for i, c in enumerate(m.columns)}
    out = []
    for c in names:
        gone = m.s[0][at[f"{c}?"]] if f"{c}?" in at else 0.0
        there = m.size - gone
        out.append(m.shift[at[c]] + m.s[0][at[c]] / there if there > 0 else m.shift[at[c]])
    return np.array(out)


def harmonised(model: SiteModel, sites: dict, parts: dict, names: Sequence[str], p: int) -> list[Moments]:
    """Statistics after the site effects are gone, for sites the model knows; ``parts`` has them by site."""
    out = []
    for site, i in sites.items():
        if site not in parts:
            continue
        root = np.sqrt(model.delta[i])
        scale, offset = np.ones(len(names)), np.zeros(len(names))
        scale[:p] = 1 / root
        offset[:p] = model.grand - (model.grand + model.gamma[i] * model.sd) / root
        out.append(mapped(parts[site], [0], np.diag(scale), offset, names))
    return out


def _fitted(m: Moments, train: dict, features: Sequence[str], passive: Sequence[str], target: str, eb: bool):
    """From training statistics by site: the filling, the site model, and the harmonised training statistics."""
    total = merged([m.pick(rows) for rows in train.values()])
    matrix, offset, names = filling(m, features, passive, target, known_means(total, [*features, *passive, target]))
    filled = {site: mapped(m, rows, matrix, offset, names) for site, rows in train.items()}
    p = len(features)
    usable = [s for s, part in filled.items() if part.size]
    only = merged([Moments(names[:p], np.zeros(p), [()], filled[s].n, filled[s].s[:, :p], filled[s].g[:, :p, :p]) for s in usable], [(s,) for s in usable])
    model = fit_sites(only, eb=eb)
    sites = {s: i for i, s in enumerate(model.sites)}
    return matrix, offset, names, model, sites, merged(harmonised(model, sites, filled, names, p))


def _by_site(m: Moments, test) -> dict:
    out: dict = {}
    for i, k in enumerate(m.keys):
        if test(k) and m.n[i]:
            out.setdefault(k[2], []).append(i)
    return out


def ridge_tune_harmonised(
    df: DataFrame, key: str | Column, features: Sequence[str], target: str, fold: str, site: str, passive: Sequence[str] = (), alphas: np.ndarray = DEFAULT_ALPHAS,
    eb: bool = True, missing: Sequence[str] = (),
) -> tuple[float, DataFrame]:
    """Best penalty by mean held-out R squared on features that are filled with their means and harmonised over all rows first.

    Rows without a target are left out, and rows of a site with a single row. ``passive`` features (such as sex) are not harmonised;
    ``missing`` names the columns that may have gaps. Returns the penalty and the curve over all penalties.
    """
    m = bootstrap_moments(df, key, [*features, *passive, target], [fold, site], 0, indicators=missing)
    everything = _by_site(m, lambda k: True)
    matrix, offset, names, model, sites, _ = _fitted(m, everything, features, passive, target, eb)
    folds = sorted({k[1] for k in m.keys}, key=str)
    cells = []
    for f in folds:
        own = {s: mapped(m, rows, matrix, offset, names) for s, rows in _by_site(m, lambda k: k[1] == f).items()}
        cells.append(merged(harmonised(model, sites, own, names, len(features))))
    cut = merged(cells, [(f,) for f in folds])
    scores = [held_out_r2(cut.of(k), ridge_path(cut.without(k), alphas), cut.without(k)) for k in cut.keys]
    mean = np.mean(scores, axis=0)
    curve = local_table(df.sparkSession, [(float(a), float(r)) for a, r in zip(alphas, mean)], "alpha double, mean_r2 double")
    return float(alphas[int(np.argmax(mean))]), curve


def ridge_bootstrap_harmonised(
    df: DataFrame, key: str | Column, features: Sequence[str], target: str, fold: str, site: str, alpha: float, replicates: int = 100, seed: int = 42,
    passive: Sequence[str] = (), eb: bool = True, missing: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """R squared over bootstrap replicates: in every (replicate, fold) means, site effects and ridge come from the weighted training rows.

    Held-out rows are filled and harmonised with what the training rows gave; those of a site without two training rows cannot be
    harmonised and are left out of the score (``scored`` counts the others). Returns (rep, r2, scored) and the coefficients of every
    replicate and fold. One scan of the rows, whatever the number of replicates.
    """
    m = bootstrap_moments(df, key, [*features, *passive, target], [fold, site], replicates, seed, missing)
    folds = sorted({k[1] for k in m.keys}, key=str)
    p = len(features)
    rows_by: dict = {}
    for i, k in enumerate(m.keys):
        if m.n[i]:
            rows_by.setdefault((k[0], k[1]), {}).setdefault(k[2], []).append(i)
    r2_rows, coef_rows = [], []
    for rep in range(replicates):
        sse, held = 0.0, []
        for f in folds:
            train: dict = {}
            for g in folds:
                if g != f:
                    for s, rows in rows_by.get((rep, g), {}).items():
                        train.setdefault(s, []).extend(rows)
            matrix, offset, names, model, sites, total = _fitted(m, train, features, passive, target, eb)
            ridge = solve_ridge(total, alpha)
            own = {s: mapped(m, rows, matrix, offset, names) for s, rows in rows_by.get((PLAIN, f), {}).items()}
            parts = harmonised(model, sites, own, names, p)
            if parts:
                test = merged(parts)
                sse += float(held_out_sse(test, ridge.coef[None, :], total)[0])
                held.append(test)
            coef_rows += [(rep, str(f), c, float(w)) for c, w in zip(ridge.features, ridge.coef)]
        scored = merged(held)
        spread = float(scored.scatter[-1, -1])
        r2_rows.append((rep, 1 - sse / spread if spread > 0 else None, int(scored.size)))
    spark = df.sparkSession
    return (local_table(spark, r2_rows, "rep int, r2 double, scored long"),
            local_table(spark, coef_rows, "rep int, fold string, feature string, coef double"))
