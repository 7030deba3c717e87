"""Removing site effects: location/scale adjustment with or without empirical Bayes shrinkage, and its extension to
the covariance between features.

Fitting takes one pass, the moments of [features | covariates] per site.  Everything after it, the shrinkage loop
included, works on (site, feature) statistics: the loop needs the sum of (s - g)^2 over the rows of a site, which is
sum(s^2) - 2 g sum(s) + n g^2.  Applying is a broadcast join on the site (one parameter row per site).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.operators.latent import pack, spread, unpack
from cohortloom.operators.scaling import impute_site_median, restore_missing
from cohortloom.operators.suffstats import Moments, vector_moments
from cohortloom.session import local_table

CONVERGENCE = 1e-4
MAX_STEPS = 100_000


@dataclass
class SiteModel:
    """Location/scale model.  ``gamma`` and ``delta`` have one row per site."""

    sites: list
    grand: np.ndarray
    beta: np.ndarray  # covariates x features
    sd: np.ndarray
    gamma: np.ndarray
    delta: np.ndarray
    covariates: list[str] = field(default_factory=list)


def site_moments(df: DataFrame, site: str, vector: str, covariates: Sequence[str] = ()) -> Moments:
    """Moments of the feature vector followed by the covariates, per site, over complete rows."""
    known = df.where(col(site).isNotNull() & col(vector).isNotNull())
    for c in covariates:
        known = known.where(col(c).isNotNull())
    extra = [F.array(*[col(c).cast("double") for c in covariates])] if covariates else []
    joint = known.select(col(site), F.concat(col(vector).cast("array<double>"), *extra).alias("_v"))
    return vector_moments(joint, "_v", [site])


def _useful(m: Moments, covariates: Sequence[str], p: int) -> list[int]:
    """Covariates that vary; a constant one is an intercept and the sites already have that."""
    spread = np.diag(m.total().scatter)[p:]
    return [i for i in range(len(covariates)) if spread[i] > 0]


def fit_sites(m: Moments, covariates: Sequence[str] = (), eb: bool = True) -> SiteModel:
    """Sites of a single row have no scale: they are left out of the fit, and ``apply_sites`` gives them NULL.  A feature that
    does not vary (within the sites, after the covariates) is not moved and has no part in the priors."""
    p = len(m.columns) - len(covariates)
    m = m.only(lambda i: m.n[i] >= 2)
    if not m.keys:
        raise ValueError("no site has two complete rows")
    use = _useful(m, covariates, p)
    c = [p + i for i in use]
    parts = [m.pick([i]) for i in range(len(m.keys))]
    n = np.array([s.size for s in parts])
    xbar = np.array([s.mean[:p] for s in parts])
    cbar = np.array([s.mean[c] for s in parts])
    scc = [s.scatter[np.ix_(c, c)] for s in parts]
    scx = [s.scatter[np.ix_(c, range(p))] for s in parts]
    beta = np.linalg.solve(sum(scc), sum(scx)) if c else np.zeros((0, p))
    level = xbar - cbar @ beta
    grand = (n / n.sum()) @ level
    rss = np.array([np.diag(s.scatter)[:p] - 2 * (beta * b).sum(0) + (beta * (a @ beta)).sum(0) for s, a, b in zip(parts, scc, scx)])
    square = sum(np.diag(s.scatter)[:p] + s.size * s.mean[:p] ** 2 for s in parts)
    varies = rss.sum(0) > 1e-12 * square
    sd = np.sqrt(np.where(varies, rss.sum(0), n.sum()) / n.sum())
    gamma = np.where(varies, (level - grand) / sd, 0.0)
    delta = np.where(varies, rss / (n - 1)[:, None] / sd**2, 1.0)
    if eb and varies.sum() > 1:
        shrunk = [_shrink(g[varies], d[varies], k) for g, d, k in zip(gamma, delta, n)]
        gamma[:, varies], delta[:, varies] = np.array([s[0] for s in shrunk]), np.array([s[1] for s in shrunk])
    delta = np.where(delta > 0, delta, 1.0)  # constant inside one site only: moved, not scaled
    if not (np.isfinite(gamma).all() and np.isfinite(delta).all()):
        raise ArithmeticError("site effects are not finite")
    return SiteModel([k[0] for k in m.keys], grand, beta, sd, gamma, delta, [covariates[i] for i in use])


def _shrink(gamma: np.ndarray, delta: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior location and scale of one site; priors come from the spread over features."""
    prior_mean, prior_var = gamma.mean(), gamma.var()
    m, v = delta.mean(), delta.var(ddof=1)
    if v == 0 or prior_var == 0:
        return gamma, delta  # all features agree, so there is no spread to shrink by
    shape, rate = (2 * v + m**2) / v, (m * v + m**3) / v
    total, squares = n * gamma, (n - 1) * delta + n * gamma**2
    g, d = gamma.copy(), delta.copy()
    for _ in range(MAX_STEPS):
        g_next = (prior_var * n * gamma + d * prior_mean) / (prior_var * n + d)
        d_next = (0.5 * (squares - 2 * g_next * total + n * g_next**2) + rate) / (n / 2 + shape - 1)
        # Relative to the signed old value, as in the published method.
        step_g = np.abs(g_next - g) / np.where(g == 0, np.inf, g)
        change = max(step_g.max(), (np.abs(d_next - d) / d).max())
        g, d = g_next, d_next
        if not change > CONVERGENCE:
            return g, d
    raise ArithmeticError("site effects did not converge")


def _array(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _centre(model: SiteModel) -> Column:
    """Grand mean plus covariate effects of a row, as an array."""

    def add(total: Column, name: str, slopes: np.ndarray) -> Column:
        return F.zip_with(total, _array(slopes), lambda t, w: t + w * col(name))

    out = _array(model.grand)
    for name, slopes in zip(model.covariates, model.beta):
        out = add(out, name, slopes)
    return out


def _site_table(spark, kind: str, sites: Sequence, columns: dict[str, np.ndarray]) -> DataFrame:
    rows = [(s, *[list(map(float, columns[c][i])) for c in columns]) for i, s in enumerate(sites)]
    return local_table(spark, rows, f"_site {kind}, " + ", ".join(f"{c} array<double>" for c in columns))


def apply_sites(df: DataFrame, model: SiteModel, site: str, vector: str, add_back: bool = True) -> DataFrame:
    """Adjusted vectors; a site the model has not seen gives NULL (see ``scaling.unseen_sites``)."""
    kind = df.schema[site].dataType.simpleString()
    params = _site_table(df.sparkSession, kind, model.sites, {"_gamma": model.gamma * model.sd, "_root": np.sqrt(model.delta)})
    joined = df.join(F.broadcast(params), df[site] == params["_site"], "left")
    out = joined.withColumn("_centre", _centre(model))
    moved = F.zip_with(F.zip_with(col(vector), F.col("_centre"), lambda x, m: x.cast("double") - m), F.col("_gamma"), lambda r, g: r - g)
    scaled = F.zip_with(moved, F.col("_root"), lambda r, s: r / s)
    if add_back:
        scaled = F.zip_with(scaled, F.col("_centre"), lambda r, m: r + m)
    keep = [F.when(F.col("_root").isNotNull(), scaled).alias(vector) if c == vector else col(c) for c in df.columns]
    return out.select(*keep)


@dataclass
class CovarianceModel:
    """Site model plus the adjustment of leading component scores."""

    sites: SiteModel
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray  # features x adjusted components
    slope: np.ndarray  # per site: adjusted = slope * score + offset
    offset: np.ndarray


def _adjusted_moments(m: Moments, model: SiteModel, covariates: Sequence[str]) -> Moments:
    """Moments per site of the adjusted residuals, derived from the moments already taken (they are linear in the data)."""
    p = len(model.grand)
    use = [p + list(covariates).index(c) for c in model.covariates]
    s, g = [], []
    for i in range(len(m.keys)):
        part = m.pick([i])
        root = np.sqrt(model.delta[i])
        a = np.zeros((p, len(m.columns)))
        a[:, :p] = np.diag(1 / root)
        for j, b in zip(use, model.beta):
            a[:, j] = -b / root
        mean = a @ part.mean - (model.grand + model.gamma[i] * model.sd) / root
        s.append(mean * part.size)
        g.append(a @ part.scatter @ a.T + part.size * np.outer(mean, mean))
    return Moments(m.columns[:p], np.zeros(p), m.keys, m.n, np.array(s), np.array(g))


def fit_covariance(m: Moments, covariates: Sequence[str] = (), explained: float = 0.95, components: int = 0, eb: bool = True) -> CovarianceModel:
    """Harmonise means and variances, then the scores of the leading components of the standardised residuals.

    Components are taken until the running sum of their ratios (four decimals) first exceeds ``explained``, or as many
    as ``components`` says.
    """
    m = m.only(lambda i: m.n[i] >= 2)
    model = fit_sites(m, covariates, eb)
    y = _adjusted_moments(m, model, covariates)
    total = y.total()
    cov = total.scatter / total.size
    scale = np.sqrt(np.diag(cov))
    scale = np.where(scale == 0, 1.0, scale)
    lam, v = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(-lam)
    lam, v = np.clip(lam[order], 0, None), v[:, order]
    running = np.cumsum(np.round(lam / lam.sum(), 4))
    above = np.nonzero(running > explained)[0]
    k = components or (int(above[0]) + 1 if len(above) else len(lam))
    axes = v[:, :k]
    w = axes / scale[:, None]
    scores_s, scores_g = [], []
    for i in range(len(y.keys)):
        s, g = y.pick([i]).about(total.mean)
        scores_s.append(s @ w)
        scores_g.append(w.T @ g @ w)
    scores = Moments([f"t{j}" for j in range(k)], np.zeros(k), y.keys, y.n, np.array(scores_s), np.array(scores_g))
    sub = fit_sites(scores, (), eb=False)
    slope = 1 / np.sqrt(sub.delta)
    offset = sub.grand - (sub.grand + sub.gamma * sub.sd) * slope
    return CovarianceModel(model, total.mean, scale, axes, slope, offset)


def apply_covariance(df: DataFrame, model: CovarianceModel, site: str, vector: str) -> DataFrame:
    """Adjusted vectors: one matrix product per Arrow batch and site, then the location is added back."""
    m = model.sites
    kind = df.schema[site].dataType.simpleString()
    residuals = apply_sites(df, m, site, vector, add_back=False)
    params = _site_table(df.sparkSession, kind, m.sites, {"_slope": model.slope, "_offset": model.offset})
    joined = residuals.join(F.broadcast(params), residuals[site] == params["_site"], "left")
    mean, scale, axes = model.mean, model.scale, model.axes

    @F.pandas_udf("array<double>")
    def rotate(v: pd.Series, slope: pd.Series, offset: pd.Series) -> pd.Series:
        here = (v.notna() & slope.notna()).to_numpy()
        if not here.any():
            return spread(here, ())
        z = (np.stack(v[here].to_numpy()) - mean) / scale
        t = z @ axes
        moved = np.stack(slope[here].to_numpy()) * t + np.stack(offset[here].to_numpy())
        return spread(here, (z + (moved - t) @ axes.T) * scale + mean)

    back = F.zip_with(rotate(col(vector), F.col("_slope"), F.col("_offset")), _centre(m), lambda r, g: r + g)
    return joined.select(*[back.alias(vector) if c == vector else col(c) for c in df.columns])


def harmonize_split(
    train: DataFrame, test: DataFrame, site: str, features: Sequence[str], covariance: bool = True, explained: float = 0.95,
) -> tuple[DataFrame, DataFrame]:
    """Fit on the training rows, apply to both sides.

    Missing features are filled with the training median of the site, harmonised, and taken out again, so the models
    after it see the same missing cells as before.  Other columns (sex, target, ids) pass through untouched.
    """
    filled = [impute_site_median(train, part, site, features) for part in (train, test)]
    packed = [pack(f, features) for f in filled]
    m = site_moments(packed[0], site, "_v")
    if covariance:
        model = fit_covariance(m, explained=explained)
        done = [apply_covariance(p, model, site, "_v") for p in packed]
    else:
        sites = fit_sites(m)
        done = [apply_sites(p, sites, site, "_v") for p in packed]
    order = train.columns
    return tuple(restore_missing(unpack(d, "_v", features), features).select(*map(col, order)) for d in done)
