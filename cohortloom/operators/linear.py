"""Linear models from sufficient statistics: one pass over the data, all solves on p x p matrices.

``Moments`` of [features..., target] per fold give training statistics by subtraction and held-out R squared without
touching the data again; predictions come back as literal expressions or one small broadcast join on the fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.operators.replicates import PLAIN, bootstrap_moments
from cohortloom.operators.suffstats import Moments, moments
from cohortloom.session import local_table


@dataclass
class LinearModel:
    features: list[str]
    coef: np.ndarray
    intercept: float

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.coef):
            out = out + F.lit(float(w)) * col(f)
        return out


def _parts(m: Moments) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    """Centred X'X, X'y, y'y, feature means and target mean; the target is the last column."""
    c, mu = m.scatter, m.mean
    return c[:-1, :-1], c[:-1, -1], float(c[-1, -1]), mu[:-1], float(mu[-1])


def solve_ols(m: Moments) -> LinearModel:
    xx, xy, _, mx, my = _parts(m)
    w = np.linalg.lstsq(xx, xy, rcond=None)[0]
    return LinearModel(m.columns[:-1], w, my - mx @ w)


def solve_ridge(m: Moments, alpha: float) -> LinearModel:
    """|y - Xw|^2 + alpha |w|^2, intercept not penalised."""
    xx, xy, _, mx, my = _parts(m)
    w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    return LinearModel(m.columns[:-1], w, my - mx @ w)


def ridge_path(m: Moments, alphas: np.ndarray) -> np.ndarray:
    """Coefficients for all penalties from one eigendecomposition, shape (alphas, features)."""
    xx, xy, *_ = _parts(m)
    lam, v = np.linalg.eigh(xx)
    return ((v.T @ xy) / (np.maximum(lam, 0)[None, :] + alphas[:, None])) @ v.T


def held_out_r2(test: Moments, coefs: np.ndarray, train: Moments) -> np.ndarray:
    """R squared on held-out statistics for rows of ``coefs`` fitted on ``train`` (intercept from the training means)."""
    sse = held_out_sse(test, coefs, train)
    yy = _parts(test)[2]
    return 1 - sse / yy if yy > 0 else np.full(len(sse), np.nan)


def held_out_sse(test: Moments, coefs: np.ndarray, train: Moments) -> np.ndarray:
    xx, xy, yy, mx, my = _parts(test)
    _, _, _, tx, ty = _parts(train)
    gap = (my - ty) - coefs @ (mx - tx)
    return yy - 2 * coefs @ xy + np.einsum("ai,ij,aj->a", coefs, xx, coefs) + test.size * gap**2


DEFAULT_ALPHAS = np.logspace(-4, 4, 1000)


def fold_gram(df: DataFrame, features: Sequence[str], target: str, fold: str) -> Moments:
    return moments(df, [*features, target], [fold])


def ridge_tune(m: Moments, spark, alphas: np.ndarray = DEFAULT_ALPHAS) -> tuple[float, DataFrame]:
    """Best penalty by mean held-out R squared over the folds of ``m``; returns it and the whole curve."""
    scores = []
    for k in m.keys:
        train, test = m.without(k), m.of(k)
        scores.append(held_out_r2(test, ridge_path(train, alphas), train))
    mean = np.mean(scores, axis=0)
    curve = local_table(spark, [(float(a), float(r)) for a, r in zip(alphas, mean)], "alpha double, mean_r2 double")
    return float(alphas[int(np.argmax(mean))]), curve


def ridge_bootstrap(
    df: DataFrame, key: str | Column, features: Sequence[str], target: str, fold: str, alpha: float, replicates: int = 100, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Distribution of cross-validated R squared over bootstrap replicates of the training rows.

    For every (replicate, fold) the model is fitted on weighted statistics of the other folds and scored on the
    unweighted rows of its own fold; both kinds of statistics come from one scan.  Returns R squared per replicate (over
    the pooled out-of-fold predictions) and the coefficients of every replicate and fold.
    """
    boot = bootstrap_moments(df, key, [*features, target], [fold], replicates, seed)
    rows = [i for i, k in enumerate(boot.keys) if k[0] == PLAIN]
    plain = Moments(boot.columns, boot.shift, [boot.keys[i][1:] for i in rows], boot.n[rows], boot.s[rows], boot.g[rows])
    y_total = plain.total().scatter[-1, -1]
    by_rep: dict[int, list[int]] = {}
    for i, (rep, _) in enumerate(boot.keys):
        if rep != PLAIN:
            by_rep.setdefault(int(rep), []).append(i)
    r2_rows, coef_rows = [], []
    for rep, rows in sorted(by_rep.items()):
        sse = 0.0
        for k in plain.keys:
            train = boot.pick([i for i in rows if str(boot.keys[i][1]) != str(k[0])])
            model = solve_ridge(train, alpha)
            sse += float(held_out_sse(plain.of(k), model.coef[None, :], train)[0])
            coef_rows += [(rep, int(k[0]), f, float(w)) for f, w in zip(model.features, model.coef)]
        r2_rows.append((rep, float(1 - sse / y_total)))
    spark = df.sparkSession
    return (local_table(spark, r2_rows, "rep int, r2 double"),
            local_table(spark, coef_rows, "rep int, fold int, feature string, coef double"))


def coef_summary(runs: DataFrame, feature: str = "feature", coef: str = "coef") -> DataFrame:
    """Mean, population std, absolute mean, and shares of positive and negative coefficients over runs."""
    c = col(coef)
    return runs.groupBy(col(feature)).agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.abs(F.avg(c)).alias("abs_mean"),
        F.avg((c > 0).cast("double")).alias("share_positive"), F.avg((c < 0).cast("double")).alias("share_negative"))


def importance_summary(runs: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    return runs.groupBy(col(feature)).agg(F.avg(col(value)).alias("mean_importance"), F.stddev_pop(col(value)).alias("std_importance"))


def solve_elastic_net(m: Moments, alpha: float, l1: float, start: np.ndarray | None = None, max_iter: int = 5000, tol: float = 1e-8) -> np.ndarray:
    """Coordinate descent on the Gram matrix: 1/2n |y - Xw|^2 + alpha l1 |w|_1 + alpha (1 - l1)/2 |w|^2."""
    xx, xy, *_ = _parts(m)
    q, b = xx / m.size, xy / m.size
    w = np.zeros(len(b)) if start is None else start.copy()
    step = np.diag(q) + alpha * (1 - l1)
    for _ in range(max_iter):
        largest = 0.0
        for j in range(len(b)):
            rho = b[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / step[j] if step[j] > 0 else 0.0
            largest = max(largest, abs(new - w[j]) * np.sqrt(q[j, j]))
            w[j] = new
        if largest < tol * max(1e-12, np.sqrt(_parts(m)[2] / m.size)):
            break
    return w


# The mixing ratios and penalties searched by default.
ELASTIC_NET_MIXES = (0.1, 0.5, 0.7, 0.9)
ELASTIC_NET_ALPHAS = tuple(np.logspace(-3, 2, 10))


def _best_elastic_net(m: Moments, mixes, alphas) -> tuple[float, float]:
    """Mix and penalty with the lowest mean squared error over the folds of ``m``."""
    best = (np.inf, mixes[0], alphas[0])
    folds = [(m.without(k), m.of(k)) for k in m.keys]
    for l1 in mixes:
        warm: list[np.ndarray | None] = [None] * len(folds)
        for a in sorted(alphas, reverse=True):
            mse = []
            for i, (train, test) in enumerate(folds):
                warm[i] = solve_elastic_net(train, a, l1, warm[i])
                mse.append(held_out_sse(test, warm[i][None, :], train)[0] / test.size)
            if np.mean(mse) < best[0]:
                best = (float(np.mean(mse)), l1, a)
    return best[1], best[2]


def elastic_net_cv(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], outer: str, inner: str,
    mixes: Sequence[float] = ELASTIC_NET_MIXES, alphas: Sequence[float] = ELASTIC_NET_ALPHAS, top: int = 5,
) -> DataFrame:
    """Nested cross-validated elastic net per target: outer-fold R squared, refit on everything, largest coefficients.

    One pass per target over (outer x inner fold) cells; every training set is a sum of cells.
    """
    rows = []
    for target in targets:
        m = moments(df.where(col(target).isNotNull()), [*features, target], [outer, inner])
        scores = []
        for fold in sorted({k[0] for k in m.keys}):
            test = m.where(lambda k: k[0] == fold)
            train_cells = Moments(m.columns, m.shift, [], np.empty(0), np.empty(0), np.empty(0))
            inner_keys = sorted({k[1] for k in m.keys})
            merged = [m.where(lambda k, i=i: k[0] != fold and k[1] == i) for i in inner_keys]
            train_cells = Moments(m.columns, m.shift, [(i,) for i in inner_keys], np.concatenate([x.n for x in merged]),
                                  np.concatenate([x.s for x in merged]), np.concatenate([x.g for x in merged]))
            l1, a = _best_elastic_net(train_cells, mixes, alphas)
            train = train_cells.total()
            scores.append(float(held_out_r2(test, solve_elastic_net(train, a, l1)[None, :], train)[0]))
        cells = [m.where(lambda k, i=i: k[1] == i) for i in sorted({k[1] for k in m.keys})]
        everything = Moments(m.columns, m.shift, [(i,) for i in range(len(cells))], np.concatenate([x.n for x in cells]),
                             np.concatenate([x.s for x in cells]), np.concatenate([x.g for x in cells]))
        l1, a = _best_elastic_net(everything, mixes, alphas)
        w = solve_elastic_net(m.total(), a, l1)
        order = np.argsort(-np.abs(w), kind="stable")[:top]
        rows.append((target, float(np.mean(scores)), float(l1), float(a), [features[i] for i in order], [float(abs(w[i])) for i in order]))
    return local_table(df.sparkSession, rows,
                       "target string, mean_r2 double, l1_ratio double, alpha double, top_features array<string>, top_weights array<double>")


def oof_linear(df: DataFrame, features: Sequence[str], target: str, fold: str, alpha: float = 0.0) -> DataFrame:
    """Every row predicted by the model that did not see its fold, and by the mean of the models that did.

    The mean of linear predictions is the prediction of the mean coefficients, so both need one parameter row per fold
    and a broadcast join on the fold.
    """
    m = moments(df, [*features, target], [fold])
    models = {k[0]: solve_ridge(m.without(k), alpha) if alpha else solve_ols(m.without(k)) for k in m.keys}
    rows = []
    for f, model in models.items():
        seen = [models[g] for g in models if g != f]
        rows.append((f, [float(model.intercept), *map(float, model.coef)],
                     [float(np.mean([s.intercept for s in seen])), *map(float, np.mean([s.coef for s in seen], axis=0))]))
    kind = df.schema[fold].dataType.simpleString()
    params = local_table(df.sparkSession, rows, f"_fold {kind}, _held array<double>, _seen array<double>")
    joined = df.join(F.broadcast(params), df[fold] == params["_fold"], "left")

    def score(p: str) -> Column:
        out = F.col(p)[0]
        for i, f in enumerate(features):
            out = out + F.col(p)[i + 1] * col(f)
        return out

    return joined.withColumn("val_prediction", score("_held")).withColumn("train_prediction", score("_seen")).drop("_fold", "_held", "_seen")


def linear_attribution(df: DataFrame, model: LinearModel, means: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """Exact per-row attributions of a linear model, long: coefficient x (value - mean)."""
    parts = [((col(f) - F.lit(float(means[f]))) * F.lit(float(w))).alias(f) for f, w in zip(model.features, model.coef)]
    return df.select(*map(col, keep), *parts).unpivot(list(keep), model.features, "feature", "attribution")


def attribution_summary(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute attribution per feature (and group)."""
    return long.groupBy("feature", *map(col, by)).agg(F.avg(F.abs("attribution")).alias("mean_abs"), F.count("attribution").alias("n"))


def marginal_curve(df: DataFrame, model: LinearModel, over: str, by: str, by_levels: Sequence, fixed: Sequence[str] = (), points: int = 100) -> DataFrame:
    """Model predictions along one covariate for several levels of another, the rest held at their means."""
    row = df.agg(F.min(col(over)), F.max(col(over)), *[F.avg(col(c)) for c in fixed]).first()
    lo, hi = float(row[0]), float(row[1])
    weight = dict(zip(model.features, model.coef))
    base = model.intercept + sum(weight[c] * float(row[2 + i]) for i, c in enumerate(fixed))
    steps = df.sparkSession.range(points).select(
        F.col("id").cast("int").alias("point"), (F.lit(lo) + F.col("id") * F.lit((hi - lo) / (points - 1))).alias("x"),
        F.explode(F.array(*[F.lit(float(v)) for v in by_levels])).alias("level"))
    return steps.withColumn("prediction", F.lit(float(base)) + F.lit(float(weight[over])) * F.col("x") + F.lit(float(weight[by])) * F.col("level"))
