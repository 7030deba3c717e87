"""One-scan bootstrap statistics and harmonised ridge, against copies of rows and row-wise fits."""

import numpy as np
import pytest

from cohortloom.functions.hashing import with_replicate_hashes
from cohortloom.operators import packed
from cohortloom.operators import replicates as R
from cohortloom.operators import site_ridge as S
from cohortloom.operators.harmonize import fit_sites
from cohortloom.operators.linear import ridge_bootstrap
from cohortloom.operators.resample import bootstrap_rows
from cohortloom.operators.suffstats import Moments

FEATURES, PASSIVE = ["a", "b", "c"], ["sex"]


def cohort(spark, n=260, seed=3, gaps=True):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        site = int(r.integers(0, 3))
        sex = float(r.integers(0, 2))
        x = r.normal(size=3) * [1, 2, 3] * (1 + 0.3 * site) + site + 0.5 * sex
        y = float(x @ [1.0, -0.5, 0.2] + sex + r.normal())
        cells = [None if gaps and r.random() < 0.1 else float(v) for v in x]
        rows.append((i, f"s{site}", int(i % 4), sex, *cells, y if i % 50 else None))
    return spark.createDataFrame(rows, "id long, site string, fold int, sex double, a double, b double, c double, y double")


def test_weights_are_those_of_the_unfolded_rows(spark):
    df = cohort(spark)
    rows = with_replicate_hashes(df, "id", 5).select("id", "_h1", "_h2").toPandas()
    w = R.weights_of(rows["_h1"].to_numpy(), rows["_h2"].to_numpy(), 9)
    got = {(int(i), rep): int(w[k, rep]) for k, i in enumerate(rows["id"]) for rep in range(9) if w[k, rep]}
    assert got == {(x.id, x.rep): x.weight for x in bootstrap_rows(df.select("id"), "id", 9, 5).collect()}


def test_one_scan_equals_unfolded_rows(spark):
    df = cohort(spark, gaps=False).where("y IS NOT NULL")
    m = R.bootstrap_moments(df, "id", ["a", "b", "y"], ["fold", "site"], 7, 5)
    for rep in (0, 6, R.PLAIN):
        for fold in (0, 3):
            part = m.of((rep, fold, "s1"))
            own = (bootstrap_rows(df, "id", 7, 5).where(f"rep = {rep}") if rep >= 0 else df.selectExpr("*", "1 AS weight")).where(f"fold = {fold} AND site = 's1'").toPandas()
            x, w = own[["a", "b", "y"]].to_numpy(), own["weight"].to_numpy(float)
            mean = w @ x / w.sum()
            assert part.size == w.sum()
            assert np.allclose(part.mean, mean) and np.allclose(part.scatter, (x - mean).T @ (w[:, None] * (x - mean)))


def test_no_rows_are_unfolded(spark, monkeypatch):
    """The replicates' statistics have one shuffle of packed sums and no generated rows."""
    df = cohort(spark, gaps=False)
    seen = []
    monkeypatch.setattr(R, "collected", lambda parts, *a: seen.append(parts) or packed.collected(parts, *a))
    R.bootstrap_means(df, "id", ["a"], 20)
    plan = seen[0]._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_means_with_gaps(spark):
    df = cohort(spark)
    got = {r.rep: (r.n, r.a, r.b) for r in R.bootstrap_means(df, "id", ["a", "b"], 5).collect()}
    for rep, rows in bootstrap_rows(df, "id", 5).toPandas().groupby("rep"):
        want = [np.average(rows[c][rows[c].notna()], weights=rows["weight"][rows[c].notna()]) for c in "ab"]
        assert got[rep][0] == rows["weight"].sum() and np.allclose(got[rep][1:], want)


def test_nothing(spark):
    assert R.bootstrap_means(cohort(spark).where("false"), "id", ["a"], 5).count() == 0


def fill(x, means):
    return np.where(np.isnan(x), means, x)


def moments_of(x, w):
    return Moments([f"x{i}" for i in range(x.shape[1])], np.zeros(x.shape[1]), [()], np.array([w.sum()]), (w @ x)[None], (x.T @ (w[:, None] * x))[None])


def site_model(x, w, site, eb):
    names = [s for s in sorted(set(site)) if w[site == s].sum()]
    parts = [moments_of(x[site == s], w[site == s]) for s in names]
    return fit_sites(S.merged(parts, [(s,) for s in names]), eb=eb)


def adjust(x, model, site):
    out = np.full(x.shape, np.nan)
    for i, s in enumerate(model.sites):
        rows = site == s
        out[rows] = (x[rows] - model.grand - model.gamma[i] * model.sd) / np.sqrt(model.delta[i]) + model.grand
    return out


def ridge(x, y, w, alpha):
    mx, my = w @ x / w.sum(), w @ y / w.sum()
    coef = np.linalg.solve((x - mx).T @ (w[:, None] * (x - mx)) + alpha * np.eye(x.shape[1]), (x - mx).T @ (w * (y - my)))
    return coef, my - mx @ coef


@pytest.mark.parametrize("eb", [True, False])
def test_harmonised_bootstrap_equals_row_wise_fits(spark, eb):
    df = cohort(spark)
    r2, coefs = S.ridge_bootstrap_harmonised(df, "id", FEATURES, "y", "fold", "site", 2.0, 4, 8, PASSIVE, eb, FEATURES)
    rows = with_replicate_hashes(df.where("y IS NOT NULL"), "id", 8).toPandas()
    weight = R.weights_of(rows["_h1"].to_numpy(), rows["_h2"].to_numpy(), 4)
    x, sex, y = rows[FEATURES].to_numpy(float), rows[["sex"]].to_numpy(float), rows["y"].to_numpy(float)
    site, fold = rows["site"].to_numpy(), rows["fold"].to_numpy()
    got = {r.rep: r for r in r2.collect()}
    found = {(r.rep, int(r.fold), r.feature): r.coef for r in coefs.collect()}
    for rep in range(4):
        sse = 0.0
        for f in range(4):
            train, w = fold != f, weight[fold != f, rep]
            known = ~np.isnan(x[train])
            means = (w @ np.where(known, x[train], 0)) / (w @ known)
            model = site_model(fill(x[train], means), w, site[train], eb)
            own = np.hstack([adjust(fill(x[train], means), model, site[train]), sex[train]])
            coef, intercept = ridge(own, y[train], w, 2.0)
            held = np.hstack([adjust(fill(x[~train], means), model, site[~train]), sex[~train]])
            sse += ((y[~train] - held @ coef - intercept) ** 2).sum()
            assert np.allclose([found[rep, f, c] for c in FEATURES + PASSIVE], coef)
        assert got[rep].scored == len(y) and got[rep].r2 == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_harmonised_tuning_equals_row_wise_fits(spark):
    df = cohort(spark)
    alphas = np.array([0.1, 3.0, 50.0])
    best, curve = S.ridge_tune_harmonised(df, "id", FEATURES, "y", "fold", "site", PASSIVE, alphas, missing=FEATURES)
    rows = df.where("y IS NOT NULL").toPandas()
    x, y, site, fold = rows[FEATURES].to_numpy(float), rows["y"].to_numpy(float), rows["site"].to_numpy(), rows["fold"].to_numpy()
    filled = fill(x, np.nanmean(x, axis=0))
    x = np.hstack([adjust(filled, site_model(filled, np.ones(len(y)), site, True), site), rows[["sex"]].to_numpy(float)])
    want = []
    for a in alphas:
        scores = []
        for f in range(4):
            t = fold != f
            coef, c = ridge(x[t], y[t], np.ones(t.sum()), a)
            scores.append(1 - ((y[~t] - x[~t] @ coef - c) ** 2).sum() / ((y[~t] - y[~t].mean()) ** 2).sum())
        want.append(np.mean(scores))
    assert np.allclose([r.mean_r2 for r in curve.orderBy("alpha").collect()], want) and best == alphas[int(np.argmax(want))]


def test_a_site_seen_only_in_one_fold_is_not_scored_there(spark):
    df = cohort(spark, gaps=False).selectExpr("id", "CASE WHEN id IN (2, 6) THEN 'rare' ELSE site END AS site", "fold", "sex", "a", "b", "c", "y")
    r2, _ = S.ridge_bootstrap_harmonised(df, "id", FEATURES, "y", "fold", "site", 2.0, 2)
    assert {r.scored for r in r2.collect()} == {df.where("y IS NOT NULL").count() - 2}


def test_linear_bootstrap_still_counts_replicates(spark):
    r2, coefs = ridge_bootstrap(cohort(spark, gaps=False).where("y IS NOT NULL"), "id", ["a", "b"], "y", "fold", 1.0, 6)
    assert r2.count() == 6 and coefs.count() == 6 * 4 * 2
