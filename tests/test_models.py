import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import harmonize as H
from cohortloom.operators import latent as P
from cohortloom.operators import linear as L
from cohortloom.operators import normative, pls_da, resample, scaling, suffstats, trees
from cohortloom.operators import cluster as C
from cohortloom.session import TooLarge, bounded_broadcast, cut_lineage, settle, small_rows

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def xy(spark):
    n, p = 240, 4
    x = RNG.normal(size=(n, p)) * [1, 5, 0.1, 30] + [0, 100, 3, -7]
    y = x @ [1.0, -0.2, 4.0, 0.01] + RNG.normal(size=n) + 50
    rows = [(i, "abc"[i % 3], *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, site string, x0 double, x1 double, x2 double, x3 double, y double")
    return x, y, df


XS = ["x0", "x1", "x2", "x3"]


@pytest.mark.parametrize("native", [True, False])
def test_moments(spark, xy, native):
    x, y, df = xy
    z = np.column_stack([x, y])
    if native:
        m = suffstats.moments(df, [*XS, "y"], ["site"])
    else:
        m = suffstats.vector_moments(P.pack(df, [*XS, "y"]), "_v", ["site"])
    assert m.n.sum() == len(y) and [k[0] for k in m.keys] == ["a", "b", "c"]
    np.testing.assert_allclose(m.total().scatter, (z - z.mean(0)).T @ (z - z.mean(0)), rtol=1e-9, atol=1e-8)
    part = z[1::3]
    np.testing.assert_allclose(m.of(("b",)).mean, part.mean(0))
    np.testing.assert_allclose(m.without(("b",)).scatter + 0, np.cov(z[np.arange(240) % 3 != 1].T, ddof=0) * 160, rtol=1e-8, atol=1e-8)


def test_weighted_moments(spark, xy):
    x, y, df = xy
    w = df.withColumn("w", (F.col("id") % 4).cast("int"))
    rep = np.repeat(np.column_stack([x, y]), np.arange(240) % 4, axis=0)
    m = suffstats.moments(w, [*XS, "y"], weight="w").total()
    np.testing.assert_allclose(m.scatter, (rep - rep.mean(0)).T @ (rep - rep.mean(0)), rtol=1e-9, atol=1e-7)


def ridge(x, y, a):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + a * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(0) @ w


def folds(df):
    return resample.assign_folds(df, "id", 5)


def test_ridge_grid_equals_refitting(spark, xy):
    x, y, df = xy
    f = np.array([r["fold"] for r in folds(df).orderBy("id").collect()])
    alphas = np.logspace(-4, 4, 25)
    m = L.fold_gram(folds(df), XS, "y", "fold")
    best, curve = L.ridge_tune(m, spark, alphas)
    expected = []
    for a in alphas:
        scores = []
        for k in range(5):
            w, b = ridge(x[f != k], y[f != k], a)
            t = y[f == k]
            scores.append(1 - ((t - x[f == k] @ w - b) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        expected.append(np.mean(scores))
    got = [r["mean_r2"] for r in curve.orderBy("alpha").collect()]
    np.testing.assert_allclose(got, expected, rtol=1e-8)
    assert best == alphas[int(np.argmax(expected))]


def test_ridge_bootstrap_counts_rows_as_weights(spark, xy):
    x, y, df = xy
    r2, coefs = L.ridge_bootstrap(folds(df), "id", XS, "y", "fold", 1.0, 6)
    w = resample.bootstrap_rows(folds(df), "id", 6).select("rep", "id", "fold", "weight").toPandas()
    f = np.array([r["fold"] for r in folds(df).orderBy("id").collect()])
    for rep, part in w.groupby("rep"):
        counts = np.zeros(240, int)
        counts[part["id"]] = part["weight"]
        pred = np.empty(240)
        for k in range(5):
            idx = np.repeat(np.arange(240)[f != k], counts[f != k])
            c, b = ridge(x[idx], y[idx], 1.0)
            pred[f == k] = x[f == k] @ c + b
        assert {r["rep"]: r["r2"] for r in r2.collect()}[rep] == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-8)
    assert coefs.count() == 6 * 5 * 4
    s = {r["feature"]: r for r in L.coef_summary(coefs).collect()}
    assert s["x0"]["share_positive"] == 1.0 and s["x1"]["share_negative"] == 1.0


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = resample.bootstrap_rows(spark.range(20000).select(F.col("id").alias("k")), "k", 3).groupBy("rep").agg(
        F.sum("weight").alias("m"), F.sum(F.col("weight") * F.col("weight")).alias("q")).collect()
    for r in w:
        assert abs(r["m"] / 20000 - 1) < 0.04 and abs(r["q"] / 20000 - (r["m"] / 20000) ** 2 - 1) < 0.06


def test_elastic_net_meets_its_conditions(spark, xy):
    x, y, df = xy
    m = suffstats.moments(df, [*XS, "y"])
    for a, l1 in ((0.5, 0.5), (0.05, 0.9), (2.0, 0.1)):
        w = L.solve_elastic_net(m, a, l1, tol=1e-12)
        xc, yc = x - x.mean(0), y - y.mean()
        grad = -xc.T @ (yc - xc @ w) / len(y) + a * (1 - l1) * w
        for j in range(4):
            assert abs(grad[j] + a * l1 * np.sign(w[j])) < 1e-6 if w[j] else abs(grad[j]) <= a * l1 + 1e-9
    f = resample.assign_folds(folds(df).withColumnRenamed("fold", "outer"), "id", 5, "inner", "inner")
    out = L.elastic_net_cv(f, XS, ["y"], "outer", "inner").first()
    assert out["mean_r2"] > 0.5 and len(out["top_features"]) == 4


def test_out_of_fold(spark, xy):
    x, y, df = xy
    got = L.oof_linear(folds(df), XS, "y", "fold").orderBy("id").collect()
    f = np.array([r["fold"] for r in got])
    preds = np.array([x @ ridge(x[f != k], y[f != k], 0)[0] + ridge(x[f != k], y[f != k], 0)[1] for k in range(5)])
    np.testing.assert_allclose([r["val_prediction"] for r in got], preds[f, np.arange(240)], rtol=1e-8)
    seen = np.array([np.mean([preds[k, i] for k in range(5) if k != f[i]]) for i in range(240)])
    np.testing.assert_allclose([r["train_prediction"] for r in got], seen, rtol=1e-8)


def nipals(x, y, k):
    """Row-space partial least squares with scaling."""
    sx, sy = x.std(0, ddof=1), y.std(ddof=1)
    e, f = (x - x.mean(0)) / sx, (y - y.mean()) / sy
    e0, ws, ps, qs = e.copy(), [], [], []
    for _ in range(k):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    return (e0 @ (w @ np.linalg.solve(p.T @ w, np.array(qs)))) * sy + y.mean(), w


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pls(spark, xy, k):
    x, y, df = xy
    model, w = P.fit_pls(suffstats.moments(df, [*XS, "y"]), k)
    pred, w_ref = nipals(x, y, k)
    np.testing.assert_allclose(x @ model.coef + model.intercept, pred, rtol=1e-8)
    np.testing.assert_allclose(w, w_ref, rtol=1e-7, atol=1e-9)


def test_pls_component_choice(spark, xy):
    x, y, df = xy
    f = np.array([r["fold"] for r in folds(df).orderBy("id").collect()])
    _, errors = P.choose_pls_components(L.fold_gram(folds(df), XS, "y", "fold"), 3)
    for k in (1, 2, 3):
        sse = 0
        for j in range(5):
            tr = f != j
            sx, mx = x[tr].std(0, ddof=1), x[tr].mean(0)
            coef = np.linalg.lstsq(x[tr] - mx, nipals(x[tr], y[tr], k)[0] - y[tr].mean(), rcond=None)[0]
            sse += ((y[f == j] - y[tr].mean() - (x[f == j] - mx) @ coef) ** 2).sum()
        assert errors[k - 1] == pytest.approx(sse / 240, rel=1e-7)


def test_pls_da_finds_the_signal(spark, xy):
    _, _, df = xy
    out, weights = pls_da.pls_da(df, "id", XS, "y", permutations=60)
    r = out.first()
    assert r["test_auc"] > 0.8 and r["p"] < 0.1 and weights.count() == 4


def test_components(spark, xy):
    x, _, df = xy
    pcs = P.principal_components(suffstats.moments(df, XS), 2, standardise=True)
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(pcs.loadings.T), np.abs(vt[:2]), rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(pcs.ratio, (s**2 / (s**2).sum())[:2])
    wide = np.array([[r[0], r[1]] for r in df.orderBy("id").select(*pcs.score_expressions()).collect()])
    packed = np.array([r[0] for r in P.pack(df, XS).orderBy("id").select(pcs.score("_v")).collect()])
    np.testing.assert_allclose(wide, z @ pcs.loadings, atol=1e-9)
    np.testing.assert_allclose(packed, wide, atol=1e-9)


def test_project_passes_missing_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>").coalesce(1)
    assert [r[0] for r in df.orderBy("id").select(P.project("v", np.zeros(2), np.array([[1.0], [1.0]]))).collect()] == [[3.0], None]


def test_discriminant(spark, xy):
    x, y, df = xy
    g = df.withColumn("g", (F.col("y") > float(np.median(y))).cast("int"))
    coef, axis, _ = P.lda_axis(suffstats.moments(g, XS, ["g"]))
    c = (y > np.median(y)).astype(int)
    within = sum((x[c == k] - x[c == k].mean(0)).T @ (x[c == k] - x[c == k].mean(0)) for k in (0, 1)) / 238
    np.testing.assert_allclose(coef, np.linalg.solve(within, x[c == 1].mean(0) - x[c == 0].mean(0)), rtol=1e-6)
    assert axis @ within @ axis == pytest.approx(1)


# ---------------------------------------------------------------- norms and imputation


def test_norms_skip_missing_cells(spark):
    n = 160
    c = RNG.normal(size=(n, 2))
    f = c @ [[1.0, 1000.0], [2.0, -500.0]] + RNG.normal(size=(n, 2)) * [1, 100] + [0.05, 1e6]
    rows = [[i, "ref" if i < 100 else "case", *map(float, c[i]), *map(float, f[i])] for i in range(n)]
    rows[3][4] = None
    rows[5][2] = None
    rows[120][5] = None
    rows[130][3] = None
    df = spark.createDataFrame([tuple(r) for r in rows], "id int, g string, c0 double, c1 double, f0 double, f1 double")
    got = {r["id"]: (r["f0_z"], r["f1_z"]) for r in normative.normative_z(df, "g", ["ref"], ["case"], ["f0", "f1"], ["c0", "c1"], ["id"]).collect()}
    assert set(got) == set(range(100, n)) - {120, 130}
    for j in range(2):
        ok = [i for i in range(100) if i != 5 and not (j == 0 and i == 3)]
        d = np.column_stack([np.ones(len(ok)), c[ok]])
        b = np.linalg.lstsq(d, f[ok, j], rcond=None)[0]
        sd = (f[ok, j] - d @ b).std()
        for i in got:
            assert got[i][j] == pytest.approx((f[i, j] - b[0] - c[i] @ b[1:]) / sd, rel=1e-6)
    own = normative.normative_z(df, "g", ["ref"], ["ref"], ["f1"], ["c0", "c1"], ["id"]).agg(F.avg("f1_z"), F.stddev_pop("f1_z")).first()
    assert own[0] == pytest.approx(0, abs=1e-9) and own[1] == pytest.approx(1)


def test_site_imputation(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 8.0), ("a", None), ("b", 5.0)], "s string, v double")
    test = spark.createDataFrame([("a", None), ("b", None), ("new", None), ("b", 2.0)], "s string, v double")
    filled = scaling.impute_site_median(train, test, "s", ["v"])
    assert sorted((tuple(r) for r in filled.collect()), key=str) == [("a", 3.0, True), ("b", 2.0, False), ("b", 5.0, True), ("new", None, True)]
    assert [r[0] for r in scaling.unseen_sites(train, test, "s").collect()] == ["new"]
    assert sorted((tuple(r) for r in scaling.restore_missing(filled, ["v"]).collect()), key=str) == [("a", None), ("b", 2.0), ("b", None), ("new", None)]


def test_collinear():
    r = np.array([[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1]])
    assert scaling.collinear_columns(r, ["a", "b", "c"]) == ["b"]


# ---------------------------------------------------------------- harmonisation, checked against a row-wise computation


@pytest.fixture(scope="module")
def sites(spark):
    n, p = 90, 6
    site = np.repeat(["s1", "s2", "s3"], [20, 30, 40])
    cov = RNG.normal(size=n)
    mix = RNG.normal(size=(p, p))
    x = RNG.normal(size=(n, p)) @ mix + np.outer(cov, np.arange(p)) + (site == "s2")[:, None] * 3.0
    x[site == "s3"] = x[site == "s3"] * np.linspace(1, 2, p) - 1
    df = spark.createDataFrame([(i, str(s), float(c), list(map(float, r))) for i, (s, c, r) in enumerate(zip(site, cov, x))], "id int, site string, cov double, v array<double>")
    return site, cov, x, df


def standardised(x, site, cov=None):
    """Rows without the pooled covariate effect and the weighted site level, in units of the spread within sites."""
    own = {s: site == s for s in sorted(set(site))}
    within = np.vstack([x[rows] - x[rows].mean(0) for rows in own.values()])
    slope = np.zeros(x.shape[1])
    if cov is not None:
        c = np.concatenate([cov[rows] - cov[rows].mean() for rows in own.values()])
        slope = c @ within / (c @ c)
        within = within - np.outer(c, slope)
    effect = np.outer(cov, slope) if cov is not None else np.zeros_like(x)
    centre = (x - effect).mean(0) + effect
    spread = np.sqrt((within**2).mean(0))
    return (x - centre) / spread, centre, spread


def assert_posterior(z, g, d, hat_g, hat_d):
    """Location and scale of a site solve the two conditional-mean equations of the normal / inverse-gamma model."""
    n, tau = len(z), hat_g.var()
    ratio = hat_d.mean() ** 2 / hat_d.var(ddof=1)
    shape, rate = ratio + 2, hat_d.mean() * (ratio + 1)
    weight = n * tau / (n * tau + d)
    np.testing.assert_allclose(g, weight * hat_g + (1 - weight) * hat_g.mean(), atol=2e-3)
    np.testing.assert_allclose(d * (shape + n / 2 - 1), rate + ((z - g) ** 2).sum(0) / 2, rtol=2e-3)


def values(df):
    return np.array([r["v"] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("eb", [True, False])
@pytest.mark.parametrize("with_cov", [True, False])
def test_site_model(sites, eb, with_cov):
    site, cov, x, df = sites
    names = ["cov"] if with_cov else []
    model = H.fit_sites(H.site_moments(df, "site", "v", names), names, eb)
    z, centre, spread = standardised(x, site, cov if with_cov else None)
    expected = np.empty_like(x)
    for i, s in enumerate(model.sites):
        own = z[site == s]
        g, d = model.gamma[i], model.delta[i]
        if eb:
            assert_posterior(own, g, d, own.mean(0), own.var(0, ddof=1))
        else:
            np.testing.assert_allclose(g, own.mean(0), atol=1e-9)
            np.testing.assert_allclose(d, own.var(0, ddof=1))
        expected[site == s] = (own - g) / np.sqrt(d)
    np.testing.assert_allclose(values(H.apply_sites(df, model, "site", "v")), expected * spread + centre, rtol=1e-7, atol=1e-7)


def test_without_shrinkage_sites_agree(sites):
    site, _, x, df = sites
    got = values(H.apply_sites(df, H.fit_sites(H.site_moments(df, "site", "v"), eb=False), "site", "v"))
    pooled = sum(((x[site == s] - x[site == s].mean(0)) ** 2).sum(0) for s in set(site)) / len(x)
    for s in set(site):
        np.testing.assert_allclose(got[site == s].mean(0), x.mean(0), atol=1e-9)
        np.testing.assert_allclose(got[site == s].var(0, ddof=1), pooled, rtol=1e-9)


def test_constant_covariate_is_dropped(sites):
    _, _, _, df = sites
    one = df.withColumn("cov", F.lit(1.0))
    a = H.fit_sites(H.site_moments(one, "site", "v", ["cov"]), ["cov"])
    b = H.fit_sites(H.site_moments(df, "site", "v"))
    np.testing.assert_allclose(a.gamma, b.gamma) and a.covariates == []


@pytest.mark.parametrize("with_cov", [True, False])
@pytest.mark.parametrize("n_pc", [0, 2])
def test_covariance_model(sites, with_cov, n_pc):
    site, cov, x, df = sites
    names = ["cov"] if with_cov else []
    model = H.fit_covariance(H.site_moments(df, "site", "v", names), names, explained=0.8, components=n_pc)
    centre = standardised(x, site, cov if with_cov else None)[1]
    res = values(H.apply_sites(df, model.sites, "site", "v")) - centre  # test_site_model holds these
    mu, sd = res.mean(0), res.std(0)
    lam, axes = np.linalg.eigh(np.corrcoef(res.T))
    lam, axes = lam[::-1], axes[:, ::-1]
    k = n_pc or int(np.argmax(np.cumsum(np.round(lam / lam.sum(), 4)) > 0.8)) + 1
    scores = ((res - mu) / sd) @ axes
    z, middle, width = standardised(scores[:, :k], site)
    for s in set(site):
        rows = site == s
        scores[rows, :k] = (z[rows] - z[rows].mean(0)) / z[rows].std(0, ddof=1) * width + middle[rows]
    expected = (scores @ axes.T) * sd + mu + centre
    assert model.axes.shape[1] == k
    np.testing.assert_allclose(values(H.apply_covariance(df, model, "site", "v")), expected, rtol=1e-6, atol=1e-6)


def test_unseen_site_is_missing(spark, sites):
    _, _, _, df = sites
    new = spark.createDataFrame([(0, "other", 0.0, [1.0] * 6), (1, "s1", 0.0, [1.0] * 6)], df.schema)
    for out in (H.apply_sites(new, H.fit_sites(H.site_moments(df, "site", "v")), "site", "v"), H.apply_covariance(new, H.fit_covariance(H.site_moments(df, "site", "v")), "site", "v")):
        assert [r["v"] is None for r in out.orderBy("id").collect()] == [True, False]


def test_train_test_keeps_missing_cells(spark, sites):
    _, _, _, df = sites
    names = [f"f{i}" for i in range(6)]
    wide = P.unpack(df, "v", names).withColumn("f2", F.when(F.col("id") % 9 != 0, F.col("f2"))).withColumn("sex", F.col("id") % 2)
    train, test = H.harmonize_split(wide.where("id % 4 <> 0"), wide.where("id % 4 = 0"), "site", names)
    assert train.columns == wide.columns
    both = train.union(test)
    assert both.count() == 90 and both.where("f2 IS NULL").count() == 10 and both.where("f0 IS NULL").count() == 0


# ---------------------------------------------------------------- trees and clusters

SMALL = {"n_estimators": 4, "max_depth": 2, "eta": 0.3, "subsample": 0.9, "colsample_bytree": 0.9, "gamma": 0.0, "min_child_weight": 1}
SPACE = {"n_estimators": (2, 3, "int"), "max_depth": (2, 2, "int"), "eta": (0.1, 0.5, "log")}


def test_tree_flows(spark, xy):
    _, _, df = xy
    two = df.withColumn("site", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    params, trials = trees.search(two, "id", XS, "y", SPACE, n_iter=2, cv=2)
    assert trials.count() == 2 and set(params) == set(SPACE)
    folds_, imps, holdout = trees.nested_cv(two, "id", XS, "y", "site", SPACE, outer=2, n_iter=1, inner=2, passive=["x3"], holdout=two.where("id < 40"))
    assert folds_.count() == 2 and imps.count() == 8 and holdout > 0
    assert L.importance_summary(imps).count() == 4
    oof = trees.oof_gbt(resample.assign_folds(two, "id", 2), XS, "y", "fold", SMALL)
    assert oof.where("val_prediction IS NULL OR train_prediction IS NULL").count() == 0
    out = trees.permutation_importance(trees.gbt_fit(two, XS, "y", SMALL), two, "id", XS, "y")
    assert out.orderBy(F.desc("importance")).first()["importance"] > 0


def test_draws_are_reproducible():
    a, b = trees.draw_params(trees.SEARCH_SPACE, 20, 1), trees.draw_params(trees.SEARCH_SPACE, 20, 1)
    assert a == b and all(50 <= d["n_estimators"] <= 2001 and 0.2 <= d["subsample"] <= 1 and 2 <= d["max_depth"] <= 6 for d in a)


def test_run_grid_reports_failures(spark):
    def run(target, name):
        if name == "bad":
            raise ValueError("no such set")
        return {"r2": 0.5, "params": {"a": 1}}

    got = {(r["target"], r["feature_set"]): (r["r2"], r["error"]) for r in trees.run_grid(spark, ["t", "u"], ["ok", "bad"], run).collect()}
    assert got[("t", "ok")] == (0.5, None) and got[("u", "bad")] == (None, "no such set")


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(12)
    rows = [(i, "HR", float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([rng.normal(0, 0.5, (60, 2)), rng.normal(5, 0.5, (40, 2))]))]
    rows += [(100 + i, "LR", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(2, 1, (30, 2)))] + [(200, "HR", None, 1.0)]
    return spark.createDataFrame(rows, "id int, risk string, a double, b double")


def test_kmeans_and_mixture_find_two_clouds(clouds):
    hr = clouds.where("risk = 'HR'")
    for labelled, _ in (C.kmeans_search(hr, ["a", "b"], [2, 3]), C.gmm_search(hr, ["a", "b"], [2])):
        assert {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()} == {"0": 60, "1": 40}
    labelled, scores = C.gmm_search(hr, ["a", "b"], [2, 3])
    assert labelled.select("cluster").distinct().count() <= scores.orderBy("bic").first()["k"]
    low, _ = C.two_level_gmm(hr, ["a", "b"])
    assert {r["cluster"]: r["count"] for r in low.groupBy("cluster").count().collect()} == {"0": 60, "1": 40}


def test_mixture_probabilities_follow_labels(clouds):
    labelled, _ = C.gmm_search(clouds.where("risk = 'HR'"), ["a", "b"], [2])
    assert labelled.where("probabilities[CAST(cluster AS INT)] < 0.5").count() == 0


def test_profiles_with_reference(clouds):
    hr, _ = C.kmeans_search(clouds.where("risk = 'HR'"), ["a", "b"], [2])
    out = C.cluster_vs_reference(hr, clouds.where("risk = 'LR'"), ["a", "b"], ["b"])
    assert sorted({r["cluster"] for r in out.collect()}) == ["0", "1", "LR"] and out.count() == 6


def test_bic():
    assert C.gmm_bic(-100.0, 2, 2, 50) == pytest.approx(200 + 11 * np.log(50))


# ---------------------------------------------------------------- bounds


def test_bounds(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    with pytest.raises(TooLarge):
        small_rows(df, 49, "rows")
    assert len(small_rows(df, 50, "rows")) == 50
    assert bounded_broadcast(df, 10) is df
    assert settle(df, 100)[1] is True and settle(df, 10)[1] is False and settle(df, 10)[0].count() == 50
    assert cut_lineage(df).count() == 50


def test_sites_with_one_row_and_constant_features(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], [float(v) for v in (*rng.normal(3 * (i % 2), 1 + i % 2, 3), 5.0)]) for i in range(60)]
    full = spark.createDataFrame(rows, "i int, site string, v array<double>")
    odd = spark.createDataFrame(rows + [(99, "z", [1.0, 2.0, 3.0, 5.0])], "i int, site string, v array<double>")
    for eb in (False, True):
        one, two = (H.apply_sites(odd, H.fit_sites(H.site_moments(d, "site", "v"), eb=eb), "site", "v") for d in (full, odd))
        a, b = ({r["i"]: r["v"] for r in d.collect()} for d in (one, two))
        assert a[99] is None and b[99] is None
        assert all(np.allclose(a[i], b[i]) and abs(a[i][3] - 5.0) < 1e-9 for i in range(60))
    both = H.apply_covariance(odd, H.fit_covariance(H.site_moments(odd, "site", "v")), "site", "v").collect()
    assert all((r["v"] is None) == (r["i"] == 99) for r in both)
    assert all(np.isfinite(r["v"]).all() for r in both if r["i"] != 99)


@pytest.mark.parametrize("width", [12, 13])
def test_moments_by_any_key(spark, width):
    """Boolean and NULL keys mean the same on both sides of the width at which Arrow takes over; weightless keys are no keys."""
    rows = [(None if i % 3 == 0 else i % 3 == 1, i % 2, 0.0 if i % 6 == 4 else 1.0, *[float(i * k % 7) for k in range(width)]) for i in range(60)]
    df = spark.createDataFrame(rows, "b boolean, g int, w double, " + ", ".join(f"c{k} double" for k in range(width)))
    m = suffstats.moments(df, [f"c{k}" for k in range(width)], ["b", "g"], "w")
    x = np.array([r[3:] for r in rows])
    want = {k: [i for i, r in enumerate(rows) if (r[0], r[1]) == k and r[2]] for k in {(r[0], r[1]) for r in rows}}
    want = {k: v for k, v in want.items() if v}
    assert set(m.keys) == set(want)
    for k, at in want.items():
        assert m.of(k).size == len(at) and np.allclose(m.of(k).mean, x[at].mean(axis=0))


def test_pairwise_correlation(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 14))
    x[:, 1] += 2 * x[:, 0]
    x[np.arange(300), np.arange(300) % 14] = np.nan  # no complete row
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{k} double" for k in range(14)))
    r = suffstats.pairwise_correlation(df, [f"c{k}" for k in range(14)])
    for i in range(14):
        for j in range(14):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert r[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])


def test_trees_fit_sets_of_features_like_rows(spark):
    """Fits and searches read two rows per set of features, and give what all rows give."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    r = np.random.default_rng(9)
    rows = [(i, float(r.integers(0, 40)), float(r.integers(0, 3)), float(r.normal())) for i in range(1500)]
    df = spark.createDataFrame([(i, a, b, float(3 * b + np.sin(a / 6) * 5 + e)) for i, a, b, e in rows] + [(2000, 1.0, 1.0, None)], "id long, a double, b double, y double")
    known, params = df.where("y IS NOT NULL"), {"n_estimators": 4, "max_depth": 3, "eta": 0.4}
    plain = GBTRegressor(featuresCol="_features", labelCol="y", seed=42, **trees.spark_params(params))
    want = plain.fit(trees.assemble(known, ["a", "b"]))
    got = trees.gbt_fit(df, ["a", "b"], "y", params)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    one, two = ({x.id: x.prediction for x in trees.gbt_predict(m, known, ["a", "b"]).collect()} for m in (got, want))
    assert one.keys() == two.keys() and np.allclose([one[k] for k in two], list(two.values()))
    sums = trees.alike(known, ["a", "b"], "y")
    assert sums.count() <= 2 * 120
    back = sums.selectExpr("sum(_weight) n", "sum(_weight * y) s", "sum(_weight * y * y) q").first()
    assert np.allclose(back, known.selectExpr("count(*)", "sum(y)", "sum(y * y)").first())

    space = {"n_estimators": (2, 3, "int"), "max_depth": (2, 3, "int"), "eta": (0.2, 0.5, "real")}
    _, trials = trees.search(df, "id", ["a", "b"], "y", space, n_iter=2, cv=2, seed=3)
    folded = trees.assemble(resample.assign_folds(known, "id", 2, "search:3", "_cv"), ["a", "b"])
    for x, draw in zip(trials.orderBy("trial").collect(), trees.draw_params(space, 2, 3)):
        model = GBTRegressor(featuresCol="_features", labelCol="y", seed=3, **trees.spark_params(draw))
        scores = [RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.fit(folded.where(F.col("_cv") != f)).transform(folded.where(F.col("_cv") == f))) for f in range(2)]
        assert x.r2 == pytest.approx(np.mean(scores), abs=1e-9)
    assert trees.counts_rows({"subsample": 0.5}) and trees.counts_rows({"min_child_weight": 2}) and not trees.counts_rows(params)


def test_models_read_many_rows_in_bounded_tasks(spark, monkeypatch):
    df = spark.range(0, 400, 1, 1).selectExpr("id", "CAST(id % 2 * 50 + id / 100 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b")
    monkeypatch.setattr(C, "FEW_ROWS", 100)
    monkeypatch.setattr(C, "TASK_ROWS", 30)
    x = C._dealt(C._vectors(df, ["a", "b"], True))
    assert x.rdd.getNumPartitions() == 14 and x.columns == ["_x"]
    labelled, scores = C.kmeans_search(df, ["a"], [2])
    assert {(r.id % 2, r.cluster) for r in labelled.collect()} == {(0, "0"), (1, "1")} and labelled.columns == ["id", "a", "b", "cluster"]
    assert C.gmm_search(df, ["a"], [2])[0].groupBy("cluster").count().count() == 2
    monkeypatch.setattr(trees, "TASK_ROWS", 30)
    assert trees.spread_rows(df).rdd.getNumPartitions() == 14


def test_hyper_search_is_whole(spark, monkeypatch):
    """The query asks for fifty draws of all seven parameters, over their whole ranges, in three folds."""
    import inspect

    from cohortloom.plans import catalog, cluster_queries

    asked, plain = [], trees.search

    def search(*a, **k):
        asked.append(inspect.signature(plain).bind(*a, **k))
        asked[-1].apply_defaults()
        return None, spark.createDataFrame([(0, 0.5)], "trial int, r2 double")

    monkeypatch.setattr(cluster_queries.G, "search", search)
    catalog.QUERIES["hyper_search"](spark, "/root/testdata/sf0.001")
    got = asked[0].arguments
    assert (got["n_iter"], got["cv"]) == (50, 3)
    assert got["space"] == {
        "n_estimators": (50, 2001, "int"), "min_child_weight": (1, 11, "int"), "gamma": (0.01, 5.0, "log"), "eta": (0.005, 0.5, "log"),
        "subsample": (0.2, 1.0, "real"), "colsample_bytree": (0.2, 1.0, "real"), "max_depth": (2, 6, "int")}


def table_with_id(spark, n=1500):
    r = np.random.default_rng(9)
    rows = [(i, float(r.integers(0, 40)), float(r.integers(0, 3)), float(r.normal())) for i in range(n)]
    return spark.createDataFrame([(i, a, b, float(3 * b + np.sin(a / 6) * 5 + e)) for i, a, b, e in rows] + [(n + 500, 1.0, 1.0, None)], "id long, a double, b double, y double")


def test_search_that_counts_rows_equals_spark(spark):
    """Least rows in a leaf and least gain as Spark's trees have them, which read the rows."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    df = table_with_id(spark)
    space = {"n_estimators": (2, 6, "int"), "max_depth": (2, 5, "int"), "eta": (0.2, 0.5, "real"), "min_child_weight": (8, 40, "int"), "gamma": (0.001, 0.3, "log")}
    _, trials = trees.search(df, "id", ["a", "b"], "y", space, n_iter=3, cv=3, seed=3)
    folded = trees.assemble(resample.assign_folds(df.where("y IS NOT NULL"), "id", 3, "search:3", "_cv"), ["a", "b"]).persist()
    for x, draw in zip(trials.orderBy("trial").collect(), trees.draw_params(space, 3, 3)):
        model = GBTRegressor(featuresCol="_features", labelCol="y", seed=3, **trees.spark_params(draw))
        scores = [RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.fit(folded.where(F.col("_cv") != f)).transform(folded.where(F.col("_cv") == f))) for f in range(3)]
        assert x.r2 == pytest.approx(np.mean(scores), abs=1e-9)


def test_search_samples_rows(spark, monkeypatch):
    """A tree of a sample is Spark's tree of the rows whose hashes fall below the share; partitions, blocks and groups change nothing."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    from cohortloom.functions.hashing import with_replicate_hashes
    from cohortloom.operators import boosting, tree_search

    df = table_with_id(spark).withColumn("a", F.col("a") % 20)
    space = {"n_estimators": (1, 1, "int"), "max_depth": (2, 4, "int"), "subsample": (0.5, 0.9, "real")}
    _, trials = trees.search(df, "id", ["a", "b"], "y", space, n_iter=3, cv=2, seed=3)
    folded = with_replicate_hashes(resample.assign_folds(df.where("y IS NOT NULL"), "id", 2, "search:3", "_cv"), "id", 3).toPandas()
    number = boosting.sampled(folded._h1.to_numpy(), folded._h2.to_numpy(), 3, 0)
    for x, draw in zip(trials.orderBy("trial").collect(), trees.draw_params(space, 3, 3)):
        scores = []
        for f in range(2):
            train, held = (trees.assemble(spark.createDataFrame(t[["a", "b", "y"]]), ["a", "b"]) for t in (folded[(folded._cv != f) & (number < draw["subsample"] * 2**24)], folded[folded._cv == f]))
            model = GBTRegressor(featuresCol="_features", labelCol="y", maxIter=1, maxDepth=draw["max_depth"]).fit(train)
            scores.append(RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.transform(held)))
        assert x.r2 == pytest.approx(np.mean(scores), abs=1e-9)

    space = {"n_estimators": (3, 9, "int"), "max_depth": (2, 4, "int"), "subsample": (0.4, 1.1, "real"), "colsample_bytree": (0.3, 1.0, "real"), "eta": (0.2, 0.5, "real")}
    want = [r.r2 for r in trees.search(df, "id", ["a", "b"], "y", space, n_iter=5, cv=3, seed=4)[1].orderBy("trial").collect()]
    assert all(0 < r < 1 for r in want) and len(set(want)) == 5
    for name, v in [("BLOCK_NUMBERS", 2000), ("STATE_NUMBERS", 400), ("SCAN_ROWS", 50), ("TASK_ROWS", 300), ("SCAN_TASK_ROWS", 500)]:
        monkeypatch.setattr(tree_search, name, v)
    got = [r.r2 for r in trees.search(df.repartition(5), "id", ["a", "b"], "y", space, n_iter=5, cv=3, seed=4)[1].orderBy("trial").collect()]
    assert np.allclose(got, want)


def test_search_of_continuous_features(spark, monkeypatch):
    """Cells are sets of bins, so distinct features of every row give no more of them; beyond a bound Spark ML fits the rows."""
    from cohortloom.operators import tree_search

    df = table_with_id(spark, 600).withColumn("a", F.col("a") + F.rand(1))
    known = resample.assign_folds(df.where("y IS NOT NULL"), "id", 3, "search:1", "_cv")
    cells, rows = tree_search.gather(known, "id", ["a", "b"], "y", "_cv", 3, 1, True)
    assert cells.n.sum() == 600 == rows.count() and all(len(own) <= 32 * 3 for own in cells.own)
    monkeypatch.setattr(tree_search, "MAX_VALUES", 100)
    again, _ = tree_search.gather(known, "id", ["a", "b"], "y", "_cv", 3, 1, False)
    assert again.n.sum() == 600 and all(len(own) <= 32 * 3 for own in again.own)
    space = {"n_estimators": (3, 4, "int"), "max_depth": (2, 3, "int"), "subsample": (0.7, 0.9, "real")}
    one = trees.search(df, "id", ["a", "b"], "y", space, n_iter=2, cv=2)[1].orderBy("trial").collect()
    monkeypatch.setattr(tree_search, "MAX_CELLS", 5)
    two = trees.search(df, "id", ["a", "b"], "y", space, n_iter=2, cv=2)[1].orderBy("trial").collect()
    assert all(abs(x.r2 - y.r2) < 0.1 for x, y in zip(one, two))
    with pytest.raises(ValueError):
        tree_search.gather(known.withColumn("b", F.when(F.col("id") != 7, F.col("b"))), "id", ["a", "b"], "y", "_cv", 3, 1, False)
