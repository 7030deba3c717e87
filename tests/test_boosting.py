"""Shared-scan boosted trees against a plain recursion over rows."""

from dataclasses import replace

import numpy as np
import pytest

from cohortloom.functions.hashing import with_replicate_hashes
from cohortloom.operators import boosting as B
from cohortloom.operators import replicates as R

X = ["a", "b", "c"]


def cohort(spark, n=240, seed=1, gaps=True):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = [float(r.integers(0, 12)), float(r.integers(0, 5)), round(float(r.normal()), 1)]
        y = float(np.sin(x[0]) * 3 + (x[1] > 2) * x[2] + 0.1 * r.normal())
        rows.append((i, f"s{i % 3}", i % 4, *[None if gaps and r.random() < 0.15 else v for v in x], y))
    rows += [(n, "s0", 0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "id long, site string, fold int, a double, b double, c double, y double")


def grow(x, r, w, m, edges, depth):
    """A nested tuple, or a leaf's value."""
    g, h = (w * r).sum(), w.sum()
    best = None
    if depth:
        for missing_left in (False, True):
            for j in range(x.shape[1]):
                for e in edges[j]:
                    left = np.where(np.isnan(x[:, j]), missing_left, x[:, j] <= e)
                    hl, hr = w[left].sum(), w[~left].sum()
                    if min(hl, hr) < max(m.min_child_weight, 1e-9):
                        continue
                    gl, gr = (w * r)[left].sum(), (w * r)[~left].sum()
                    gain = gl**2 / (hl + m.reg_lambda) + gr**2 / (hr + m.reg_lambda) - g**2 / (h + m.reg_lambda)
                    if gain > max(m.gamma, 1e-12) and (best is None or gain > best[0] + 1e-9):
                        best = (gain, j, e, missing_left, left)
    if best is None:
        return m.eta * g / (h + m.reg_lambda)
    _, j, e, missing_left, left = best
    return (j, e, missing_left, grow(x[left], r[left], w[left], m, edges, depth - 1), grow(x[~left], r[~left], w[~left], m, edges, depth - 1))


def value(tree, row):
    while isinstance(tree, tuple):
        j, e, missing_left, left, right = tree
        tree = left if (missing_left if np.isnan(row[j]) else row[j] <= e) else right
    return tree


def plain_boost(x, y, w, m, edges):
    out = np.full(len(y), (w @ y) / w.sum())
    for _ in range(m.n_estimators):
        used = w > 0
        tree = grow(x[used], (y - out)[used], w[used], m, edges, m.max_depth)
        out = out + np.array([value(tree, row) for row in x])
    return out


@pytest.mark.parametrize("gaps", [True, False])
def test_equals_plain_boosting(spark, gaps):
    df = cohort(spark, gaps=gaps)
    binned = B.bin_rows(df, "id", X, "y", "fold", 7)
    models = [B.Model(rep=rep, fold=f, n_estimators=n, max_depth=d, eta=0.4, min_child_weight=mw, gamma=gm)
              for rep, f, n, d, mw, gm in [(R.PLAIN, 0, 3, 2, 1, 0), (R.PLAIN, B.NOBODY, 2, 3, 5, 0.5), (0, 1, 3, 1, 1, 0), (2, 3, 2, 2, 1, 0)]]
    boosters = B.fit_many(binned, models)
    scores = B.score_many(binned, boosters)
    rows = with_replicate_hashes(df.where("y IS NOT NULL"), "id", 7).toPandas()
    x, y, fold = rows[X].to_numpy(float), rows["y"].to_numpy(), rows["fold"].to_numpy()
    weight = R.weights_of(rows["_h1"].to_numpy(), rows["_h2"].to_numpy(), 3)
    for m, booster, s in zip(models, boosters, scores):
        w = np.where(fold != m.fold, weight[:, m.rep] if m.rep >= 0 else 1.0, 0.0)
        want = plain_boost(x, y, w, m, binned.coder.edges)
        got = {r.id: r.prediction for r in B.predict_rows(df.where("y IS NOT NULL"), booster, binned).collect()}
        assert np.allclose([got[i] for i in rows["id"]], want, atol=1e-9)
        held = fold == m.fold
        assert s[0] == held.sum() and s[1] == pytest.approx(((y - want)[held] ** 2).sum(), abs=1e-8)


def test_stored_predictions_and_small_batches_change_nothing(spark, monkeypatch):
    df = cohort(spark, 120)
    binned = B.bin_rows(df, "id", X, "y", "fold", 7)
    models = [B.Model(fold=f, n_estimators=5, max_depth=2, subsample=0.7, colsample_bytree=0.7, seed=3) for f in range(3)]
    want = B.score_many(binned, B.fit_many(binned, models))
    monkeypatch.setattr(B, "KEEP", 2)
    monkeypatch.setattr(B, "BATCH_NUMBERS", 4 * 3 * 65 * 2)
    monkeypatch.setattr(B, "ROWS", 17)
    again = B.score_many(replace(binned, table=binned.table.repartition(5)), B.fit_many(replace(binned, table=binned.table.repartition(5)), models))
    assert np.allclose(want, again)


def test_sampling_uses_about_its_share(spark):
    binned = B.bin_rows(cohort(spark), "id", X, "y", "fold", 7)
    batch = B.Batch(binned.table.toArrow().combine_chunks().to_batches()[0], binned.coder, [])
    m = B.Model(subsample=0.5)
    shares = [(batch.train(m, t) > 0).mean() for t in range(40)]
    assert 0.45 < np.mean(shares) < 0.55 and len(set(shares)) > 3
    assert len(B.columns_of(B.Model(colsample_bytree=0.4, seed=1), 0, 10)) == 4


def test_bootstrap(spark):
    r2, shares = B.gbt_bootstrap(cohort(spark), "id", X, "y", "fold", {"n_estimators": 6, "max_depth": 3, "eta": 0.5}, 5)
    rows = r2.collect()
    assert sorted(r.rep for r in rows) == list(range(5)) and all(0.2 < r.r2 < 1 for r in rows) and len({r.r2 for r in rows}) == 5
    assert sum(r.mean_importance for r in shares.collect()) == pytest.approx(1)


def test_harmonised_bootstrap_ignores_site_shifts(spark):
    """A shift and scale per site disappear, so the harmonised scores are those of the data without them, nearly."""
    df = cohort(spark, gaps=False).where("y IS NOT NULL")
    moved = df.selectExpr("id", "site", "fold", *[f"{c} * CASE site WHEN 's1' THEN 3 ELSE 1 END + CASE site WHEN 's2' THEN 40 ELSE 0 END AS {c}" for c in X], "y")
    params = {"n_estimators": 4, "max_depth": 2, "eta": 0.5}
    one, two = ({r.rep: r.r2 for r in B.gbt_bootstrap(d, "id", X, "y", "fold", params, 2, site="site", eb=False)[0].collect()} for d in (df, moved))
    plain = {r.rep: r.r2 for r in B.gbt_bootstrap(moved, "id", X, "y", "fold", params, 2)[0].collect()}
    assert all(abs(one[k] - two[k]) < 0.12 for k in one) and all(two[k] > plain[k] - 0.05 for k in two)


def test_search(spark):
    space = {"n_estimators": (1, 6, "int"), "max_depth": (1, 3, "int"), "eta": (0.05, 0.6, "real"), "subsample": (0.5, 1.0, "real")}
    best, trials = B.search_shared(cohort(spark), "id", X, "y", space, n_iter=4, cv=3, seed=2)
    rows = trials.orderBy("trial").collect()
    assert len(rows) == 4 and best == B.draw_params(space, 4, 2)[int(np.argmax([r.r2 for r in rows]))]
    again = B.search_shared(cohort(spark).repartition(3), "id", X, "y", space, n_iter=4, cv=3, seed=2)[1].orderBy("trial").collect()
    assert np.allclose([r.r2 for r in rows], [r.r2 for r in again])


def test_constant_and_empty_columns(spark):
    df = cohort(spark).selectExpr("id", "fold", "1.0 AS a", "CAST(NULL AS DOUBLE) AS b", "c", "y")
    binned = B.bin_rows(df, "id", X, "y", "fold", 7)
    booster = B.fit_many(binned, [B.Model(n_estimators=2)])[0]
    assert booster.importances(3)[:2].tolist() == [0, 0] and booster.importances(3)[2] == 1


def test_nested_cross_validation(spark, tmp_path):
    df = cohort(spark)
    space = {"n_estimators": (2, 5, "int"), "max_depth": (1, 3, "int"), "eta": (0.2, 0.6, "real")}
    folds, shares, summary = B.nested_cv_shared(df.where("id % 10 <> 0"), "id", X, "y", "site", space, outer=2, n_iter=2, inner=2, passive=["c"], holdout=df.where("id % 10 = 0"),
                                                covariance=False, record=f"{tmp_path}/runs")
    rows, one = folds.orderBy("fold").collect(), summary.first()
    scores = [r.r2 for r in rows]
    assert len(rows) == 2 and shares.count() == 6
    assert one.mean_r2 == pytest.approx(np.mean(scores)) and one.best_r2 == max(scores) and one.r2_holdout is not None
    assert (one.ci_low, one.ci_high) == pytest.approx(tuple(np.percentile(scores, [2.5, 97.5])))
    kept = spark.read.parquet(f"{tmp_path}/runs").first()
    assert kept.target == "y" and kept.ci_low == one.ci_low and kept.best_params.keys() == space.keys()


def repeated(spark, n=600):
    """Rows that share few sets of features."""
    r = np.random.default_rng(4)
    rows = [(i, f"s{i % 3}", i % 4, float(r.integers(0, 4)), None if r.random() < 0.1 else float(r.integers(0, 2)), 1.0, float(r.normal()) + 50) for i in range(n)]
    rows = [(*row[:6], row[6] + 2 * row[3] * (row[4] or 0.0)) for row in rows]
    return spark.createDataFrame(rows, "id long, site string, fold int, a double, b double, c double, y double")


@pytest.mark.parametrize("site", [None, "site"])
def test_cells_equal_rows(spark, monkeypatch, site):
    df = repeated(spark)
    params = {"n_estimators": 5, "max_depth": 2, "eta": 0.4, "subsample": 0.7}
    both = []
    for repeats in (B.REPEATS, 10**9):
        monkeypatch.setattr(B, "REPEATS", repeats)
        for keep, weightings, numbers in [(16, 256, 10**6), (2, 4, 50)] if repeats < 10**9 else [(16, 256, 10**6)]:
            monkeypatch.setattr(B, "KEEP", keep)
            monkeypatch.setattr(B, "WEIGHTINGS", weightings)
            monkeypatch.setattr(B, "CELL_NUMBERS", numbers)
            r2, shares = B.gbt_bootstrap(df, "id", X, "y", "fold", params, 3, site=site)
            both.append(([r.r2 for r in r2.orderBy("rep").collect()], [r.mean_importance for r in shares.orderBy("feature").collect()]))
    assert B.bin_rows(df, "id", X, "y", "fold").repeats is False  # the bound is out of reach now
    for got in both[:2]:
        assert np.allclose(got[0], both[2][0]) and np.allclose(got[1], both[2][1])


def test_passes_read_cells(spark):
    """The passes of a search read as many cells for a hundred times the rows."""
    df = repeated(spark, 400)
    more = df.selectExpr("*", "explode(sequence(0, 9)) AS copy").selectExpr("id + 1000000 * copy AS id", *df.columns[1:])
    sizes = []
    for d in (df, more):
        binned = B.bin_rows(d, "id", X, "y", "fold", 7)
        assert binned.repeats
        table = B.cells(binned, [(R.PLAIN, 1.0, 0, B.NOBODY)], 50.0)
        sizes.append(table.count())
        sums = np.array([np.frombuffer(r.sums) for r in table.collect()]).sum(axis=0)
        assert sums[0] == d.count() == sums[3] and sums[4] == pytest.approx(d.groupBy().sum("y").first()[0])
    assert sizes[0] == sizes[1] <= 4 * 4 * 3


@pytest.mark.parametrize("changes", [{}, {"ROW_BYTES": 10**6}, {"ROW_BYTES": 10**6, "CELL_NUMBERS": 700 * 63}, {"CELL_ROWS": 100}, {"SENT": None}])
def test_cells_are_sent_as_sums_or_rows(spark, monkeypatch, changes):
    """What tasks send is bounded by the rows, or by what a few tasks hold; one cell with half of the rows and missing keys and folds change nothing."""
    r = np.random.default_rng(8)
    n, reps = 6000, 30
    rows = [(None if i % 997 == 5 else i, None if i % 500 == 3 else i % 4, *((0.0, 0.0) if i % 2 else (float(r.integers(0, 20)), float(r.integers(0, 15)))), float(r.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, fold int, a double, b double, y double")
    binned = B.bin_rows(df, "id", ["a", "b"], "y", "fold", 7)
    if "SENT" in changes:
        changes = {}
        binned = replace(binned, table=binned.table.coalesce(1))
    for name, v in changes.items():
        monkeypatch.setattr(B, name, v)
    weightings = [*((k, 1.0, 0, B.NOBODY) for k in range(reps - 2)), (R.PLAIN, 0.3, 5, 0), (R.PLAIN, 0.8, 5, 0)]
    moved, plain = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: (moved.append(self), plain(self, *a))[1])
    got = {(x.fold, x.cell): np.frombuffer(x.sums) for x in B.cells(binned, weightings, 0.5).collect()}
    few, size = spark.sparkContext.defaultParallelism, 8 * (3 + 2 * reps)
    sent = moved[-1].selectExpr("coalesce(sum(length(sums)), 0) + coalesce(sum(length(rows)), 0) AS bytes" if "rows" in moved[-1].columns else "sum(length(sums)) AS bytes").first()[0]
    assert sent <= (few * binned.cells * 1.2 * size if "ROW_BYTES" in changes else n * 32)

    table = binned.table.toPandas()
    h1, h2 = (np.where(table[h].isna(), np.nan, table[h]) for h in ("h1", "h2"))
    w = R.weights_of(h1, h2, reps - 2)
    known = ~np.isnan(h1)
    u = np.zeros(n)
    u[known] = B.sampled(h1[known].astype(np.int64), h2[known].astype(np.int64), 5, 0)
    want = {}
    for i in range(n):
        key = (None if np.isnan(table.fold[i]) else int(table.fold[i]), bytes(table.bins[i]))
        weight = np.append(w[i], [u[i] < 0.3 * 2**24, u[i] < 0.8 * 2**24])
        z = table.y[i] - 0.5
        want[key] = want.get(key, 0) + np.array([1, z, z * z, *weight, *(weight * table.y[i])])
    nobody = np.iinfo(np.int32).min
    assert {(nobody if f is None else f, c) for f, c in want} == {(nobody if f is None else f, c) for f, c in got}
    for (f, c), v in want.items():
        other = got[f if (f, c) in got else nobody, c]
        some = np.arange(len(v)) < 3 + reps - 2 if not known.all() else slice(None)
        assert np.allclose(v[some], other[some])


def test_large_tables_of_cells_are_not_made(spark, monkeypatch):
    df = repeated(spark)
    params = {"n_estimators": 2, "max_depth": 2, "eta": 0.4}
    want = [r.r2 for r in B.gbt_bootstrap(df, "id", X, "y", "fold", params, 3)[0].orderBy("rep").collect()]
    monkeypatch.setattr(B, "CELL_BYTES", 0)
    monkeypatch.setattr(B, "ROW_BYTES", 1)
    made, cells = [], B.cells
    monkeypatch.setattr(B, "cells", lambda binned, weightings, *a: (made.append(len(weightings)), cells(binned, weightings, *a))[1])
    got = [r.r2 for r in B.gbt_bootstrap(df, "id", X, "y", "fold", params, 3)[0].orderBy("rep").collect()]
    assert made == [0] and np.allclose(got, want)
