"""Clustering, boosted trees and run grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import boosting as BT
from cohortloom.operators import cluster as C
from cohortloom.operators import trees as G
from cohortloom.operators.latent import principal_components
from cohortloom.operators.linear import fold_gram, ridge_tune
from cohortloom.operators.resample import assign_folds, regression_metrics
from cohortloom.operators.suffstats import Moments, vector_moments
from cohortloom.plans.inference_queries import FOLD_SQL, MW_SQL, bootstrap_sql, folded_lines
from cohortloom.plans.registry import FEATURES, LINE_KEY, SITE, query
from cohortloom.plans.summary_queries import rounded
from cohortloom.session import local_table


def customer_scores(t):
    """One row per customer with three scores."""
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_done"))
    return t("customer").select("c_custkey", "c_mktsegment", "c_acctbal").join(o, "c_custkey")


SCORES = ["n_orders", "mean_price", "share_done"]


@query("kmeans_search")
def kmeans_search(t):
    """k by silhouette on the first components of the embeddings; cluster sizes."""
    e = t("embeddings")
    pcs = principal_components(vector_moments(e, "embedding"), 4)
    s = e.select("vec_id", "label", pcs.score("embedding").alias("s")).select("vec_id", "label", *[F.col("s")[i].alias(f"PC{i + 1}") for i in range(4)])
    labelled, scores = C.kmeans_search(s, ["PC1", "PC2", "PC3", "PC4"], [2, 3, 4, 5, 6])
    return labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("PC1"), 4).alias("mean_pc1"))


@query("gmm_search")
def gmm_search(t):
    """Mixtures over customer scores, number of parts by BIC; size and sharpness of the clusters."""
    labelled, _ = C.gmm_search(customer_scores(t), SCORES, [2, 3, 4, 5])
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(s), 4).alias(s) for s in SCORES],
                                           F.round(F.avg(F.array_max("probabilities")), 4).alias("sharpness"))


@query("two_level_gmm")
def two_level_gmm(t):
    """Low and high group along the first component of the scores."""
    labelled, _ = C.two_level_gmm(customer_scores(t), SCORES)
    return labelled.select("c_custkey", "cluster", F.round("PC1", 4).alias("PC1"))


@query("cluster_vs_reference", """WITH b AS (SELECT l_linestatus AS cluster, (SELECT max(l_quantity) FROM lineitem) - l_quantity AS q, l_extendedprice AS p FROM lineitem WHERE l_returnflag <> 'N'
 UNION ALL SELECT 'LR', (SELECT max(l_quantity) FROM lineitem) - l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'N'),
 s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(p) AS mp, stddev_pop(p) AS sp FROM b),
 long AS (SELECT cluster, 'l_quantity' AS measure, (q - mq) / sq AS v FROM b, s UNION ALL SELECT cluster, 'l_extendedprice', (p - mp) / sp FROM b, s)
SELECT cluster, measure, round(avg(v), 6) AS mean, round(1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS ci95 FROM long GROUP BY cluster, measure""")
def cluster_vs_reference(t):
    """Standardised profiles of clusters next to the reference group, one measure reversed."""
    li = t("lineitem")
    clustered = li.where("l_returnflag <> 'N'").withColumn("cluster", F.col("l_linestatus"))
    out = C.cluster_vs_reference(clustered, li.where("l_returnflag = 'N'"), ["l_quantity", "l_extendedprice"], ["l_quantity"])
    return rounded(out, 6, "mean", "ci95")


@query("normative_clustering")
def normative_clustering(t):
    """Clusters of deviation profiles with two components."""
    li = t("lineitem").withColumn("id", F.expr(LINE_KEY))
    scored, _, _ = C.normative_clustering(li, "id", "l_returnflag", ["N"], ["A", "R"], ["l_extendedprice", "l_discount", "l_tax"], ["l_quantity"])
    return scored.groupBy("cluster", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("PC1"), 3).alias("mean_pc1"))


_TESTED = ["l_quantity", "l_discount", "l_tax"]
_TESTED_LONG = " UNION ALL ".join(f"SELECT l_returnflag AS g, l_extendedprice AS axis, '{f}' AS feature, {f} AS value FROM lineitem" for f in _TESTED)


@query("feature_cluster_tests", f"WITH long AS ({_TESTED_LONG}), two AS (SELECT * FROM long WHERE g IN ('A', 'R')), " +
       MW_SQL.format(by="feature", first="g = 'A'", source="two") + """,
 md AS (SELECT feature, median(value) FILTER (g = 'A') AS a, median(value) FILTER (g = 'R') AS r FROM two GROUP BY feature), cr AS (SELECT feature, corr(value, axis) AS c FROM long GROUP BY feature)
SELECT u.feature, round(u, 1) AS u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd, 6) AS z, round(md.a, 6) AS median_1, round(md.r, 6) AS median_2, round(c, 6) AS r
 FROM u JOIN md USING (feature) JOIN cr USING (feature)""")
def feature_cluster_tests(t):
    """Per feature: rank test between two groups with medians, and correlation with a score."""
    out = C.feature_cluster_tests(t("lineitem"), "l_returnflag", "A", "R", _TESTED, "l_extendedprice")
    return out.select("feature", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"), F.round("median_1", 6).alias("median_1"),
                      F.round("median_2", 6).alias("median_2"), F.round("r", 6).alias("r"))


@query("pairwise_mann_whitney", "WITH long AS (" + " UNION ALL ".join(
    f"SELECT p.a || '|' || p.b AS pair, l_returnflag AS g, p.a AS first, value FROM (SELECT l_returnflag, l_extendedprice AS value FROM lineitem) JOIN (SELECT '{a}' AS a, '{b}' AS b) p ON l_returnflag IN (p.a, p.b)"
    for a, b in [("A", "N"), ("A", "R"), ("N", "R")]) + "), " + MW_SQL.format(by="pair", first="g = first", source="long") +
    " SELECT 'l_extendedprice' AS measure, split_part(pair, '|', 1) AS group1, split_part(pair, '|', 2) AS group2, round(u, 1) AS u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd, 6) AS z FROM u")
def pairwise_mann_whitney(t):
    """All pairs of groups."""
    out = C.pairwise_mann_whitney(t("lineitem"), "l_returnflag", ["A", "N", "R"], ["l_extendedprice"])
    return out.select("measure", "group1", "group2", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"))


# ---------------------------------------------------------------- trees

_SMALL = {"n_estimators": 5, "max_depth": 3, "eta": 0.3}
_TINY_SPACE = {"n_estimators": (2, 4, "int"), "max_depth": (2, 3, "int"), "eta": (0.1, 0.5, "real")}
_XS = ["l_quantity", "l_discount", "l_tax"]


def lines(t):
    return t("lineitem").select(F.expr(LINE_KEY).alias("id"), F.expr(SITE).alias("site"), *FEATURES)


@query("gbt_fit")
def gbt_fit(t):
    """Boosted trees on all lines: importance per feature."""
    model = G.gbt_fit(lines(t), _XS, "l_extendedprice", _SMALL)
    return local_table(t.spark, G.importances(model, _XS), "feature string, importance double")


@query("gbt_oof")
def gbt_oof(t):
    """Out-of-fold predictions of the trees and their R squared."""
    folded = assign_folds(lines(t), "id", 3)
    out = G.oof_gbt(folded, _XS, "l_extendedprice", "fold", _SMALL)
    return regression_metrics(out, "l_extendedprice", "val_prediction", ["fold"])


@query("hyper_search")
def hyper_search(t):
    """Seeded random search: fifty draws of all seven parameters over their whole ranges, three folds."""
    _, trials = G.search(lines(t), "id", _XS, "l_extendedprice", n_iter=50, cv=3)
    return trials.select("trial", "r2")


@query("nested_cv")
def nested_cv(t):
    """Outer folds with harmonisation by site and an inner search."""
    folds, _, _ = G.nested_cv(lines(t), "id", _XS, "l_extendedprice", "site", _TINY_SPACE, outer=2, n_iter=2, inner=2, passive=["l_tax"])
    return folds.select("fold", "r2")


# One tree of depth one per replicate and fold: cuts are distinct values, sums come from weighted counts per value.
_STUMP = """WITH f AS ({fold}), ks AS (SELECT DISTINCT fold AS k FROM f),
 b AS (SELECT rep, fold, {columns}, sum(w)::DOUBLE AS n, sum(w * l_extendedprice) AS sy FROM {rows} GROUP BY ALL),
 v AS ({values}),
 s AS (SELECT rep, k, j, v, sum(n) AS n, sum(sy) AS sy FROM v JOIN ks ON k <> fold GROUP BY rep, k, j, v),
 t AS (SELECT rep, k, sum(n) AS h, sum(sy) / sum(n) AS base FROM s WHERE j = 0 GROUP BY rep, k),
 c AS (SELECT rep, k, j, v, base, h, sum(n) OVER w AS lh, sum(sy) OVER w - base * sum(n) OVER w AS lg FROM s JOIN t USING (rep, k) WINDOW w AS (PARTITION BY rep, k, j ORDER BY v)),
 g AS (SELECT *, lg * lg / (lh + 1) + lg * lg / (h - lh + 1) AS gain FROM c WHERE h - lh >= 1 AND lh >= 1),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, k ORDER BY gain DESC, j, v) AS place FROM g) WHERE place = 1),
 e AS (SELECT rep, sum(power(l_extendedprice - base - 0.3::DOUBLE * CASE WHEN CASE j WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END <= v THEN lg / (lh + 1) ELSE -lg / (h - lh + 1) END, 2)) AS sse
  FROM f JOIN best ON k = fold GROUP BY rep)
SELECT rep::INTEGER AS rep, round(1 - sse / (SELECT var_pop(l_extendedprice) * count(*) FROM f), 7) AS r2 FROM e"""


@query("gbt_bootstrap", _STUMP.format(
    fold=FOLD_SQL, columns=", ".join(_XS), rows=bootstrap_sql(100, "fold, l_extendedprice, " + ", ".join(_XS), "f"),
    values=" UNION ALL ".join(f"SELECT rep, fold, {j} AS j, {c} AS v, sum(n) AS n, sum(sy) AS sy FROM b GROUP BY rep, fold, {c}" for j, c in enumerate(_XS))))
def gbt_bootstrap(t):
    """A hundred replicates x ten folds of boosted trees (one tree of depth one): a thousand models in two shared scans."""
    r2, _ = BT.gbt_bootstrap(folded_lines(t), F.expr(LINE_KEY), _XS, "l_extendedprice", "fold", {"n_estimators": 1, "max_depth": 1, "eta": 0.3}, 100)
    return rounded(r2, 7, "r2")


@query("gbt_bootstrap_harmonised")
def gbt_bootstrap_harmonised(t):
    """Deeper trees on features whose site effects every replicate and fold removes from its own training rows."""
    f = folded_lines(t).withColumn("site", F.expr(SITE))
    r2, _ = BT.gbt_bootstrap(f, F.expr(LINE_KEY), _XS, "l_extendedprice", "fold", {"n_estimators": 2, "max_depth": 2, "eta": 0.3}, 5, site="site", passive=["l_tax"])
    return r2


_SHORT_SPACE = {**G.SEARCH_SPACE, "n_estimators": (1, 3, "int")}


@query("hyper_search_shared")
def hyper_search_shared(t):
    """Fifty draws of all seven parameters x three folds (few trees each): 150 models that share their scans."""
    _, trials = BT.search_shared(lines(t), "id", _XS, "l_extendedprice", _SHORT_SPACE, n_iter=50, cv=3)
    return trials.select("trial", "r2")


_GRID_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
_GRID_SETS = {f"without_{a}": [c for c in _GRID_COLUMNS if c != a] for a in _GRID_COLUMNS} | {
    "amounts": ["l_quantity", "l_extendedprice"], "rates": ["l_discount", "l_tax"], "places": ["l_linenumber", "l_suppkey"], "all": _GRID_COLUMNS}


@query("run_grid")
def run_grid(t):
    """Four targets x ten feature sets, tuned over a thousand penalties in ten folds; all forty runs use the statistics of one scan."""
    folded = assign_folds(t("lineitem").withColumn("id", F.expr(LINE_KEY)), "id", 10)
    m = fold_gram(folded, _GRID_COLUMNS[:-1], _GRID_COLUMNS[-1], "fold")

    def one(target: str, name: str):
        own = [m.columns.index(c) for c in _GRID_SETS[name] if c != target] + [m.columns.index(target)]
        part = Moments([m.columns[i] for i in own], m.shift[own], m.keys, m.n, m.s[:, own], m.g[:, own][:, :, own])
        alpha, curve = ridge_tune(part, t.spark)
        return {"r2": curve.agg(F.max("mean_r2")).first()[0], "params": {"alpha": alpha}}

    return G.run_grid(t.spark, FEATURES, list(_GRID_SETS), one).select("target", "feature_set", "r2", "error")


@query("permutation_importance")
def permutation_importance(t):
    """Rise of the error when a feature is shuffled over all rows."""
    data = lines(t)
    model = G.gbt_fit(data, _XS, "l_extendedprice", _SMALL)
    return G.permutation_importance(model, data, "id", _XS, "l_extendedprice")
