"""Norms, imputation, harmonisation, linear and latent models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import describe as D
from cohortloom.operators import harmonize as H
from cohortloom.operators import latent as P
from cohortloom.operators import linear as L
from cohortloom.operators import pls_da as PD
from cohortloom.operators import scaling as Z
from cohortloom.operators import site_ridge as SR
from cohortloom.operators.normative import deviation_summary, normative_z
from cohortloom.operators.resample import assign_folds, regression_metrics
from cohortloom.operators.suffstats import moments, pairwise_correlation, vector_moments, with_target
from cohortloom.plans.inference_queries import FOLD_SQL, bootstrap_sql, folded_lines
from cohortloom.plans.registry import FEATURES, LINE_KEY, SITE, query
from cohortloom.plans.summary_queries import rounded
from cohortloom.plans.table_queries import _LONG_SQL, _NORM_SQL
from cohortloom.session import local_table

NORM_FEATURES = ["l_extendedprice", "l_discount", "l_tax"]


@query("normative_z", f"""WITH {_LONG_SQL}, {_NORM_SQL} SELECT feature || '_z' AS feature, l_returnflag, count(z) AS n, round(avg(z), 6) AS mean_z, round(stddev_samp(z), 6) AS sd_z,
 count(*) FILTER (abs(z) > 2) AS n_extreme FROM z GROUP BY feature, l_returnflag""")
def normative_summary(t):
    """Which features of the case groups deviate from the reference group, given a covariate?"""
    z = normative_z(t("lineitem"), "l_returnflag", ["N"], ["A", "R"], NORM_FEATURES, ["l_quantity"], ["l_returnflag"])
    return rounded(deviation_summary(z, [f"{f}_z" for f in NORM_FEATURES], "l_returnflag"), 6, "mean_z", "sd_z")


_TWO_COVARIATES = """ref AS (SELECT count(*) AS n, avg(l_discount) AS m1, avg(l_tax) AS m2, avg(l_extendedprice) AS my, var_pop(l_discount) AS v1, var_pop(l_tax) AS v2,
  covar_pop(l_discount, l_tax) AS v12, covar_pop(l_discount, l_extendedprice) AS c1, covar_pop(l_tax, l_extendedprice) AS c2, var_pop(l_extendedprice) AS vy FROM lineitem WHERE l_returnflag = 'N'),
 fit AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM ref)"""


@query("normative_z_rows", f"""WITH {_TWO_COVARIATES} SELECT l_orderkey, l_partkey, l_returnflag,
 round((l_extendedprice - my - b1 * (l_discount - m1) - b2 * (l_tax - m2)) / sqrt(vy - b1 * c1 - b2 * c2), 6) AS l_extendedprice_z FROM lineitem, fit WHERE l_returnflag IN ('A', 'R')""")
def normative_rows(t):
    """Two covariates, one z per case row."""
    z = normative_z(t("lineitem"), "l_returnflag", ["N"], ["A", "R"], ["l_extendedprice"], ["l_discount", "l_tax"], ["l_orderkey", "l_partkey", "l_returnflag"])
    return rounded(z, 6, "l_extendedprice_z")


# ---------------------------------------------------------------- preparation

_HOLES = ("l_orderkey", "l_partkey", f"{SITE} AS site", "CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity",
          "CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS l_extendedprice", "l_orderkey % 4 <> 0 AS training")


def holes(t):
    return t("lineitem").selectExpr(*_HOLES)


_HOLES_SQL = f"h AS (SELECT {', '.join(_HOLES)} FROM lineitem)"


@query("impute_site_median", f"""WITH {_HOLES_SQL}, m AS (SELECT site, median(l_quantity) AS q, median(l_extendedprice) AS p FROM h WHERE training AND site <> 'RO' GROUP BY site)
SELECT l_orderkey, l_partkey, h.site, round(coalesce(l_quantity, q), 4) AS l_quantity, round(coalesce(l_extendedprice, p), 4) AS l_extendedprice,
 l_quantity IS NULL AS l_quantity_was_missing, l_extendedprice IS NULL AS l_extendedprice_was_missing FROM h LEFT JOIN m ON m.site = h.site""")
def impute_site_median(t):
    """Medians of the training rows; one site is absent from training and stays missing."""
    h = holes(t)
    done = Z.impute_site_median(h.where("training AND site <> 'RO'"), h.drop("training"), "site", ["l_quantity", "l_extendedprice"])
    return rounded(done, 4, "l_quantity", "l_extendedprice")


@query("unseen_sites", f"WITH {_HOLES_SQL} SELECT DISTINCT site FROM h WHERE site NOT IN (SELECT site FROM h WHERE training AND site <> 'RO')")
def unseen_sites(t):
    h = holes(t)
    return Z.unseen_sites(h.where("training AND site <> 'RO'"), h, "site")


@query("impute_mean", f"""WITH {_HOLES_SQL}, m AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM h WHERE training)
SELECT l_orderkey, l_partkey, round(coalesce(l_quantity, q), 4) AS l_quantity, round(coalesce(l_extendedprice, p), 4) AS l_extendedprice FROM h, m""")
def impute_mean(t):
    h = holes(t)
    done = Z.impute_mean(h.where("training"), h.drop("training", "site"), ["l_quantity", "l_extendedprice"])
    return rounded(done, 4, "l_quantity", "l_extendedprice")


@query("restore_missing", f"WITH {_HOLES_SQL} SELECT l_orderkey, l_partkey, site, round(2 * l_quantity, 4) AS l_quantity, l_extendedprice FROM h")
def restore_missing(t):
    """Fill, change, and take the filled cells out again."""
    h = holes(t).drop("training")
    filled = Z.impute_site_median(h, h, "site", ["l_quantity", "l_extendedprice"])
    changed = filled.withColumn("l_quantity", 2 * F.col("l_quantity"))
    return rounded(Z.restore_missing(changed, ["l_quantity", "l_extendedprice"]), 4, "l_quantity")


EMB_LONG = "x AS (SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


def dims(df, digits: int = 6, *keep: str):
    return df.select(*keep, F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", digits))


@query("standardize", f"""WITH {EMB_LONG}, s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY dim)
SELECT vec_id, dim, round((x - m) / sd, 6) AS x FROM x JOIN s USING (dim)""")
def standardize(t):
    return dims(Z.standardize_vector(t("embeddings"), "embedding"), 6, "vec_id")


_EMB_CORR = f"""{EMB_LONG}, c AS (SELECT a.dim AS i, b.dim AS j, corr(a.x, b.x) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY a.dim, b.dim)"""


@query("prune_collinear", f"WITH {_EMB_CORR} SELECT 'd' || dim AS feature FROM (SELECT DISTINCT dim FROM x) WHERE dim NOT IN (SELECT j FROM c WHERE abs(r) > 0.15)")
def prune_collinear(t):
    m = vector_moments(t("embeddings"), "embedding")
    gone = set(Z.collinear_columns(m.correlation(), m.columns, 0.15))
    return local_table(t.spark, [(c,) for c in m.columns if c not in gone], "feature string")


_GAPS = {"q": "CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END", "p": "CASE WHEN l_orderkey % 3 <> 1 THEN l_extendedprice END",
         "d": "CASE WHEN l_orderkey % 3 <> 2 THEN l_discount END", "w": "CASE WHEN l_partkey % 5 <> 0 THEN 2 * l_quantity + l_tax END"}


@query("prune_collinear_gaps", "WITH g AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GAPS.items()) + " FROM lineitem) "
       + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM g" for i, a in enumerate(_GAPS) for b in list(_GAPS)[i + 1:]))
def prune_collinear_gaps(t):
    """Every row misses a feature: each pair uses the rows that have both."""
    names = list(_GAPS)
    r = pairwise_correlation(t("lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _GAPS.items()]), names)
    return local_table(t.spark, [(a, names[j], round(float(r[i, j]), 6)) for i, a in enumerate(names) for j in range(i + 1, len(names))], "a string, b string, r double")


_WIDE = [f"(l_quantity * {k + 1} + l_linenumber * {k * k}) AS c{k}" for k in range(13)]
_WIDE_KEY = "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey % 2 = 0 END AS k"


@query("moments_wide_keys", f"""WITH w AS (SELECT {_WIDE_KEY}, {", ".join(_WIDE)} FROM lineitem)
SELECT k, CAST(count(*) AS DOUBLE) AS n, round(avg(c0), 4) AS m0, round(avg(c12), 4) AS m12, round(covar_pop(c0, c12), 4) AS cov FROM w GROUP BY k""")
def moments_wide_keys(t):
    """More columns than plain SQL sums take, by a key that is boolean and sometimes NULL."""
    m = moments(t("lineitem").selectExpr(_WIDE_KEY, *_WIDE), [f"c{k}" for k in range(13)], ["k"])
    parts = [(key[0], m.pick([i])) for i, key in enumerate(m.keys)]
    return local_table(t.spark, [(k, p.size, round(float(p.mean[0]), 4), round(float(p.mean[12]), 4), round(float(p.scatter[0, 12] / p.size), 4)) for k, p in parts],
                       "k boolean, n double, m0 double, m12 double, cov double")


# ---------------------------------------------------------------- harmonisation

_NOEB = f"""{EMB_LONG}, b AS (SELECT label, dim, count(*) AS n, avg(x) AS m, var_pop(x) AS v, var_samp(x) AS vs FROM x GROUP BY label, dim),
 g AS (SELECT dim, sum(n * m) / sum(n) AS grand, sqrt(sum(n * v) / sum(n)) AS sd FROM b GROUP BY dim)"""


@query("combat_noeb", f"""WITH {_NOEB} SELECT vec_id, dim, round((x - b.m) / (sqrt(vs) / sd) + grand, 5) AS x FROM x JOIN b USING (label, dim) JOIN g USING (dim)""")
def combat_noeb(t):
    """Location and scale of every site moved to the pooled ones."""
    e = t("embeddings")
    model = H.fit_sites(H.site_moments(e, "label", "embedding"), eb=False)
    return dims(H.apply_sites(e, model, "label", "embedding"), 5, "vec_id")


@query("combat_small_site", f"""WITH {_NOEB.replace("FROM embeddings,", "FROM (SELECT * FROM embeddings WHERE vec_id <> 7),")}
SELECT vec_id, dim, round((x - b.m) / (sqrt(vs) / sd) + grand, 5) AS x FROM x JOIN b USING (label, dim) JOIN g USING (dim)
UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE vec_id = 7""")
def combat_small_site(t):
    """A site of one row has no scale: its row is NULL, and the others are as without it."""
    e = t("embeddings").withColumn("label", F.when(F.col("vec_id") == 7, -1).otherwise(F.col("label")))
    model = H.fit_sites(H.site_moments(e, "label", "embedding"), eb=False)
    adjusted = H.apply_sites(e, model, "label", "embedding")
    return adjusted.select("vec_id", F.posexplode_outer("embedding").alias("dim", "x")).withColumn("x", F.round("x", 5))


@query("combat_eb")
def combat_eb(t):
    """The same with shrinkage of the site effects and one covariate."""
    e = t("embeddings").withColumn("order", F.col("vec_id").cast("double"))
    model = H.fit_sites(H.site_moments(e, "label", "embedding", ["order"]), ["order"])
    return dims(H.apply_sites(e, model, "label", "embedding"), 5, "vec_id")


@query("covbat_harmonize")
def covbat_harmonize(t):
    """Shrinkage plus harmonised component scores."""
    e = t("embeddings")
    model = H.fit_covariance(H.site_moments(e, "label", "embedding"))
    return dims(H.apply_covariance(e, model, "label", "embedding"), 5, "vec_id")


@query("covbat_train_test")
def covbat_train_test(t):
    """Fit on training lines, apply to both; cells that were missing are missing again."""
    h = holes(t).selectExpr("l_orderkey", "l_partkey", "site", "l_quantity", "l_extendedprice", "training")
    train, test = H.harmonize_split(h.where("training"), h.where("NOT training"), "site", ["l_quantity", "l_extendedprice"])
    both = train.unionByName(test)
    return both.groupBy("site", "training").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("n_quantity"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"),
        F.round(F.stddev_samp("l_quantity"), 4).alias("sd_quantity"), F.round(F.avg("l_extendedprice"), 2).alias("mean_price"))


# ---------------------------------------------------------------- linear models

_COLS = [*FEATURES[:1], "l_discount", "l_tax", "l_extendedprice"]
_CELLS = [(i, j) for i in range(4) for j in range(i, 4)]


@query("fold_gram", f"WITH f AS ({FOLD_SQL}) " + " UNION ALL ".join(
    f"SELECT fold, '{_COLS[i]}' AS a, '{_COLS[j]}' AS b, count(*)::DOUBLE AS n, round(covar_pop({_COLS[i]}, {_COLS[j]}), 2) AS cov FROM f GROUP BY fold" for i, j in _CELLS))
def fold_gram(t):
    """Cross products per fold (as covariances), the input of all linear models."""
    m = L.fold_gram(folded_lines(t), _COLS[:3], _COLS[3], "fold")
    rows = []
    for key in m.keys:
        one = m.of(key)
        rows += [(int(key[0]), _COLS[i], _COLS[j], one.size, float(one.scatter[i, j] / one.size)) for i, j in _CELLS]
    return rounded(local_table(t.spark, rows, "fold int, a string, b string, n double, cov double"), 2, "cov")


# Ridge of two features in closed form, on the sums per fold: the SQL twin of the penalty path.
_RIDGE_SQL = f"""f AS ({FOLD_SQL}), ks AS (SELECT DISTINCT fold AS k FROM f),
 tr AS (SELECT k, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS v1, var_pop(l_discount) * count(*) AS v2,
  covar_pop(l_quantity, l_discount) * count(*) AS v12, covar_pop(l_quantity, l_extendedprice) * count(*) AS c1, covar_pop(l_discount, l_extendedprice) * count(*) AS c2 FROM f JOIN ks ON k <> fold GROUP BY k),
 te AS (SELECT fold AS k, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS v1, var_pop(l_discount) * count(*) AS v2,
  covar_pop(l_quantity, l_discount) * count(*) AS v12, covar_pop(l_quantity, l_extendedprice) * count(*) AS c1, covar_pop(l_discount, l_extendedprice) * count(*) AS c2, var_pop(l_extendedprice) * count(*) AS vy FROM f GROUP BY fold)"""
_SSE_SQL = """te.vy - 2 * (w1 * te.c1 + w2 * te.c2) + w1 * w1 * te.v1 + w2 * w2 * te.v2 + 2 * w1 * w2 * te.v12
 + te.n * power((te.my - tr.my) - w1 * (te.m1 - tr.m1) - w2 * (te.m2 - tr.m2), 2)"""


@query("ridge_tune", f"""WITH {_RIDGE_SQL}, al AS (SELECT i, power(10::DOUBLE, -4 + 8 * i / 999.0::DOUBLE) AS alpha FROM (SELECT unnest(range(0, 1000)) AS i)),
 w AS (SELECT k, i, alpha, (c1 * (v2 + alpha) - c2 * v12) / ((v1 + alpha) * (v2 + alpha) - v12 * v12) AS w1, (c2 * (v1 + alpha) - c1 * v12) / ((v1 + alpha) * (v2 + alpha) - v12 * v12) AS w2 FROM tr, al)
SELECT round(log10(alpha), 6) AS log_alpha, round(avg(1 - ({_SSE_SQL}) / te.vy), 8) AS mean_r2 FROM w JOIN tr USING (k) JOIN te USING (k) GROUP BY i, alpha""")
def ridge_tune(t):
    """A thousand penalties in ten folds from one pass over the data."""
    m = L.fold_gram(folded_lines(t), ["l_quantity", "l_discount"], "l_extendedprice", "fold")
    _, curve = L.ridge_tune(m, t.spark)
    return curve.select(F.round(F.log10("alpha"), 6).alias("log_alpha"), F.round("mean_r2", 8).alias("mean_r2"))


@query("ridge_bootstrap", f"""WITH {_RIDGE_SQL.split(' tr AS')[0]}
 b AS (SELECT rep, fold, sum(w)::DOUBLE AS n, sum(w * l_quantity) AS s1, sum(w * (l_discount)) AS s2, sum(w * l_extendedprice) AS sy, sum(w * l_quantity * l_quantity) AS g11, sum(w * l_discount * l_discount) AS g22,
  sum(w * l_quantity * l_discount) AS g12, sum(w * l_quantity * l_extendedprice) AS g1y, sum(w * l_discount * l_extendedprice) AS g2y FROM {bootstrap_sql(100, 'fold, l_quantity, l_discount, l_extendedprice', 'f')} GROUP BY rep, fold),
 s AS (SELECT rep, k, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(sy) AS sy, sum(g11) AS g11, sum(g22) AS g22, sum(g12) AS g12, sum(g1y) AS g1y, sum(g2y) AS g2y FROM b JOIN ks ON k <> fold GROUP BY rep, k),
 tr AS (SELECT rep, k, s1 / n AS m1, s2 / n AS m2, sy / n AS my, g11 - s1 * s1 / n + 10 AS v1, g22 - s2 * s2 / n + 10 AS v2, g12 - s1 * s2 / n AS v12, g1y - s1 * sy / n AS c1, g2y - s2 * sy / n AS c2 FROM s),
 w AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS w1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS w2 FROM tr),
 e AS (SELECT rep, sum(power(l_extendedprice - my - w1 * (l_quantity - m1) - w2 * (l_discount - m2), 2)) AS sse FROM f JOIN w ON w.k = f.fold GROUP BY rep)
SELECT rep::INTEGER AS rep, round(1 - sse / (SELECT var_pop(l_extendedprice) * count(*) FROM f), 8) AS r2 FROM e""")
def ridge_bootstrap(t):
    """R squared over bootstrap replicates x folds; the copies are weights, never rows."""
    r2, _ = L.ridge_bootstrap(folded_lines(t), F.expr(LINE_KEY), ["l_quantity", "l_discount"], "l_extendedprice", "fold", 10.0, 100)
    return rounded(r2, 8, "r2")


# Per (replicate, held-out fold, site): the statistics of the training rows, and location and scale of every site from them.
@query("ridge_bootstrap_harmonised", f"""WITH f AS (SELECT *, {SITE} AS site FROM ({FOLD_SQL})), ks AS (SELECT DISTINCT fold AS k FROM f),
 b AS (SELECT rep, fold, site, sum(w)::DOUBLE AS n, sum(w * l_quantity) AS s1, sum(w * l_discount) AS s2, sum(w * l_extendedprice) AS sy, sum(w * l_quantity * l_quantity) AS g11, sum(w * l_discount * l_discount) AS g22,
  sum(w * l_quantity * l_discount) AS g12, sum(w * l_quantity * l_extendedprice) AS g1y, sum(w * l_discount * l_extendedprice) AS g2y FROM {bootstrap_sql(100, 'fold, site, l_quantity, l_discount, l_extendedprice', 'f')} GROUP BY rep, fold, site),
 s AS (SELECT rep, k, site, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(sy) AS sy, sum(g11) AS g11, sum(g22) AS g22, sum(g12) AS g12, sum(g1y) AS g1y, sum(g2y) AS g2y FROM b JOIN ks ON k <> fold GROUP BY rep, k, site),
 c AS (SELECT rep, k, site, n, s1 / n AS m1, s2 / n AS m2, sy, sqrt((g11 - s1 * s1 / n) / (n - 1)) AS d1, sqrt((g22 - s2 * s2 / n) / (n - 1)) AS d2, g11 - s1 * s1 / n AS r1, g22 - s2 * s2 / n AS r2,
  g12 - s1 * s2 / n AS r12, g1y - s1 * sy / n AS c1, g2y - s2 * sy / n AS c2 FROM s),
 p AS (SELECT rep, k, sqrt(sum(r1) / sum(n)) AS p1, sqrt(sum(r2) / sum(n)) AS p2 FROM c GROUP BY rep, k),
 h AS (SELECT rep, k, site, n, m1, m2, sy, d1 / p1 AS d1, d2 / p2 AS d2, r1, r2, r12, c1, c2 FROM c JOIN p USING (rep, k)),
 tr AS (SELECT rep, k, sum(sy) / sum(n) AS my, sum(r1 / d1 / d1) + 10 AS v1, sum(r2 / d2 / d2) + 10 AS v2, sum(r12 / d1 / d2) AS v12, sum(c1 / d1) AS c1, sum(c2 / d2) AS c2 FROM h GROUP BY rep, k),
 w AS (SELECT rep, k, my, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS w1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS w2 FROM tr),
 o AS (SELECT rep, k, site, my, w1 / d1 AS w1, w2 / d2 AS w2, m1, m2 FROM w JOIN h USING (rep, k)),
 e AS (SELECT rep, count(*) AS scored, sum(power(l_extendedprice - my - w1 * (l_quantity - m1) - w2 * (l_discount - m2), 2)) AS sse FROM f JOIN o ON o.k = f.fold AND o.site = f.site GROUP BY rep)
SELECT rep::INTEGER AS rep, round(1 - sse / (SELECT var_pop(l_extendedprice) * count(*) FROM f), 8) AS r2, scored FROM e""")
def ridge_bootstrap_harmonised(t):
    """A hundred replicates x ten folds, each with its own site effects and ridge, from one scan."""
    f = folded_lines(t).withColumn("site", F.expr(SITE))
    r2, _ = SR.ridge_bootstrap_harmonised(f, F.expr(LINE_KEY), ["l_quantity", "l_discount"], "l_extendedprice", "fold", "site", 10.0, 100, eb=False)
    return rounded(r2, 8, "r2")


@query("ridge_tune_harmonised", f"""WITH f0 AS (SELECT *, {SITE} AS site FROM ({FOLD_SQL})),
 h AS (SELECT site, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_samp(l_quantity) AS q1, var_samp(l_discount) AS q2, var_pop(l_quantity) * count(*) AS r1, var_pop(l_discount) * count(*) AS r2 FROM f0 GROUP BY site),
 p AS (SELECT sum(r1) / sum(n) AS p1, sum(r2) / sum(n) AS p2, sum(n * m1) / sum(n) AS g1, sum(n * m2) / sum(n) AS g2 FROM h),
 hf AS (SELECT fold, (l_quantity - m1) / sqrt(q1 / p1) + g1 AS l_quantity, (l_discount - m2) / sqrt(q2 / p2) + g2 AS l_discount, l_extendedprice FROM f0 JOIN h USING (site), p),
 {_RIDGE_SQL.replace(f"f AS ({FOLD_SQL})", "f AS (SELECT * FROM hf)")}, al AS (SELECT i, power(10::DOUBLE, -4 + 8 * i / 999.0::DOUBLE) AS alpha FROM (SELECT unnest(range(0, 1000)) AS i)),
 w AS (SELECT k, i, alpha, (c1 * (v2 + alpha) - c2 * v12) / ((v1 + alpha) * (v2 + alpha) - v12 * v12) AS w1, (c2 * (v1 + alpha) - c1 * v12) / ((v1 + alpha) * (v2 + alpha) - v12 * v12) AS w2 FROM tr, al)
SELECT round(log10(alpha), 6) AS log_alpha, round(avg(1 - ({_SSE_SQL}) / te.vy), 8) AS mean_r2 FROM w JOIN tr USING (k) JOIN te USING (k) GROUP BY i, alpha""")
def ridge_tune_harmonised(t):
    """A thousand penalties on harmonised features, from one pass."""
    f = folded_lines(t).withColumn("site", F.expr(SITE))
    _, curve = SR.ridge_tune_harmonised(f, F.expr(LINE_KEY), ["l_quantity", "l_discount"], "l_extendedprice", "fold", "site", eb=False)
    return curve.select(F.round(F.log10("alpha"), 6).alias("log_alpha"), F.round("mean_r2", 8).alias("mean_r2"))


def supplier_runs(t):
    """Coefficients of one small regression per supplier: a table of model runs."""
    runs = t("lineitem").groupBy("l_suppkey").agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("quantity"), (F.regr_slope("l_discount", "l_tax") * 100).alias("tax"))
    return runs.unpivot(["l_suppkey"], ["quantity", "tax"], "feature", "coef").where("coef IS NOT NULL")


_RUNS_SQL = """runs AS (SELECT l_suppkey, 'quantity' AS feature, regr_slope(l_extendedprice, l_quantity) AS coef FROM lineitem GROUP BY l_suppkey
 UNION ALL SELECT l_suppkey, 'tax', 100 * regr_slope(l_discount, l_tax) FROM lineitem GROUP BY l_suppkey)"""


@query("coef_summary", f"""WITH {_RUNS_SQL} SELECT feature, round(avg(coef), 4) AS mean, round(stddev_pop(coef), 4) AS std, round(abs(avg(coef)), 4) AS abs_mean,
 round(avg(CASE WHEN coef > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_positive, round(avg(CASE WHEN coef < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_negative FROM runs WHERE coef IS NOT NULL GROUP BY feature""")
def coef_summary(t):
    s = L.coef_summary(supplier_runs(t))
    return rounded(rounded(s, 4, "mean", "std", "abs_mean"), 6, "share_positive", "share_negative")


@query("importance_summary", f"""WITH {EMB_LONG}, r AS (SELECT label, dim, avg(abs(x)) AS importance FROM x GROUP BY label, dim)
SELECT dim, round(avg(importance), 6) AS mean_importance, round(stddev_pop(importance), 6) AS std_importance FROM r GROUP BY dim""")
def importance_summary(t):
    x = t("embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    runs = x.groupBy("label", "dim").agg(F.avg(F.abs(F.col("x").cast("double"))).alias("importance"))
    return rounded(L.importance_summary(runs, "dim"), 6, "mean_importance", "std_importance")


@query("elastic_net_cv")
def elastic_net_cv(t):
    """Nested cross-validated elastic net for two targets."""
    f = assign_folds(assign_folds(t("lineitem"), F.expr(LINE_KEY), 5, 1, "outer"), F.expr(LINE_KEY), 5, 2, "inner")
    return L.elastic_net_cv(f, ["l_quantity", "l_discount", "l_tax"], ["l_extendedprice"], "outer", "inner").unionByName(
        L.elastic_net_cv(f, ["l_quantity", "l_extendedprice", "l_tax"], ["l_discount"], "outer", "inner"))


@query("search_report", """WITH runs AS (SELECT user_id, event_type, count(*)::DOUBLE AS depth, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS eta, avg(value) AS r2 FROM events GROUP BY 1, 2)
SELECT 'depth' AS x, 'r2' AS y, count(*) AS n, round(corr(depth, r2), 6) AS r FROM runs UNION ALL SELECT 'eta', 'r2', count(*), round(corr(eta, r2), 6) FROM runs""")
def search_report(t):
    """How each searched parameter goes with the score over all runs."""
    runs = t("events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("depth"), F.avg(F.get_json_object("props", "$.k").try_cast("double")).alias("eta"), F.avg("value").alias("r2"))
    return rounded(D.corr_pairs(runs, [("depth", "r2"), ("eta", "r2")]), 6, "r")


@query("linear_attribution", """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS q FROM lineitem)
SELECT 'l_quantity' AS feature, l_returnflag, l_linestatus, round(avg(abs(b * (l_quantity - q))), 4) AS mean_abs, count(*) AS n FROM lineitem, m GROUP BY l_returnflag, l_linestatus""")
def linear_attribution(t):
    """Mean absolute attribution by group."""
    li = t("lineitem")
    m = moments(li, ["l_quantity", "l_extendedprice"])
    long = L.linear_attribution(li, L.solve_ols(m), dict(zip(m.columns, m.mean)), ["l_returnflag", "l_linestatus"])
    return rounded(L.attribution_summary(long, ["l_returnflag", "l_linestatus"]), 4, "mean_abs")


_TWO_FEATURES = """s AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_tax) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) AS v1, var_pop(l_tax) AS v2, covar_pop(l_quantity, l_tax) AS v12,
  covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_tax, l_extendedprice) AS c2, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
 fit AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2 FROM s)"""


@query("marginal_curve", f"""WITH {_TWO_FEATURES} SELECT p::INTEGER AS point, round(lo + p * (hi - lo) / 99, 6) AS x, lv::DOUBLE AS level,
 round(my + b1 * (lo + p * (hi - lo) / 99 - m1) + b2 * (lv - m2), 4) AS prediction FROM fit, (SELECT unnest(range(0, 100)) AS p), (SELECT unnest([0, 1]) AS lv)""")
def marginal_curve(t):
    li = t("lineitem")
    model = L.solve_ols(moments(li, ["l_quantity", "l_tax", "l_extendedprice"]))
    return rounded(rounded(L.marginal_curve(li, model, "l_quantity", "l_tax", [0, 1]), 6, "x"), 4, "prediction")


# ---------------------------------------------------------------- latent structure


@query("pca_covariance", f"""WITH {EMB_LONG} SELECT a.dim AS i, b.dim AS j, round(covar_pop(a.x, b.x), 7) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY a.dim, b.dim""")
def pca_covariance(t):
    m = vector_moments(t("embeddings"), "embedding")
    c = m.scatter / m.size
    rows = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(i, len(c))]
    return rounded(local_table(t.spark, rows, "i int, j int, cov double"), 7, "cov")


@query("pca_scores")
def pca_scores(t):
    """Scores on the first two components."""
    e = t("embeddings")
    pcs = P.principal_components(vector_moments(e, "embedding"), 2)
    s = e.select("vec_id", pcs.score("embedding").alias("s"))
    return s.select("vec_id", F.round(F.col("s")[0], 5).alias("PC1"), F.round(F.col("s")[1], 5).alias("PC2"))


@query("pls_first_weights", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS q, corr(l_discount, l_extendedprice) AS d, corr(l_tax, l_extendedprice) AS x FROM lineitem),
 n AS (SELECT *, sqrt(q * q + d * d + x * x) AS len FROM c)
SELECT 'l_quantity' AS feature, round(q / len, 6) AS weight FROM n UNION ALL SELECT 'l_discount', round(d / len, 6) FROM n UNION ALL SELECT 'l_tax', round(x / len, 6) FROM n""")
def pls_first_weights(t):
    """Weights of the first component for a target."""
    names = ["l_quantity", "l_discount", "l_tax"]
    _, w = P.fit_pls(moments(t("lineitem"), [*names, "l_extendedprice"]), 1)
    return rounded(P.weights_table(t.spark, names, w[:, 0]).drop("place"), 6, "weight")


@query("pls_regression")
def pls_regression(t):
    """Hold out a fifth, choose up to three components by ten-fold error, report on the held-out part."""
    names = ["l_quantity", "l_discount", "l_tax"]
    split = assign_folds(assign_folds(t("lineitem"), F.expr(LINE_KEY), 5, 7, "part"), F.expr(LINE_KEY), 10, 8, "fold")
    m = L.fold_gram(split.where("part > 0"), names, "l_extendedprice", "fold")
    k, errors = P.choose_pls_components(m, 3)
    model, _ = P.fit_pls(m.total(), k)
    held = split.where("part = 0").select("l_extendedprice", model.predict().alias("prediction"))
    out = regression_metrics(held, "l_extendedprice", "prediction")
    return out.select(F.lit(k).alias("components"), F.lit(float(min(errors))).alias("cv_mse"), "n", "r2", "mse")


@query("pls_da")
def pls_da(t):
    """Lowest against highest quarter of order value by line features: cross-validated AUC, permutation p."""
    o = t("orders").select("o_orderkey", "o_totalprice")
    f = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.avg(c).alias(c) for c in FEATURES])
    result, _ = PD.pls_da(f.join(o, "o_orderkey"), "o_orderkey", FEATURES, "o_totalprice", permutations=1000)
    return result


@query("class_means", f"""WITH {EMB_LONG} SELECT dim, round(avg(x) FILTER (label >= 5) - avg(x) FILTER (label < 5), 6) AS diff FROM x GROUP BY dim""")
def class_means(t):
    """Mean differences of two classes, the numerator of the discriminant."""
    e = t("embeddings").withColumn("cls", (F.col("label") >= 5).cast("int"))
    m = D.vector_group_means(e, "cls", "embedding")
    out = m.groupBy("dim").agg(F.max(F.when(F.col("cls") == 1, F.col("mean"))).alias("hi"), F.max(F.when(F.col("cls") == 0, F.col("mean"))).alias("lo"))
    return out.select("dim", F.round(F.col("hi") - F.col("lo"), 6).alias("diff"))


@query("lda_axis")
def lda_axis(t):
    """Ten largest signed discriminant coefficients."""
    e = t("embeddings").withColumn("cls", (F.col("label") >= 5).cast("int"))
    m = vector_moments(e, "embedding", ["cls"])
    coef, _, _ = P.lda_axis(m)
    return P.weights_table(t.spark, m.columns, coef, 10)


@query("covariance_axis", f"""WITH {EMB_LONG}, c AS (SELECT dim, covar_pop(x, label) AS c FROM x GROUP BY dim), n AS (SELECT sqrt(sum(c * c)) AS len FROM c)
SELECT 'd' || dim AS feature, round(c / len, 6) AS weight FROM c, n""")
def covariance_axis(t):
    m = vector_moments(with_target(t("embeddings"), "embedding", "label"), "_v")
    axis, _ = P.covariance_axis(m)
    return rounded(P.weights_table(t.spark, m.columns[:-1], axis).drop("place"), 6, "weight")


@query("covariance_axis_scores", f"""WITH {EMB_LONG}, c AS (SELECT dim, covar_pop(x, label) AS c, avg(x) AS m FROM x GROUP BY dim), n AS (SELECT sqrt(sum(c * c)) AS len FROM c),
 s AS (SELECT vec_id, label, sum((x - m) * c / len) AS s FROM x JOIN c USING (dim), n GROUP BY vec_id, label)
SELECT vec_id, round(s, 5) AS score FROM s""")
def covariance_axis_scores(t):
    """Rows projected on the axis."""
    e = t("embeddings")
    axis, centre = P.covariance_axis(vector_moments(with_target(e, "embedding", "label"), "_v"))
    return e.select("vec_id", F.round(P.project("embedding", centre, axis[:, None])[0], 5).alias("score"))


# ---------------------------------------------------------------- closed forms in two dimensions

_TWO = "SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_linestatus, l_returnflag FROM lineitem"


@query("pca_two_features", f"""WITH t AS ({_TWO}), c AS (SELECT var_pop(x) AS a, var_pop(y) AS d, covar_pop(x, y) AS b FROM t),
 l AS (SELECT *, (a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b) AS big FROM c), v AS (SELECT *, b / sqrt(b * b + power(big - a, 2)) AS u, (big - a) / sqrt(b * b + power(big - a, 2)) AS w FROM l),
 f AS (SELECT *, sign(CASE WHEN abs(u) >= abs(w) THEN u ELSE w END) AS s1, sign(CASE WHEN abs(w) >= abs(u) THEN -w ELSE u END) AS s2 FROM v)
SELECT 'x' AS feature, 1 AS component, round(s1 * u, 6) AS loading, round(big / (a + d), 6) AS explained FROM f UNION ALL SELECT 'y', 1, round(s1 * w, 6), round(big / (a + d), 6) FROM f
UNION ALL SELECT 'x', 2, round(s2 * -w, 6), round(1 - big / (a + d), 6) FROM f UNION ALL SELECT 'y', 2, round(s2 * u, 6), round(1 - big / (a + d), 6) FROM f""")
def pca_two_features(t):
    """Loadings and explained shares where they have a closed form."""
    m = moments(t("lineitem").selectExpr("l_quantity AS x", "l_extendedprice / 1000 AS y"), ["x", "y"])
    return rounded(P.principal_components(m).table(t.spark), 6, "loading", "explained")


@query("lda_two_features", f"""WITH t AS ({_TWO}), g AS (SELECT l_linestatus = 'O' AS cls, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS a, var_pop(y) * count(*) AS d, covar_pop(x, y) * count(*) AS b FROM t GROUP BY 1),
 w AS (SELECT sum(a) / (sum(n) - 2) AS a, sum(b) / (sum(n) - 2) AS b, sum(d) / (sum(n) - 2) AS d, sum(CASE WHEN cls THEN mx ELSE -mx END) AS p, sum(CASE WHEN cls THEN my ELSE -my END) AS q FROM g)
SELECT 'x' AS feature, round((d * p - b * q) / (a * d - b * b), 6) AS weight FROM w UNION ALL SELECT 'y', round((a * q - b * p) / (a * d - b * b), 6) FROM w""")
def lda_two_features(t):
    """Discriminant coefficients of two classes and two features."""
    rows = t("lineitem").selectExpr("l_quantity AS x", "l_extendedprice / 1000 AS y", "CAST(l_linestatus = 'O' AS INT) AS cls")
    m = moments(rows, ["x", "y"], ["cls"])
    return rounded(P.weights_table(t.spark, m.columns, P.lda_axis(m)[0]).drop("place"), 6, "weight")
