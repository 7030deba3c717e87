"""Tests of differences and association, and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import cluster
from cohortloom.operators import inference as I
from cohortloom.operators import replicates as R
from cohortloom.operators import resample as S
from cohortloom.operators.linear import oof_linear
from cohortloom.operators.suffstats import moments, vector_moments
from cohortloom.plans.registry import LINE_KEY, key_hash_sql, order_hash_sql, query, replicate_number_sql
from cohortloom.plans.summary_queries import _RANK_SQL, long_features, rounded
from cohortloom.session import local_table

PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_quantity", "l_discount")]
_PAIR_ROWS = " UNION ALL ".join(f"SELECT l_returnflag, '{x}' AS x, '{y}' AS y, {x} AS a, {y} AS b FROM lineitem" for x, y in PAIRS)


@query("pearson_test", f"""SELECT l_returnflag, x, y, count(*) AS n, round(corr(a, b), 8) AS r,
 round(corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))), 4) AS t FROM ({_PAIR_ROWS}) GROUP BY l_returnflag, x, y""")
def pearson_test(t):
    """Within-group correlations with their t (p-values come from the result table)."""
    out = I.pearson_test(t("lineitem"), PAIRS, ["l_returnflag"])
    return rounded(out.select("l_returnflag", "x", "y", "n", "r", "t"), 8, "r").withColumn("t", F.round("t", 4))


@query("regression_line", f"SELECT x, y, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 4) AS intercept FROM ({_PAIR_ROWS}) GROUP BY x, y")
def regression_line(t):
    out = I.pearson_test(t("lineitem"), PAIRS, p_values=False)
    return out.select("x", "y", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


MW_SQL = """c AS (SELECT {by}, value, count(*) AS n, count(*) FILTER ({first}) AS n1 FROM {source} GROUP BY {by}, value),
 r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY value) - n + (n + 1) / 2.0::DOUBLE AS ar FROM c),
 s AS (SELECT {by}, sum(n1)::DOUBLE AS n1, sum(n - n1)::DOUBLE AS n2, sum(n1 * ar) AS r1, sum(power(n, 3) - n) AS ties FROM r GROUP BY {by}),
 u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM s)"""


@query("mann_whitney", f"WITH {_RANK_SQL}, two AS (SELECT * FROM long WHERE g IN ('A', 'R')), " + MW_SQL.format(by="measure", first="g = 'A'", source="two") +
       " SELECT measure, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 1) AS u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd, 6) AS z FROM u")
def mann_whitney(t):
    out = I.mann_whitney(long_features(t, "l_returnflag"), "l_returnflag", "A", "R", "value", ["measure"])
    return out.select("measure", "n1", "n2", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"))


# Every way to draw the first sample is listed; the share of draws with as small or as large a statistic is the tail.
@query("mann_whitney_exact", """WITH a AS (SELECT n_regionkey AS region, c_nationkey, avg(c_acctbal) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
 l AS (SELECT r.region AS other, a.* FROM a, (SELECT unnest(range(1, 5)) AS region) r WHERE a.region IN (0, r.region)),
 k AS (SELECT other, region = 0 AS own, row_number() OVER (PARTITION BY other ORDER BY value) AS place, count(*) OVER (PARTITION BY other) AS n FROM l),
 u AS (SELECT other, count(*) FILTER (own) AS n1, count(*) FILTER (NOT own) AS n2, max(n) AS n, sum(place) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0::DOUBLE AS u FROM k GROUP BY other),
 m AS (SELECT other, n1, n2, u, mask FROM u, (SELECT unnest(range(0, 1024)) AS mask) WHERE mask < power(2, n) AND bit_count(mask::INTEGER) = n1),
 d AS (SELECT other, n1, n2, u, mask, sum(place) - n1 * (n1 + 1) / 2.0::DOUBLE AS v FROM m JOIN (SELECT unnest(range(1, 11)) AS place) ON (mask >> (place - 1)::INTEGER) & 1 = 1 GROUP BY other, n1, n2, u, mask)
SELECT other::INTEGER AS other, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(least(1.0::DOUBLE, 2 * least(count(*) FILTER (v <= u), count(*) FILTER (v >= u)) / count(*)::DOUBLE), 9) AS p FROM d GROUP BY other, n1, n2, u""")
def mann_whitney_exact(t):
    """Small samples: mean balances of the nations of one region against those of each other region."""
    nation = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    a = t("customer").join(F.broadcast(nation), "c_nationkey").groupBy("region", "c_nationkey").agg(F.avg("c_acctbal").alias("value"))
    long = a.withColumn("other", F.explode(F.array(*[F.lit(r) for r in range(1, 5)]))).where("region IN (0, other)")
    return rounded(I.rank_test(long, "value", F.col("region") == 0, ["other"]).drop("z"), 9, "p")


_ANOVA_SQL = """g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY event_type),
 s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS sm, sum(n * m * m) AS smm, sum(n * v) AS w FROM g)"""


@query("anova_oneway", f"WITH {_ANOVA_SQL} SELECT (k - 1)::BIGINT AS df1, (n - k)::BIGINT AS df2, round(((smm - sm * sm / n) / (k - 1)) / (w / (n - k)), 6) AS f FROM s")
def anova_oneway(t):
    return rounded(I.anova_oneway(t("events"), "event_type", "value").drop("p"), 6, "f")


@query("ttest_pooled", """WITH s AS (SELECT count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type = 'view') AS n2, avg(value) FILTER (event_type = 'click') AS m1,
 avg(value) FILTER (event_type = 'view') AS m2, var_samp(value) FILTER (event_type = 'click') AS v1, var_samp(value) FILTER (event_type = 'view') AS v2 FROM events)
SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, n1 + n2 - 2 AS df FROM s""")
def ttest_pooled(t):
    return rounded(I.ttest_pooled(t("events"), "event_type", "click", "view", "value").drop("p"), 6, "t")


@query("tukey_pairs", f"""WITH {_ANOVA_SQL} SELECT a.event_type AS group1, b.event_type AS group2, round(b.m - a.m, 6) AS diff,
 round(abs(b.m - a.m) / sqrt(w / (s.n - k) / 2 * (1 / a.n + 1 / b.n)), 6) AS q, k, (s.n - k)::BIGINT AS df FROM g a JOIN g b ON a.event_type < b.event_type, s""")
def tukey_pairs(t):
    out = I.tukey_hsd(t("events"), "event_type", "value")
    return rounded(out.select("group1", "group2", "diff", "q", "k", "df"), 6, "diff", "q")


@query("chi2_independence", """WITH b AS (SELECT c_mktsegment AS a, coalesce(n, 0) > 9 AS b FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
 c AS (SELECT a, b, count(*) AS o FROM b GROUP BY a, b), g AS (SELECT x.a, y.b, r, k, n, coalesce(o, 0) AS o FROM (SELECT a, sum(o) AS r FROM c GROUP BY a) x,
 (SELECT b, sum(o) AS k FROM c GROUP BY b) y, (SELECT sum(o) AS n FROM c) LEFT JOIN c ON c.a = x.a AND c.b = y.b)
SELECT round(sum(power(o - r * k / n, 2) / (r * k / n)), 6) AS chi2, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::BIGINT AS dof, max(n)::BIGINT AS n FROM g""")
def chi2_independence(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    busy = t("customer").join(n, "c_custkey", "left").select("c_mktsegment", (F.coalesce("n", F.lit(0)) > 9).alias("busy"))
    return rounded(I.chi2_independence(busy, "c_mktsegment", "busy").drop("p"), 6, "chi2")


@query("chi2_two_by_two", """WITH c AS (SELECT o_orderstatus IN ('F') AS a, o_totalprice > 250000 AS b FROM orders),
 s AS (SELECT count(*) FILTER (a AND b)::DOUBLE AS n11, count(*) FILTER (a AND NOT b)::DOUBLE AS n12, count(*) FILTER (NOT a AND b)::DOUBLE AS n21, count(*) FILTER (NOT a AND NOT b)::DOUBLE AS n22 FROM c),
 e AS (SELECT *, n11 + n12 + n21 + n22 AS n, abs(n11 - (n11 + n12) * (n11 + n21) / (n11 + n12 + n21 + n22)) AS gap FROM s)
SELECT round(power(gap - least(0.5, gap), 2) * n * n * n / ((n11 + n12) * (n21 + n22) * (n11 + n21) * (n12 + n22)), 6) AS chi2, 1::BIGINT AS dof, n::BIGINT AS n FROM e""")
def chi2_two_by_two(t):
    """Two by two, with the continuity correction."""
    c = t("orders").select((F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 250000).alias("b"))
    return rounded(I.chi2_independence(c, "a", "b").drop("p"), 6, "chi2")


@query("odds_ratio", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 250000) AS a, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 250000) AS b,
 count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 250000) AS c, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice <= 250000) AS d,
 round(a::DOUBLE * d / (b::DOUBLE * c), 6) AS odds_ratio FROM orders GROUP BY o_orderpriority""")
def odds_ratio(t):
    o = t("orders").withColumn("dear", F.col("o_totalprice") > 250000)
    out = I.two_by_two(o, "o_orderstatus", "F", "O", "dear", True, False, ["o_orderpriority"])
    return rounded(out.drop("p"), 6, "odds_ratio")


@query("manova_gram", """SELECT label, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j,
 round(sum(CAST(embedding[i] AS DOUBLE) * CAST(embedding[j] AS DOUBLE)), 5) AS g
 FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) WHERE i <= j GROUP BY label, i, j""")
def manova_gram(t):
    """Cross products of the features per group, the whole input of the multivariate tests."""
    m = vector_moments(t("embeddings"), "embedding", ["label"])
    zero = m.shift * 0
    rows = []
    for k, key in enumerate(m.keys):
        g = m.pick([k]).about(zero)[1]
        rows += [(int(key[0]), i, j, float(g[i, j])) for i in range(len(g)) for j in range(i, len(g))]
    return local_table(t.spark, rows, "label int, i int, j int, g double").withColumn("g", F.round("g", 5))


@query("manova_statistics")
def manova_statistics(t):
    """Four multivariate statistics of the group means."""
    return I.manova(vector_moments(t("embeddings"), "embedding", ["label"]), t.spark)


_SCORED_SQL = "scored AS (SELECT l.doc_id, n_chars AS score, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def scored_documents(t):
    return t("labels").join(t("documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id").select("doc_id", "score", "quality", "toxic")


@query("auc", f"""WITH {_SCORED_SQL}, c AS (SELECT score, count(*) AS n, count(*) FILTER (quality = 1) AS p FROM scored GROUP BY score),
 r AS (SELECT *, sum(n) OVER (ORDER BY score) - n + (n + 1) / 2.0::DOUBLE AS ar FROM c), s AS (SELECT sum(p)::DOUBLE AS n1, sum(n - p)::DOUBLE AS n0, sum(p * ar) AS r FROM r)
SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 8) AS auc FROM s""")
def auc(t):
    return rounded(I.auc(scored_documents(t), "score", "quality"), 8, "auc")


@query("permutation_auc", f"""WITH {_SCORED_SQL},
 ranked AS (SELECT doc_id, ar FROM (SELECT score, sum(count(*)) OVER (ORDER BY score) - count(*) + (count(*) + 1) / 2.0::DOUBLE AS ar FROM scored GROUP BY score) JOIN scored USING (score)),
 sizes AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) AS n FROM scored),
 draws AS (SELECT rep, ar, row_number() OVER (PARTITION BY rep ORDER BY {replicate_number_sql('doc_id', 42)}, doc_id) AS i FROM ranked, (SELECT unnest(range(0, 1000)) AS rep))
SELECT rep::INTEGER AS rep, round((sum(ar) FILTER (i <= n1) - n1 * (n1 + 1) / 2) / (n1::DOUBLE * (n - n1)), 8) AS auc FROM draws, sizes GROUP BY rep, n1, n""")
def permutation_auc(t):
    """A thousand label shuffles."""
    return rounded(I.permuted_auc(scored_documents(t), "doc_id", "score", "quality", 1000), 8, "auc")


@query("logit_inference")
def logit_inference(t):
    d = scored_documents(t).withColumn("log_chars", F.log1p("score"))
    return cluster.logit_inference(d, "quality", ["toxic", "log_chars"])


# ---------------------------------------------------------------- resampling


@query("assign_folds", f"SELECT o_orderkey, CAST({key_hash_sql('o_orderkey', 42)} % 10 AS INTEGER) AS fold FROM orders")
def assign_folds(t):
    return S.assign_folds(t("orders").select("o_orderkey"), "o_orderkey", 10)


@query("stratified_split", f"""SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {order_hash_sql('doc_id', "'42'")}) <= floor(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE + 0.5) AS is_test FROM labels""")
def stratified_split(t):
    return S.stratified_split(t("labels").select("doc_id", "quality"), "quality", "doc_id")


@query("stratified_folds", f"""SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {order_hash_sql('doc_id', "'42'")}) - 1) % 5 AS INTEGER) AS fold FROM labels""")
def stratified_folds(t):
    return S.assign_folds_stratified(t("labels").select("doc_id", "quality"), "quality", "doc_id", 5)


def bootstrap_sql(replicates: int, columns: str, source: str = "lineitem") -> str:
    """Rows x replicates with their weight."""
    weight = " + ".join(f"CAST(x >= {cut} AS INTEGER)" for cut in S.POISSON_CUTS)
    return f"""(SELECT *, {weight} AS w FROM (SELECT {columns}, rep, ({replicate_number_sql(LINE_KEY, 42)}) AS x
 FROM {source}, (SELECT unnest(range(0, {replicates})) AS rep)) WHERE x >= {S.POISSON_CUTS[0]})"""


@query("bootstrap_means", f"""SELECT rep::INTEGER AS rep, sum(w)::BIGINT AS n, round(sum(w * l_quantity) / sum(w), 6) AS l_quantity, round(sum(w * l_extendedprice) / sum(w), 4) AS l_extendedprice
 FROM {bootstrap_sql(100, 'l_quantity, l_extendedprice')} GROUP BY rep""")
def bootstrap_means(t):
    b = R.bootstrap_means(t("lineitem"), F.expr(LINE_KEY), ["l_quantity", "l_extendedprice"], 100)
    return rounded(b, 6, "l_quantity").withColumn("l_extendedprice", F.round("l_extendedprice", 4))


FOLD_SQL = f"SELECT *, CAST({key_hash_sql(LINE_KEY, 42)} % 10 AS INTEGER) AS fold FROM lineitem"


def folded_lines(t, k: int = 10):
    return S.assign_folds(t("lineitem"), F.expr(LINE_KEY), k)


@query("oof_predictions", f"""WITH f AS ({FOLD_SQL}), ks AS (SELECT DISTINCT fold AS k FROM f),
 m AS (SELECT k, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM f JOIN ks ON k <> fold GROUP BY k),
 s AS (SELECT ks.k, avg(a) AS sa, avg(b) AS sb FROM ks JOIN m ON m.k <> ks.k GROUP BY ks.k)
SELECT l_orderkey, l_linenumber, l_partkey, fold, round(a + b * l_quantity, 4) AS val_prediction, round(sa + sb * l_quantity, 4) AS train_prediction
 FROM f JOIN m ON m.k = fold JOIN s ON s.k = fold""")
def oof_predictions(t):
    out = oof_linear(folded_lines(t), ["l_quantity"], "l_extendedprice", "fold")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "fold", "val_prediction", "train_prediction"), 4, "val_prediction", "train_prediction")


@query("regression_metrics", """SELECT l_returnflag, count(*) AS n, round(1 - sum(power(l_extendedprice - 1500 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 8) AS r2,
 round(sum(power(l_extendedprice - 1500 * l_quantity, 2)) / count(*), 2) AS mse FROM lineitem GROUP BY l_returnflag""")
def regression_metrics(t):
    p = t("lineitem").select("l_returnflag", "l_extendedprice", (1500 * F.col("l_quantity")).alias("prediction"))
    return rounded(S.regression_metrics(p, "l_extendedprice", "prediction", ["l_returnflag"]), 8, "r2").withColumn("mse", F.round("mse", 2))


@query("holdout_by_group", """SELECT 'train' AS part, l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_returnflag IN ('A', 'N')
UNION ALL SELECT 'test', l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_returnflag = 'R'""")
def holdout_by_group(t):
    """Rows without a target go; one class is kept away from training."""
    src = t("lineitem").selectExpr("l_orderkey", "l_partkey", "l_returnflag", "CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS l_quantity")
    train, test = S.holdout_by_group(src, "l_quantity", "l_returnflag", ["A", "N"], ["R"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).drop("l_returnflag")


@query("manova_two_features", """WITH g AS (SELECT count(*) * var_pop(l_quantity) AS a, count(*) * var_pop(l_discount) AS d, count(*) * covar_pop(l_quantity, l_discount) AS b FROM lineitem GROUP BY l_returnflag),
 e AS (SELECT sum(a) AS a, sum(b) AS b, sum(d) AS d FROM g), t AS (SELECT count(*) * var_pop(l_quantity) AS ta, count(*) * var_pop(l_discount) AS td, count(*) * covar_pop(l_quantity, l_discount) AS tb FROM lineitem)
SELECT 'wilks' AS statistic, round((a * d - b * b) / (ta * td - tb * tb), 8) AS value FROM e, t UNION ALL SELECT 'pillai', round(2 - (a * td - 2 * b * tb + d * ta) / (ta * td - tb * tb), 8) FROM e, t""")
def manova_two_features(t):
    """Wilks and Pillai where they have a closed form."""
    out = I.manova(moments(t("lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"]), t.spark)
    return out.where("statistic IN ('wilks', 'pillai')").select("statistic", F.round("value", 8).alias("value"))


@query("logit_binary_term", """WITH c AS (SELECT count(*) FILTER (o_totalprice > 150000 AND o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (o_totalprice > 150000 AND o_orderstatus <> 'F')::DOUBLE AS b,
 count(*) FILTER (o_totalprice <= 150000 AND o_orderstatus = 'F')::DOUBLE AS c, count(*) FILTER (o_totalprice <= 150000 AND o_orderstatus <> 'F')::DOUBLE AS d FROM orders)
SELECT 'large' AS term, round(ln(a * d / (b * c)), 5) AS coef, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5) AS se FROM c UNION ALL SELECT 'intercept', round(ln(c / d), 5), round(sqrt(1 / c + 1 / d), 5) FROM c""")
def logit_binary_term(t):
    """One binary term: the log odds ratio and its standard error."""
    o = t("orders").selectExpr("CAST(o_orderstatus = 'F' AS INT) AS done", "CAST(o_totalprice > 150000 AS INT) AS large")
    return cluster.logit_inference(o, "done", ["large"]).select("term", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"))
