"""Summary tables, ranks and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import describe as D
from cohortloom.operators import ranks
from cohortloom.plans.registry import FEATURES, query
from cohortloom.plans.scan_queries import LISTS_SQL, members


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_MEMBERS_SQL = f"""{LISTS_SQL}, m AS (SELECT membership, c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance,
 CAST(c_nationkey AS DOUBLE) AS nation, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS grp FROM customer JOIN lists ON k = c_custkey),
 long AS (SELECT membership, grp, 'balance' AS "column", balance AS value FROM m UNION ALL SELECT membership, grp, 'nation', nation FROM m)"""


def member_values(t):
    return members(t).selectExpr("membership", "c_mktsegment", "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance",
                                 "CAST(c_nationkey AS DOUBLE) AS nation", "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS grp")


_STATS_SQL = """round(avg(value), 4) AS mean, max(value) AS max, min(value) AS min, round(stddev_samp(value), 4) AS std,
 count(value) AS count, count(*) FILTER (value IS NULL) AS n_missing"""


@query("describe_by_membership", f'WITH {_MEMBERS_SQL} SELECT membership, "column", {_STATS_SQL} FROM long GROUP BY membership, "column"')
def describe_by_membership(t):
    return rounded(D.describe_by_membership(member_values(t), ["balance", "nation"]), 4, "mean", "std")


@query("describe_grouping_sets", f"""WITH {_MEMBERS_SQL} SELECT membership, "column", NULL AS grp, {_STATS_SQL}, 'all' AS level FROM long GROUP BY membership, "column"
UNION ALL SELECT membership, "column", grp, {_STATS_SQL}, 'group' FROM long WHERE grp IS NOT NULL GROUP BY membership, "column", grp""")
def describe_grouping_sets(t):
    return rounded(D.describe_by_membership(member_values(t), ["balance", "nation"], "grp"), 4, "mean", "std")


@query("count_by_membership", f"""WITH {_MEMBERS_SQL} SELECT membership, 'grp' AS "column", grp AS value, count(*) AS n FROM m GROUP BY membership, grp
UNION ALL SELECT membership, 'c_mktsegment', c_mktsegment, count(*) FROM m GROUP BY membership, c_mktsegment""")
def count_by_membership(t):
    """Category columns: counts per membership, missing included."""
    return D.count_by_membership(member_values(t), ["grp", "c_mktsegment"])


@query("cluster_profile", """SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, count(*) AS n
 FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i""")
def cluster_profile(t):
    return rounded(D.vector_group_means(t("embeddings"), "label", "embedding"), 6, "mean")


@query("group_means", "SELECT l_returnflag, " + ", ".join(f"round(avg({f}), 4) AS {f}" for f in FEATURES) + ", count(*) AS n FROM lineitem GROUP BY l_returnflag")
def group_means(t):
    return rounded(D.group_means(t("lineitem"), "l_returnflag", FEATURES), 4, *FEATURES)


@query("value_counts", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 6 <> 0 THEN event_type END AS kind FROM events) GROUP BY kind")
def value_counts(t):
    return D.value_counts(t("events").selectExpr("CASE WHEN event_id % 6 <> 0 THEN event_type END AS kind"), "kind")


@query("composition", """SELECT n_name, c_mktsegment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY n_name), 4) AS share
 FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, c_mktsegment""")
def composition(t):
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(D.composition(named, "n_name", "c_mktsegment", 100.0), 4, "share")


_COHORT_SQL = """base AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS grp, c_acctbal, c_nationkey,
 CASE WHEN c_custkey % 2 = 0 THEN 'Male' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Female' END AS sex, coalesce(n, 0) AS orders
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey),
 kept AS (SELECT * FROM base WHERE grp IS NOT NULL AND grp <> 'FURNITURE')"""


@query("cohort_table", f"""WITH {_COHORT_SQL}
SELECT 'total' AS section, 'N' AS row, grp AS "group", count(*) AS n, NULL::DOUBLE AS value, NULL::DOUBLE AS spread FROM kept GROUP BY grp
UNION ALL SELECT 'share', 'sex (Male)', grp, count(*) FILTER (sex = 'Male'), round(100.0 * count(*) FILTER (sex = 'Male') / count(*), 1), NULL FROM kept WHERE sex IS NOT NULL GROUP BY grp
UNION ALL SELECT 'sex', sex, grp, count(*), NULL, NULL FROM kept WHERE sex IS NOT NULL GROUP BY grp, sex
UNION ALL SELECT 'continuous', 'c_acctbal', grp, count(c_acctbal), round(avg(c_acctbal), 2), round(stddev_samp(c_acctbal), 2) FROM kept GROUP BY grp
UNION ALL SELECT 'continuous', 'orders', grp, count(orders), round(avg(orders), 2), round(stddev_samp(orders), 2) FROM kept GROUP BY grp""")
def cohort_table(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    base = t("customer").join(n, "c_custkey", "left").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS grp", "c_acctbal", "coalesce(orders, 0) AS orders",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Male' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Female' END AS sex")
    return D.cohort_table(base, "grp", ["FURNITURE"], ("sex", "Male"), ["sex"], ["c_acctbal", "orders"]).drop("label")


_HOLES = "CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS l_quantity"


@query("mean_ci95", f"""SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS ci95
 FROM (SELECT l_returnflag, {_HOLES} FROM lineitem) GROUP BY l_returnflag""")
def mean_ci95(t):
    return rounded(D.mean_ci95(t("lineitem").selectExpr("l_returnflag", _HOLES), ["l_returnflag"], "l_quantity"), 6, "mean", "ci95")


@query("group_median", """SELECT l_returnflag || l_linestatus AS site, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1""")
def group_median(t):
    sited = t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("site"), "l_extendedprice")
    return rounded(ranks.exact_median(sited, ["site"], "l_extendedprice"), 4, "median")


_LUMPY = "CASE WHEN l_orderkey % 10 < 8 THEN 7.5 WHEN l_orderkey % 10 = 8 THEN -l_extendedprice * 1000000000.0 ELSE l_extendedprice / 1000.0 END"


@query("group_median_lumpy", f"""SELECT l_returnflag, round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.95), 4) AS p95
 FROM (SELECT l_returnflag, CAST({_LUMPY} AS DOUBLE) AS x FROM lineitem) GROUP BY l_returnflag""")
def group_median_lumpy(t):
    """Quantiles where most rows have one value and the others lie far out."""
    x = t("lineitem").select("l_returnflag", F.expr(f"CAST({_LUMPY} AS DOUBLE)").alias("x"))
    return rounded(ranks.exact_quantiles(x, ["l_returnflag"], "x", {"p05": 0.05, "median": 0.5, "p95": 0.95}), 4, "p05", "median", "p95")


@query("percentile_bounds", """SELECT l_returnflag, round(quantile_cont(v, 0.05), 4) AS lower, round(quantile_cont(v, 0.025), 4) AS ci_low, round(quantile_cont(v, 0.975), 4) AS ci_high,
 quantile_cont(v, 0.05) > 0 AS above_zero, 0.05::DOUBLE AS alpha FROM (SELECT l_returnflag, l_extendedprice - 9000 * l_tax AS v FROM lineitem) GROUP BY l_returnflag""")
def percentile_bounds(t):
    v = t("lineitem").select("l_returnflag", (F.col("l_extendedprice") - 9000 * F.col("l_tax")).alias("v"))
    return rounded(D.percentile_bounds(v, "v", by=["l_returnflag"]), 4, "lower", "ci_low", "ci_high")


_HOLES_SQL = f"WITH holes AS (SELECT {_HOLES}, l_extendedprice, l_discount, l_tax FROM lineitem) "


@query("corr_matrix", _HOLES_SQL + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM holes"
    for a in FEATURES for b in FEATURES))
def corr_matrix(t):
    holes = t("lineitem").selectExpr(_HOLES, "l_extendedprice", "l_discount", "l_tax")
    return rounded(D.corr_matrix(holes, FEATURES), 6, "r")


@query("paired_corr", """WITH g AS (SELECT l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
SELECT l_suppkey, 'l_quantity' AS x, 'l_discount' AS y, count(*) AS n, round(CASE WHEN count(*) >= 580 THEN corr(l_quantity, l_discount) END, 6) AS r FROM g GROUP BY l_suppkey
UNION ALL SELECT l_suppkey, 'l_quantity', 'l_tax', count(*), round(CASE WHEN count(*) >= 580 THEN corr(l_quantity, l_tax) END, 6) FROM g GROUP BY l_suppkey
UNION ALL SELECT l_suppkey, 'l_extendedprice', 'l_discount', count(*), round(CASE WHEN count(*) >= 580 THEN corr(l_extendedprice, l_discount) END, 6) FROM g GROUP BY l_suppkey
UNION ALL SELECT l_suppkey, 'l_extendedprice', 'l_tax', count(*), round(CASE WHEN count(*) >= 580 THEN corr(l_extendedprice, l_tax) END, 6) FROM g GROUP BY l_suppkey""")
def paired_corr(t):
    """All left x right pairs per supplier; missing where the supplier has too few rows."""
    pairs = [(a, b) for a in ("l_quantity", "l_extendedprice") for b in ("l_discount", "l_tax")]
    return rounded(D.corr_pairs(t("lineitem"), pairs, 580, ["l_suppkey"]), 6, "r")


@query("feature_summary", """SELECT CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(embedding[i] AS DOUBLE)), 6) AS std, count(*) AS n
 FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i""")
def feature_summary(t):
    return rounded(D.vector_feature_summary(t("embeddings"), "embedding"), 6, "mean", "std")


@query("histogram_equal_width", f"""WITH long AS (SELECT 'l_quantity' AS "column", l_quantity AS value FROM (SELECT {_HOLES} FROM lineitem) UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
 ranges AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM long GROUP BY "column"),
 b AS (SELECT long."column", value, lo, (hi - lo) / 10 AS w, CAST(CASE WHEN value IS NULL THEN -1 ELSE least(floor((value - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin FROM long JOIN ranges ON ranges."column" = long."column")
SELECT "column", bin, CASE WHEN bin >= 0 THEN round(lo + bin * w, 6) END AS low, CASE WHEN bin >= 0 THEN round(lo + (bin + 1) * w, 6) END AS high, count(*) AS n FROM b GROUP BY "column", bin, lo, w""")
def histogram_equal_width(t):
    h = D.histogram(t("lineitem").selectExpr(_HOLES, "l_extendedprice"), ["l_quantity", "l_extendedprice"], 10)
    return rounded(h.drop("density"), 6, "low", "high")


@query("histogram_shared_bins", """WITH long AS (SELECT event_type, 'value' AS "column", value FROM events UNION ALL SELECT event_type, 'double', 2 * value FROM events),
 r AS (SELECT min(value) AS lo, max(value) AS hi FROM long),
 b AS (SELECT event_type, "column", lo, (hi - lo) / 30 AS w, CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin FROM long, r)
SELECT event_type, "column", bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type, "column") * w), 6) AS density FROM b GROUP BY event_type, "column", bin, w""")
def histogram_shared_bins(t):
    """Thirty equal bins over one range shared by all measures and groups."""
    e = t("events").select("event_type", "value", (2 * F.col("value")).alias("double"))
    return rounded(D.histogram(e, ["value", "double"], 30, shared_range=True, by=["event_type"]).drop("low", "high"), 6, "density")


@query("box_stats", """SELECT event_type, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
 round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events GROUP BY event_type""")
def box_stats(t):
    return rounded(D.box_stats(t("events"), "value", ["event_type"]), 6, "q1", "median", "q3")


@query("best_config", """WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS i FROM s) WHERE i = 1""")
def best_config(t):
    s = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return D.best_row(s, "n", ["user_id"], by=["event_type"])


# ---------------------------------------------------------------- ranks, order, top lists

_RANK_SQL = """long AS (SELECT l_returnflag AS g, 'l_quantity' AS measure, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem
 UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem)"""


def long_features(t, *ids):
    return t("lineitem").select(*ids, *FEATURES).unpivot(list(ids), FEATURES, "measure", "value")


@query("avg_rank", f"""WITH {_RANK_SQL}, c AS (SELECT measure, value, count(*) AS n FROM long GROUP BY measure, value)
SELECT measure, value, n, sum(n) OVER (PARTITION BY measure ORDER BY value) - n + (n + 1) / 2.0::DOUBLE AS avg_rank FROM c""")
def avg_rank(t):
    return ranks.avg_rank(long_features(t), ["measure"], "value").select("measure", "value", "n", "avg_rank")


@query("fdr_bh", """WITH p AS (SELECT user_id, event_type, 1 / (1 + avg(value)) AS p FROM events GROUP BY 1, 2),
 r AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / rank_hi AS raw FROM (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY p) AS rank_hi FROM p)),
 f AS (SELECT user_id, event_type, p, least(1.0, min(raw) OVER (PARTITION BY event_type ORDER BY p DESC)) AS p_fdr FROM r)
SELECT user_id, event_type, round(p, 8) AS p, round(p_fdr, 8) AS p_fdr, p_fdr < 0.05 AS significant FROM f""")
def fdr_bh(t):
    """Adjusted p-values within each family of tests (one test per user and event type)."""
    p = t("events").groupBy("user_id", "event_type").agg((1 / (1 + F.avg("value"))).alias("p"))
    return rounded(ranks.fdr_bh(p, "p", ["event_type"]), 8, "p", "p_fdr")


@query("sort_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")
def sort_abs(t):
    return ranks.sort_abs(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return ranks.top_k(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("top_k_per_group", """SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i <= 5""")
def top_k_per_group(t):
    o = t("orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ranks.top_k_per_group(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
