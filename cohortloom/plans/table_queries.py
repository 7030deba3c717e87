"""Filters, joins, set operations, duplicates and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import align, pls_da, rows
from cohortloom.operators import reshape as R
from cohortloom.operators.normative import normative_z
from cohortloom.plans.registry import FEATURES, key_hash_sql, query
from cohortloom.plans.scan_queries import CLEAN_CUSTOMER, LISTS_SQL, clean_customer, order_lists

# ---------------------------------------------------------------- filters and sampling


@query("filter_basic", f"""SELECT c_custkey, segment FROM ({CLEAN_CUSTOMER}) c WHERE segment IS DISTINCT FROM 'BUILDING'
 AND c_nationkey IN (1, 2, 3, 5, 8, 13) AND balance IS NOT NULL""")
def filter_basic(t):
    """A missing segment counts as different from BUILDING."""
    c = clean_customer(t)
    kept = c.where(rows.not_equal("segment", "BUILDING") & F.col("c_nationkey").isin(1, 2, 3, 5, 8, 13) & F.col("balance").isNotNull())
    return kept.select("c_custkey", "segment")


@query("drop_rows_any_contains", "SELECT p_partkey, p_size FROM part WHERE NOT (contains(p_type, 'SMALL') OR contains(p_type, 'PROMO') OR contains(p_name, 'SMALL') OR contains(p_name, 'PROMO') OR contains(p_name, 'red') OR contains(p_type, 'red'))")
def drop_rows_any_contains(t):
    return rows.drop_rows_any_contains(t("part").select("p_partkey", "p_size", "p_type", "p_name"), ["p_type", "p_name"], ["SMALL", "PROMO", "red"])


_ORDER_STATS = "SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey"
_WIDE_SQL = f"""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, CASE WHEN n_orders > 8 THEN n_orders END AS n_orders,
 CASE WHEN spent > 2000000 THEN round(spent, 2) END AS spent FROM customer LEFT JOIN ({_ORDER_STATS}) o ON o_custkey = c_custkey"""


def order_stats(t):
    return t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))


def wide_customer(t):
    w = align.lookup(t("customer").select("c_custkey", "c_acctbal"), order_stats(t), "c_custkey")
    return w.selectExpr("c_custkey", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance", "CASE WHEN n_orders > 8 THEN n_orders END AS n_orders",
                        "CASE WHEN spent > 2000000 THEN round(spent, 2) END AS spent")


@query("drop_rows_all_missing", f"SELECT * FROM ({_WIDE_SQL}) w WHERE balance IS NOT NULL OR n_orders IS NOT NULL OR spent IS NOT NULL")
def drop_rows_all_missing(t):
    return rows.drop_rows_all_missing(wide_customer(t), ["balance", "n_orders", "spent"])


@query("complete_cases", f"SELECT * FROM ({_WIDE_SQL}) w WHERE balance IS NOT NULL AND n_orders IS NOT NULL AND spent IS NOT NULL")
def complete_cases(t):
    return rows.complete_cases(wide_customer(t), ["balance", "n_orders", "spent"])


@query("hash_sample", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {key_hash_sql('o_orderkey', 42)} / 268435456.0 < 0.1")
def hash_sample(t):
    """The sampling operator: about one row in ten, the same ones every time."""
    return rows.sample_rows(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.1)


_NORM_SQL = """ref AS (SELECT feature, regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a,
  sqrt((1 - power(corr(y, l_quantity), 2)) * var_pop(y)) AS s FROM long WHERE l_returnflag = 'N' GROUP BY feature),
 z AS (SELECT feature, l_returnflag, (y - (a + b * l_quantity)) / s AS z FROM long JOIN ref USING (feature) WHERE l_returnflag <> 'N')"""
_LONG_SQL = """long AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, 'l_extendedprice' AS feature, l_extendedprice AS y FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, 'l_discount', l_discount FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, 'l_tax', l_tax FROM lineitem)"""


@query("count_extreme_z", f"WITH {_LONG_SQL}, {_NORM_SQL} SELECT feature || '_z' AS feature, count(*) FILTER (abs(z) > 1.5) AS n_extreme FROM z GROUP BY feature")
def count_extreme_z(t):
    names = ["l_extendedprice", "l_discount", "l_tax"]
    z = normative_z(t("lineitem"), "l_returnflag", ["N"], ["A", "R"], names, ["l_quantity"], ["l_returnflag"])
    return rows.count_extreme(z, [f"{n}_z" for n in names], 1.5)


@query("extreme_groups", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS lo, quantile_cont(l_extendedprice, 0.75) AS hi FROM lineitem)
SELECT l_orderkey, l_partkey, CAST(l_extendedprice > hi AS INTEGER) AS high, CASE WHEN l_extendedprice >= hi THEN 'High' ELSE 'Low' END AS label
 FROM lineitem, q WHERE l_extendedprice <= lo OR l_extendedprice >= hi""")
def extreme_groups(t):
    """Rows at or beyond the quartiles; ``high`` is strict, the label is not."""
    marked = pls_da.extreme_groups(t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), "l_extendedprice")
    return marked.select("l_orderkey", "l_partkey", "high", "label")


# ---------------------------------------------------------------- joins


@query("align_sources", """WITH o AS (SELECT o_custkey AS k, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1),
 e AS (SELECT user_id AS k, count(*) AS n_events, round(max(value), 4) AS top_value FROM events GROUP BY 1)
SELECT subject, c_acctbal, n_orders, spent, n_events, top_value FROM (
 SELECT coalesce(c_custkey, o.k, e.k) AS subject, c_acctbal, n_orders, spent, n_events, top_value FROM customer
 FULL OUTER JOIN o ON o.k = c_custkey FULL OUTER JOIN e ON e.k = coalesce(c_custkey, o.k))""")
def align_sources(t):
    c = t("customer").select(F.col("c_custkey").alias("subject"), "c_acctbal")
    o = t("orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    e = t("events").groupBy(F.col("user_id").alias("subject")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.max("value"), 4).alias("top_value"))
    return align.align_sources([c, o, e], "subject")


@query("left_lookup", "SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_lookup(t):
    return align.lookup(t("documents").select("doc_id", "lang", "source"), t("labels"), "doc_id")


@query("inner_join", "SELECT d.doc_id, lang, n_chars, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def inner_join(t):
    return align.keyed_join(t("documents").select("doc_id", "lang", "n_chars"), t("labels").select("doc_id", "quality"), "doc_id", "inner")


@query("membership_flags", f"""WITH {LISTS_SQL} SELECT c_custkey, max(CASE WHEN membership = 'urgent' THEN k END) AS urgent,
 max(CASE WHEN membership = 'large' THEN k END) AS large, max(CASE WHEN membership = 'open' THEN k END) AS open FROM customer LEFT JOIN lists ON k = c_custkey GROUP BY c_custkey""")
def membership_flags(t):
    return align.membership_flags(t("customer").select("c_custkey"), order_lists(t), "c_custkey")


@query("anti_join", "SELECT c_custkey, c_mktsegment FROM customer EXCEPT ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def anti_join(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    big = t("orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return align.removed_rows(c, align.restrict_to(c, big, "c_custkey"))


@query("overlay", """SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, s_acctbal) AS balance,
 coalesce(c_nationkey, s_nationkey) AS nation, CAST((CASE WHEN (c_custkey IS NULL OR c_custkey % 3 = 0) AND s_acctbal IS NOT NULL THEN 1 ELSE 0 END) +
 (CASE WHEN c_nationkey IS NULL AND s_nationkey IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS n_filled
 FROM customer FULL OUTER JOIN supplier ON s_suppkey = c_custkey""")
def overlay(t):
    c = t("customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance", "c_nationkey AS nation")
    s = t("supplier").selectExpr("s_suppkey AS id", "s_acctbal", "s_nationkey")
    done = align.overlay(c, s, "id", {"balance": "s_acctbal", "nation": "s_nationkey"})
    return done.select("id", "balance", "nation", F.size("filled").alias("n_filled"))


@query("semi_join", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(t):
    ids = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return align.restrict_to(t("customer").select("c_custkey", "c_name", "c_acctbal"), ids, "c_custkey")


@query("pairwise_groups", """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY event_type)
SELECT a.event_type AS group1, b.event_type AS group2, round(b.m - a.m, 6) AS diff, a.n AS n_1, b.n AS n_2 FROM g a JOIN g b ON a.event_type < b.event_type""")
def pairwise_groups(t):
    g = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).withColumn("measure", F.lit("value"))
    p = align.pairs_of_groups(g, "event_type", ["measure"], ["n", "mean"])
    return p.select("group1", "group2", F.round(F.col("mean_2") - F.col("mean_1"), 6).alias("diff"), "n_1", "n_2")


# ---------------------------------------------------------------- sets and duplicates


@query("union_rows", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def union_rows(t):
    c = t("customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment")
    return rows.stack([c, t("supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance", "s_name AS name")])


@query("distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(t):
    return rows.distinct_rows(t("events").select("user_id", "event_type"))


@query("duplicate_keys", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_different FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(t):
    return rows.duplicate_keys(t("orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), "o_custkey")


@query("key_intersect", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def key_intersect(t):
    return rows.key_intersection(t("customer").selectExpr("c_custkey AS id"), t("orders").where("o_totalprice > 300000").selectExpr("o_custkey AS id"))


@query("key_union", "SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 490000")
def key_union(t):
    return rows.key_union(t("customer").where("c_nationkey < 5").selectExpr("c_custkey AS id"), t("orders").where("o_totalprice > 490000").selectExpr("o_custkey AS id"))


# Copies of a user's record: the type column agrees only for some users, the fixed column always, the flag is often missing.
_COPIES = ("user_id", "CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'same' END AS kind", "CASE WHEN event_id % 3 = 0 THEN user_id * 10 END AS fixed")


@query("reconcile_duplicates", f"""SELECT user_id, CASE WHEN min(kind) = max(kind) THEN min(kind) END AS kind, min(fixed) AS fixed
 FROM (SELECT {', '.join(_COPIES)} FROM events) GROUP BY user_id""")
def reconcile_duplicates(t):
    return rows.reconcile_duplicates(t("events").selectExpr(*_COPIES), "user_id", strict=False)


@query("duplicate_conflicts", f"""WITH c AS (SELECT {', '.join(_COPIES)} FROM events), bad AS (SELECT user_id FROM c GROUP BY user_id HAVING min(kind) <> max(kind))
SELECT user_id, 'kind' AS "column", kind AS value, count(*) AS n FROM c JOIN bad USING (user_id) GROUP BY user_id, kind""")
def duplicate_conflicts(t):
    return rows.duplicate_conflicts(t("events").selectExpr(*_COPIES), "user_id")


# ---------------------------------------------------------------- reshape

_KINDS = ["click", "error", "login", "purchase", "view"]


@query("widen_visits", "SELECT user_id, " + ", ".join(f"max(v) FILTER (event_type = '{k}') AS value_{k}" for k in _KINDS) +
       " FROM (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def widen_visits(t):
    means = t("events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("value_VQC"))
    return R.widen_visits(means, "user_id", "event_type", ["value", "value_VQC"], _KINDS, drop_parts=["VQC"])


@query("lengthen", " UNION ALL ".join(f"SELECT l_orderkey, l_partkey, '{f}' AS measure, {f} AS value FROM lineitem" for f in FEATURES))
def lengthen(t):
    return R.lengthen(t("lineitem").select("l_orderkey", "l_partkey", *FEATURES), ["l_orderkey", "l_partkey"], FEATURES)


@query("crosstab", "SELECT n_name, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in
       ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def crosstab(t):
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.crosstab(named, "n_name", "c_mktsegment")


@query("category_grid", """WITH g AS (SELECT DISTINCT o_custkey FROM orders), p AS (SELECT DISTINCT o_orderpriority FROM orders),
 c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, coalesce(n, 0) AS n FROM g CROSS JOIN p LEFT JOIN c USING (o_custkey, o_orderpriority)""")
def category_grid(t):
    """Counts for all categories of a customer, zeros included."""
    return R.category_grid(t("orders"), "o_custkey", "o_orderpriority")
