"""Scalar cleaning, recoding, dates and arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import cleaning as K
from cohortloom.operators import reshape
from cohortloom.plans.registry import FEATURES, RAW_BALANCE, query
from cohortloom.plans.scan_queries import CLEAN_CUSTOMER, RAW_CUSTOMER, clean_customer, raw_customer


@query("null_sentinels", CLEAN_CUSTOMER)
def null_sentinels(t):
    return clean_customer(t)


@query("coerce_numeric", f"""SELECT c_custkey, CASE WHEN isnan(TRY_CAST(balance AS DOUBLE)) THEN NULL ELSE TRY_CAST(balance AS DOUBLE) END AS balance,
 segment, c_nationkey FROM ({RAW_CUSTOMER}) r""")
def coerce_numeric(t):
    return K.coerce_numeric(raw_customer(t), keep=["segment"])


@query("merge_twin_columns", """SELECT c_custkey, c_name AS "VSA-CVD alone",
 coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_acctbal AS VARCHAR) END, CASE WHEN c_custkey % 2 <> 0 THEN CAST(c_nationkey AS VARCHAR) END) AS "VSD-All score"
 FROM customer""")
def merge_twin_columns(t):
    raw = t("customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE CAST(c_acctbal AS STRING) END AS `VSA score`",
        "CASE WHEN c_custkey % 2 = 0 THEN 'nan' ELSE CAST(c_nationkey AS STRING) END AS `VSA-CVD score`", "c_name AS `VSA-CVD alone`")
    return K.merge_twin_columns(raw)


_OPTIONAL = ("CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS a", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS b",
             "CASE WHEN o_orderkey % 5 = 0 THEN 'late' END AS c")


@query("coalesce_columns", f"SELECT o_orderkey, coalesce(a, b, c) AS merged FROM (SELECT o_orderkey, {', '.join(_OPTIONAL)} FROM orders)")
def coalesce_columns(t):
    return K.coalesce_columns(t("orders").selectExpr("o_orderkey", *_OPTIONAL), {"merged": ["a", "b", "c"]})


_COPIES = ("CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS s1", "CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS s2",
           "CASE WHEN l_suppkey % 5 = 0 THEN 'A' END AS s3")


@query("row_consensus", f"""SELECT l_orderkey, l_linenumber, l_partkey,
 CASE WHEN len(list_distinct([s1, s2, s3])) = 1 THEN coalesce(s1, s2, s3) END AS agreed
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(_COPIES)} FROM lineitem)""")
def row_consensus(t):
    raw = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", *_COPIES)
    return raw.select("l_orderkey", "l_linenumber", "l_partkey", K.consensus("s1", "s2", "s3").alias("agreed"))


_CODE = "CASE WHEN l_partkey % 4 = 0 THEN 'text' WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS code"


@query("invalidate_by_code", f"""SELECT l_orderkey, l_partkey, CASE WHEN TRY_CAST(code AS DOUBLE) = 3 THEN NULL ELSE l_quantity END AS score
 FROM (SELECT l_orderkey, l_partkey, l_quantity, {_CODE} FROM lineitem)""")
def invalidate_by_code(t):
    raw = t("lineitem").selectExpr("l_orderkey", "l_partkey", "l_quantity", _CODE)
    return raw.select("l_orderkey", "l_partkey", K.invalidate("l_quantity", "code").alias("score"))


@query("label_from_text", """SELECT p_partkey, CASE WHEN contains(p_type, 'M') THEN 'has M' WHEN contains(p_type, 'AR') THEN 'has AR' END AS label FROM part""")
def label_from_text(t):
    return t("part").select("p_partkey", K.label_from_text("p_type", [("M", "has M"), ("AR", "has AR")]).alias("label"))


@query("route_value", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN CAST(o_custkey AS DOUBLE) END AS x_score,
 CASE o_orderstatus WHEN 'O' THEN o_totalprice WHEN 'F' THEN CAST(o_custkey AS DOUBLE) END AS y_score FROM orders""")
def route_value(t):
    o = t("orders").withColumn("second", F.col("o_custkey").cast("double"))
    x, y = K.route_value("o_orderstatus", "o_totalprice", "second", "F", "O")
    return o.select("o_orderkey", x.alias("x_score"), y.alias("y_score"))


@query("age_months", """SELECT l_orderkey, l_linenumber, l_partkey,
 round(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 30.44, 6) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def age_months(t):
    """Dates go through the short text form of the raw files and back."""
    born = t("orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yy").alias("born"))
    seen = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "M/d/yy").alias("seen"))
    both = seen.join(born, F.col("l_orderkey") == F.col("o_orderkey"))
    months = K.months_between_days(K.parse_short_date("born"), K.parse_short_date("seen"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", F.round(months, 6).alias("months"))


@query("cross_label", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'U+' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'U-'
 WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'L+' WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'L-' END AS label FROM orders""")
def cross_label(t):
    table = {("1-URGENT", "F"): "U+", ("1-URGENT", "O"): "U-", ("5-LOW", "F"): "L+", ("5-LOW", "O"): "L-"}
    return t("orders").select("o_orderkey", K.cross_label("o_orderpriority", "o_orderstatus", table).alias("label"))


@query("bin_label", """SELECT p_partkey, CASE WHEN p_size < 12 THEN 'some_hs' WHEN p_size = 12 THEN 'high_school' WHEN p_size <= 14 THEN 'some_college'
 WHEN p_size = 16 THEN 'college_degree' WHEN p_size <= 18 THEN 'some_grad_level' WHEN p_size > 18 THEN 'grad_degree' END AS level FROM part""")
def bin_label(t):
    return t("part").select("p_partkey", K.bin_label("p_size", K.EDUCATION_RULES).alias("level"))


@query("map_codes", """SELECT s_suppkey, CASE WHEN code IS NULL THEN 'missing' ELSE coalesce(CASE code WHEN 0 THEN 'unknown_not_reported' WHEN 1 THEN 'white'
 WHEN 2 THEN 'black_african_american' WHEN 4 THEN 'asian' WHEN 8 THEN 'american_indian_alaska_native' WHEN 16 THEN 'native_hawaiian_pacific_islander'
 WHEN 32 THEN 'other' WHEN 64 THEN 'unknown_not_reported' END, 'more_than_one_race') END AS race
 FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_nationkey END AS code FROM supplier)""")
def map_codes(t):
    s = t("supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_nationkey END AS code")
    return s.select("s_suppkey", K.map_codes("code", K.RACE_CODES, "more_than_one_race", "missing").alias("race"))


@query("replace_matching", """SELECT doc_id, CASE WHEN contains(text, '@') THEN 'more_than_one' ELSE md5(text) END AS text_digest,
 CASE WHEN contains(lang, '@') THEN 'more_than_one' ELSE lang END AS lang FROM documents""")
def replace_matching(t):
    marked = K.replace_matching(t("documents").select("doc_id", "text", "lang"), "@", "more_than_one")
    digest = F.when(F.col("text") == "more_than_one", F.col("text")).otherwise(F.md5("text"))
    return marked.select("doc_id", digest.alias("text_digest"), "lang")


@query("replace_literal", f"""SELECT c_custkey, CASE WHEN raw = 'less than 25' THEN 25.0 WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS score,
 coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, 'unknown_not_reported') AS segment
 FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN 'less than 25' ELSE {RAW_BALANCE} END AS raw FROM customer)""")
def replace_literal(t):
    raw = t("customer").selectExpr("c_custkey", f"CASE WHEN c_custkey % 9 = 0 THEN 'less than 25' ELSE {RAW_BALANCE} END AS raw",
                                   "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment")
    return raw.select("c_custkey", K.replace_literal("raw", "less than 25", 25).alias("score"), K.fill_label("segment", "unknown_not_reported").alias("segment"))


@query("encode_binary", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS flag FROM orders")
def encode_binary(t):
    return t("orders").select("o_orderkey", K.encode_binary("o_orderstatus", "F", "O").alias("flag"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT c_custkey, c_mktsegment, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"Group_{s}\"" for s in _SEGMENTS) + " FROM customer")
def one_hot(t):
    return K.one_hot(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", prefix="Group")


@query("derive_prefix", "SELECT p_partkey, substr(p_type, 1, 3) AS site FROM part")
def derive_prefix(t):
    return t("part").select("p_partkey", K.derive_prefix("p_type").alias("site"))


@query("scale_by", "SELECT l_orderkey, l_partkey, round(l_quantity / 100, 8) AS l_quantity, round(l_extendedprice / 100, 8) AS l_extendedprice FROM lineitem")
def scale_by(t):
    scaled = K.scale_by(t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 100)
    return scaled.select("l_orderkey", "l_partkey", F.round("l_quantity", 8).alias("l_quantity"), F.round("l_extendedprice", 8).alias("l_extendedprice"))


@query("ratio_to", """SELECT l_orderkey, l_partkey, round(CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END, 6) AS l_quantity,
 round(CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / l_tax END, 4) AS l_extendedprice FROM lineitem""")
def ratio_to(t):
    r = K.ratio_to(t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax"), ["l_quantity", "l_extendedprice", "l_tax"], "l_tax")
    return r.select("l_orderkey", "l_partkey", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("tidy_text", """SELECT p_partkey, lower(trim(coalesce(CASE WHEN p_partkey % 4 <> 0 THEN '  ' || p_type || ' ' END, 'missing'))) AS lowered,
 upper(substr(trim(p_name), 1, 1)) || lower(substr(trim(p_name), 2)) AS capital FROM part""")
def tidy_text(t):
    raw = t("part").selectExpr("p_partkey", "CASE WHEN p_partkey % 4 <> 0 THEN concat('  ', p_type, ' ') END AS kind", "p_name")
    return raw.select("p_partkey", K.tidy_text("kind", "missing").alias("lowered"), K.tidy_text("p_name", "unknown", "capital").alias("capital"))


@query("reverse_score", "SELECT l_orderkey, l_partkey, round(max(l_quantity) OVER () - l_quantity, 6) AS l_quantity FROM lineitem")
def reverse_score(t):
    r = K.reverse_score(t("lineitem").select("l_orderkey", "l_partkey", "l_quantity"), ["l_quantity"])
    return r.withColumn("l_quantity", F.round("l_quantity", 6))


@query("availability", f"""SELECT c_custkey, CAST(balance IS NOT NULL AS INTEGER) AS balance, CAST(segment IS NOT NULL AS INTEGER) AS segment,
 CAST(c_nationkey IS NOT NULL AS INTEGER) AS c_nationkey FROM ({CLEAN_CUSTOMER}) c""")
def availability(t):
    return K.availability(clean_customer(t), ["c_custkey"])


@query("encode_with_vocab", """WITH v AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS level FROM customer WHERE c_nationkey < 3 AND c_mktsegment <> 'BUILDING'))
SELECT c_custkey, CAST(coalesce(code, -1) AS INTEGER) AS code FROM customer LEFT JOIN v ON level = c_mktsegment""")
def encode_with_vocab(t):
    """Codes are learned on a training part that lacks one category, then applied to the whole table."""
    c = t("customer")
    train = c.where("c_nationkey < 3 AND c_mktsegment <> 'BUILDING'")
    return K.encode_with_vocab(train, c.select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "code")


@query("visit_delta", """SELECT user_id, round(avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'click'), 6) AS value_delta
 FROM events GROUP BY user_id""")
def visit_delta(t):
    means = t("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    wide = reshape.widen_visits(means, "user_id", "event_type", ["value"], ["click", "purchase"])
    return K.visit_delta(wide, ["value"], "click", "purchase").select("user_id", F.round("value_delta", 6).alias("value_delta"))


_WEIGHTS = dict(zip(FEATURES, K.FRONTAL_INDEX_WEIGHTS.values()))


@query("weighted_index", "SELECT l_orderkey, l_partkey, round(" + " + ".join(f"({w}) * {f}" for f, w in _WEIGHTS.items()) + ", 8) AS idx FROM lineitem")
def weighted_index(t):
    return t("lineitem").select("l_orderkey", "l_partkey", F.round(K.weighted_index(_WEIGHTS), 8).alias("idx"))
