"""Scans, sinks, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.cleaning import null_sentinels
from cohortloom.operators import columns as C
from cohortloom.operators.rows import rows_with_missing
from cohortloom.plans.registry import RAW_BALANCE, RAW_SEGMENT, TOKENS_SQL, query
from cohortloom.sources.readers import block_metrics, read_keyed, split_blocks
from cohortloom.sources.sinks import membership_rows, missing_ids
from cohortloom.operators.align import membership_flags

RAW_CUSTOMER = f"SELECT c_custkey, {RAW_BALANCE} AS balance, {RAW_SEGMENT} AS segment, c_nationkey FROM customer"
CLEAN_CUSTOMER = f"""SELECT c_custkey, CASE WHEN balance NOT IN {TOKENS_SQL} THEN balance END AS balance,
 CASE WHEN segment NOT IN {TOKENS_SQL} THEN segment END AS segment, c_nationkey FROM ({RAW_CUSTOMER}) r"""


def raw_customer(t):
    return t("customer").selectExpr("c_custkey", f"{RAW_BALANCE} AS balance", f"{RAW_SEGMENT} AS segment", "c_nationkey")


def clean_customer(t):
    return null_sentinels(raw_customer(t))


@query("scan_raw", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
                   "CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer")
def scan_raw(t):
    """Every column as text, the state in which raw sources arrive."""
    df = t("customer")
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("scan_pruned", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def scan_pruned(t):
    return C.drop(t("lineitem"), ["l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])


_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@query("scan_keyed_files", " UNION ALL ".join(f"SELECT '{n}' AS file_key, count(*) AS n FROM {n}" for n in _TABLES))
def scan_keyed_files(t):
    """All files of the folder in one scan, keyed by file name."""
    return read_keyed(t.spark, f"{t.folder}/*.parquet", r"^(\w+)\.parquet$").groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))


@query("list_missing", f"""WITH c AS ({CLEAN_CUSTOMER})
SELECT 'balance' AS "column", c_custkey FROM c WHERE balance IS NULL
UNION ALL SELECT 'segment', c_custkey FROM c WHERE segment IS NULL""")
def list_missing(t):
    return missing_ids(clean_customer(t), "c_custkey", ["balance", "segment"])


@query("rows_with_missing", f"SELECT balance, segment FROM ({CLEAN_CUSTOMER}) c WHERE balance IS NULL OR segment IS NULL")
def rows_missing(t):
    return rows_with_missing(clean_customer(t), ["balance", "segment"], ["c_"])


# Membership lists: customers who have orders of a kind.
def order_lists(t):
    o = t("orders")
    return {"urgent": o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")),
            "large": o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")),
            "open": o.where("o_orderstatus = 'O' AND o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))}


LISTS_SQL = """lists AS (SELECT 'urgent' AS membership, o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION SELECT 'large', o_custkey FROM orders WHERE o_totalprice > 400000
 UNION SELECT 'open', o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 350000)"""


def members(t):
    flagged = membership_flags(t("customer"), order_lists(t), "c_custkey")
    return membership_rows(flagged, {m: m for m in ("urgent", "large", "open")})


@query("membership_extract", f"WITH {LISTS_SQL} SELECT membership, c_custkey, c_name, c_acctbal FROM customer JOIN lists ON k = c_custkey")
def membership_extract(t):
    return members(t).select("membership", "c_custkey", "c_name", "c_acctbal")


@query("text_block_metrics", r"""WITH b AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS block_no, trim(string_split(text, '. ')[i]) AS block
 FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i FROM documents))
SELECT doc_id, block_no, TRY_CAST(nullif(regexp_extract(block, '(-?[0-9]+\.?[0-9]*)', 1), '') AS DOUBLE) AS first_number,
 contains(block, '@') AS has_at FROM b WHERE block <> ''""")
def text_block_metrics(t):
    """Whole texts cut into blocks, one row of metrics per block."""
    blocks = split_blocks(t("documents"), "text", ". ", ["doc_id"])
    return block_metrics(blocks.withColumn("has_at", F.col("block").contains("@")), "block",
                         {"first_number": r"(-?[0-9]+\.?[0-9]*)"}, ["doc_id", "block_no", "has_at"])


# ---------------------------------------------------------------- projections


@query("project_keep", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def project_keep(t):
    return C.keep(t("lineitem"), ["l_orderkey", "l_linenumber", "l_tax", "not_there"])


@query("project_substring", "SELECT l_orderkey, l_partkey, l_suppkey, l_discount, l_shipdate FROM lineitem")
def project_substring(t):
    kept = C.keep_containing(t("lineitem"), ["KEY", "DIS", "SHIP"], case=False)
    return C.drop_containing(kept, ["mode"])


FEATURE_SETS = {
    "price": {"pattern": r"price$|quantity$", "covariates": ["l_tax"]},
    "rates": {"pattern": r"^l_(discount|tax)$", "covariates": ["l_quantity"], "without": ["l_tax", "absent"]},
}


@query("project_feature_set", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def project_feature_set(t):
    return C.feature_set(t("lineitem"), "rates", FEATURE_SETS, ["l_orderkey", "l_linenumber"])


@query("rename_affix", "SELECT p_partkey, p_name AS V12_p_name_x, p_brand AS V12_p_brand_x, p_type AS V12_p_type_x, "
                       "p_size AS V12_p_size_x, p_retailprice AS V12_p_retailprice_x FROM part")
def rename_affix(t):
    return C.rename_affix(t("part"), "V12_", "_x", ["p_partkey"])


@query("move_column", "SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def move_column(t):
    return C.move_column(t("orders"), "o_totalprice", 1)
