"""Registry of named queries with their SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(read)`` where ``read(table)`` gives a table; ``sql`` is the equivalent statement, if there is one."""

    def add(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


class Tables:
    """``tables("orders")`` reads one table; ``folder`` and ``spark`` are there for the scan operators."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def key_hash_sql(expr: str, salt: str | int) -> str:
    """The SQL twin of ``functions.hashing.key_hash``."""
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR) || '|{salt}'), 1, 7))::BIGINT"


def replicate_number_sql(expr: str, seed: int, rep: str = "rep") -> str:
    return f"(({key_hash_sql(expr, f'{seed}:a')} + {rep} * {key_hash_sql(expr, f'{seed}:b')}) % 268435399)"


def order_hash_sql(expr: str, salt: str) -> str:
    return f"md5(CAST({expr} AS VARCHAR) || '|' || {salt})"


# A line item has no single key; these four numbers identify it. Valid in both dialects.
LINE_KEY = "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))"
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SITE = "concat(l_returnflag, l_linestatus)"
# Injected missing-value texts, so that the standard tables (which have no missing values) exercise the cleaning code.
RAW_BALANCE = ("CASE WHEN c_custkey % 7 = 0 THEN '.' WHEN c_custkey % 11 = 0 THEN 'nan' WHEN c_custkey % 13 = 0 THEN '#NULL!' "
               "ELSE CAST(c_acctbal AS STRING) END")
RAW_SEGMENT = ("CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' WHEN c_custkey % 17 = 0 THEN 'not_answered' ELSE c_mktsegment END")
TOKENS_SQL = "('#NULL!', '.', 'nan', 'NaN', 'Unknown', 'not_answered')"
