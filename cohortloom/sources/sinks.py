"""Writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import quoted


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def missing_ids(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(column, key)`` for every listed column that is missing in a row; one scan, no shuffle."""
    flags = F.array_compact(F.array(*[F.when(F.col(quoted(c)).isNull(), F.lit(c)) for c in columns]))
    return df.select(F.explode(flags).alias("column"), F.col(quoted(key)))


def write_missing_ids(df: DataFrame, key: str, columns: Sequence[str], path: str, fmt: str = "csv") -> None:
    """One folder per column with the ids that lack it."""
    write_table(missing_ids(df, key, columns), path, fmt, by=["column"])


def membership_rows(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Rows repeated once per membership (``{label: flag column}``) they belong to."""
    marks = F.array_compact(F.array(*[F.when(F.col(quoted(c)).isNotNull(), F.lit(m)) for m, c in flags.items()]))
    kept = [F.col(quoted(c)) for c in df.columns if c not in set(flags.values())]
    return df.select(F.explode(marks).alias("membership"), *kept)


def export_by_membership(df: DataFrame, flags: Mapping[str, str], path: str, fmt: str = "csv") -> None:
    write_table(membership_rows(df, flags), path, fmt, by=["membership"])


RUN_RECORD = T.StructType([
    T.StructField("run_at", T.TimestampType()), T.StructField("target", T.StringType()),
    T.StructField("metric", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("quick_run", T.BooleanType()), T.StructField("bootstrap", T.BooleanType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("r2_train", T.DoubleType()), T.StructField("r2_test", T.DoubleType()),
    T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType()),
    T.StructField("run_minutes", T.DoubleType()),
])


def append_run_record(spark: SparkSession, path: str, record: Mapping) -> None:
    """Append one model run to the results table."""
    row = tuple(record.get(f.name) for f in RUN_RECORD.fields)
    spark.createDataFrame([row], RUN_RECORD).coalesce(1).write.mode("append").parquet(path)
