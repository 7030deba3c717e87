"""Row filters, sampling, set operations and duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.functions.hashing import unit_hash
from cohortloom.session import small_rows


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def not_equal(c: str | Column, value) -> Column:
    """Different from ``value``; a missing cell counts as different."""
    return ~col(c).eqNullSafe(F.lit(value))


def drop_rows_any_contains(df: DataFrame, columns: Sequence[str], needles: Sequence[str], drop_columns: bool = True) -> DataFrame:
    """Remove rows in which any listed column contains any needle; the listed columns then go."""
    hit = _any(F.coalesce(col(c).contains(n), F.lit(False)) for c in columns for n in needles)
    kept = df.where(~hit)
    return kept.select(*[col(c) for c in df.columns if c not in set(columns)]) if drop_columns else kept


def drop_rows_all_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="all", subset=list(columns))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns) if columns is not None else None)


def rows_with_missing(df: DataFrame, columns: Sequence[str], exclude_prefixes: Sequence[str] = ()) -> DataFrame:
    """Rows lacking any listed column, without the columns that start with an excluded prefix."""
    kept = [c for c in df.columns if not c.startswith(tuple(exclude_prefixes))] if exclude_prefixes else df.columns
    return df.where(_any(col(c).isNull() for c in columns)).select(*map(col, kept))


def sample_rows(df: DataFrame, key: str | Column, fraction: float, seed: int = 42) -> DataFrame:
    """Reproducible sample: rows whose key hash falls below ``fraction``."""
    return df.where(unit_hash(key, seed) < F.lit(float(fraction)))


def count_extreme(df: DataFrame, columns: Sequence[str], bound: float = 2.0) -> DataFrame:
    """Per column, how many values lie beyond ``bound`` in absolute value."""
    totals = df.agg(*[F.count_if(F.abs(col(c)) > bound).alias(c) for c in columns])
    return totals.unpivot([], list(columns), "feature", "n_extreme")


# ---------------------------------------------------------------- sets and duplicates


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, absent ones missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys on more than one row, with the number of rows and of different rows.

    The rows are first collapsed to distinct ones with a count, so a key that holds very many copies is merged on the
    map side.
    """
    per_row = df.groupBy(*map(col, df.columns)).agg(F.count(F.lit(1)).alias("_copies"))
    per_key = per_row.groupBy(col(key)).agg(F.sum("_copies").alias("n_rows"), F.count(F.lit(1)).alias("n_different"))
    return per_key.where(F.col("n_rows") > 1)


def key_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def column_difference(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) - set(b.columns))


def duplicate_conflicts(df: DataFrame, key: str) -> DataFrame:
    """``(key, column, value, n)`` wherever copies of one key disagree in a column.

    Minimum and maximum per key find the conflicting cells with map-side combining; only those keys are then listed
    with their values, one row per value, so no key needs a list in memory.
    """
    values = [c for c in df.columns if c != key]
    text = df.select(col(key), *[col(c).cast("string").alias(c) for c in values])
    long = text.unpivot([key], values, "column", "value").where(F.col("value").isNotNull())
    counted = long.groupBy(col(key), "column", "value").agg(F.count(F.lit(1)).alias("n"))
    spread = counted.groupBy(col(key), "column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n"))
    bad = spread.where(F.col("lo") != F.col("hi")).select(key, "column")
    return counted.join(bad, [key, "column"], "left_semi")


def reconcile_duplicates(df: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """One row per key with the non-missing value of each column.

    ``strict`` stops with an error when copies of a key disagree; otherwise a disputed cell becomes missing (see
    ``duplicate_conflicts`` for the report).  One shuffle, with map-side combining.
    """
    values = [c for c in df.columns if c != key]
    lo = [F.min(col(c)).alias(f"lo_{i}") for i, c in enumerate(values)]
    hi = [F.max(col(c)).alias(f"hi_{i}") for i, c in enumerate(values)]
    merged = df.groupBy(col(key)).agg(*lo, *hi)

    def cell(i: int, name: str) -> Column:
        agreed = F.col(f"lo_{i}").eqNullSafe(F.col(f"hi_{i}"))
        if not strict:
            return F.when(agreed, F.col(f"lo_{i}")).alias(name)
        message = F.concat(F.lit(f"conflict in column {name} for key "), col(key).cast("string"))
        return F.when(agreed, F.col(f"lo_{i}")).otherwise(F.raise_error(message)).alias(name)

    return merged.select(col(key), *[cell(i, c) for i, c in enumerate(values)])


def has_duplicates(df: DataFrame, key: str) -> bool:
    """Whether a non-missing key repeats (stops at the first)."""
    repeated = df.where(col(key).isNotNull()).groupBy(col(key)).count().where("count > 1")
    return bool(small_rows(repeated.limit(1), 1, "probe"))
