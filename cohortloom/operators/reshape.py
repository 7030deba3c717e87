"""Wide and long layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.session import levels


def widen_visits(
    df: DataFrame, key: str, visit: str, features: Sequence[str], visits: Sequence[str] | None = None,
    drop_parts: Sequence[str] = (), on_duplicates: str = "error", name: str = "{feature}_{visit}",
) -> DataFrame:
    """One row per key, one column per feature and visit (visit labels in lower case).

    A repeated (key, visit) is an error, found in the same pass.  ``drop_parts`` leaves out quality-control columns.
    """
    features = [f for f in features if not any(p in f for p in drop_parts)]
    visits = levels(df, visit, 200) if visits is None else list(visits)
    cells, guards = [], []
    for v in visits:
        here = col(visit) == v
        cells += [F.max(F.when(here, col(f))).alias(name.format(feature=f, visit=str(v).lower())) for f in features]
        guards.append(F.count_if(here))
    wide = df.where(col(key).isNotNull()).groupBy(col(key)).agg(*cells, F.greatest(*guards, F.lit(0)).alias("_copies"))
    if on_duplicates == "error":
        message = F.concat(F.lit("repeated visit for "), col(key).cast("string"))
        wide = wide.where(F.when(F.col("_copies") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return wide.drop("_copies")


def lengthen(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "measure", value: str = "value") -> DataFrame:
    """Wide to long; missing values are kept."""
    return df.unpivot(list(ids), list(columns), name, value)


def crosstab(df: DataFrame, a: str, b: str, b_levels: Sequence | None = None) -> DataFrame:
    """Counts of ``a`` by ``b`` with every combination present; missing categories are left out."""
    b_levels = levels(df, b) if b_levels is None else list(b_levels)
    known = df.where(col(a).isNotNull() & col(b).isNotNull())
    return known.groupBy(col(a)).agg(*[F.count_if(col(b) == v).alias(str(v)) for v in b_levels])


def category_grid(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long crosstab ``(a, b, n)`` including the empty combinations."""
    counts = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a), col(b)).agg(F.count(F.lit(1)).alias("n"))
    kind = df.schema[b].dataType.simpleString()
    names = F.array(*[F.lit(v).cast(kind) for v in levels(df, b)])
    grid = counts.select(col(a)).distinct().select(col(a), F.explode(names).alias(b))
    return grid.join(counts, [a, b], "left").na.fill(0, ["n"])
