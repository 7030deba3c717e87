"""Means, scales, imputation and collinearity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col, rewrite
from cohortloom.operators.ranks import exact_median
from cohortloom.session import bounded_broadcast, small_rows


def fit_scale(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``{column: (mean, population std)}``; a constant column gets the scale 1."""
    row = df.agg(*[F.struct(F.avg(col(c)), F.stddev_pop(col(c))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        mean, sd = row[f"s{i}"]
        out[c] = (mean, sd if sd else 1.0)
    return out


def apply_scale(df: DataFrame, scale: Mapping[str, tuple[float, float]]) -> DataFrame:
    return rewrite(df, {c: (col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std, fitted on ``fit_on`` (default: the table itself)."""
    return apply_scale(df, fit_scale(df if fit_on is None else fit_on, columns))


def fit_vector_scale(df: DataFrame, vector: str, limit: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Means and population scales of the positions of an array column."""
    long = df.select(F.posexplode(col(vector)).alias("dim", "x"))
    x = F.col("x").cast("double")
    stats = long.groupBy("dim").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    rows = sorted(small_rows(stats, limit, "vector positions"), key=lambda r: r["dim"])
    scale = np.array([r["s"] for r in rows])
    return np.array([r["m"] for r in rows]), np.where(scale == 0, 1.0, scale)


def apply_vector_scale(df: DataFrame, vector: str, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    m, s = F.array(*[F.lit(float(v)) for v in mean]), F.array(*[F.lit(float(v)) for v in scale])
    centred = F.zip_with(col(vector), m, lambda x, c: x.cast("double") - c)
    return rewrite(df, {vector: F.zip_with(centred, s, lambda x, k: x / k)})


def standardize_vector(df: DataFrame, vector: str) -> DataFrame:
    return apply_vector_scale(df, vector, *fit_vector_scale(df, vector))


def impute_mean(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of ``test`` filled with the means of ``train`` (the same frame for the training side)."""
    row = train.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return rewrite(test, {c: F.coalesce(col(c).cast("double"), F.lit(row[f"m{i}"])) for i, c in enumerate(columns)})


def site_medians(train: DataFrame, site: str, columns: Sequence[str]) -> DataFrame:
    """Exact medians, one row per site, one column per feature; all features share one ranked pass."""
    doubles = train.where(col(site).isNotNull()).select(col(site), *[col(c).cast("double").alias(c) for c in columns])
    medians = exact_median(doubles.unpivot([site], list(columns), "_feature", "_x"), [site, "_feature"], "_x", "_median")
    return medians.groupBy(col(site)).agg(
        *[F.max(F.when(F.col("_feature") == c, F.col("_median"))).alias(f"_median_{c}") for c in columns])


def impute_site_median(train: DataFrame, test: DataFrame, site: str, columns: Sequence[str], masks: bool = True) -> DataFrame:
    """Missing values of ``test`` filled with the medians of the same site in ``train``.

    ``<column>_was_missing`` remembers the filled cells.  A site unknown to ``train`` stays missing (find such sites
    with ``unseen_sites``).
    """
    medians = bounded_broadcast(site_medians(train, site, columns))
    joined = test.join(medians, site, "left")
    changes = {c: F.coalesce(col(c).cast("double"), col(f"_median_{c}")) for c in columns}
    if masks:
        changes |= {f"{c}_was_missing": col(c).isNull() for c in columns}
    return rewrite(joined, changes).drop(*[f"_median_{c}" for c in columns])


def unseen_sites(train: DataFrame, test: DataFrame, site: str) -> DataFrame:
    return test.select(col(site)).distinct().join(train.select(col(site)).distinct(), site, "left_anti")


def restore_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Take imputed cells back out, using the ``_was_missing`` marks."""
    back = rewrite(df, {c: F.when(~col(f"{c}_was_missing"), col(c)) for c in columns})
    return back.drop(*[f"{c}_was_missing" for c in columns])


def collinear_columns(r: np.ndarray, columns: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Columns whose absolute correlation with an earlier column exceeds the threshold."""
    above = np.triu(np.abs(np.nan_to_num(r)), k=1) > threshold
    return [c for j, c in enumerate(columns) if above[:, j].any()]
