"""Scoring subjects against a reference group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.operators.linear import solve_ols
from cohortloom.operators.rows import complete_cases
from cohortloom.operators.suffstats import moments


def fit_norms(reference: DataFrame, features: Sequence[str], covariates: Sequence[str]) -> dict[str, tuple[np.ndarray, float, float]]:
    """``{feature: (covariate slopes, intercept, population sd of the residuals)}`` on the complete reference rows of
    each feature.  All features share one pass: rows are unfolded per feature and summed on the map side."""
    names = [*covariates, *features]
    doubles = reference.select(*[col(c).cast("double").alias(c) for c in names])
    # Features differ in scale by orders of magnitude; each is moved near zero before they share one column.
    head = doubles.limit(1000).agg(*[F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(features)]).first()
    near = {f: float(head[i] or 0.0) for i, f in enumerate(features)}
    moved = doubles.select(*map(col, covariates), *[(col(f) - F.lit(near[f])).alias(f) for f in features])
    long = complete_cases(moved.unpivot(list(covariates), list(features), "_feature", "_y"))
    m = moments(long, [*covariates, "_y"], ["_feature"], shift={"_y": 0.0})
    out = {}
    for key in m.keys:
        one = m.of(key)
        model = solve_ols(one)
        c = one.scatter
        rss = c[-1, -1] - model.coef @ c[:-1, -1]
        out[key[0]] = (model.coef, model.intercept + near[key[0]], float(np.sqrt(max(rss, 0.0) / one.size)))
    return out


def score_norms(cases: DataFrame, norms: dict, features: Sequence[str], covariates: Sequence[str], keep: Sequence[str], suffix: str = "_z") -> DataFrame:
    """z = (actual - predicted) / residual sd as plain expressions; cases lacking any z are left out."""
    scores = []
    for f in features:
        slopes, intercept, sd = norms[f]
        predicted = F.lit(float(intercept))
        for c, b in zip(covariates, slopes):
            predicted = predicted + F.lit(float(b)) * col(c)
        scores.append(((col(f) - predicted) / F.lit(sd)).alias(f"{f}{suffix}"))
    return complete_cases(cases.select(*map(col, keep), *scores), [f"{f}{suffix}" for f in features])


def normative_z(
    df: DataFrame, group: str, reference: Sequence[str], cases: Sequence[str], features: Sequence[str], covariates: Sequence[str],
    keep: Sequence[str],
) -> DataFrame:
    """Deviation of case rows from what the covariates predict in the reference group, one z column per feature."""
    norms = fit_norms(df.where(col(group).isin(*reference)), features, covariates)
    return score_norms(df.where(col(group).isin(*cases)), norms, features, covariates, keep)


def deviation_summary(z: DataFrame, z_columns: Sequence[str], group: str, bound: float = 2.0) -> DataFrame:
    """Per feature and case group: n, mean and sample sd of z, and how many lie beyond ``bound``."""
    long = z.unpivot([group], list(z_columns), "feature", "z")
    return long.groupBy("feature", col(group)).agg(
        F.count("z").alias("n"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"),
        F.count_if(F.abs("z") > bound).alias("n_extreme"))
