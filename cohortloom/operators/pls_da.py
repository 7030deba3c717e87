"""Two-class partial least squares: extreme groups, component choice by AUC, permutation test."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.operators.inference import auc, permutation_test
from cohortloom.operators.latent import fit_pls, weights_table
from cohortloom.operators.ranks import exact_quantiles
from cohortloom.operators.resample import assign_folds_stratified, stratified_split
from cohortloom.operators.rows import complete_cases
from cohortloom.operators.scaling import standardize
from cohortloom.operators.suffstats import moments
from cohortloom.session import cut_lineage, small_rows


def extreme_groups(df: DataFrame, score: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Rows at or below the lower, or at or above the upper quantile.

    ``high`` is 1 only strictly above the upper quantile; ``label`` counts the quantile itself as "High".
    """
    q = small_rows(exact_quantiles(df, [], score, {"lo": low, "hi": high}), 1, "quantiles")[0]
    kept = df.where((col(score) <= F.lit(q["lo"])) | (col(score) >= F.lit(q["hi"])))
    return kept.withColumn("high", (col(score) > F.lit(q["hi"])).cast("int")).withColumn(
        "label", F.when(col(score) >= F.lit(q["hi"]), "High").otherwise("Low"))


def pls_da(
    df: DataFrame, key: str | Column, features: Sequence[str], score: str, most: int = 5, folds: int = 5, permutations: int = 1000,
    scale_on: str = "train", seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Separate the lowest from the highest quarter of a score.  Returns one result row and the ranked first weights.

    All candidate models are scored on their held-out folds together, as one ranked pass over (components, fold).
    """
    known = extreme_groups(complete_cases(df, [*features, score]), score)
    slim = known.select((key if isinstance(key, Column) else col(key)).alias("_key"), *map(col, features), "high")
    split = cut_lineage(stratified_split(slim, "high", "_key", 0.2, seed))
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    base = split if scale_on == "all" else train
    train, test = standardize(train, features, base), standardize(test, features, base)
    folded = cut_lineage(assign_folds_stratified(train, "high", "_key", folds, seed + 1, "_fold"))
    m = moments(folded, [*features, "high"], ["_fold"])
    most = min(most, len(features))
    models = {(k[0], c): fit_pls(m.without(k), c)[0] for k in m.keys for c in range(1, most + 1)}
    candidates = []
    for c in range(1, most + 1):
        value = F.lit(None).cast("double")
        for k in m.keys:
            value = F.when(F.col("_fold") == k[0], models[k[0], c].predict()).otherwise(value)
        candidates.append(F.struct(F.lit(c).alias("components"), value.alias("_score")))
    scored = folded.select("high", "_fold", F.explode(F.array(*candidates)).alias("s")).select("high", "_fold", "s.*")
    per_fold = small_rows(auc(scored, "_score", "high", ["components", "_fold"]), most * folds, "fold results")
    mean = {c: float(np.mean([r["auc"] for r in per_fold if r["components"] == c])) for c in range(1, most + 1)}
    best = max(mean, key=lambda c: (mean[c], -c))
    model, weights = fit_pls(m.total(), best)
    tested = cut_lineage(test.select("_key", "high", model.predict().alias("_score")))
    result = permutation_test(tested, "_key", "_score", "high", permutations, seed)
    out = result.select(F.lit(best).alias("components"), F.lit(mean[best]).alias("cv_auc"), F.col("observed").alias("test_auc"), "p", "replicates")
    return out, weights_table(df.sparkSession, list(features), weights[:, 0])
