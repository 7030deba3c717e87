"""Folds, splits, bootstrap weights, out-of-fold predictions and metrics; all driven by hashes of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.functions.hashing import POISSON_CUTS, key_hash, replicate_number, with_replicate_hashes
from cohortloom.operators.ranks import hashed_row_number


def assign_folds(df: DataFrame, key: str | Column, k: int, seed: int | str = 42, name: str = "fold") -> DataFrame:
    """k near-equal random folds; no shuffle."""
    return df.withColumn(name, F.pmod(key_hash(key, seed), F.lit(k)).cast("int"))


def assign_folds_stratified(df: DataFrame, label: str, key: str | Column, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds in which every class is spread evenly (sizes differ by at most one per class)."""
    numbered = hashed_row_number(df, [label], key, seed, "_position")
    return numbered.withColumn(name, F.pmod(F.col("_position") - 1, F.lit(k)).cast("int")).drop("_position", "group_rows")


def stratified_split(df: DataFrame, label: str, key: str | Column, test: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Marks the rounded share ``test`` of every class as test rows."""
    numbered = hashed_row_number(df, [label], key, seed, "_position")
    quota = F.floor(F.col("group_rows") * F.lit(float(test)) + 0.5)
    return numbered.withColumn(name, F.col("_position") <= quota).drop("_position", "group_rows")


def poisson_weight(number: Column) -> Column:
    """Bootstrap weight: Poisson(1) by inverse distribution function on a replicate number."""
    weight = F.lit(0)
    for cut in POISSON_CUTS:
        weight = weight + (number >= F.lit(cut)).cast("int")
    return weight


def bootstrap_rows(df: DataFrame, key: str | Column, replicates: int, seed: int = 42) -> DataFrame:
    """Rows with ``rep`` and ``weight`` columns, rows of weight 0 left out.

    Keys are hashed once per row; a replicate costs a little integer arithmetic.  The replicates are unfolded inside the
    scan stage and are meant to be aggregated right away (partial sums per replicate), so copies never cross the network.
    For means and cross products ``replicates`` does the same without unfolding.
    """
    hashed = with_replicate_hashes(df, key, seed)
    reps = hashed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    number = replicate_number("rep")
    return reps.where(number >= F.lit(POISSON_CUTS[0])).withColumn("weight", poisson_weight(number)).drop("_h1", "_h2")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R squared (against the mean) and mean squared error over rows that have both."""
    y, f = col(actual).cast("double"), col(predicted).cast("double")
    both = df.where(y.isNotNull() & f.isNotNull())
    sums = both.groupBy(*map(col, by)).agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - f) * (y - f)).alias("sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    return sums.select(*map(col, by), "n", (1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"), (F.col("sse") / F.col("n")).alias("mse"))


def holdout_by_group(df: DataFrame, target: str, group: str, train: Sequence, test: Sequence) -> tuple[DataFrame, DataFrame]:
    """Rows that have the target, split by class: models are fitted on one set of classes and tried on the other."""
    known = df.where(col(target).isNotNull())
    return known.where(col(group).isin(*train)), known.where(col(group).isin(*test))
