"""Gradient-boosted trees with Spark ML: fit, seeded random search, nested cross-validation, run grids.

Spark's trees follow the same recipe as other boosting libraries (squared error, shrinkage, row and column sampling) but
are not number-identical to them.  Missing features have to be imputed first.
"""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col, rewrite
from cohortloom.operators.harmonize import harmonize_split
from cohortloom.operators.ranks import hashed_row_number
from cohortloom.operators.resample import assign_folds, regression_metrics
from cohortloom.operators.scaling import impute_mean
from cohortloom.session import cut_lineage, ensure_checkpoint_dir, local_table

# The search ranges (low, high, kind).
SEARCH_SPACE = {
    "n_estimators": (50, 2001, "int"), "min_child_weight": (1, 11, "int"), "gamma": (0.01, 5.0, "log"), "eta": (0.005, 0.5, "log"),
    "subsample": (0.2, 1.0, "real"), "colsample_bytree": (0.2, 1.0, "real"), "max_depth": (2, 6, "int"),
}
# The small, slow-learning model used for a quick look at every score.
QUICK_PARAMS = {"n_estimators": 50, "max_depth": 2, "eta": 0.05, "subsample": 0.8, "colsample_bytree": 0.8}

# Familiar boosting names and the Spark parameters they set.  ``gamma`` is the least fall of the loss in other libraries and the
# least fall of the variance per row here, so equal numbers prune more strongly.
SPARK_NAMES = {
    "n_estimators": "maxIter", "eta": "stepSize", "gamma": "minInfoGain", "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy", "max_depth": "maxDepth", "min_child_weight": "minInstancesPerNode",
}


TASK_ROWS = 1_000_000


def spark_params(params: Mapping) -> dict:
    out = {}
    for name, value in params.items():
        kind = SPARK_NAMES[name]
        if kind == "featureSubsetStrategy":
            value = "all" if float(value) >= 1.0 else str(float(value))
        elif kind in ("maxIter", "maxDepth", "minInstancesPerNode"):
            value = int(value)
        out[kind] = value
    return out


def assemble(df: DataFrame, features: Sequence[str], out: str = "_features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def counts_rows(params: Mapping) -> bool:
    """Whether a fit looks at single rows: it samples them, or asks for more than one in a leaf."""
    return float(params.get("subsample", 1.0)) < 1 or int(params.get("min_child_weight", 1)) > 1


def alike(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with equal features (and ``by``) as two rows of half their number ``_weight``, one spread above and one below their mean target.

    Number, sum and sum of squares stay, so do all gains, predictions and errors; trees keep their rows in memory and read them
    many times, which then costs by the sets of features.
    """
    y = col(target).cast("double")
    cells = df.groupBy(*map(col, [*by, *features])).agg((F.count(F.lit(1)) / 2).alias("_weight"), F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_spread"))
    return cells.withColumn(target, F.explode(F.array(F.col("_mean") - F.col("_spread"), F.col("_mean") + F.col("_spread")))).drop("_mean", "_spread")


class WeightedR2(Evaluator):
    """R squared of the rows that weighted ones stand for; Spark's own takes weights as a matter of reliability in the total."""

    def __init__(self, target: str, shift: float):
        super().__init__()
        self.target, self.shift = target, shift

    def _evaluate(self, dataset: DataFrame) -> float:
        w, y = F.col("_weight"), col(self.target) - F.lit(self.shift)
        row = dataset.agg(F.sum(w).alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q"), F.sum(w * F.pow(col(self.target) - F.col("prediction"), 2)).alias("e")).first()
        spread = row["q"] - row["s"] * row["s"] / row["n"] if row["n"] else 0.0
        return 1 - row["e"] / spread if spread > 0 else math.nan

    def isLargerBetter(self) -> bool:
        return True


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows dealt to tasks of some ``TASK_ROWS`` each, if there are more than that many."""
    count = df.count()
    return df.repartition(-(-count // TASK_ROWS)) if count > TASK_ROWS else df


def gbt_fit(df: DataFrame, features: Sequence[str], target: str, params: Mapping, seed: int = 42) -> GBTRegressionModel:
    """A model of the rows that have the target; rows with equal features are fitted together unless ``params`` look at single rows."""
    known = df.where(col(target).isNotNull())
    base = GBTRegressor(featuresCol="_features", labelCol=target, seed=seed, **spark_params(params))
    if counts_rows(params):
        return base.fit(assemble(spread_rows(known.select(*map(col, features), col(target))), features))
    return base.setWeightCol("_weight").fit(assemble(cut_lineage(alike(known, features, target)), features))


def gbt_predict(model: GBTRegressionModel, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    return model.setPredictionCol(out).transform(assemble(df, features)).drop("_features")


def importances(model: GBTRegressionModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return list(zip(features, map(float, model.featureImportances.toArray())))


def gbt_cv(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: str, params: Mapping = QUICK_PARAMS, top: int = 5, seed: int = 42) -> DataFrame:
    """Per target: mean held-out R squared over the folds, refit on all rows, most important features."""
    rows = []
    for target in targets:
        known = df.where(col(target).isNotNull()).persist()
        scores = []
        for f in [r[0] for r in known.select(fold).distinct().orderBy(fold).collect()]:
            model = gbt_fit(known.where(col(fold) != f), features, target, params, seed)
            held = gbt_predict(model, known.where(col(fold) == f), features)
            scores.append(regression_metrics(held, target, "prediction").first()["r2"])
        ranked = sorted(importances(gbt_fit(known, features, target, params, seed), features), key=lambda p: -p[1])[:top]
        known.unpersist()
        rows.append((target, float(np.mean(scores)), [n for n, _ in ranked], [v for _, v in ranked]))
    return local_table(df.sparkSession, rows, "target string, mean_r2 double, top_features array<string>, top_importances array<double>")


def draw_params(space: Mapping, n: int, seed: int) -> list[dict]:
    """Reproducible random draws; whole-number ranges include both ends, ``log`` ranges are log-uniform."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        draw = {}
        for name, (lo, hi, kind) in space.items():
            if kind == "int":
                draw[name] = int(rng.integers(lo, hi + 1))
            elif kind == "log":
                draw[name] = float(math.exp(rng.uniform(math.log(lo), math.log(hi))))
            else:
                draw[name] = float(rng.uniform(lo, hi))
        out.append(draw)
    return out


def search(
    df: DataFrame, key: str | Column, features: Sequence[str], target: str, space: Mapping = SEARCH_SPACE, n_iter: int = 50,
    cv: int = 3, seed: int = 42, parallelism: int = 4,
) -> tuple[dict, DataFrame]:
    """Random search scored by mean R squared over ``cv`` folds; returns the best parameters and all trials.

    Draws that look at single rows are fitted by ``tree_search``, all at once, unless there are too many sets of features even when binned.
    """
    from cohortloom.operators.tree_search import trial_scores  # which needs this module

    draws = draw_params(space, n_iter, seed)
    known = assign_folds(df.where(col(target).isNotNull()), key, cv, f"search:{seed}", "_cv")
    scores = None
    if any(map(counts_rows, draws)):
        scores = trial_scores(known, key, features, target, "_cv", list(map(spark_params, draws)), cv, seed)
    if scores is None:
        scores = _searched(known.select(*map(col, features), col(target), "_cv"), features, target, draws, cv, seed, parallelism)
    rows = [(i, s, {k: str(v) for k, v in d.items()}) for i, (d, s) in enumerate(zip(draws, scores))]
    return draws[int(np.argmax(scores))], local_table(df.sparkSession, rows, "trial int, r2 double, params map<string,string>")


def _searched(folded: DataFrame, features: Sequence[str], target: str, draws: Sequence[Mapping], cv: int, seed: int, parallelism: int) -> list[float]:
    """Mean R squared per draw by Spark's cross-validator."""
    base = GBTRegressor(featuresCol="_features", labelCol=target, seed=seed)
    judge = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="r2")
    grid = [{base.getParam(k): v for k, v in spark_params(d).items()} for d in draws]
    if any(map(counts_rows, draws)):
        ensure_checkpoint_dir(folded.sparkSession)  # thousands of trees are too long a lineage
        folded = spread_rows(folded)
    else:
        folded = cut_lineage(alike(folded, features, target, ["_cv"]))
        mean = folded.agg(F.sum(F.col("_weight") * col(target)) / F.sum("_weight")).first()[0]
        base, judge = base.setWeightCol("_weight"), WeightedR2(target, mean or 0.0)
    tuner = CrossValidator(estimator=base, estimatorParamMaps=grid, numFolds=cv, foldCol="_cv", parallelism=parallelism, seed=seed, evaluator=judge)
    return list(map(float, tuner.fit(assemble(folded, features)).avgMetrics))


def nested_cv(
    df: DataFrame, key: str | Column, features: Sequence[str], target: str, site: str | None = None, space: Mapping = SEARCH_SPACE,
    outer: int = 10, n_iter: int = 50, inner: int = 3, seed: int = 42, passive: Sequence[str] = (), holdout: DataFrame | None = None,
    parallelism: int = 4, harmonise: bool = True,
) -> tuple[DataFrame, DataFrame, float | None]:
    """Outer folds: harmonise on the training part, search, score the held-out part.

    ``passive`` features (such as sex) are used but not harmonised.  Returns R squared per fold with its parameters,
    importances per fold, and R squared on ``holdout`` after refitting everything with the best fold's parameters.
    """
    known = cut_lineage(assign_folds(df.where(col(target).isNotNull()), key, outer, f"outer:{seed}", "_outer"))
    active = [f for f in features if f not in passive]
    folds, imps = [], []

    def prepare(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        if site is not None and harmonise:
            train, test = harmonize_split(train, test, site, active)
            train = cut_lineage(train)  # harmonised once for all that follows
        # Trees here take no missing values, so what is still missing gets the training mean.
        return impute_mean(train, train, features), impute_mean(train, test, features)

    for f in range(outer):
        train, test = prepare(known.where(F.col("_outer") != f), known.where(F.col("_outer") == f))
        best, _ = search(train, key, features, target, space, n_iter, inner, seed + f, parallelism)
        model = gbt_fit(train, features, target, best, seed)
        score = regression_metrics(gbt_predict(model, test, features), target, "prediction").first()
        folds.append((f, float(score["r2"]) if score and score["r2"] is not None else None, {k: str(v) for k, v in best.items()}, best))
        imps += [(f, n, v) for n, v in importances(model, features)]
    r2_holdout = None
    if holdout is not None:
        best = max(folds, key=lambda r: -math.inf if r[1] is None else r[1])[3]
        train, test = prepare(known.drop("_outer"), holdout.where(col(target).isNotNull()))
        held = gbt_predict(gbt_fit(train, features, target, best, seed), test, features)
        r2_holdout = regression_metrics(held, target, "prediction").first()["r2"]
    spark = df.sparkSession
    return (local_table(spark, [r[:3] for r in folds], "fold int, r2 double, params map<string,string>"),
            local_table(spark, imps, "fold int, feature string, importance double"), r2_holdout)


def oof_gbt(df: DataFrame, features: Sequence[str], target: str, fold: str, params: Mapping, seed: int = 42) -> DataFrame:
    """Every row predicted by the model that did not see its fold (``val_prediction``) and by the mean of the others."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    models = {f: gbt_fit(df.where(col(fold) != f), features, target, params, seed) for f in folds}
    out = assemble(df, features)
    for i, f in enumerate(folds):
        out = models[f].setPredictionCol(f"_p{i}").transform(out)
    val, seen = F.lit(None).cast("double"), F.lit(0.0)
    for i, f in enumerate(folds):
        val = F.when(col(fold) == f, F.col(f"_p{i}")).otherwise(val)
        seen = seen + F.when(col(fold) != f, F.col(f"_p{i}")).otherwise(0.0)
    drop = ["_features", *[f"_p{i}" for i in range(len(folds))]]
    return out.withColumn("val_prediction", val).withColumn("train_prediction", seen / (len(folds) - 1)).drop(*drop)


def permutation_importance(model: GBTRegressionModel, df: DataFrame, key: str | Column, features: Sequence[str], target: str, seed: int = 42) -> DataFrame:
    """Rise of the squared error when one feature is shuffled over the rows.

    Shuffling is a join of two random row numberings, so it is a real permutation at any size.
    """
    one = hashed_row_number(df, [], key, seed, "_a").drop("group_rows")
    two = hashed_row_number(df, [], key, seed + 1, "_a").drop("group_rows")
    other = two.select("_a", *[col(f).alias(f"_s_{f}") for f in features])
    both = one.join(other, "_a").drop("_a").persist()
    base = regression_metrics(gbt_predict(model, both, features), target, "prediction").first()["mse"]
    rows = []
    for f in features:
        shuffled = rewrite(both, {f: col(f"_s_{f}")})
        mse = regression_metrics(gbt_predict(model, shuffled, features), target, "prediction").first()["mse"]
        rows.append((f, float(mse - base)))
    both.unpersist()
    return local_table(df.sparkSession, rows, "feature string, importance double")


def run_grid(spark, targets: Sequence[str], feature_sets: Sequence[str], run: Callable[[str, str], Mapping], workers: int = 4) -> DataFrame:
    """Every target x feature set as its own set of Spark jobs, a few at a time; one result row each.

    ``run`` returns ``{"r2": ..., "params": {...}}``; a run that fails is reported, not lost.
    """

    def one(pair: tuple[str, str]) -> tuple:
        begin = time.time()
        try:
            got = run(*pair)
            return (*pair, float(got["r2"]), {k: str(v) for k, v in got.get("params", {}).items()}, (time.time() - begin) / 60, None)
        except Exception as e:  # noqa: BLE001 - a failed run is a row of the report
            return (*pair, None, None, (time.time() - begin) / 60, str(e)[:500])

    with ThreadPoolExecutor(workers) as pool:
        rows = list(pool.map(one, itertools.product(targets, feature_sets)))
    return local_table(spark, rows, "target string, feature_set string, r2 double, params map<string,string>, minutes double, error string")
