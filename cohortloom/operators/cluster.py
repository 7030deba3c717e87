"""Clustering subjects and comparing the clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col, reverse_score
from cohortloom.operators.describe import joint_z_profile, mean_ci95
from cohortloom.operators.inference import mann_whitney, pearson_test, rank_test
from cohortloom.operators.latent import Components, principal_components
from cohortloom.operators.normative import normative_z
from cohortloom.operators.ranks import exact_median, fdr_bh
from cohortloom.operators.rows import complete_cases, stack
from cohortloom.operators.scaling import fit_scale
from cohortloom.operators.suffstats import moments
from cohortloom.session import cut_lineage, local_table


FEW_ROWS = 50_000
TASK_ROWS = 500_000  # with their vectors some tens of megabytes


def _vectors(df: DataFrame, features: Sequence[str], scale: bool) -> DataFrame:
    """Complete rows with the (scaled) model vector ``_x``; the original columns stay as they are."""
    known = complete_cases(df, features)
    stats = fit_scale(known, features) if scale else {c: (0.0, 1.0) for c in features}
    x = F.array(*[(col(c).cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in features])
    return known.withColumn("_x", array_to_vector(x))


def relabel(df: DataFrame, label: str, order: Sequence[int]) -> DataFrame:
    """Cluster numbers to text labels "0", "1", ... in the given order (position = new label)."""
    names = F.array(*[F.lit(str(list(order).index(i))) for i in range(len(order))])
    return df.withColumn(label, F.element_at(names, col(label).cast("int") + 1))


def _dealt(x: DataFrame) -> DataFrame:
    """Many rows in tasks of bounded size, and no fewer tasks than cores: the models read them up to a hundred times."""
    n = x.count()
    cores = x.sparkSession.sparkContext.defaultParallelism
    return x if n <= FEW_ROWS else x.select("_x").repartition(max(cores, -(-n // TASK_ROWS)))


def kmeans_search(df: DataFrame, features: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6), seed: int = 42, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """k with the best silhouette (squared Euclidean); returns rows with ``cluster`` and the score per k.

    Labels are ordered by the first coordinate of the centres, so they are stable from run to run.
    """
    rows = _vectors(df, features, scale)
    x = _dealt(rows).persist()
    judge = ClusteringEvaluator(featuresCol="_x", predictionCol="_c", metricName="silhouette", distanceMeasure="squaredEuclidean")
    tried, best = [], None
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="_c", maxIter=100).fit(x)
        score = float(judge.evaluate(model.transform(x)))
        tried.append((k, score))
        if best is None or score > best[0]:
            best = (score, model)
    x.unpersist()
    order = np.argsort([tuple(c)[0] for c in best[1].clusterCenters()], kind="stable")
    labelled = relabel(best[1].transform(rows).withColumnRenamed("_c", "cluster"), "cluster", list(order)).drop("_x")
    return labelled, local_table(df.sparkSession, tried, "k int, silhouette double")


def gmm_bic(log_likelihood: float, k: int, d: int, n: int) -> float:
    free = (k - 1) + k * d + k * d * (d + 1) / 2
    return -2 * log_likelihood + free * math.log(n)


def gmm_search(df: DataFrame, features: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5), seed: int = 42, scale: bool = True,
               criterion: str = "bic") -> tuple[DataFrame, DataFrame]:
    """Full-covariance mixture with the lowest BIC (or best silhouette): hard labels and membership probabilities."""
    rows = _vectors(df, features, scale)
    x = _dealt(rows).persist()
    n = x.count()
    judge = ClusteringEvaluator(featuresCol="_x", predictionCol="_c", metricName="silhouette", distanceMeasure="squaredEuclidean")
    tried, best = [], None
    for k in ks:
        model = GaussianMixture(k=k, seed=seed, featuresCol="_x", predictionCol="_c", probabilityCol="_p", maxIter=100).fit(x)
        if criterion == "bic":
            score = gmm_bic(model.summary.logLikelihood, k, len(features), n)
        else:
            score = -float(judge.evaluate(model.transform(x)))
        tried.append((k, score if criterion == "bic" else -score))
        if best is None or score < best[0]:
            best = (score, model)
    x.unpersist()
    model = best[1]
    first = [float(g.mean[0]) for g in model.gaussians]
    order = list(np.argsort(first, kind="stable"))
    p = vector_to_array("_p")
    out = model.transform(rows).withColumnRenamed("_c", "cluster")
    out = out.withColumn("probabilities", F.array(*[p[int(i)] for i in order])).drop("_x", "_p")
    return relabel(out, "cluster", order), local_table(df.sparkSession, tried, f"k int, {criterion} double")


def add_components(df: DataFrame, features: Sequence[str], k: int, scale: bool = True) -> tuple[DataFrame, Components]:
    """Append PC1..PCk (of the standardised features) to the complete rows."""
    known = complete_cases(df, features)
    pcs = principal_components(moments(known, features), k, standardise=scale)
    return known.select("*", *pcs.score_expressions()), pcs


def two_level_gmm(df: DataFrame, features: Sequence[str], seed: int = 42) -> tuple[DataFrame, Components]:
    """Low and high group: a two-part mixture on the first component; "0" is the low one."""
    scored, pcs = add_components(df, features, 1)
    labelled, _ = gmm_search(scored, ["PC1"], [2], seed, scale=False)
    return labelled, pcs


def cluster_vs_reference(clustered: DataFrame, reference: DataFrame, measures: Sequence[str], reverse: Sequence[str] = (),
                         reference_label: str = "LR", z: bool = True) -> DataFrame:
    """Profiles of the clusters with the reference group as one more cluster: mean and 95 % half-width per measure."""
    columns = ["cluster", *measures]
    known = complete_cases(reference, measures).withColumn("cluster", F.lit(reference_label))
    both = stack([clustered.select(*map(col, columns)), known.select(*map(col, columns))])
    if z:
        return joint_z_profile(both, "cluster", measures, reverse)
    flipped = reverse_score(both, reverse) if reverse else both
    return mean_ci95(flipped.unpivot(["cluster"], list(measures), "measure", "value"), ["cluster", "measure"], "value")


def pairwise_mann_whitney(df: DataFrame, group: str, labels: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Every pair of groups on every measure, with adjusted p-values over all of them; one ranking pass serves all pairs."""
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1:]]
    mine = F.array_compact(F.array(*[F.when(F.col("_group").isin(a, b), F.struct(F.lit(a).alias("group1"), F.lit(b).alias("group2"))) for a, b in pairs]))
    # Equal values are counted before the pairs copy them.
    long = df.where(col(group).isin(list(labels))).select(col(group).alias("_group"), *map(col, measures)).unpivot(["_group"], list(measures), "measure", "value")
    counts = cut_lineage(long.where("value IS NOT NULL").groupBy("_group", "measure", "value").agg(F.count(F.lit(1)).alias("_copies")))
    rows = counts.select("*", F.explode(mine).alias("_pair")).select("_group", "_pair.*", "measure", "value", "_copies")
    tests = rank_test(rows, "value", F.col("_group") == F.col("group1"), ["measure", "group1", "group2"], copies="_copies")
    return fdr_bh(tests, "p", out="p_corrected")


def logit_inference(df: DataFrame, outcome: str, terms: Sequence[str]) -> DataFrame:
    """Logistic regression with standard errors, z and p per term (iteratively reweighted least squares)."""
    known = complete_cases(df.select(col(outcome).cast("double").alias("_y"), *[col(t).cast("double").alias(t) for t in terms]))
    x = VectorAssembler(inputCols=list(terms), outputCol="_x").transform(known)
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y", maxIter=50, tol=1e-10).fit(x)
    s = model.summary
    coefs = [*map(float, model.coefficients), float(model.intercept)]
    rows = [(n, c, float(e), float(t), float(p)) for n, c, e, t, p in
            zip([*terms, "intercept"], coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return local_table(df.sparkSession, rows, "term string, coef double, se double, z double, p double")


def normative_clustering(df: DataFrame, key: str, group: str, reference: Sequence[str], cases: Sequence[str], features: Sequence[str],
                         covariates: Sequence[str], k: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame, Components]:
    """Deviation scores, clusters of deviation profiles, and two components of the deviations."""
    z = normative_z(df, group, reference, cases, features, covariates, [key, group])
    names = [f"{f}_z" for f in features]
    labelled, score = kmeans_search(z, names, [k], seed)
    scored, pcs = add_components(labelled, names, 2, scale=False)
    return scored, score, pcs


def feature_cluster_tests(df: DataFrame, cluster: str, group1: str, group2: str, features: Sequence[str], axis: str) -> DataFrame:
    """Per feature: rank test between two clusters with medians, correlation with a score axis, both with adjusted p."""
    long = df.unpivot([cluster, axis], list(features), "feature", "value")
    mw = fdr_bh(mann_whitney(long, cluster, group1, group2, "value", ["feature"]), "p", out="p_fdr").drop("significant")
    med = exact_median(long.where(col(cluster).isin(group1, group2)), ["feature", cluster], "value").groupBy("feature").agg(
        F.max(F.when(col(cluster) == group1, F.col("median"))).alias("median_1"),
        F.max(F.when(col(cluster) == group2, F.col("median"))).alias("median_2"))
    r = pearson_test(df, [(f, axis) for f in features]).select(F.col("x").alias("feature"), "r", F.col("p").alias("r_p"))
    r = fdr_bh(r, "r_p", out="r_p_fdr").withColumnRenamed("significant", "r_significant")
    return mw.join(med, "feature").join(r, "feature")
