"""Describing and comparing: membership tables, and deviation/cluster correspondence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.operators import align, cluster, describe
from cohortloom.operators.normative import normative_z
from cohortloom.operators.rows import complete_cases
from cohortloom.session import cut_lineage, levels
from cohortloom.sources.sinks import membership_rows


def membership_summary(subjects: DataFrame, lists: Mapping[str, DataFrame], key: str, group: str, categorical: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Numeric and category summaries of every membership list, overall and by group."""
    flagged = align.membership_flags(subjects, lists, key)
    members = membership_rows(flagged, {m: m for m in lists})
    numbers = [c for c in describe.numeric_columns(members, [key]) if c not in categorical]
    texts = [c for c in members.columns if c not in numbers and c not in ("membership", key, group)]
    return describe.describe_by_membership(members, numbers, group), describe.count_by_membership(members, texts, group)


def deviation_correspondence(
    df: DataFrame, key: str, group: str, reference: Sequence[str], cases: Sequence[str], scores: Sequence[str], features: Sequence[str],
    covariates: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5), seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Cluster the cases on their scores, score their features against the reference group, test features between all pairs of
    clusters (``cluster_a``, ``cluster_b``) and against the first score component."""
    known = complete_cases(df.where(col(group).isin(*cases)), scores)
    labelled, _ = cluster.gmm_search(known, scores, ks, seed)
    scored, _ = cluster.add_components(labelled.select(key, "cluster", *scores), scores, 1)
    z = normative_z(df, group, reference, cases, features, covariates, [key])
    joined = cut_lineage(align.keyed_join(z, scored.select(key, "cluster", "PC1"), key, "inner"))
    names = [f"{f}_z" for f in features]
    pairs = [cluster.feature_cluster_tests(joined, "cluster", a, b, names, "PC1").select(F.lit(a).alias("cluster_a"), F.lit(b).alias("cluster_b"), "*")
             for a, b in combinations(levels(joined, "cluster", max(ks)), 2)]
    return joined, reduce(DataFrame.unionByName, pairs)
