"""Summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cohortloom.functions.cleaning import col, reverse_score
from cohortloom.operators.ranks import exact_quantiles
from cohortloom.operators.scaling import standardize


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def _long_numbers(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    doubles = df.select(*map(col, ids), *[col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(ids), list(columns), "column", "value")


def _moments() -> list[Column]:
    return [F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"),
            F.stddev_samp("value").alias("std"), F.count("value").alias("count"),
            F.count_if(F.col("value").isNull()).alias("n_missing")]


def describe_by_membership(members: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """Mean, max, min, sample std, count and missing count per (membership, column), or also per group.

    ``members`` has one row per subject and membership (see ``membership_rows``).  With ``group``, the per-membership and
    the per-group rows come out of one pass as grouping sets (``group`` is NULL and ``level`` is "all" in the former);
    subjects without a group count only in the former.
    """
    if group is None:
        return _long_numbers(members, ["membership"], columns).groupBy("membership", "column").agg(*_moments())
    long = _long_numbers(members, ["membership", group], columns)
    sets = [[col("membership"), col("column")], [col("membership"), col("column"), col(group)]]
    both = long.groupingSets(sets, col("membership"), col("column"), col(group)).agg(
        F.grouping(col(group)).alias("_all"), *_moments())
    kept = both.where((F.col("_all") == 1) | col(group).isNotNull())
    return kept.withColumn("level", F.when(F.col("_all") == 1, "all").otherwise("group")).drop("_all")


def count_by_membership(members: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """Long value counts of category columns per (membership[, group]); the missing value is a category of its own."""
    ids = ["membership"] + ([group] if group else [])
    text = members.select(*map(col, ids), *[col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(ids, list(columns), "column", "value").groupBy(*map(col, ids), "column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per category, the missing one included."""
    return df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))


def value_count_map(counts: DataFrame, by: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Counts of a bounded set of categories folded into one map per group, for display."""
    entries = F.collect_list(F.struct(F.coalesce(col(value).cast("string"), F.lit("missing")), col(n)))
    return counts.groupBy(*map(col, by)).agg(F.map_from_entries(entries).alias("value_counts"))


def group_means(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Mean profile and size of every non-missing group, wide."""
    return df.where(col(group).isNotNull()).groupBy(col(group)).agg(
        *[F.avg(col(c)).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))


def vector_group_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean of each position of an array column per group, long; additions are combined on the map side."""
    long = df.where(col(group).isNotNull()).select(col(group), F.posexplode(col(vector)).alias("dim", "x"))
    return long.groupBy(col(group), "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("x").alias("n"))


def composition(df: DataFrame, a: str, b: str, scale: float = 1.0) -> DataFrame:
    """Share of each ``b`` within ``a``; the window runs over the counts only."""
    counts = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a), col(b)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.lit(scale) * F.col("n") / F.sum("n").over(W.partitionBy(col(a))))


def mean_ci95(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and 1.96 standard errors; the row count under the root includes missing values."""
    return df.groupBy(*map(col, by)).agg(
        F.avg(col(value)).alias("mean"), (F.lit(1.96) * F.stddev_samp(col(value)) / F.sqrt(F.count(F.lit(1)))).alias("ci95"))


def feature_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample std of every column, long, from one aggregate row."""
    stats = df.agg(*[F.struct(F.avg(col(c)).alias("mean"), F.stddev_samp(col(c)).alias("std")).alias(c) for c in columns])
    return stats.unpivot([], list(columns), "feature", "s").select("feature", "s.mean", "s.std")


def vector_feature_summary(df: DataFrame, vector: str) -> DataFrame:
    long = df.select(F.posexplode(col(vector)).alias("dim", "x"))
    x = F.col("x").cast("double")
    return long.groupBy("dim").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count("x").alias("n"))


def corr_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], min_n: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r over the rows where both are present, long ``(x, y, n, r)``; below ``min_n`` rows r is missing.

    All pairs come from a single aggregate, so missing values need no separate pass per pair.
    """
    aggs = []
    for i, (x, y) in enumerate(pairs):
        both = col(x).isNotNull() & col(y).isNotNull()
        a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
        n = F.count_if(both)
        aggs.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), n.alias("n"),
                             F.when(n >= min_n, F.corr(a, b)).alias("r")).alias(f"p{i}"))
    wide = df.groupBy(*map(col, by)).agg(*aggs)
    cells = F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("c")
    return wide.select(*map(col, by), cells).select(*map(col, by), "c.x", "c.y", "c.n", "c.r")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations of ``columns``: upper triangle computed, both halves returned."""
    columns = list(columns)
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    half = corr_pairs(df, upper)
    other = half.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "n", "r")
    return half.unionByName(other)


def histogram(df: DataFrame, columns: Sequence[str], bins: int, shared_range: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bin counts, last bin closed; ``shared_range`` uses one range for all columns.

    Returns ``(by, column, bin, low, high, n, density)``; missing values are reported as bin -1.
    """
    long = _long_numbers(df, by, columns)
    range_keys = [] if shared_range else ["column"]
    ranges = long.groupBy(*range_keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row, or one per listed column.
    placed = long.join(F.broadcast(ranges), range_keys) if range_keys else long.join(F.broadcast(ranges))
    width = (F.col("hi") - F.col("lo")) / bins
    spot = F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    binned = placed.withColumn("bin", F.when(F.col("value").isNull(), -1).otherwise(F.coalesce(spot, F.lit(0))).cast("int"))
    counts = binned.groupBy(*map(col, by), "column", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    filled = F.sum(F.when(F.col("bin") >= 0, F.col("n"))).over(W.partitionBy(*map(col, by), "column"))
    return counts.select(
        *map(col, by), "column", "bin",
        F.when(F.col("bin") >= 0, F.col("lo") + F.col("bin") * width).alias("low"),
        F.when(F.col("bin") >= 0, F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n",
        F.when(F.col("bin") >= 0, F.try_divide(F.col("n"), filled * width)).alias("density"))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Exact quartiles with extremes and size per group."""
    q = exact_quantiles(df, by, value, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})
    return q


def percentile_bounds(df: DataFrame, value: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """One-sided lower bound, its verdict, and the two-sided 95 % interval of a distribution of results."""
    q = exact_quantiles(df, by, value, {"lower": alpha, "ci_low": 0.025, "ci_high": 0.975})
    return q.withColumn("above_zero", F.col("lower") > 0).withColumn("alpha", F.lit(alpha))


def best_row(df: DataFrame, score: str, first: Sequence[str], highest: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The row with the best score; among ties the first in the order of ``first``."""
    whole = F.struct(*map(col, df.columns))
    rank = F.struct((-col(score) if highest else col(score)).alias("s"), *map(col, first))
    known = df.where(col(score).isNotNull())
    return known.groupBy(*map(col, by)).agg(F.min_by(whole, rank).alias("r")).select("r.*")


def cohort_table(
    df: DataFrame, group: str, exclude: Sequence[str] = (), share_of: tuple[str, str] | None = None,
    categories: Sequence[str] = (), continuous: Sequence[str] = (),
) -> DataFrame:
    """Baseline characteristics, long ``(section, row, group, n, value, spread, label)``.

    Sections: group sizes; count and percentage (one decimal) of one category; counts of every category; mean (SD) with
    two decimals.  Long form keeps any number of categories distributed; ``pivot`` it for print.
    """
    kept = df.where(col(group).isNotNull() & ~col(group).isin(*exclude)) if exclude else df.where(col(group).isNotNull())
    g = col(group).alias("group")
    parts = []
    number = lambda c: c.cast("double")
    sizes = kept.groupBy(g).agg(F.count(F.lit(1)).alias("n"))
    parts.append(sizes.select(F.lit("total").alias("section"), F.lit("N").alias("row"), "group", "n",
                              number(F.lit(None)).alias("value"), number(F.lit(None)).alias("spread"),
                              F.col("n").cast("string").alias("label")))
    if share_of:
        c, level = share_of
        known = kept.where(col(c).isNotNull()).groupBy(g).agg(F.count_if(col(c) == level).alias("n"), F.count(F.lit(1)).alias("all"))
        pct = F.round(100.0 * F.col("n") / F.col("all"), 1)
        parts.append(known.select(F.lit("share"), F.lit(f"{c} ({level})"), "group", "n", pct, number(F.lit(None)),
                                  F.format_string("%d (%.1f%%)", F.col("n"), pct)))
    if categories:
        long = kept.select(g, *[col(c).cast("string").alias(c) for c in categories]).unpivot(["group"], list(categories), "section", "row")
        parts.append(long.where(F.col("row").isNotNull()).groupBy("section", "row", "group").agg(F.count(F.lit(1)).alias("n")).select(
            "section", "row", "group", "n", number(F.lit(None)), number(F.lit(None)), F.col("n").cast("string")))
    if continuous:
        long = _long_numbers(kept.withColumnRenamed(group, "group"), ["group"], continuous)
        stats = long.groupBy("column", "group").agg(F.count("value").alias("n"), F.round(F.avg("value"), 2).alias("m"),
                                                    F.round(F.stddev_samp("value"), 2).alias("s"))
        parts.append(stats.select(F.lit("continuous"), "column", "group", "n", "m", "s",
                                  F.format_string("%.2f (%.2f)", F.col("m"), F.col("s"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def joint_z_profile(groups: DataFrame, cluster: str, measures: Sequence[str], reverse: Sequence[str] = ()) -> DataFrame:
    """Mean and 95 % half-width of jointly standardised measures per cluster, some measures reversed first."""
    flipped = reverse_score(groups, reverse) if reverse else groups
    scaled = standardize(flipped, list(measures))
    long = scaled.unpivot([cluster], list(measures), "measure", "value")
    return mean_ci95(long, [cluster, "measure"], "value")
