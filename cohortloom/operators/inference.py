"""Group-difference and association tests.  Statistics are Spark aggregates; p-values are added to the result table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cohortloom.functions import tails
from cohortloom.functions.cleaning import col
from cohortloom.functions.hashing import REPLICATE_PRIME, with_replicate_hashes
from cohortloom.operators.align import pairs_of_groups
from cohortloom.operators.packed import PIECES, collected, pieces
from cohortloom.operators.ranks import avg_rank
from cohortloom.operators.suffstats import Moments
from cohortloom.session import cut_lineage, local_table

PERMUTED = 1000  # replicates of one scan
PERMUTED_ROWS = 200_000  # of a task, each of which costs work for every replicate
SLICE_BITS = 10

@F.pandas_udf(T.DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else tails.t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(c) else tails.f_sf(a, b, c) for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else tails.chi2_sf(a, b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else min(1.0, 2 * tails.normal_sf(abs(a))) for a in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_rank_sum(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(c) else tails.rank_sum_two_sided(int(a), int(b), c) for a, b, c in zip(n1, n2, u)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([tails.fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_tukey(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else tails.studentized_range_sf(a, int(b), c) for a, b, c in zip(q, k, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def tukey_critical(alpha: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    out = []
    for key in zip(alpha, k, df):
        if key not in seen:
            seen[key] = tails.studentized_range_quantile(key[0], int(key[1]), key[2])
        out.append(seen[key])
    return pd.Series(out, dtype="float64")


def pearson_test(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """r, t, p, and the fitted line y = intercept + slope x, per pair over the rows that have both."""
    cells = []
    for i, (x, y) in enumerate(pairs):
        both = col(x).isNotNull() & col(y).isNotNull()
        a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
        cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.count_if(both).alias("n"), F.corr(a, b).alias("r"),
                              F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept")).alias(f"p{i}"))
    wide = df.groupBy(*map(col, by)).agg(*cells)
    flat = wide.select(*map(col, by), F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("c"))
    out = flat.select(*map(col, by), "c.*")
    out = out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))
    return out.withColumn("p", p_t("t", F.col("n") - 2)) if p_values else out


def mann_whitney(df: DataFrame, group: str, group1, group2, value: str, by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """U of the first group, with the tie- and continuity-corrected z; ``by`` tests many measures at once.

    Only distinct values with their counts are ranked (see ``ranks``), so neither a measure nor a heavily tied value has
    to fit in one task.
    """
    return rank_test(df.where(col(group).isin(group1, group2)), value, col(group) == group1, by, p_values)


SMALL_SAMPLE = 8  # rows of the smaller sample up to which p is exact
MOST_OUTCOMES = 20_000  # n1 x n2


def rank_test(df: DataFrame, value: str, first: Column, by: Sequence[str] = (), p_values: bool = True, copies: str | None = None) -> DataFrame:
    """Rank-sum test of the rows where ``first`` holds against the others, per ``by``; with ``copies`` a row stands for so many.

    p is exact for small samples without ties (``SMALL_SAMPLE``), else that of the tie- and continuity-corrected normal.
    """
    ranked = avg_rank(df, by, value, first, copies)
    sums = ranked.groupBy(*map(col, by)).agg(
        F.sum("hits").alias("n1"), F.sum(F.col("n") - F.col("hits")).alias("n2"), F.sum(F.col("hits") * F.col("avg_rank")).alias("r1"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    top = F.greatest(u, n1 * n2 - u)
    z = F.try_divide(top - n1 * n2 / 2 - 0.5, sd)
    # Without ties and with a small sample p is counted out, as long as there are few outcomes; else the normal tail.
    small = (F.col("ties") == 0) & (F.least("n1", "n2").between(1, SMALL_SAMPLE)) & (n1 * n2 <= MOST_OUTCOMES)
    out = sums.select(*map(col, by), "n1", "n2", u.alias("u"), z.alias("z"), small.alias("_small"))
    if not p_values:
        return out.drop("_small")
    counted = p_rank_sum(F.when(F.col("_small"), F.col("n1")).otherwise(1), F.when(F.col("_small"), F.col("n2")).otherwise(1), F.when(F.col("_small"), F.col("u")))
    return out.withColumn("p", F.when(F.col("_small"), counted).otherwise(p_normal("z"))).drop("_small")


def _group_stats(df: DataFrame, group: str, value: str, by: Sequence[str]) -> DataFrame:
    known = df.where(col(value).isNotNull() & col(group).isNotNull())
    return known.groupBy(*map(col, by), col(group)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col(value)).alias("mean"), F.var_pop(col(value)).alias("var"))


def anova_oneway(df: DataFrame, group: str, value: str, by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """F of equal group means from per-group count, mean and variance."""
    stats = _group_stats(df, group, value, by)
    n, m = F.col("n"), F.col("mean")
    sums = stats.groupBy(*map(col, by)).agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("total"), F.sum(n * m).alias("sm"), F.sum(n * m * m).alias("smm"),
        F.sum(n * F.col("var")).alias("within"))
    between = F.col("smm") - F.col("sm") * F.col("sm") / F.col("total")
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    out = sums.select(*map(col, by), d1.alias("df1"), d2.alias("df2"),
                      F.try_divide(between / d1, F.col("within") / d2).alias("f"))
    return out.withColumn("p", p_f("f", "df1", "df2")) if p_values else out


def ttest_pooled(df: DataFrame, group: str, group1, group2, value: str, by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """Equal-variance two-sample t."""
    x = col(value).cast("double")
    a, b = F.when(col(group) == group1, x), F.when(col(group) == group2, x)
    stats = df.groupBy(*map(col, by)).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
                                          F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / n1 + 1 / n2)))
    out = stats.select(*map(col, by), "n1", "n2", t.alias("t"), (n1 + n2 - 2).alias("df"))
    return out.withColumn("p", p_t("t", "df")) if p_values else out


def tukey_hsd(df: DataFrame, group: str, value: str, by: Sequence[str] = (), alpha: float = 0.05, p_values: bool = True) -> DataFrame:
    """Pairwise mean differences (second minus first), studentised range q, adjusted p, simultaneous interval."""
    stats = _group_stats(df, group, value, by)
    pooled = stats.groupBy(*map(col, by)).agg(
        F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"),
        (F.sum(F.col("n") * F.col("var")) / (F.sum("n") - F.count(F.lit(1)))).alias("mse"))
    keyed = [*by, "_one"]
    pairs = pairs_of_groups(stats.withColumn("_one", F.lit(1)), group, keyed, ["n", "mean"])
    joined = pairs.join(pooled.withColumn("_one", F.lit(1)), keyed)
    diff = F.col("mean_2") - F.col("mean_1")
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("n_1") + 1 / F.col("n_2")))
    out = joined.select(*map(col, by), "group1", "group2", diff.alias("diff"), (F.abs(diff) / se).alias("q"), "k", "df", se.alias("_se"))
    if not p_values:
        return out.drop("_se")
    half = tukey_critical(F.lit(float(alpha)), "k", "df") * F.col("_se")
    return out.withColumn("p_adj", p_tukey("q", "k", "df")).withColumn("low", F.col("diff") - half).withColumn(
        "high", F.col("diff") + half).withColumn("reject", F.col("p_adj") < alpha).drop("_se")


def chi2_independence(df: DataFrame, a: str, b: str, p_values: bool = True) -> DataFrame:
    """Chi-square of a contingency table, with the continuity correction when it is 2x2.  Empty cells count.

    The data are reduced to one count per observed cell.  The sum over all cells is n * sum(o^2 / (r c)) - n, to which empty cells
    add nothing, so the grid of categories is never built.  In a 2x2 table all four gaps |o - r c / n| are equal, so one observed
    cell and the margins give the corrected value.
    """
    counts = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).alias("a"), col(b).alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("o"))
    rows, cols = (counts.groupBy(k).agg(F.sum("o").alias(m)) for k, m in (("a", "r"), ("b", "c")))
    none = F.lit(None).cast("double")
    cells = counts.join(rows, "a").join(cols, "b").select("o", (F.col("r") * F.col("c")).alias("rc"), none.alias("r"), none.alias("c"))
    parts = cells.unionByName(rows.select("r"), allowMissingColumns=True).unionByName(cols.select("c"), allowMissingColumns=True)
    sums = parts.agg(F.sum("r").cast("long").alias("n"), F.count("r").alias("ra"), F.count("c").alias("cb"), F.sum(F.col("o") * F.col("o") / F.col("rc")).alias("share"),
                     F.max(F.struct("o", "rc")).alias("cell"), (F.sum(1 / F.col("r")) * F.sum(1 / F.col("c"))).alias("inverse")).where("n > 0")
    gap = F.abs(F.col("cell.o") - F.col("cell.rc") / F.col("n"))
    fixed = gap - F.least(F.lit(0.5), gap)
    chi2 = F.when((F.col("ra") == 2) & (F.col("cb") == 2), fixed * fixed * F.col("n") * F.col("inverse")).otherwise(F.greatest(F.col("n") * F.col("share") - F.col("n"), F.lit(0.0)))
    out = sums.select(chi2.alias("chi2"), ((F.col("ra") - 1) * (F.col("cb") - 1)).alias("dof"), "n")
    return out.withColumn("p", p_chi2("chi2", "dof")) if p_values else out


def two_by_two(df: DataFrame, row: str, row1, row2, column: str, col1, col2, by: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """Cells, sample odds ratio and Fisher's exact p of 2x2 tables (one per ``by``)."""
    cell = lambda r, c: F.count_if((col(row) == r) & (col(column) == c))
    t = df.groupBy(*map(col, by)).agg(cell(row1, col1).alias("a"), cell(row1, col2).alias("b"), cell(row2, col1).alias("c"), cell(row2, col2).alias("d"))
    out = t.withColumn("odds_ratio", F.try_divide(F.col("a").cast("double") * F.col("d"), F.col("b").cast("double") * F.col("c")))
    return out.withColumn("p", p_fisher("a", "b", "c", "d")) if p_values else out


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of a continuous score for 0/1 labels; ties count one half."""
    ranked = avg_rank(df.where(col(label).isNotNull()), by, score, col(label) == 1)
    sums = ranked.groupBy(*map(col, by)).agg(
        F.sum("hits").alias("n1"), F.sum(F.col("n") - F.col("hits")).alias("n0"), F.sum(F.col("hits") * F.col("avg_rank")).alias("r"))
    n1 = F.col("n1").cast("double")
    return sums.select(*map(col, by), "n1", "n0", F.try_divide(F.col("r") - n1 * (n1 + 1) / 2, n1 * F.col("n0")).alias("auc"))


def permuted_auc(df: DataFrame, key: str, score: str, label: str, replicates: int, seed: int = 42) -> DataFrame:
    """AUC after shuffling the labels, one row per replicate ``(rep, auc)``.

    Shuffling labels means drawing the positives anew: in each replicate the n1 rows with the smallest random numbers
    are the positives.  Scores are ranked once and keys are hashed once.  One scan counts and sums the ranks by slices of the
    numbers, for many replicates together and without copies of rows; only the one slice of a replicate that holds the cut is sorted.
    """
    pool = cut_lineage(df.where(col(score).isNotNull() & col(label).isNotNull()).select(
        col(key).alias("_key"), col(score).alias("value"), col(label).alias("_label")))
    ranks = avg_rank(pool, [], "value").select("value", "avg_rank")
    sizes = pool.agg(F.count_if(F.col("_label") == 1).alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n = int(sizes["n1"]), int(sizes["n"])
    rows = cut_lineage(with_replicate_hashes(pool.join(ranks, "value"), "_key", seed).select("_key", "avg_rank", "_h1", "_h2"))
    if not n1:
        return local_table(df.sparkSession, [], "rep int, auc double")
    # Every row costs work for every replicate, so rows are dealt by their number and not by their bytes.
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PERMUTED_ROWS)))
    totals = reduce(DataFrame.unionByName, [_drawn_ranks(rows, a, min(PERMUTED, replicates - a), n1, n) for a in range(0, replicates, PERMUTED)])
    return totals.select("rep", ((F.col("r") - n1 * (n1 + 1) / 2) / (float(n1) * (n - n1))).alias("auc"))


def _drawn_ranks(rows: DataFrame, first: int, many: int, n1: int, n: int) -> DataFrame:
    """(rep, r): in each of ``many`` replicates the sum of the ranks of the ``n1`` rows with the smallest numbers."""
    # Slices hold some dozens of rows at least; slice 0 is for keys without hashes.
    width = -(-REPLICATE_PRIME // 2 ** min(SLICE_BITS, max(2, (n // 64).bit_length())))
    slices = REPLICATE_PRIME // width + 2

    def numbers(b: pa.RecordBatch):
        h1, h2 = (b.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("_h1", "_h2"))
        for i in range(many):
            yield i, np.where(h1 < 0, -1, (h1 + h2 * (first + i)) % REPLICATE_PRIME)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, 2, slices))
        for b in batches:
            rank = b.column("avg_rank").to_numpy()
            for i, number in numbers(b):
                at = number // width + 1
                total[i, 0] += np.bincount(at, minlength=slices)
                total[i, 1] += np.bincount(at, rank, slices)
        yield from pieces("", total.ravel())

    size = many * 2 * slices
    total = collected(rows.select("avg_rank", "_h1", "_h2").mapInArrow(partial, PIECES), size, 1).get("", np.zeros(size)).reshape(many, 2, slices)
    upto = np.cumsum(total[:, 0], axis=1)
    taken = upto <= n1
    below = [(first + i, float(total[i, 1][taken[i]].sum())) for i in range(many)]
    cut = np.minimum(taken.sum(axis=1), slices - 1)
    need = n1 - np.where(cut > 0, upto[np.arange(many), cut - 1], 0)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, number in numbers(b):
                at = np.flatnonzero((number >= (cut[i] - 1) * width) & (number < cut[i] * width))
                if need[i] > 0 and len(at):
                    own = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + i, np.int32)), pa.array(number[at]), own.column("_key"), own.column("avg_rank")],
                                                     ["rep", "_order", "_key", "avg_rank"])

    spark, kind = rows.sparkSession, rows.schema["_key"].dataType.simpleString()
    wanted = local_table(spark, [(first + i, int(need[i])) for i in range(many)], "rep int, need long")
    crowd = rows.mapInArrow(inside, f"rep int, _order long, _key {kind}, avg_rank double").join(F.broadcast(wanted), "rep")
    picked = crowd.withColumn("_i", F.row_number().over(W.partitionBy("rep").orderBy("_order", "_key"))).where(F.col("_i") <= F.col("need"))
    return local_table(spark, below, "rep int, ranks double").unionByName(picked.select("rep", F.col("avg_rank").alias("ranks"))).groupBy("rep").agg(F.sum("ranks").alias("r"))


def permutation_test(df: DataFrame, key: str, score: str, label: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Observed AUC and p = (number of shuffles at least as good + 1) / (replicates + 1)."""
    observed = auc(df, score, label).select(F.col("auc").alias("observed"))
    null = permuted_auc(df, key, score, label, replicates, seed)
    joined = null.join(F.broadcast(observed))  # one row
    return joined.groupBy("observed").agg(
        ((F.count_if(F.col("auc") >= F.col("observed")) + 1) / F.lit(replicates + 1.0)).alias("p"), F.count(F.lit(1)).alias("replicates"))


def manova(groups: Moments, spark) -> DataFrame:
    """Wilks, Pillai, Hotelling-Lawley and Roy for a group factor, from the moments per group."""
    e = sum(groups.pick([i]).scatter for i in range(len(groups.keys)))
    return _manova_rows(groups.total().scatter - e, e, len(groups.keys) - 1, groups.total().size - len(groups.keys), spark)


def manova_continuous(m: Moments, features: Sequence[str], x: str, spark) -> DataFrame:
    """The same for one continuous predictor, from the joint moments of features and predictor."""
    c, i = m.scatter, [m.columns.index(f) for f in features]
    j = m.columns.index(x)
    b = c[i, j]
    h = np.outer(b, b) / c[j, j]
    return _manova_rows(h, c[np.ix_(i, i)] - h, 1, m.size - 2, spark)


def _manova_rows(h: np.ndarray, e: np.ndarray, q: float, v: float, spark) -> DataFrame:
    """Rao's and Pillai's F approximations of the four statistics."""
    p = len(e)
    low = np.linalg.inv(np.linalg.cholesky(e))
    lam = np.clip(np.linalg.eigvalsh(low @ h @ low.T), 0, None)
    wilks, pillai, trace, roy = np.prod(1 / (1 + lam)), np.sum(lam / (1 + lam)), lam.sum(), lam.max()
    s = min(p, q)
    m, n = (abs(p - q) - 1) / 2, (v - p - 1) / 2
    t = np.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    r, u = v - (p - q + 1) / 2, (p * q - 2) / 4
    rows = []

    def add(name, value, f, d1, d2):
        rows.append((name, float(value), float(f), float(d1), float(d2), tails.f_sf(f, d1, d2)))

    root = wilks ** (1 / t)
    add("wilks", wilks, (1 - root) / root * (r * t - 2 * u) / (p * q), p * q, r * t - 2 * u)
    add("pillai", pillai, (2 * n + s + 1) / (2 * m + s + 1) * pillai / (s - pillai), s * (2 * m + s + 1), s * (2 * n + s + 1))
    if n > 0:
        b = (p + 2 * n) * (q + 2 * n) / (2 * (2 * n + 1) * (n - 1))
        d2 = 4 + (p * q + 2) / (b - 1)
        c = (d2 - 2) / (2 * n)
        add("hotelling_lawley", trace, d2 / c * trace / (p * q), p * q, d2)
    else:
        add("hotelling_lawley", trace, 2 * (s * n + 1) * trace / (s * s * (2 * m + s + 1)), s * (2 * m + s + 1), 2 * (s * n + 1))
    rmax = max(p, q)
    add("roy", roy, (v - rmax + q) / rmax * roy, rmax, v - rmax + q)
    return local_table(spark, rows, "statistic string, value double, f double, df1 double, df2 double, p double")
