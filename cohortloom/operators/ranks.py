"""Exact ordering statistics without ever sorting a whole group in one task.

The obvious plan for ranks, medians or cumulative minima is a window over the whole group, which puts all rows of a
measure into a single task.  Ranks: a mergeable sketch first proposes cut points per group (a small table whose size is
checked before it is broadcast).  They cut a group into slices; slice totals give every slice its starting offset, and
windows run inside slices of distinct values only.  The sketch decides where slices begin and never what the result is.
Quantiles: histograms over the leading bits of the values, refined only where a quantile lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.functions.cleaning import col
from cohortloom.functions.hashing import order_hash
from cohortloom.operators.align import keyed_join
from cohortloom.session import bounded_broadcast, quoted, settle

SLICES, MOST_SLICES = 64, 512
SLICE_ROWS = 100_000
CELL_SHIFTS = (42, 21, 0)  # low bits of a value's code that a cell leaves open, scan by scan
CELL_ROWS = 1_000_000  # rows of an open cell that are ordered by value


def _with_small(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach a per-group table that fits a broadcast (or, beyond the bound, does not and is joined by shuffle)."""
    checked = bounded_broadcast(small)
    return keyed_join(df, checked, by, "inner", null_safe=True) if by else df.join(checked)


def _offsets(counts: DataFrame, by: Sequence[str], order: Sequence[str], **extra: Column) -> DataFrame:
    """Rows before each slice: a window over one row per group and slice."""
    totals = counts.groupBy(*map(col, by), *order).agg(F.sum("n").alias("_m"), *[c.alias(k) for k, c in extra.items()])
    earlier = W.partitionBy(*map(col, by)).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*map(col, by), *order, *extra, F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_start"))


def slice_count(df: DataFrame) -> int:
    """Slices per group: as many as the session has shuffle partitions, within bounds."""
    return min(MOST_SLICES, max(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _cuts_below(x: Column, cuts: Column, size: int) -> Column:
    """How many of the sorted cuts lie below x, as a decision tree of comparisons (stays in generated code)."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(cuts[mid] < x, search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, size)


def ranked_counts(
    df: DataFrame, by: Sequence[str], value: str, hit: Column | None = None, slices: int | None = None, copies: str | None = None,
) -> DataFrame:
    """One row per distinct ``(by, value)``: ``n`` copies, ``before`` smaller rows, ``total`` rows of the group.

    With ``hit`` the copies that meet the condition are counted as ``hits``.  ``slice`` tells the slice.  Missing values
    are left out.  With ``copies`` a row stands for as many rows as that column says.
    """
    by = list(by)
    slices = slices or slice_count(df)
    hit = F.coalesce(hit, F.lit(False)) if hit is not None else None
    known = df.where(col(value).isNotNull())

    def many(condition: Column) -> Column:
        return F.sum(F.when(condition, col(copies)).otherwise(0)) if copies else F.count_if(condition)

    probs = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = known.groupBy(*map(col, by)).agg(
        F.percentile_approx(col(value), probs, 10 * slices).alias("_cuts"), many(F.lit(True)).alias("total"))
    grouped = known.groupBy(*map(col, by), col(value).alias("value"))
    if hit is None:
        counts = grouped.agg(many(F.lit(True)).alias("n"))
    else:
        # Both parts make up n, so the slice totals and the ranking read the same shuffle.
        counts = grouped.agg(many(hit).alias("hits"), many(~hit).alias("_others"))
        counts = counts.withColumn("n", F.col("hits") + F.col("_others")).drop("_others")
    counts = _with_small(counts, cuts, by).withColumn("slice", _cuts_below(F.col("value"), F.col("_cuts"), slices - 1)).drop("_cuts")
    placed = keyed_join(counts, _offsets(counts, by, ["slice"]), [*by, "slice"], "inner", null_safe=True)
    inside = W.partitionBy(*map(col, by), "slice").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return placed.withColumn("before", before).drop("_start")


def avg_rank(df: DataFrame, by: Sequence[str], value: str, hit: Column | None = None, copies: str | None = None) -> DataFrame:
    """Mid-ranks (ties share the mean of their positions), one row per distinct value."""
    ranked = ranked_counts(df, by, value, hit, copies=copies)
    return ranked.withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2)


def _histogram(rows: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """Rows, least and largest value per key and cell; a cell is the leading bits of a value's order-preserving 64-bit code."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("_x").to_numpy(zero_copy_only=False) + 0.0  # -0 counts as 0
            code = x.view(np.int64)
            code = (code ^ (code >> 63 & np.int64(2**63 - 1))) >> shift
            table = pa.table([*(b.column(k) for k in keys), pa.array(code), pa.array(x)], names=[*keys, "_cell", "_x"])
            counted = table.group_by([*keys, "_cell"]).aggregate([([], "count_all"), ("_x", "min"), ("_x", "max")])
            out = counted.select([*keys, "_cell", "count_all", "_x_min", "_x_max"]).rename_columns([*keys, "_cell", "n", "lo", "hi"])
            yield from out.combine_chunks().to_batches()

    schema = ", ".join([*(f"{quoted(k)} {kinds[k]}" for k in keys), "_cell long, n long, lo double, hi double"])
    found = rows.select(*map(col, keys), "_x").mapInArrow(cells, schema)
    return found.groupBy(*map(col, keys), "_cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``; NULLs are left out.  Values are taken as doubles.

    One scan counts the rows by the leading bits of the values (a cell spans a thousandth of a power of two), with the least and
    largest value of every cell.  Many quantiles are known then: the ends of a cell, and cells of one value.  For the others the rows
    of their cell alone are counted by value, after splitting it by further bits for as long as it holds over ``CELL_ROWS`` rows.
    Nothing is estimated, so neither lumps nor outliers matter.
    """
    by, names = list(by), list(probs)
    known = df.where(col(value).isNotNull()).select(*map(col, by), col(value).cast("double").alias("_x"))

    def before(keys: Sequence[str], order: str) -> Column:
        earlier = W.partitionBy(*map(col, keys)).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(earlier), F.lit(0))

    def inside(rest: DataFrame) -> DataFrame:
        """Rows of the open cells, once per quantile that needs them."""
        both = _with_small(known, rest.select(*map(col, by), "_t", "_k", "_total", "_start", "lo", "hi"), by)
        return both.where(F.col("_x").between(F.col("lo"), F.col("hi"))).select(*map(col, by), "_t", "_x")

    keys = [*by, "_t"]
    here = (F.col("_start") <= F.col("_k")) & (F.col("_k") < F.col("_start") + F.col("n"))
    columns = [*map(col, by), "_t", "_k", "_total", "_start", "n", "lo", "hi"]
    total = F.sum("n").over(W.partitionBy(*map(col, by)))
    counted = _histogram(known, by, CELL_SHIFTS[0]).withColumns({"_start": before(by, "_cell"), "_total": total})
    positions = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs.values()]
    targets = F.explode(F.array(*[F.struct(F.lit(2 * j + up).alias("_t"), (F.ceil if up else F.floor)(at).alias("_k")) for j, at in enumerate(positions) for up in (0, 1)]))
    cell, _ = settle(counted.withColumn("_target", targets).select("*", "_target.*").where(here).select(*columns))
    end = F.when(F.col("_k") == F.col("_start"), F.col("lo")).when(F.col("_k") == F.col("_start") + F.col("n") - 1, F.col("hi")).when(F.col("lo") == F.col("hi"), F.col("lo"))
    done = []
    for shift in [*CELL_SHIFTS[1:], None]:
        done.append(cell.withColumn("_v", end).where(F.col("_v").isNotNull()).select(*map(col, keys), "_total", "_v"))
        rest = cell.where(end.isNull())
        largest = rest.agg(F.max("n")).first()[0]
        if largest is None:
            break
        place = rest.select(*map(col, keys), "_k", "_total", F.col("_start").alias("_first"))
        if largest <= CELL_ROWS or shift is None:
            counts = inside(rest).groupBy(*map(col, keys), "_x").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", before(keys, "_x"))
            found = keyed_join(counts, place, keys, "inner", null_safe=True).withColumn("_start", F.col("_first") + F.col("_before")).where(here)
            done.append(found.select(*map(col, keys), "_total", F.col("_x").alias("_v")))
            break
        finer = _histogram(inside(rest), keys, shift).withColumn("_before", before(keys, "_cell"))
        cell, _ = settle(keyed_join(finer, place, keys, "inner", null_safe=True).withColumn("_start", F.col("_first") + F.col("_before")).where(here).select(*columns))
    every = reduce(DataFrame.unionByName, done)
    aggs = []
    for j, name in enumerate(names):
        position = F.lit(float(probs[name])) * (F.col("_total") - 1)
        low, high = (F.max(F.when(F.col("_t") == 2 * j + up, F.col("_v"))) for up in (0, 1))
        aggs.append((low + (high - low) * F.max(position - F.floor(position))).alias(name))
    return every.groupBy(*map(col, by)).agg(*aggs)


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, by, value, {name: 0.5})


def hashed_row_number(df: DataFrame, by: Sequence[str], key: str | Column, seed: int = 42, name: str = "position",
                      digits: int | None = None) -> DataFrame:
    """Random but reproducible row numbers 1..n within each ``by`` group, ordered by the md5 of the key.

    Hash texts are uniform, so their first ``digits`` hex digits cut every group into equal slices (16**digits); only the
    slice counts meet in one place.  By default there are as many digits as keep a slice at some 100,000 rows, at least
    three; the numbers do not depend on it.  ``group_rows`` is the size of the group.
    """
    by = list(by)
    if digits is None:
        digits = max(3, math.ceil(math.log(max(df.count(), 1) / SLICE_ROWS, 16)))
    marked = df.withColumn("_order", order_hash(key, seed)).withColumn("_slice", F.substring("_order", 1, digits))
    counts = marked.groupBy(*map(col, by), "_slice").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.sum("_size").over(W.partitionBy(*map(col, by)))
    starts = _offsets(counts, by, ["_slice"])
    totals = keyed_join(starts, counts.withColumnRenamed("n", "_size"), [*by, "_slice"], "inner", null_safe=True)
    small = totals.withColumn("group_rows", sizes).drop("_size")
    placed = keyed_join(marked, small, [*by, "_slice"], "inner", null_safe=True)
    inside = W.partitionBy(*map(col, by), "_slice").orderBy("_order")
    return placed.withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_order", "_slice", "_start")


def fdr_bh(df: DataFrame, p: str, by: Sequence[str] = (), alpha: float = 0.05, out: str = "p_fdr", small: int = 100_000) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values: the reverse cumulative minimum of p x m / rank, at most 1.

    The table of tests is computed once.  A usual one (up to ``small`` tests) is adjusted by plain windows; millions of
    tests use slices: slice minima are accumulated from the top down, and each slice needs only the minimum of the slices
    above it.
    """
    by = list(by)
    tests, is_small = settle(df, small)
    if is_small:
        family = W.partitionBy(*map(col, by))
        tied = family.orderBy(col(p))
        raw = col(p) * F.count(col(p)).over(family) / F.count(col(p)).over(tied)
        lowest = F.min("_raw").over(family.orderBy(col(p).desc()))
        done = tests.withColumn("_raw", F.when(col(p).isNotNull(), raw)).withColumn(out, F.when(col(p).isNotNull(), F.least(lowest, F.lit(1.0))))
        return done.drop("_raw").withColumn("significant", F.col(out) < alpha)
    raw = ranked_counts(tests, by, p).withColumn("_raw", F.col("value") * F.col("total") / (F.col("before") + F.col("n")))
    mins = raw.groupBy(*map(col, by), "slice").agg(F.min("_raw").alias("_least"))
    above = W.partitionBy(*map(col, by)).orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    tops = mins.select(*map(col, by), "slice", F.min("_least").over(above).alias("_above"))
    inside = W.partitionBy(*map(col, by), "slice").orderBy(F.col("value").desc()).rowsBetween(W.unboundedPreceding, 0)
    joined = keyed_join(raw, tops, [*by, "slice"], "inner", null_safe=True)
    adjusted = joined.select(*map(col, by), F.col("value").alias(p), F.least(F.min("_raw").over(inside), F.col("_above"), F.lit(1.0)).alias(out))
    return keyed_join(tests, adjusted, [*by, p], "left", null_safe=True).withColumn("significant", F.col(out) < alpha)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group; Spark limits each group on the map side before the shuffle."""
    w = W.partitionBy(*map(col, by)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def sort_abs(df: DataFrame, value: str, *ties: str) -> DataFrame:
    return df.orderBy(F.abs(col(value)).desc(), *map(col, ties))
