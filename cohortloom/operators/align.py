"""Joining sources on a subject key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import col
from cohortloom.operators.rows import has_duplicates, stack


def align_sources(frames: Sequence[DataFrame], key: str, on_duplicates: str = "error") -> DataFrame:
    """Full outer alignment: one wide row per key holding the columns of every source.

    The sources are stacked and merged by key in a single shuffle with map-side combining, where a chain of outer
    joins would shuffle once per source.  Rows without a key match nothing and pass through.  A key repeated within one
    source is an error by default (found in the same pass); ``on_duplicates="join"`` checks first and then uses real
    outer joins, which pair up all copies.
    """
    names = [[c for c in f.columns if c != key] for f in frames]
    flat = [c for n in names for c in n]
    if len(set(flat)) != len(flat):
        raise ValueError("sources share a value column; rename before aligning")
    if on_duplicates == "join" and any(has_duplicates(f, key) for f in frames):
        return reduce(lambda a, b: a.join(b, key, "outer"), frames)
    tagged = stack([f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)])
    keyed = tagged.where(col(key).isNotNull())
    first = [F.first(col(c), ignorenulls=True).alias(c) for c in flat]
    copies = [F.count_if(F.col("_source") == i).alias(f"_n{i}") for i in range(len(frames))]
    merged = keyed.groupBy(col(key)).agg(*first, *copies)
    repeated = F.greatest(*[F.col(f"_n{i}") for i in range(len(frames))], F.lit(0)) > 1
    message = F.concat(F.lit(f"{key} repeats within a source: "), col(key).cast("string"))
    checked = merged.where(F.when(repeated, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    unkeyed = tagged.where(col(key).isNull())
    return stack([checked.select(key, *map(col, flat)), unkeyed.select(key, *map(col, flat))])


def lookup(left: DataFrame, right: DataFrame, key: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join.  ``null_safe`` lets missing keys match missing keys.  Catalyst picks broadcast by size."""
    return keyed_join(left, right, key, "left", null_safe)


def keyed_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str, null_safe: bool = False) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    if not null_safe:
        return left.join(right, keys, how)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, match, how)
    if how in ("outer", "full", "right"):
        merged = [F.coalesce(col(k), col(f"_right_{k}")).alias(k) for k in keys]
        rest = [col(c) for c in joined.columns if c not in keys and not c.startswith("_right_")]
        return joined.select(*merged, *rest)
    return joined.drop(*[f"_right_{k}" for k in keys])


def membership_flags(base: DataFrame, lists: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One column per list with the key where the subject is in that list, else missing.

    All lists are stacked and merged to one row of flags per key before the single join with ``base``.
    """
    tagged = stack([ids.select(col(key).alias(key), F.lit(name).alias("_list")) for name, ids in lists.items()])
    marks = tagged.where(col(key).isNotNull()).groupBy(col(key)).agg(
        *[F.max(F.when(F.col("_list") == n, col(key))).alias(n) for n in lists])
    return base.join(marks, key, "left")


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``before`` that are not in ``after``, compared on all columns with missing equal to missing."""
    return before.exceptAll(after)


def overlay(primary: DataFrame, fallback: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Union of ids; each ``{primary column: fallback column}`` takes the primary's value, else the fallback's.

    ``filled`` lists the columns that came from the fallback.  Stack and merge: one shuffle.
    """
    extra = [c for c in primary.columns if c != key and c not in columns]
    absent = [p for p in columns if p not in primary.columns]
    a = primary.select(col(key), *[col(c) for c in extra],
                       *[(F.lit(None) if p in absent else col(p)).alias(f"_a_{p}") for p in columns])
    b = fallback.select(col(key), *[col(f).alias(f"_b_{p}") for p, f in columns.items()])
    wide = align_sources([a, b], key)
    filled = F.array_compact(F.array(*[
        F.when(col(f"_a_{p}").isNull() & col(f"_b_{p}").isNotNull(), F.lit(p)) for p in columns]))
    return wide.select(col(key), *map(col, extra),
                       *[F.coalesce(col(f"_a_{p}"), col(f"_b_{p}")).alias(p) for p in columns], filled.alias("filled"))


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def pairs_of_groups(stats: DataFrame, group: str, within: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Unordered pairs of group-level rows (an aggregate, one row per group) that share the ``within`` columns."""
    a = stats.select(*map(col, within), col(group).alias("group1"), *[col(c).alias(f"{c}_1") for c in keep])
    b = stats.select(*map(col, within), col(group).alias("group2"), *[col(c).alias(f"{c}_2") for c in keep])
    return a.join(b, list(within)).where(F.col("group1") < F.col("group2"))
