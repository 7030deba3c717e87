"""Choosing, renaming and ordering columns by name; pure planning work over ``df.columns``."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from cohortloom.functions.cleaning import col


def keep(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Listed columns in list order; names the table does not have are ignored."""
    have = set(df.columns)
    return df.select(*[col(c) for c in names if c in have])


def drop(df: DataFrame, names: Iterable[str]) -> DataFrame:
    gone = set(names)
    return df.select(*[col(c) for c in df.columns if c not in gone])


def _holds(name: str, parts: Sequence[str], case: bool) -> bool:
    return any(p in name for p in parts) if case else any(p.lower() in name.lower() for p in parts)


def keep_containing(df: DataFrame, parts: Sequence[str], always: Iterable[str] = (), case: bool = True) -> DataFrame:
    always = set(always)
    return df.select(*[col(c) for c in df.columns if c in always or _holds(c, parts, case)])


def drop_containing(df: DataFrame, parts: Sequence[str], except_names: Iterable[str] = (), case: bool = True) -> DataFrame:
    spared = set(except_names)
    return df.select(*[col(c) for c in df.columns if c in spared or not _holds(c, parts, case)])


def matching(df: DataFrame, pattern: str, without: Iterable[str] = ()) -> list[str]:
    """Names matching a regular expression, minus exceptions (absent exceptions are fine)."""
    gone = set(without)
    return [c for c in df.columns if re.search(pattern, c) and c not in gone]


def select_regex(df: DataFrame, pattern: str, always: Sequence[str] = (), without: Iterable[str] = ()) -> DataFrame:
    chosen = matching(df, pattern, without)
    return df.select(*[col(c) for c in always], *[col(c) for c in chosen if c not in always])


def feature_set(df: DataFrame, name: str, sets: Mapping[str, Mapping], key: Sequence[str]) -> DataFrame:
    """Named feature set: ``{name: {"pattern": regex, "covariates": [...], "without": [...]}}``."""
    spec = sets[name]
    always = [*key, *[c for c in spec.get("covariates", ()) if c in df.columns]]
    return select_regex(df, spec["pattern"], always, spec.get("without", ()))


def rename_affix(df: DataFrame, prefix: str = "", suffix: str = "", except_names: Iterable[str] = ()) -> DataFrame:
    spared = set(except_names)
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in df.columns if c not in spared})


def strip_affix(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return df.withColumnsRenamed({c: c.removeprefix(prefix).removesuffix(suffix) for c in df.columns})


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def move_column(df: DataFrame, name: str, position: int) -> DataFrame:
    order = [c for c in df.columns if c != name]
    order.insert(position, name)
    return df.select(*[col(c) for c in order])
