"""Cleaning, recoding, date and arithmetic functions.

Functions named after a value (``consensus``, ``bin_label`` ...) return a Column.  Functions that take ``df`` rewrite
many columns at once and always build one ``select``, so that several hundred columns still give one short plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import levels, local_table, quoted, small_rows

# Cell texts that mean "missing" in raw cohort files.
MISSING_TOKENS = ("#NULL!", ".", "nan", "NaN", "Unknown", "not_answered")
# The shorter token list used where unanswered items are kept.
MISSING_TOKENS_BASIC = ("#NULL!", ".", "nan", "NaN", "Unknown")
# Fixed value: days in a month when ages are given in months.
DAYS_PER_MONTH = 30.44

# Text that a lenient number parser accepts; excludes forms like "1d" that only the JVM takes.
_NUMBER = r"(?i)^\s*[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?\s*$|^\s*[-+]?inf(inity)?\s*$"


def col(name: str | Column) -> Column:
    return name if isinstance(name, Column) else F.col(quoted(name))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def rewrite(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """Replace or add columns in a single projection, keeping the column order."""
    kept = [changes[c].alias(c) if c in changes else col(c) for c in df.columns]
    added = [v.alias(k) for k, v in changes.items() if k not in df.columns]
    return df.select(*kept, *added)


def apply_to(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    return rewrite(df, {c: fn(col(c)) for c in columns})


# ---------------------------------------------------------------- missing values and types


def null_sentinels(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS, columns: Iterable[str] | None = None) -> DataFrame:
    """Whole-cell sentinel texts become NULL in the text columns."""
    targets = string_columns(df) if columns is None else list(columns)
    return apply_to(df, targets, lambda c: F.when(~c.isin(*tokens), c))


def as_number(c: str | Column) -> Column:
    """Text to double; anything that is not a number, and NaN, becomes NULL."""
    c = col(c)
    value = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL: from here on there is one kind of missing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return apply_to(df, floats, lambda c: F.when(~F.isnan(c), c))


def coerce_numeric(df: DataFrame, keep: Iterable[str] = (), columns: Iterable[str] | None = None) -> DataFrame:
    """Every text column but ``keep`` becomes double, unreadable cells NULL."""
    keep = set(keep)
    targets = [c for c in (string_columns(df) if columns is None else columns) if c not in keep]
    return apply_to(df, targets, as_number)


# ---------------------------------------------------------------- combining columns


def merge_twin_columns(
    df: DataFrame, second: str = "VSA-CVD", first: str = "VSA", merged: str = "VSD-All",
    tokens: Sequence[str] = MISSING_TOKENS_BASIC,
) -> DataFrame:
    """Columns that exist once per collection mode are merged: first mode's value, else the second's.

    A column holding ``second`` in its name is paired with the same name holding ``first``; the merged column takes
    ``merged`` in its place and both originals go.  Columns without a twin stay.
    """
    clean = null_sentinels(df, tokens)
    pairs = {c: c.replace(second, first) for c in df.columns if second in c}
    pairs = {b: a for b, a in pairs.items() if a in df.columns}
    gone = set(pairs) | set(pairs.values())
    kept = [col(c) for c in df.columns if c not in gone]
    made = [F.coalesce(col(a), col(b)).alias(b.replace(second, merged)) for b, a in pairs.items()]
    return clean.select(*kept, *made)


def coalesce_columns(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{new: [first choice, second choice, ...]}``: first non-missing value; the originals are dropped."""
    gone = {c for members in groups.values() for c in members}
    kept = [col(c) for c in df.columns if c not in gone]
    return df.select(*kept, *[F.coalesce(*map(col, members)).alias(new) for new, members in groups.items()])


def consensus(*columns: str | Column) -> Column:
    """The value of a row's copies if all non-missing copies agree, else NULL."""
    copies = [col(c) for c in columns]
    if len(copies) == 1:
        return copies[0]
    return F.when(F.least(*copies) == F.greatest(*copies), F.least(*copies))


def invalidate(score: str | Column, code: str | Column, bad: float = 3) -> Column:
    """The score, unless its validity code equals ``bad``; an unreadable or missing code keeps the score."""
    return F.when(as_number(col(code).cast("string")).eqNullSafe(F.lit(float(bad))), None).otherwise(col(score))


def overlay_value(primary: str | Column, fallback: str | Column) -> Column:
    return F.coalesce(col(primary), col(fallback))


# ---------------------------------------------------------------- labels and codes


def label_from_text(c: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first needle (literal, case-sensitive) found in the text; NULL if none is."""
    c, out = col(c), None
    for needle, label in rules:
        hit = c.contains(needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def route_value(selector: str | Column, first: str | Column, second: str | Column, x: str, y: str) -> tuple[Column, Column]:
    """Two scores stored in either order: returns (score of ``x``, score of ``y``) as told by the selector."""
    s = col(selector)
    to_x = F.when(s == x, col(first)).when(s == y, col(second))
    to_y = F.when(s == y, col(first)).when(s == x, col(second))
    return to_x, to_y


def cross_label(a: str | Column, b: str | Column, table: Mapping[tuple[str, str], str]) -> Column:
    """Label for a pair of categories; pairs not in the table give NULL."""
    out = None
    for (va, vb), label in table.items():
        hit = (col(a) == va) & (col(b) == vb)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


# Risk and diagnosis give the study group.
RISK_GROUPS = {("HR", "ASD+"): "HR+", ("HR", "ASD-"): "HR-", ("LR", "ASD+"): "LR+", ("LR", "ASD-"): "LR-"}


def bin_label(score: str | Column, rules: Sequence[tuple[str, float, str]]) -> Column:
    """Ordered ``(operator, bound, label)`` rules, first match wins; missing stays NULL."""
    s, out = col(score), None
    compare = {"<": s.__lt__, "<=": s.__le__, "==": s.__eq__, ">": s.__gt__, ">=": s.__ge__}
    for op, bound, label in rules:
        hit = compare[op](F.lit(bound))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


# Years of schooling to education level, in order.
EDUCATION_RULES = (
    ("<", 12, "some_hs"), ("==", 12, "high_school"), ("<=", 14, "some_college"),
    ("==", 16, "college_degree"), ("<=", 18, "some_grad_level"), (">", 18, "grad_degree"),
)
# Registration race codes.
RACE_CODES = {
    1: "white", 2: "black_african_american", 4: "asian", 8: "american_indian_alaska_native",
    16: "native_hawaiian_pacific_islander", 32: "other", 0: "unknown_not_reported", 64: "unknown_not_reported",
}


def map_codes(code: str | Column, table: Mapping, default: str | None, missing: str | None) -> Column:
    """Code lookup; codes outside the table give ``default``, a missing code gives ``missing``."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    known = F.try_element_at(F.create_map(*pairs), col(code))
    return F.when(col(code).isNull(), missing).otherwise(F.coalesce(known, F.lit(default)))


def replace_matching(df: DataFrame, pattern: str, value: str, keep: Iterable[str] = ()) -> DataFrame:
    """Text cells matching the regular expression become ``value`` (all text columns but ``keep``)."""
    keep = set(keep)
    targets = [c for c in string_columns(df) if c not in keep]
    return apply_to(df, targets, lambda c: F.when(c.rlike(pattern), value).otherwise(c))


def replace_literal(c: str | Column, token: str, value: float) -> Column:
    """Text token to a number, e.g. a "less than" entry to its bound; the rest is read as numbers."""
    return F.when(col(c) == token, F.lit(float(value))).otherwise(as_number(c))


def fill_label(c: str | Column, label: str) -> Column:
    return F.coalesce(col(c), F.lit(label))


def encode_binary(c: str | Column, one: str, zero: str) -> Column:
    return F.when(col(c) == one, 1).when(col(c) == zero, 0)


def one_hot(df: DataFrame, column: str, values: Sequence | None = None, prefix: str | None = None) -> DataFrame:
    """0/1 columns ``<prefix>_<level>`` next to the original; a missing category is 0 everywhere."""
    values = levels(df, column) if values is None else values
    prefix = prefix or column
    flags = {f"{prefix}_{v}": F.coalesce((col(column) == v).cast("int"), F.lit(0)) for v in values}
    return rewrite(df, flags)


def encode_with_vocab(train: DataFrame, test: DataFrame, column: str, out: str = "code", limit: int = 10_000) -> DataFrame:
    """Codes 0..k-1 for the sorted categories of ``train``, applied to ``test``; unknown or missing is -1."""
    words = levels(train, column, limit)
    kind = train.schema[column].dataType.simpleString()
    vocab = local_table(test.sparkSession, list(zip(words, range(len(words)))), f"level {kind}, {quoted(out)} int")
    coded = test.join(F.broadcast(vocab), test[column] == vocab["level"], "left").drop("level")
    return rewrite(coded, {out: F.coalesce(col(out), F.lit(-1))})


def derive_prefix(c: str | Column, length: int = 3) -> Column:
    return F.substring(col(c), 1, length)


def tidy_text(c: str | Column, default: str, style: str = "lower") -> Column:
    """Fill, trim, and lower-case or capitalise (first letter up, all others down)."""
    text = F.trim(F.coalesce(col(c), F.lit(default)))
    if style == "lower":
        return F.lower(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


# ---------------------------------------------------------------- dates


def parse_short_date(c: str | Column) -> Column:
    """``month/day/two-digit-year``; years 69-99 belong to the 1900s, unreadable text is NULL."""
    parsed = F.try_to_date(col(c), "M/d/yy")
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed).cast("date")


def months_between_days(start: str | Column, end: str | Column) -> Column:
    """Days between two dates divided by the fixed month length."""
    return F.datediff(col(end), col(start)) / F.lit(DAYS_PER_MONTH)


# ---------------------------------------------------------------- arithmetic


def scale_by(df: DataFrame, columns: Iterable[str], divisor: float) -> DataFrame:
    return apply_to(df, columns, lambda c: c / F.lit(float(divisor)))


def ratio_to(df: DataFrame, columns: Iterable[str], denominator: str) -> DataFrame:
    """Columns divided by one column; a zero or missing denominator gives NULL."""
    return apply_to(df, [c for c in columns if c != denominator], lambda c: F.try_divide(c, col(denominator)))


def ratio_to_visit_volume(df: DataFrame, visit: str, columns: Iterable[str] | None = None) -> DataFrame:
    """All measures of one visit divided by the intracranial volume of that visit."""
    school_age = visit.upper() == "VSA"
    volume = f"ICV_vol_{visit.upper()}" if school_age else f"ICV_{visit.upper()}"
    tissue = f"total_Tissue_vol_{visit.upper()}" if school_age else f"totTiss_{visit.upper()}"
    if tissue not in df.columns:
        raise ValueError(f"no column {tissue}")
    pool = df.columns if columns is None else columns
    chosen = [c for c in pool if c in df.columns and c.endswith(f"_{visit}") and c not in (volume, tissue, "CandID")]
    return ratio_to(df, chosen, volume)


def reverse_score(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``max - x`` with the maximum over the whole table (a one-row aggregate, no global window)."""
    columns = list(columns)
    top = small_rows(df.agg(*[F.max(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]), 1, "maxima")[0]
    return rewrite(df, {c: F.lit(top[f"m{i}"]) - col(c) for i, c in enumerate(columns)})


def availability(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """1 where a cell has a value, 0 where it is missing; ``keep`` columns pass through."""
    keep = set(keep)
    return apply_to(df, [c for c in df.columns if c not in keep], lambda c: c.isNotNull().cast("int"))


def visit_delta(df: DataFrame, features: Sequence[str], t1: str | None = None, t2: str | None = None,
                mode: str = "delta", suffix: str = "{feature}_{visit}") -> DataFrame:
    """Change ``t2 - t1`` per feature, or with ``mode="absolute"`` just the ``t2`` values."""
    if t2 is None or (mode == "delta" and t1 is None):
        raise ValueError("the visits to compare are missing")
    name = lambda f, v: suffix.format(feature=f, visit=v)
    if mode == "absolute":
        return rewrite(df, {f: col(name(f, t2)) for f in features})
    return rewrite(df, {f"{f}_delta": col(name(f, t2)) - col(name(f, t1)) for f in features})


def weighted_index(weights: Mapping[str, float]) -> Column:
    """Sum of weight x column; NULL if any column is missing."""
    total = None
    for name, w in weights.items():
        term = F.lit(float(w)) * col(name)
        total = term if total is None else total + term
    return total


# Weights of the four-region frontal index.
FRONTAL_INDEX_WEIGHTS = {
    "Frontal_L_WM_VSA": 0.746488, "Frontal_L_GM_VSA": 0.467038,
    "Frontal_R_WM_VSA": 0.452255, "Frontal_R_GM_VSA": -0.141765,
}
