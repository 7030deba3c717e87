"""Reading raw cohort files.  Every raw column is read as text; types are given later in one explicit cast step."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import as_number
from cohortloom.session import quoted, small_rows


def read_raw(spark: SparkSession, path: str, drop: Sequence[str] = (), drop_containing: Sequence[str] = ()) -> DataFrame:
    """Header CSV as text columns, without the columns that are not wanted (pruned in the scan)."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"')
    wanted = [c for c in df.columns if c not in drop and not any(s in c for s in drop_containing)]
    return df.select(*[F.col(quoted(c)) for c in wanted])


def list_files(spark: SparkSession, folder: str, glob: str = "*.csv", limit: int = 10_000) -> list[str]:
    """Paths below ``folder``; only the file listing is read, not the contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    return sorted(r["path"] for r in small_rows(files, limit, "files in folder"))


def read_many(
    spark: SparkSession, folder: str, key_regex: str, exclude: str | None = None, glob: str = "*.csv",
) -> dict[str, DataFrame]:
    """One lazy frame per file with its own header, keyed by a regex group of the file name (or the full name)."""
    out = {}
    for path in list_files(spark, folder, glob):
        name = path.rsplit("/", 1)[-1]
        if exclude and exclude in name:
            continue
        hit = re.search(key_regex, name)
        out[hit.group(1) if hit else name] = read_raw(spark, path)
    return out


def read_keyed(spark: SparkSession, path: str, key_regex: str, fmt: str = "parquet", key: str = "file_key") -> DataFrame:
    """All files of a folder as one frame with a key taken from each row's file name; columns are merged by name.

    What ``path`` matches may be a folder of part files too: then the first name from there down to the file that the key is found in counts. For a path without
    wildcards the file's own name comes first. Without any key it is the file name.
    """
    df = spark.read.format(fmt).option("mergeSchema", "true").load(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm_path)
    inner = F.regexp_replace("_metadata.file_path", r"^\w[\w+.-]*:(//[^/]*)?/", "")  # without scheme and authority
    names = F.transform(F.split(inner, "/"), lambda n: F.url_decode(F.replace(n, F.lit("+"), F.lit("%2B"))))
    names = F.slice(names, whole.depth(), F.size(names))
    if not re.search(r"[*?\[{]", whole.getName()):
        names = F.reverse(names)
    found = F.filter(F.transform(names, lambda n: F.regexp_extract(n, key_regex, 1)), lambda k: k != "")
    return df.select("*", F.coalesce(F.get(found, F.lit(0)), F.col("_metadata.file_name")).alias(key))


# The words of a model run log.
RUN_LOG_DELIMITER = "####### Model performance summary ######"
RUN_LOG_METRICS = {
    "r2_train": r"R2 train = (-?\d+\.?\d*)",
    "r2_test": r"R2 test = (-?\d+\.?\d*)",
    "run_minutes": r"Run completion time: (\d+\.?\d*)",
}
RUN_LOG_GROUP_FEATURES = ("Group_HR+", "Group_HR-", "Group_LR-")


def block_metrics(df: DataFrame, block: str, metrics: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One number per named pattern and text block; a block without the pattern gives NULL, never a shift."""
    text = F.col(quoted(block))
    found = [as_number(F.regexp_extract(text, p, 1)).alias(n) for n, p in metrics.items()]
    return df.select(*[F.col(quoted(c)) for c in keep], *found)


def split_blocks(df: DataFrame, text: str, delimiter: str, keep: Sequence[str] = ()) -> DataFrame:
    """Text cut at a literal delimiter into non-empty trimmed blocks, one row per block."""
    parts = F.split(F.col(quoted(text)), "\\Q" + delimiter + "\\E")
    cut = df.select(*[F.col(quoted(c)) for c in keep], F.posexplode(parts).alias("block_no", "raw"))
    return cut.select(*keep, "block_no", F.trim(F.col("raw")).alias("block")).where(F.col("block") != "")


def parse_run_log(spark: SparkSession, path: str, delimiter: str = RUN_LOG_DELIMITER) -> DataFrame:
    """Model run log to one row per run: R2, minutes, parameter ranges, best parameters, group-feature flag.

    The file is cut at the delimiter by the reader itself, so a log of any size is read in parallel.
    """
    raw = spark.read.option("lineSep", delimiter).text(path)
    block = F.trim(F.col("value"))
    blocks = raw.select(block.alias("block")).where(F.col("block").contains("R2 train"))
    ranges_text = F.regexp_extract("block", r"(?s)Parameter specified\n(.*?)\nBest Parameters", 1)
    range_names = F.regexp_extract_all(ranges_text, F.lit(r"(?m)^\s*(\w+):\s*\((.*?)\)"), F.lit(1))
    range_values = F.regexp_extract_all(ranges_text, F.lit(r"(?m)^\s*(\w+):\s*\((.*?)\)"), F.lit(2))
    best_text = F.regexp_extract("block", r"(?s)Best Parameters:(.*?)\nPerformance metrics", 1)
    best_names = F.regexp_extract_all(best_text, F.lit(r"'(\w+)'(?:,|:) ([^(),}]+)"), F.lit(1))
    best_values = F.regexp_extract_all(best_text, F.lit(r"'(\w+)'(?:,|:) ([^(),}]+)"), F.lit(2))
    features = F.split(F.regexp_extract("block", r"Features: (.*?)\n", 1), ", ")
    metrics = [as_number(F.regexp_extract("block", p, 1)).alias(n) for n, p in RUN_LOG_METRICS.items()]
    return blocks.select(
        *metrics,
        F.arrays_overlap(features, F.array(*map(F.lit, RUN_LOG_GROUP_FEATURES))).alias("has_group"),
        F.map_from_arrays(range_names, F.transform(range_values, lambda v: F.split(v, r",\s*"))).alias("ranges"),
        F.map_from_arrays(best_names, F.transform(best_values, lambda v: v.try_cast("double"))).alias("best"),
    )
