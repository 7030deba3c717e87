"""Session helpers: recommended settings, the shared checkpoint folder, and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


class TooLarge(ValueError):
    """A table that must stay small (parameters, levels, statistics) exceeded its bound."""


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators are designed for."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; a private one only on a single machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return
    if sc.getCheckpointDir() is not None:
        return
    if not (sc.master == "local" or sc.master.startswith("local[")):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it from there.

    Later jobs start from the table, also after losing executors, and read only the columns they need.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a table that has to be small; raise instead of pulling a large one to the driver."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise TooLarge(f"{what}: more than {limit} rows")
    return rows


MAX_BYTES = 32 << 20


def fetched(df: DataFrame, limit: int, max_bytes: int) -> pa.Table | None:
    """The whole table, or None if it has more than ``limit`` rows or ``max_bytes`` bytes.

    Rows come partition by partition and stop at the bound, so a large table is never held.
    """
    rows = min(limit, max(1, max_bytes // max(1, df._jdf.schema().defaultSize()))) if limit > 0 else 0
    table = df.limit(rows + 1).toArrow()
    return table if table.num_rows <= rows and table.nbytes <= max_bytes else None


def bounded_broadcast(df: DataFrame, limit: int = 100_000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A small computed table, marked for broadcast once its size has been checked.

    The table is computed here and now.  Up to ``limit`` rows and ``max_bytes`` bytes it becomes a broadcast side; beyond
    that it is returned unmarked, and Spark joins it by shuffle.
    """
    table = fetched(df, limit, max_bytes)
    return df if table is None else F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def settle(df: DataFrame, limit: int = 100_000, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, bool]:
    """Compute a result table once, for uses that read it several times.

    A table within the bounds becomes a local relation (and the flag is true); a larger one is written to the checkpoint
    folder.
    """
    table = fetched(df, limit, max_bytes) if limit > 0 else None
    if table is not None:
        return df.sparkSession.createDataFrame(table, df.schema), True
    return cut_lineage(df), False


def levels(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct non-missing values of a category column (bounded)."""
    c = F.col(quoted(column))
    rows = small_rows(df.where(c.isNotNull()).select(c.alias("level")).distinct(), limit, f"levels of {column}")
    return sorted(r["level"] for r in rows)


def quoted(name: str) -> str:
    """Back-quoted name, safe for names with dots, commas and spaces."""
    return "`" + name.replace("`", "``") + "`"


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A parameter table made on the driver (size bounded by its caller); an Arrow table stays a local relation, so
    Spark knows its size and starts no job to build it."""
    kind = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [[] for _ in kind.fields]
    arrow = to_arrow_schema(kind)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, kind)
