"""From raw documents to packed sequences: quality rules, quality classifier, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; between stages the rows are written as Parquet and read again.

All but the last return the columns of documents (``COLUMNS``); further columns are dropped, and so clash with nothing. Null and empty texts are
rejected by the rules (no words); a null id is kept as it is, and repeated rows are judged alike until one of them stays as the least
of its group. Texts of any length pass whole. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import mixing, near_copies, packing, quality_classifier, quality_rules
from cohortloom.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 512  # of an Arrow batch: with whole texts, Spark's 10,000 rows are tens of megabytes in every task
WORDS = 100_000  # whose token ids a worker knows; executors have done four stages by then


def _small_batches(spark: SparkSession) -> None:
    """Batches for long texts, unless the session asks for batches of its own size."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    _small_batches(spark)
    forest = quality_rules.train(docs, _labels(spark, sf_dir))
    return quality_rules.assess(docs.select(*COLUMNS), forest, keep=COLUMNS).where("kept").select(*COLUMNS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated probability of being good reaches the threshold."""
    _small_batches(spark)
    model = quality_classifier.train(docs, _labels(spark, sf_dir))
    scored = quality_classifier.score(docs.select(*COLUMNS), model, keep=COLUMNS)
    return scored.where(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more.

    Fingerprints that pivot tables link (op6) come first and are verified; they reach 3 bits, which miss most such pairs, so an exact join by prefixes of
    the shingle sets finds the rest.
    """
    _small_batches(spark)
    return near_copies.drop_near_copies(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    _small_batches(spark)
    return mixing.mix(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    _small_batches(spark)
    return packing.pack(docs, packing.tokenizer_path(), words=WORDS, slice_bytes=2 << 20)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
# The stages learn from samples, so no SQL gives the same rows; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
