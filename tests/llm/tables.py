"""Small tables with everything that goes wrong: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that share a name with results of the operators.
EXTRA = ", size int, taken string, score string, kept string, fingerprint int, labels int, sequence_id string, row string, fp string, _text string, block string"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCUMENTS)


PROSE = "The harbour was quiet in the morning and the boats lay close to the wall while the old keeper wrote down what had come in during the night"
ODD = [
    (1, PROSE, "a"), (2, PROSE + " again", "a"), (3, PROSE, "b"), (3, PROSE, "b"), (4, None, "b"), (5, "", None), (6, " \n\t ", "b"), (None, PROSE, "c"), (None, None, None),
    (7, "Licensed under the Apache License, Version 2.0.\n" + PROSE, "c"), (8, "word " * 30_000, "a"), (9, "!!! ### $$$ %%%", "c"), (10, "é ü ñ 日本 MIT License mit license", "a"),
    (11, "one", "a"), (12, "one two", "a"), (13, "\n".join([PROSE] * 4), "b"), (14, " ".join(f"w{i}" for i in range(9000)), "b"),
]


def odd_documents(spark: SparkSession, extra: bool = True) -> DataFrame:
    df = documents(spark, ODD)
    if not extra:
        return df
    names = [c.strip().split()[0] for c in EXTRA.split(",") if c.strip()]
    return df.selectExpr("*", *[f"'x' AS {n}" for n in names])


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
