import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from cohortloom.llm import catalog, mixing, packing, quality_classifier, quality_rules
from tests.llm.tables import documents, labels
from tests.test_oracle import FOLDER, TABLES, canonical

there = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no standard tables here")


@there
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, FOLDER)
    result = con.execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(result.fetchall(), columns)


@there
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_a_row_for_every_row(spark, name):
    table, key = {"op8_url_filter": ("pages", "page_id"), "op10_chat_format": ("conversations", "conv_id"), "op11_permutation_index": ("embeddings", "vec_id"),
                  "op13_whitening": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    rows = catalog.QUERIES[name](spark, FOLDER)
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key)
    if name == "op11_permutation_index":  # ten rows of every hundredth
        assert rows.count() == 10 * want.where(F.col(key) % 100 == 0).count()
        return
    assert rows.select(key).distinct().count() == want.distinct().count()
    if name not in ("op9_packing", "op13_whitening"):
        assert rows.count() == want.count()


def raw(n=240):
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ri", "sto", "ma", "wi", "le", "ga", "mu", "ha") for b in ("ver", "ne", "rket", "nter", "tter", "rden", "sic", "bour")]
    rows, marks = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 150))]
        good = i % 5 != 0
        rows.append((i, " ".join(words if good else [w + r.choice(["%%%", "&&&"]) for w in words]), "abc"[i % 3]))
        marks.append((i, int(good), 0))
    rows += [(n + k, rows[1][1], "a") for k in range(6)] + [(n + 10, "too short", "a"), (n + 11, None, None)]
    return rows, marks


def test_pipeline(spark, tmp_path):
    rows, marks = raw()
    df = documents(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, marks).write.parquet(f"{tmp_path}/labels.parquet")
    assert [f.__module__ for _, f in C.STAGES] == ["corpus_pipeline"] * 5
    docs = df
    seen = []
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(path := f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(path)
        seen.append(docs)
    assert all(tuple(d.columns) == C.COLUMNS for d in seen[:-1])
    kept = {r.doc_id for r in seen[0].collect()}
    forest = quality_rules.train(df, labels(spark, marks))
    assert kept == {r.doc_id for r in quality_rules.assess(df, forest).where("kept").collect()}
    assert {i for i in kept if i < 240} == {i for i, q, _ in marks if q}
    model = quality_classifier.train(seen[0], labels(spark, marks))
    assert {r.doc_id for r in seen[1].collect()} == {r.doc_id for r in quality_classifier.score(seen[0], model).where(F.col("score") >= 0.3).collect()}
    unique = {r.doc_id for r in seen[2].collect()}
    assert 1 in unique and not unique & set(range(240, 246))
    times = {r.doc_id: r["count"] for r in seen[3].groupBy("doc_id").count().collect()}
    assert times == {r.doc_id: r.taken // r.size for r in mixing.mix_report(seen[2]).collect() if r.taken}
    pieces = seen[4].groupBy("doc_id").agg(F.countDistinct("sequence_id", "offset").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == times
    assert seen[4].agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.CAPACITY
    again = C.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, seen[4].collect()))


def test_pipeline_on_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
