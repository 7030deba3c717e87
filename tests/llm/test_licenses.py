import re

import duckdb
import pytest

from cohortloom.llm import licenses as L
from tests.llm.tables import ODD, PROSE, documents, odd_documents

NOTICE = {label: text for label, _, _, text in L.TEMPLATES}
CASES = ODD + [
    (20, "MIT License mit license. The GNU General Public License and CC BY 4.0", "a"),
    (21, PROSE + " " + NOTICE["mit-text"] + " " + PROSE, "a"),
    (22, " ".join(NOTICE["mit-text"].split()[4:]), "a"),
    (23, " ".join(NOTICE["mit-text"].split()[9:]), "a"),
    (24, "x " * 31 + NOTICE["bsd"], "a"), (25, "x " * 50 + NOTICE["mpl-2"].upper() + " y" * 400, "a"),
    (26, "gnu general public gnu general public license", "a"), (27, "cc by\ncc\tby", "a"), (28, "Apache License", "a"), (29, "licence KK mit LICENSE", "a"),
    (30, "released the license under mit " * 40, "a"),
]


def test_equals_all_blocks_against_all_templates(spark, monkeypatch):
    df = documents(spark, CASES)
    monkeypatch.setattr(L, "scan", L.scan)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(L.sql()).fetchall()
    df.write.mode("overwrite").parquet(path := _folder() + "/documents.parquet")
    got = [tuple(r) for r in L.op4_license_scan(spark, path.rsplit("/", 1)[0]).collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(None if v is None or v != v else int(v) if i in (0, 3, 4) else v for i, v in enumerate(r))) for r in want)


def _folder():
    import tempfile

    return tempfile.mkdtemp()


def places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), sorted((label, i) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())


def test_places(spark):
    rows = L.scan(odd_documents(spark)).collect() + L.scan(documents(spark, CASES[len(ODD):])).collect()
    got = sorted((str(r.doc_id), r.n_words, sorted((p.label, i) for p in r.places for i in p.starts)) for r in rows)
    assert got == sorted((str(i), *places(t)) for i, t, _ in CASES)


def labels(spark, texts, **options):
    rows = L.scan(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), **options).orderBy("doc_id").collect()
    return [sorted({m.label for m in r.matches}) for r in rows]


def test_variants_exclude_each_other(spark):
    around = [PROSE + ". {} " + PROSE, "{}", PROSE + " " + PROSE + " {}"]
    for label in ("cc-by-4", "cc-by-nc-4", "cc-by-sa-4", "cc-by-nc-sa-4", "gpl-2", "gpl-3"):
        assert labels(spark, [t.format(NOTICE[label]) for t in around]) == [[label]] * 3
    assert labels(spark, ["released under the apache license version 2 0 licensed", "the gnu general public license this work is licensed under version 3 released"]) == [["apache-2"], ["gpl-3"]]


def test_whole_license_texts(spark):
    long = " ".join(f"clause{i} word{i}" for i in range(170))  # 340 words
    own = (*L.TEMPLATES, ("long", "long", "clause7", long))
    cut = long.split()
    texts = [f"{PROSE} {long} {PROSE}", f"{PROSE} {' '.join(cut[:300])} {PROSE}", f"{PROSE} {' '.join(cut[:260])} {PROSE}", "x " * 333 + NOTICE["mit-text"] + " " + NOTICE["no-warranty"]]
    assert labels(spark, texts, templates=own) == [["long"], ["long"], [], ["mit-text", "no-warranty"]]


def test_no_python_in_the_plan(spark):
    plan = L.scan(documents(spark, CASES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert L.scan(documents(spark, [])).count() == 0
