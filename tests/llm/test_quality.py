import random
import re
import zlib

import numpy as np
import pytest

from cohortloom.llm import boosting, quality_rules
from cohortloom.llm import quality_classifier as C
from tests.llm.tables import DOCUMENTS, ODD, documents, labels, odd_documents


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    marked = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def corpus(n=400):
    r, rows, marks = random.Random(3), [], []
    vocabulary = ["river", "stone", "bridge", "market", "winter", "letter", "garden", "music", "window", "harbour", "teacher", "paper", "the", "of", "and", "in"]
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(40, 120))]
        good = i % 4 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w + r.choice(["%%%", "###", "&&&"]) for w in words]
        rows.append((i, " ".join(words), "a"))
        marks.append((i, int(good), 0))
    return rows, marks


def test_counts():
    texts = [t for _, t, _ in ODD] + ["a b c d e f g h a b c d e f g h i", "x " * 8, "x " * 9, "l1\nl1 \nl1\n\n \nl1"]
    out, x = quality_rules.statistics([(t or "").encode() for t in texts])
    assert list(zip(*(out[c].tolist() for c in quality_rules.COUNTS))) == [plain(t) for t in texts]
    assert np.isfinite(x).all()


def test_rules_on_odd_rows(spark):
    rows, marks = corpus()
    forest = quality_rules.train(documents(spark, rows), labels(spark, marks))
    got = quality_rules.assess(odd_documents(spark), forest).collect()
    assert len(got) == len(ODD)
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted((str(i), *plain(t)) for i, t, _ in ODD)
    by = {r.doc_id: r for r in got}
    assert by[4].base_failed and not by[4].kept and by[8].base_failed and not by[14].base_failed
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.assess(documents(spark, []), forest).count() == 0


def test_rules_learn(spark):
    rows, marks = corpus()
    forest = quality_rules.train(documents(spark, rows[:300]), labels(spark, marks[:300] + [(None, 1, 0), (2, None, 0)]))
    kept = {r.doc_id: r.kept for r in quality_rules.assess(documents(spark, rows[300:]), forest).collect()}
    assert np.mean([kept[i] == bool(q) for i, q, _ in marks[300:]]) > 0.95


def test_no_labels(spark):
    rows, _ = corpus(20)
    forest = quality_rules.train(documents(spark, rows), labels(spark, []))
    assert quality_rules.assess(documents(spark, rows), forest).where("kept").count() == 20
    model = C.train(documents(spark, rows), labels(spark, []))
    assert C.score(documents(spark, rows), model).count() == 20


def test_forest_walk_and_order():
    r = np.random.default_rng(5)
    x = r.random((600, 3))
    y = (x[:, 0] + 0.3 * r.normal(size=600) > 0.5).astype(float)
    f = boosting.fit(x, y, np.array([1, 0, -1]), trees=20)

    def slow(row):
        total = f.bias
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return total

    assert f.margin(x[:50]) == pytest.approx([slow(row) for row in x[:50]])
    grid = np.linspace(-0.1, 1.1, 200)
    for j, sign in ((0, 1), (2, -1)):
        for at in x[:20]:
            line = np.repeat(at[None], len(grid), axis=0)
            line[:, j] = grid
            assert (sign * np.diff(f.margin(line)) >= -1e-12).all()


def test_classifier_held_out(spark):
    rows, marks = corpus(600)
    df, marked = documents(spark, rows), labels(spark, marks)
    model = C.train(df, marked)
    got = {r.doc_id: r.score for r in C.score(df, model).collect()}
    held = [(i, q) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, q in held]) > 0.95
    assert 0.25 <= model.network.temperature <= 8
    # The held-out labels teach nothing: flipping them changes no score.
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in marks]
    again = {r.doc_id: r.score for r in C.score(df, C.train(df, labels(spark, flipped))).collect()}
    assert again == got


def test_classifier_on_odd_rows(spark):
    rows, marks = corpus(100)
    model = C.train(documents(spark, rows), labels(spark, marks))
    got = C.score(odd_documents(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert C.score(documents(spark, []), model).count() == 0
    assert (C.word_vectors(spark.createDataFrame([], DOCUMENTS)) == 0).all()


def test_word_vectors_do_not_depend_on_partitions(spark):
    rows, _ = corpus(60)
    df = documents(spark, rows)
    assert np.array_equal(C.word_vectors(df.repartition(5)), C.word_vectors(df.coalesce(1)))


def test_pooling_alone_or_together():
    r = np.random.default_rng(1)
    vectors = r.normal(size=(C.ROWS, C.DIMS)).astype(np.float32)
    texts = [b"a b c", b"", b"A!! b%%", b"x " * 70_000, b"a"]
    together = C.pooled(texts, vectors)
    assert np.allclose(together, np.concatenate([C.pooled([t], vectors) for t in texts]), atol=1e-4)
