import numpy as np
import pytest

from cohortloom.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, block long, n int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", 1, 2, "z") for i, v in rows], SCHEMA)


def brute(rows, k=20):
    fine = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in fine if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def random_rows(n=900, dims=12, clusters=6, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, dims))
    x = centers[r.integers(0, clusters, n)] + 0.3 * r.normal(size=(n, dims))
    return [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


@pytest.mark.parametrize("options", [{}, {"block": 64, "max_pivots": 7, "max_rings": 5}, {"max_pivots": 1, "max_rings": 1}, {"waves": (1, None), "block": 50}])
def test_exact(spark, options):
    rows = random_rows()
    assert sorted(tuple(r) for r in T.search(table(spark, rows), **options).collect()) == brute(rows)


def test_copies_and_ties(spark):
    rows = random_rows(300)
    rows += [(1000 + i, rows[40][1]) for i in range(300)]
    assert sorted(tuple(r) for r in T.search(table(spark, rows), block=32).collect()) == brute(rows)


def test_odd_rows(spark):
    rows = random_rows(60, 4) + [(None, [1, 1, 1, 1]), (100, None), (120, [1, None, 1, 1]), (140, [float("nan"), 1, 1, 1]), (160, [float("inf"), 1, 1, 1]), (180, []), (200, [-1, -2]), (-20, [0.5, 0, 0, 9]), (220, [300.0, -300.0, 0, 0])]
    got = sorted(tuple(r) for r in T.search(table(spark, rows)).collect())
    assert got == brute(rows)
    assert {q for q, *_ in got} == {0, 20, 40, 180, 200, -20, 220}


def test_repeated_id_is_no_candidate_of_itself(spark):
    rows = random_rows(60, 4)
    got = T.search(table(spark, rows + [rows[20]])).where("query_id = 20").collect()
    assert len(got) == 20 and all(r.vec_id != 20 for r in got)


def test_few_and_none(spark):
    assert sorted(tuple(r) for r in T.search(table(spark, random_rows(3))).collect()) == brute(random_rows(3))
    assert T.search(table(spark, random_rows(1))).count() == 0
    assert T.search(table(spark, [])).count() == 0


def test_the_index_closes_annuli(spark):
    """On clustered vectors the bound has to leave part of the index unopened."""
    r = np.random.default_rng(2)
    centers = 3 * r.normal(size=(12, 8))
    x = centers[r.integers(0, 12, 4000)] + 0.05 * r.normal(size=(4000, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    seen = []
    got = sorted(tuple(r) for r in T.search(table(spark, rows), watch=seen).where("query_id < 400").collect())
    assert got == [b for b in brute(rows) if b[0] < 400]
    assert len(seen) == len(T.WAVES)
    assert 0 < sum(pairs for pairs, _ in seen) < 0.5 * seen[0][1]


def test_large_components(spark):
    rows = random_rows(60, 2) + [(80, [2e6, 1]), (81, [2e6, 1.5]), (100, [-3e6, 5])]
    got = sorted(tuple(r) for r in T.search(table(spark, rows)).collect())
    assert got == brute(rows) and {q for q, *_ in got} == {0, 20, 40, 80, 100}
    rows = random_rows(40, 2) + [(60, [2.0**24 - 1, 2.0**24 - 1]), (61, [2.0**24 - 1, 2.0**24 - 3]), (80, [2.0**24 - 3, 2.0**24 - 1])]
    assert sorted(tuple(r) for r in T.search(table(spark, rows)).collect()) == brute(rows)
    with pytest.raises(OverflowError):
        T.search(table(spark, rows + [(82, [1e30, 0])]))
