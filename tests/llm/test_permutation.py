import os

import numpy as np
import pytest

from cohortloom.llm import permutation as P
from tests.test_oracle import FOLDER

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, file int, h1 int, v string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", 1, 2, "z", "w") for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    """{(query, rank): (score, vec_id)} over all rows."""
    fine = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    width = max([len(v) for _, v in fine], default=0)
    fine = [(i, np.array(v + (0.0,) * (width - len(v)))) for i, v in sorted(fine)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            found = sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for j, x in fine if j != i)[:k]
            out |= {(i, r + 1): f for r, f in enumerate(found)}
    return out


def compare(got, rows, k=10, every=100):
    """Recall; the order, the scores and the number of rows have to be right whatever is found."""
    want = brute(rows, k, every)
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(v)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert sum(len(x) for x in by_query.values()) == len(want)
    hits = 0
    for q, found in by_query.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({f[2] for f in found} & {want[q, r][1] for r in range(1, len(found) + 1)})
        for _, score, j in found:
            assert any(abs(score - np.linalg.norm(pad(a) - pad(b))) < 1e-12 * (1 + score) for a in vectors[q] if usable(a) for b in vectors[j] if usable(b))
    return hits / max(1, len(want))


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None for x in v)


def pad(v):
    out = np.zeros(64)
    out[:len(v)] = np.array(v, np.float32)
    return out


def clustered(n=3000, dims=16, clusters=30, seed=1, spread=0.2):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, dims))
    return [(i, v.tolist()) for i, v in enumerate(centers[r.integers(0, clusters, n)] + spread * r.normal(size=(n, dims)))]


def test_footrule_is_the_sum_of_shifts():
    r = np.random.default_rng(0)
    order = np.stack([r.permutation(12)[:5] for _ in range(40)])
    place = P.positions(order.astype(np.uint16), 12)
    for i in range(40):
        want = [sum(abs(int(place[i, p]) - int(place[j, p])) for p in range(12)) for j in range(40)]
        assert P.footrule(order[i], place.T).tolist() == want


@pytest.mark.parametrize("options", [{}, {"max_pivots": 20, "prefix": 6, "block": 40}, {"lists": 1}, {"sample_rows": 300}])
def test_recall_on_clusters(spark, options):
    rows = clustered()
    assert compare(P.search(table(spark, rows), every=20, **options).collect(), rows, every=20) >= 0.9


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no standard tables here")
def test_recall_on_the_given_vectors(spark):
    got = P.op11_permutation_index(spark, FOLDER).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert compare(got, rows) >= 0.9


def test_files_stay_closed_on_clusters():
    """Calibration leaves most of the index unopened where there is structure."""
    x = np.array([v for _, v in clustered(4000, 16, 60, spread=0.05)])
    order = P.orders(x, x[:63], 63)
    opened, radius = P.calibrate(x, order, 63, 2, 10, 0.98)
    assert opened <= 12 and radius < 63 * 63 // 6


def test_copies_and_ties(spark):
    rows = clustered(400)
    rows += [(1000 + i, rows[40][1]) for i in range(900)] + [(5000, [0.0] * 15 + [1.0]), (5001, [0.0] * 14 + [1.0]), (5002, [-0.0] * 15 + [1.0])]
    got = P.search(table(spark, rows)).collect()
    assert compare(got, rows) >= 0.9
    mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 1100)
    assert mine == [(k + 1, j, 0.0) for k, j in enumerate([40, *range(1000, 1009)])]
    assert next(r.vec_id for r in got if r.query_id == 5000 and r.rank == 1) == 5002


def test_odd_rows(spark):
    rows = clustered(250, 4) + [(None, [1, 1, 1, 1]), (300, None), (400, [1, None, 1, 1]), (500, [float("nan"), 1, 1, 1]), (600, [float("inf"), 1, 1, 1]), (700, []),
                                (800, [-1, -2]), (-100, [0.5, 0, 0, 9]), (900, [3e5, -3e5, 0, 0]), (1000, [0, 0, 0, 0])]
    rows += [rows[100]] * 30  # equal rows count once
    got = P.search(table(spark, rows)).collect()
    assert compare(got, rows) >= 0.9
    assert {r.query_id for r in got} == {0, 100, 200, 800, -100, 900}


def test_repeated_id_is_no_candidate_of_itself(spark):
    rows = clustered(60, 4)
    rows += [(0, [v + 0.001 for v in rows[0][1]])]
    got = P.search(table(spark, rows)).collect()
    assert len(got) == 10 and all(r.vec_id != 0 for r in got)


def test_few_and_none(spark):
    for n in (1, 2, 3, 12):
        rows = clustered(n)
        assert compare(P.search(table(spark, rows)).collect(), rows) == (0 if n == 1 else 1)
    assert P.search(table(spark, [])).count() == 0


def test_queries_far_from_all_pivots(spark):
    """A query that lies outside gets its true neighbours, in order, whatever files the sample's neighbours are in."""
    rows = clustered(1500, 8, 40) + [(10_000 + 100 * i, [0.0] * i + [40.0] + [0.0] * (7 - i)) for i in range(8)]
    got = sorted((r.query_id, r.rank, r.score, r.vec_id) for r in P.search(table(spark, rows)).collect() if r.query_id >= 10_000)
    want = sorted((q, r, s, j) for (q, r), (s, j) in brute(rows).items() if q >= 10_000)
    assert [(q, r, j) for q, r, _, j in got] == [(q, r, j) for q, r, _, j in want]
