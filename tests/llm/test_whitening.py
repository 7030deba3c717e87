import numpy as np
import pytest

from cohortloom.llm import whitening as W
from tests.test_oracle import FOLDER

SCHEMA = "vec_id long, embedding array<float>, label int, component string, x string, n string, whitened string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def whole(rows):
    fine = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max([len(v) for _, v in fine], default=0)
    return [i for i, _ in fine], [[c + 1_000_000 for c in v + [0] * (dims - len(v))] for _, v in fine]


def compare(got, rows, wanted=32, gaps=True):
    """Every value against numpy's eigenvectors of the covariance."""
    ids, x = whole(rows)
    n, total = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(r, total)] for r in x])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    many = min(wanted, int((value > 1e-20 * value[0]).sum()) if gaps is True else gaps)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sum(len(v) for v in by.values()) == n * many
    assert {r.n for r in got} == {n}
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    want = {}
    for i, r, c in zip(ids, x, centred):
        want.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(r, total)), c))
    for k in range(many):
        assert all(abs(r.explained / (value[k] / value.sum()) - 1) < 1e-9 for r in got if r.component == k + 1)
    for i, found in by.items():
        assert {int(r.deviation) for r in found} == {d for d, _ in want[i]}
    if gaps is True:  # components are unique up to their sign
        one = {i: w[0][1] for i, w in want.items() if len(w) == 1}
        y = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in one])
        z = np.array(list(one.values())) @ vector[:, :many] / np.sqrt(value[:many])
        sign = np.sign((y * z).sum(axis=0))
        assert np.abs(y * sign - z).max() < 1e-8 * max(1.0, np.abs(z).max())


def random_rows(n, dims, seed=0, scale=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)) * (np.geomspace(3, 0.5, dims) if scale is None else scale)
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("options", [{}, {"block": 1}, {"block": 5}, {"components": 3, "block": 2}])
def test_equals_eigenvectors(spark, options):
    rows = random_rows(700, 24)
    compare(W.whiten(table(spark, rows), **options).collect(), rows, options.get("components", 32))


def test_stops_early_and_is_still_right(spark):
    """A few strong directions settle before the space is exhausted."""
    rows = random_rows(400, 60, scale=np.concatenate([np.geomspace(100, 20, 4), np.full(56, 0.3)]))
    compare(W.whiten(table(spark, rows), components=4, block=6).collect(), rows, 4)


def test_given_vectors(spark):
    got = W.op13_whitening(spark, FOLDER).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(got, rows)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_equal_values(spark, block):
    """A covariance that is a multiple of the identity: any basis will do."""
    rows = [(2 * k + s, [(1 - 2 * s) * 2.0 if d == k else 0.0 for d in range(8)]) for k in range(8) for s in (0, 1)]
    compare(W.whiten(table(spark, rows), block=block).collect(), rows, gaps=8)


@pytest.mark.parametrize("block", [1, 16])
def test_directions_without_variation_are_no_components(spark, block):
    rows = [(i, [*v, sum(v[:2]), 7.0]) for i, v in [(i, [float(round(c * 10)) for c in v]) for i, v in random_rows(200, 5)]]
    compare(W.whiten(table(spark, rows), block=block).collect(), rows, gaps=5)


def test_odd_rows(spark):
    rows = random_rows(120, 4) + [(None, [1, 2, 3, 4]), (500, None), (501, [1, None, 1, 1]), (502, [float("nan")] * 4), (503, [float("inf"), 0, 0, 0]), (504, []), (505, [-1, 2]), (506, [0, 0, 0, 0])]
    rows += [rows[3]] * 200
    compare(W.whiten(table(spark, rows)).collect(), rows)


def test_large_entries(spark):
    rows = random_rows(50, 3) + [(60, [1e9, -1e9, 5]), (61, [-3e12, 1, 1])]
    got = W.whiten(table(spark, rows)).collect()
    ids, x = whole(rows)
    total = [sum(c) for c in zip(*x)]
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, sum((len(x) * a - s) ** 2 for a, s in zip(r, total))) for i, r in zip(ids, x)}
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        W.whiten(table(spark, rows + [(62, [1e30, 0, 0])])).collect()


def test_few_and_none(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    assert W.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    rows = [(1, [1, 2]), (2, [3, 5])]
    compare(W.whiten(table(spark, rows)).collect(), rows, gaps=1)
