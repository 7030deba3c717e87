import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators import ranks


def frame(spark, values, group=None):
    return spark.createDataFrame([(None if group is None else group[i], None if v is None else float(v)) for i, v in enumerate(values)], "g string, v double")


@pytest.mark.parametrize("values", [[5.0], [1, 2], [1, 2, 3], [2, 2, 2, 2], [1, 1, 1, 9, 9, 10], list(range(101)), [0.0] * 50 + list(range(30))])
def test_quantiles_small(spark, values):
    probs = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.95, "g": 1.0}
    got = ranks.exact_quantiles(frame(spark, values), [], "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(float(np.percentile(values, 100 * p))), (values, p)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.floats(0, 1))
def test_quantiles_any(spark, values, p):
    got = ranks.exact_quantiles(frame(spark, values), [], "v", {"q": p}).first()["q"]
    assert got == pytest.approx(float(np.percentile(values, 100 * p)), abs=1e-9)


def test_quantiles_skewed_groups(spark):
    """One group and one value hold most rows; missing values and a missing group are there too."""
    rng = np.random.default_rng(0)
    v = np.concatenate([np.full(20000, 3.0), rng.normal(size=20000), rng.exponential(size=500)])
    g = ["big"] * 40000 + ["small"] * 300 + [None] * 200
    df = frame(spark, [*v.tolist(), None], [*g, "big"]).repartition(7)
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in ranks.exact_quantiles(df, ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.9}).collect()}
    for name, part in (("big", v[:40000]), ("small", v[40000:40300]), (None, v[40300:])):
        assert got[name] == pytest.approx(tuple(np.percentile(part, [5, 50, 90])))


@pytest.mark.parametrize("most", [1_000_000, 50, 1])
def test_quantiles_of_lumps_and_outliers(spark, monkeypatch, most):
    """Cells are split by more bits, down to single values, where they hold many rows."""
    monkeypatch.setattr(ranks, "CELL_ROWS", most)
    rng = np.random.default_rng(4)
    v = np.concatenate([np.full(900, 1.5), 1 + rng.random(400) * 1e-5, -1e300 * rng.random(30), [1e-310, -0.0, 0.0, 5e-324], np.nextafter(1.5, 2) * np.ones(50)])
    got = ranks.exact_quantiles(frame(spark, v.tolist()).repartition(5), [], "v", {f"q{i}": i / 40 for i in range(41)}).first()
    assert [got[f"q{i}"] for i in range(41)] == pytest.approx([float(np.quantile(v, i / 40)) for i in range(41)], rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert ranks.exact_quantiles(frame(spark, [None, None], ["a", "b"]), ["g"], "v", {"q": 0.5}).count() == 0


def brute_rank(values):
    return {x: np.mean([i + 1 for i, y in enumerate(sorted(values)) if y == x]) for x in values}


def test_mid_ranks(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=3000), 2).tolist()
    g = ["a" if i % 3 else "b" for i in range(3000)]
    expected = {(name, x): r for name in "ab" for x, r in brute_rank([x for x, y in zip(v, g) if y == name]).items()}
    for slices in (2, 64, 512):
        ranked = ranks.ranked_counts(frame(spark, v, g), ["g"], "v", slices=slices)
        assert {(x["g"], x["value"]): x["before"] + (x["n"] + 1) / 2 for x in ranked.collect()} == expected


def bh(p):
    p = np.asarray(p)
    order = np.argsort(p)
    adj = p[order] * len(p) / np.arange(1, len(p) + 1)
    adj = np.minimum(np.minimum.accumulate(adj[::-1])[::-1], 1)
    out = np.empty(len(p))
    out[order] = adj
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_adjusted_p(spark, small):
    """The plain and the sliced way give the textbook result, ties and missing p included."""
    rng = np.random.default_rng(2)
    p = np.round(rng.beta(0.4, 2, size=700), 3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(900, None)], "id int, p double")
    got = {r["id"]: r for r in ranks.fdr_bh(df, "p", small=small).collect()}
    assert [got[i]["p_fdr"] for i in range(len(p))] == pytest.approx(bh(p).tolist())
    assert got[900]["p_fdr"] is None
    assert all(got[i]["significant"] == (got[i]["p_fdr"] < 0.05) for i in range(len(p)))


def test_row_numbers_are_a_permutation(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("g"))
    out = ranks.hashed_row_number(df, ["g"], "id").collect()
    for g, n in ((True, 334), (False, 666)):
        part = [r for r in out if r["g"] == g]
        assert sorted(r["position"] for r in part) == list(range(1, n + 1)) and {r["group_rows"] for r in part} == {n}


def test_no_whole_group_window(spark):
    """Windows run inside slices, or over one row per slice."""
    plan = ranks.avg_rank(frame(spark, [1, 2, 3], ["a", "a", "b"]), ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    inner = [line for line in plan.splitlines() if "Window" in line and "value" in line]
    assert inner and all("slice" in line for line in inner)
