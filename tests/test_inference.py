import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.functions.hashing import REPLICATE_PRIME, with_replicate_hashes
from cohortloom.operators import cluster, inference
from cohortloom.operators.suffstats import moments


@pytest.mark.parametrize("got,expected", [
    (tails.t_two_sided(2.0, 10), 0.07338803), (tails.t_two_sided(12.706204736, 1), 0.05), (tails.f_sf(4.0, 2, 20), 0.03457161), (tails.f_sf(4.9646027437, 1, 10), 0.05),
    (tails.chi2_sf(3.841458821, 1), 0.05), (tails.chi2_sf(18.30703805, 10), 0.05), (tails.chi2_sf(0.1, 3), 0.9918374), (2 * tails.normal_sf(1.959963985), 0.05),
    (tails.studentized_range_sf(3.876777, 3, 10), 0.05), (tails.studentized_range_sf(3.633160, 4, 10**6), 0.05), (tails.fisher_two_sided(8, 2, 1, 5), 0.03496503),
    (tails.fisher_two_sided(3, 1, 1, 3), 0.48571429)])
def test_tails(got, expected):
    assert got == pytest.approx(expected, rel=2e-4)


def two_groups(spark, n=60, shift=0.7):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=n), 1), np.round(rng.normal(shift, 1, size=n + 7), 1)
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None), ("c", 99.0)]
    return a, b, spark.createDataFrame(rows, "g string, v double")


def test_mann_whitney(spark):
    a, b, df = two_groups(spark)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    got = inference.mann_whitney(df, "g", "a", "b", "v").first()
    back = inference.mann_whitney(df, "g", "b", "a", "v").first()
    assert got["u"] == u and got["u"] + back["u"] == len(a) * len(b)
    n = len(a) + len(b)
    _, t = np.unique(np.concatenate([a, b]), return_counts=True)
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
    z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / sd
    assert got["z"] == pytest.approx(z) and got["p"] == pytest.approx(2 * tails.normal_sf(z))


def test_auc_is_scaled_u(spark):
    a, b, df = two_groups(spark)
    labelled = df.where("g IN ('a', 'b')").withColumn("y", (F.col("g") == "b").cast("int"))
    u = sum((y > x) + 0.5 * (x == y) for x in a for y in b)
    assert inference.auc(labelled, "v", "y").first()["auc"] == pytest.approx(u / len(a) / len(b))


def test_anova_of_two_groups_is_t_squared(spark):
    _, _, df = two_groups(spark)
    two = df.where("g <> 'c'")
    f, t = inference.anova_oneway(two, "g", "v").first(), inference.ttest_pooled(two, "g", "a", "b", "v").first()
    assert f["f"] == pytest.approx(t["t"] ** 2) and f["p"] == pytest.approx(t["p"], rel=1e-6)


def test_tukey_of_two_groups_is_t(spark):
    _, _, df = two_groups(spark)
    two = df.where("g <> 'c'")
    q, t = inference.tukey_hsd(two, "g", "v").first(), inference.ttest_pooled(two, "g", "a", "b", "v").first()
    assert q["q"] == pytest.approx(abs(t["t"]) * math.sqrt(2)) and q["p_adj"] == pytest.approx(t["p"], abs=2e-4)
    assert q["reject"] == (q["low"] > 0 or q["high"] < 0)


@pytest.mark.parametrize("table", [[[8, 2], [1, 5]], [[10, 0], [3, 4]], [[5, 0, 7], [0, 4, 2]], [[6, 0], [0, 6]]])
def test_chi2(spark, table):
    obs = np.array(table, float)
    rows = [(str(i), str(j)) for i, r in enumerate(table) for j, k in enumerate(r) for _ in range(k)]
    got = inference.chi2_independence(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    gap = np.abs(obs - e)
    if obs.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    assert got["chi2"] == pytest.approx((gap**2 / e).sum()) and got["dof"] == (obs.shape[0] - 1) * (obs.shape[1] - 1)


def test_two_by_two(spark):
    rows = [("r1", "c1")] * 8 + [("r1", "c2")] * 2 + [("r2", "c1")] + [("r2", "c2")] * 5
    got = inference.two_by_two(spark.createDataFrame(rows, "a string, b string"), "a", "r1", "r2", "b", "c1", "c2").first()
    assert got["odds_ratio"] == 20.0 and got["p"] == pytest.approx(0.03496503, rel=1e-5)


def test_permutations_keep_the_number_of_positives(spark):
    """Every replicate draws exactly n1 rows: checked by brute force on the same numbers."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(x), int(i % 4 == 0)) for i, x in enumerate(np.round(rng.normal(size=300), 1))], "id long, s double, y int")
    got = {r["rep"]: r["auc"] for r in inference.permuted_auc(df, "id", "s", "y", 40).collect()}
    assert len(got) == 40 and 0.3 < np.mean(list(got.values())) < 0.7
    from cohortloom.functions.hashing import replicate_number, with_replicate_hashes
    numbers = with_replicate_hashes(df, "id", 42).select("id", "s", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("rep"), "_h1", "_h2").withColumn("x", replicate_number("rep")).toPandas()
    n1, n = 75, 300
    for rep, part in numbers.groupby("rep"):
        ranks = part["s"].rank()
        chosen = part.sort_values(["x", "id"]).index[:n1]
        assert got[rep] == pytest.approx((ranks[chosen].sum() - n1 * (n1 + 1) / 2) / (n1 * (n - n1)))
    out = inference.permutation_test(df, "id", "s", "y", 40).first()
    assert out["p"] == pytest.approx((sum(v >= out["observed"] for v in got.values()) + 1) / 41)


def test_manova_one_feature_is_anova(spark):
    _, _, df = two_groups(spark)
    two = df.where("g <> 'c' AND v IS NOT NULL")
    rows = {r["statistic"]: r for r in inference.manova(moments(two, ["v"], ["g"]), spark).collect()}
    f = inference.anova_oneway(two, "g", "v").first()
    assert all(rows[s]["f"] == pytest.approx(f["f"]) and rows[s]["p"] == pytest.approx(f["p"], rel=1e-6) for s in ("wilks", "pillai", "roy"))


def test_manova_against_direct_matrices(spark):
    rng = np.random.default_rng(5)
    g = np.repeat([0, 1, 2], 40)
    x = rng.normal(size=(120, 3)) + g[:, None] * np.array([0.3, 0.0, -0.2])
    df = spark.createDataFrame([(int(k), *map(float, r)) for k, r in zip(g, x)], "g int, a double, b double, c double")
    rows = {r["statistic"]: r["value"] for r in inference.manova(moments(df, ["a", "b", "c"], ["g"]), spark).collect()}
    e = sum(((x[g == k] - x[g == k].mean(0)).T @ (x[g == k] - x[g == k].mean(0))) for k in range(3))
    t = (x - x.mean(0)).T @ (x - x.mean(0))
    assert rows["wilks"] == pytest.approx(np.linalg.det(e) / np.linalg.det(t))
    assert rows["pillai"] == pytest.approx(np.trace((t - e) @ np.linalg.inv(t)))
    y = spark.createDataFrame([(*map(float, r), float(r[0] + z)) for r, z in zip(x, rng.normal(size=120))], "a double, b double, c double, y double")
    wilks = {r["statistic"]: r for r in inference.manova_continuous(moments(y, ["a", "b", "c", "y"]), ["a", "b", "c"], "y", spark).collect()}["wilks"]
    m = moments(y, ["a", "b", "c", "y"])
    s = m.scatter
    r2 = s[3, :3] @ np.linalg.solve(s[:3, :3], s[:3, 3]) / s[3, 3]
    assert wilks["value"] == pytest.approx(1 - r2) and wilks["f"] == pytest.approx(r2 / (1 - r2) * 116 / 3)


def test_pairwise_and_feature_tests(spark):
    rng = np.random.default_rng(6)
    rows = [(c, float(rng.normal(m)), float(rng.normal()), float(rng.normal())) for c, m in (("0", 0.0), ("1", 1.0), ("LR", 0.5)) for _ in range(50)]
    df = spark.createDataFrame(rows, "cluster string, f double, h double, PC1 double")
    pairs = cluster.pairwise_mann_whitney(df, "cluster", ["0", "1", "LR"], ["f", "h"]).collect()
    assert len(pairs) == 6 and all(r["p_corrected"] >= r["p"] - 1e-12 for r in pairs)
    one = inference.mann_whitney(df, "cluster", "0", "LR", "f").first()
    assert [r["u"] for r in pairs if (r["measure"], r["group1"], r["group2"]) == ("f", "0", "LR")] == [one["u"]]
    tests = {r["feature"]: r for r in cluster.feature_cluster_tests(df, "cluster", "0", "1", ["f", "h"], "PC1").collect()}
    assert tests["f"]["median_1"] == pytest.approx(np.median([r[1] for r in rows if r[0] == "0"]))


def test_logit(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(int)
    df = spark.createDataFrame([(int(b), float(a)) for a, b in zip(x, y)], "y int, x double")
    d, beta = np.column_stack([x, np.ones(400)]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ beta))
        h = d.T @ (d * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(h, d.T @ (y - p))
    got = {r["term"]: r for r in cluster.logit_inference(df, "y", ["x"]).collect()}
    assert got["x"]["coef"] == pytest.approx(beta[0], rel=1e-4) and got["x"]["se"] == pytest.approx(np.sqrt(np.linalg.inv(h)[0, 0]), rel=1e-3)


def test_fisher_in_constant_memory():
    from math import comb
    for a, b, c, d in [(3, 7, 9, 2), (0, 5, 5, 0), (12, 0, 3, 8), (40, 60, 55, 45), (1, 0, 0, 0), (0, 0, 0, 0)]:
        r1, c1, n = a + b, a + c, a + b + c + d
        p = {x: comb(r1, x) * comb(n - r1, c1 - x) / comb(n, c1) for x in range(max(0, c1 - (n - r1)), min(r1, c1) + 1)}
        assert tails.fisher_two_sided(a, b, c, d) == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))
    big = tails.fisher_two_sided(10**9, 10**9 + 60_000, 10**9, 10**9)
    assert big == pytest.approx(tails.chi2_sf(60_000**2 / (4 * 10**9), 1), rel=1e-3)
    assert tails.fisher_two_sided(10**9, 0, 0, 10**9) == 0.0


def test_studentized_range_is_continuous_in_df():
    p = [tails.studentized_range_sf(3.5, 3, df) for df in (4999, 5000, 5001, 10**5, float("inf"))]
    assert abs(p[1] - p[2]) < 1e-7 and p[0] > p[3] > p[4] - 1e-9 and abs(p[3] - p[4]) < 1e-5


def test_chi2_with_empty_cells(spark):
    rows = [("a", "x")] * 7 + [("b", "y")] * 5
    got = inference.chi2_independence(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    # 2x2 with two empty cells: all gaps are 35/12, less one half
    gap, margins = 35 / 12 - 0.5, [(7 * 7), (7 * 5), (5 * 7), (5 * 5)]
    assert got["chi2"] == pytest.approx(sum(gap**2 / (m / 12) for m in margins)) and got["dof"] == 1


def test_small_rank_sums_equal_enumeration():
    from itertools import combinations

    for n1 in range(1, 6):
        for n2 in range(1, 7):
            us = [sum(c) - n1 * (n1 + 1) // 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
            for u in range(n1 * n2 + 1):
                want = min(1.0, 2 * min(sum(v <= u for v in us), sum(v >= u for v in us)) / len(us))
                assert tails.rank_sum_two_sided(n1, n2, u) == pytest.approx(want, abs=1e-12)


def test_ties_and_larger_samples_use_the_normal(spark):
    rows = [("a", float(i), i % 2 == 0) for i in range(9)] + [("tied", float(i // 2), i % 2 == 0) for i in range(8)] + [("large", float(i * 7 % 40), i % 2 == 0) for i in range(40)]
    got = {r.g: r for r in inference.rank_test(spark.createDataFrame(rows, "g string, v double, own boolean"), "v", F.col("own"), ["g"]).collect()}
    assert got["a"].p == pytest.approx(tails.rank_sum_two_sided(5, 4, got["a"].u))
    for g in ("tied", "large"):
        assert got[g].p == pytest.approx(min(1.0, 2 * tails.normal_sf(abs(got[g].z))))


def test_permutations_copy_no_rows_and_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, float(r.integers(0, 40)), int(r.random() < 0.3)) for i in range(700)]
    rows += [rows[3], rows[3], (900, None, 1), (901, 1.0, None)]  # repeated keys, missing values
    df = spark.createDataFrame(rows, "id long, s double, y int")
    known = df.where("s IS NOT NULL AND y IS NOT NULL").withColumn("id", F.col("id"))
    table = with_replicate_hashes(known, "id", 42).toPandas()
    ranks, n1, n = table["s"].rank().to_numpy(), int(table["y"].sum()), len(table)
    want = []
    for rep in range(7):
        order = np.lexsort((table["id"], (table["_h1"] + rep * table["_h2"]) % REPLICATE_PRIME))
        want.append((ranks[order[:n1]].sum() - n1 * (n1 + 1) / 2) / (n1 * (n - n1)))
    for bound, bits in ((1000, 10), (3, 2)):
        monkeypatch.setattr(inference, "PERMUTED", bound)
        monkeypatch.setattr(inference, "SLICE_BITS", bits)
        out = inference.permuted_auc(df, "id", "s", "y", 7)
        assert np.allclose([x.auc for x in out.orderBy("rep").collect()], want)
        assert "Explode" not in out._jdf.queryExecution().toString() and "Generate" not in out._jdf.queryExecution().toString()
    assert inference.permuted_auc(df.where("y = 0"), "id", "s", "y", 7).count() == 0


def test_pairs_of_groups_count_equal_values_first(spark):
    """Each pair equals its own test; rows are counted by value before the pairs copy them."""
    r = np.random.default_rng(6)
    rows = [("ABCD"[int(r.integers(0, 4))], float(r.integers(0, 9)), None if i % 11 == 0 else float(r.normal())) for i in range(300)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    out = cluster.pairwise_mann_whitney(df, "g", ["A", "B", "C"], ["a", "b"])
    got = {(x.measure, x.group1, x.group2): (x.n1, x.n2, x.u, x.z, x.p) for x in out.collect()}
    want = {}
    for m in "ab":
        for a, b in (("A", "B"), ("A", "C"), ("B", "C")):
            x = inference.mann_whitney(df, "g", a, b, m).first()
            want[m, a, b] = (x.n1, x.n2, x.u, x.z, x.p)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    plain = inference.rank_test(df.where("g IN ('A', 'B')"), "a", F.col("g") == "A").first()
    twice = df.where("g IN ('A', 'B')").groupBy("g", "a").agg(F.count("*").alias("k"))
    assert inference.rank_test(twice, "a", F.col("g") == "A", copies="k").first() == plain and twice.count() <= 18
