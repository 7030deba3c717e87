import pytest

from cohortloom.functions.hashing import key_hash
from cohortloom.operators import align, describe, rows
from cohortloom.operators import reshape as R
from cohortloom.sources import readers, sinks


def rowset(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def three(spark):
    return [spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "k long, x string"), spark.createDataFrame([(2, 5.0), (3, 6.0)], "k long, y double"),
            spark.createDataFrame([(1, 7), (4, 8)], "k long, z int")]


def test_align_equals_outer_joins(three):
    a, b, c = three
    expected = a.join(b, "k", "outer").join(c, "k", "outer")
    assert rowset(align.align_sources(three, "k")) == rowset(expected.select("k", "x", "y", "z"))


def test_align_has_one_shuffle(three):
    plan = align.align_sources(three, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_align_refuses_or_pairs_duplicates(spark, three):
    twice = spark.createDataFrame([(2, 1), (2, 2)], "k long, w int")
    with pytest.raises(Exception, match="repeats"):
        align.align_sources([three[0], twice], "k").collect()
    assert rowset(align.align_sources([three[0], twice], "k", on_duplicates="join")) == rowset(three[0].join(twice, "k", "outer").select("k", "x", "w"))


def test_overlay(spark):
    p = spark.createDataFrame([("1", "5", "q"), ("2", None, "r")], "id string, a string, other string")
    f = spark.createDataFrame([("2", "7"), ("3", "9"), ("1", "0")], "id string, b string")
    assert rowset(align.overlay(p, f, "id", {"a": "b"})) == [("1", "q", "5", []), ("2", "r", "7", ["a"]), ("3", None, "9", ["a"])]


def test_reconcile(spark):
    df = spark.createDataFrame([("1", "a", None), ("1", None, 2), ("2", "x", 1), ("1", "a", None)], "id string, s string, n int")
    assert rowset(rows.reconcile_duplicates(df, "id")) == [("1", "a", 2), ("2", "x", 1)]
    again = rows.reconcile_duplicates(rows.reconcile_duplicates(df, "id"), "id")
    assert rowset(again) == [("1", "a", 2), ("2", "x", 1)]
    bad = df.unionByName(spark.createDataFrame([("2", "y", 1)], df.schema))
    with pytest.raises(Exception, match="conflict"):
        rows.reconcile_duplicates(bad, "id").collect()
    assert rowset(rows.reconcile_duplicates(bad, "id", strict=False)) == [("1", "a", 2), ("2", None, 1)]
    assert rowset(rows.duplicate_conflicts(bad, "id")) == [("2", "s", "x", 1), ("2", "s", "y", 1)]


def test_missing_is_different(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert rowset(df.where(rows.not_equal("x", "a"))) == [("b",), (None,)]


def test_removed_rows_match_missing(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None)], "k int, v string")
    assert rowset(align.removed_rows(a, b)) == [(1, None), (2, "x")]


def test_population_filter(spark):
    df = spark.createDataFrame([(1, "Down Syndrome", None), (2, None, "Fragile X"), (3, None, None), (4, "Other", "x")], "id int, `V06 Project` string, p2 string")
    assert rowset(rows.drop_rows_any_contains(df, ["V06 Project", "p2"], ["Fragile", "Down"])) == [(3,), (4,)]


def test_widen(spark):
    df = spark.createDataFrame([(1, "V12", 1.0, "ok"), (1, "V24", 2.0, "ok"), (2, "V12", 3.0, "ok")], "id int, visit string, f double, f_VQC string")
    out = R.widen_visits(df, "id", "visit", ["f", "f_VQC"], drop_parts=["_VQC"])
    assert out.columns == ["id", "f_v12", "f_v24"]
    assert rowset(out) == [(1, 1.0, 2.0), (2, 3.0, None)]
    with pytest.raises(Exception, match="repeated visit"):
        R.widen_visits(df.union(df), "id", "visit", ["f"]).collect()


def test_membership_example(spark):
    """The worked example: five membership lists over four subjects."""
    flags = ["ab12", "24", "brief2", "dccs", "flanker"]
    df = spark.createDataFrame([("101", None, "301", None, None, 10.0, "M"), ("102", None, None, "401", None, 12.0, "F"), (None, "201", None, None, "501", 11.0, "F"),
                                (None, "202", None, None, None, None, "M")], ", ".join(f"Identifiers_{f} string" for f in flags) + ", Age double, Sex string")
    members = sinks.membership_rows(df, {f: f"Identifiers_{f}" for f in flags})
    got = {r["membership"]: (r["mean"], None if r["std"] is None else round(r["std"], 2), r["count"], r["n_missing"]) for r in describe.describe_by_membership(members, ["Age"]).collect()}
    assert got == {"ab12": (11.0, 1.41, 2, 0), "24": (11.0, None, 1, 1), "brief2": (10.0, None, 1, 0), "dccs": (12.0, None, 1, 0), "flanker": (11.0, None, 1, 0)}
    sexes = {(r["membership"], r["value"]): r["n"] for r in describe.count_by_membership(members, ["Sex"]).collect()}
    assert sexes == {("ab12", "M"): 1, ("ab12", "F"): 1, ("24", "F"): 1, ("24", "M"): 1, ("brief2", "M"): 1, ("dccs", "F"): 1, ("flanker", "F"): 1}
    maps = describe.value_count_map(describe.count_by_membership(members, ["Sex"]), ["membership", "column"])
    assert {r["membership"]: r["value_counts"] for r in maps.collect()}["24"] == {"F": 1, "M": 1}


def test_no_python_in_cleaning_plans(spark, three):
    df = rows.reconcile_duplicates(align.align_sources(three, "k"), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_readers_and_sinks(spark, tmp_path):
    for name, value in [("VOLUMES_v1_Caudate_x.csv", "1"), ("VOLUMES_v1_ICV_x.csv", "2"), ("other.csv", "3"), ("LobeParcel_a.csv", "4")]:
        (tmp_path / name).write_text(f"id,\"a,b\",skip_me\n001,{value},z\n")
    files = readers.read_many(spark, str(tmp_path), r"VOLUMES_v1_([^_]+)", "LobeParcel")
    assert sorted(files) == ["Caudate", "ICV", "other.csv"]
    assert rowset(files["ICV"]) == [("001", "2", "z")]
    assert readers.read_raw(spark, str(tmp_path / "other.csv"), drop_containing=["skip"]).columns == ["id", "a,b"]
    df = spark.createDataFrame([("1", None, 2), ("2", "x", None)], "id string, a string, b int")
    sinks.write_missing_ids(df, "id", ["a", "b"], str(tmp_path / "missing"))
    assert rowset(spark.read.csv(str(tmp_path / "missing" / "column=a"), header=True)) == [("1",)]
    sinks.export_by_membership(df, {"m": "a"}, str(tmp_path / "members"))
    assert (tmp_path / "members" / "membership=m").is_dir()
    sinks.write_table(df, str(tmp_path / "t"))
    assert rowset(spark.read.parquet(str(tmp_path / "t"))) == rowset(df)
    for r2 in (0.1, -0.2):
        sinks.append_run_record(spark, str(tmp_path / "runs"), {"target": "t", "r2_test": r2, "params": {"eta": "0.1"}})
    assert sorted(r["r2_test"] for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [-0.2, 0.1]


def test_keyed_files_of_several_parts(spark, tmp_path):
    """A table in one file, and one as a folder of part files; names need decoding."""
    from cohortloom.sources.readers import read_keyed

    one = spark.createDataFrame([(i,) for i in range(6)], "a long")
    one.repartition(3).write.parquet(f"{tmp_path}/in it/many.parquet")
    pandas = one.limit(2).toPandas()
    pandas.to_parquet(f"{tmp_path}/in it/single.parquet")
    pandas.to_parquet(f"{tmp_path}/in it/a+b.parquet")
    counts = lambda path, regex: {r.file_key: r["count"] for r in read_keyed(spark, path, regex).groupBy("file_key").count().collect()}
    assert counts(f"{tmp_path}/in it/*.parquet", r"^(\w+)\.parquet$") == {"many": 6, "single": 2, "a+b.parquet": 2}
    assert counts(f"{tmp_path}/in it/many.parquet", r"^(\w+)\.parquet$") == {"many": 6}
    assert counts(f"{tmp_path}/in it/single.parquet", r"^(\w+)") == {"single": 2}


def test_run_log(spark, tmp_path):
    block = """Run Date and Time: 2025-01-01 00:00:00
{d}
Metric: m
Features: Site, {group}a_V12
Parameter specified
n_estimators: (50, 2001)
eta: (0.005, 0.5)
Best Parameters: OrderedDict([('eta', 0.05), ('max_depth', 3)])
Performance metrics:
R2 train = 0.9123
R2 test = {r2}
Run completion time: 12.50
"""
    d = readers.RUN_LOG_DELIMITER
    (tmp_path / "log.txt").write_text(block.format(d=d, group="", r2="-0.0312") + block.format(d=d, group="Group_HR+, ", r2="0.2"))
    got = sorted((r["r2_test"], r["has_group"], r["run_minutes"], r["ranges"]["eta"], r["best"]["max_depth"]) for r in readers.parse_run_log(spark, str(tmp_path / "log.txt")).collect())
    assert got == [(-0.0312, False, 12.5, ["0.005", "0.5"], 3.0), (0.2, True, 12.5, ["0.005", "0.5"], 3.0)]


def test_hash_is_stable(spark):
    assert spark.createDataFrame([("a",)], "k string").select(key_hash("k", 1)).first()[0] == int(__import__("hashlib").md5(b"a|1").hexdigest()[:7], 16)
