import datetime as dt

import pytest

from cohortloom.functions import cleaning as K
from cohortloom.operators import columns


def one(df):
    return [tuple(r) for r in df.collect()]


def test_sentinels_and_numbers(spark):
    df = spark.createDataFrame([("a", "."), ("b", "#NULL!"), ("c", "nan"), ("d", " 12 "), ("e", "1e3"), ("f", "1d"), ("g", "x"), ("h", "-.5"), ("i", None)], "k string, v string")
    nulls = dict(one(K.null_sentinels(df)))
    assert nulls == {"a": None, "b": None, "c": None, "d": " 12 ", "e": "1e3", "f": "1d", "g": "x", "h": "-.5", "i": None}
    numbers = dict(one(K.coerce_numeric(df, ["k"])))
    assert numbers == {"a": None, "b": None, "c": None, "d": 12.0, "e": 1000.0, "f": None, "g": None, "h": -0.5, "i": None}


def test_consensus(spark):
    df = spark.createDataFrame([("x", "x", None), ("x", "y", None), (None, None, None), ("z", None, "z")], "a string, b string, c string")
    assert [r[0] for r in df.select(K.consensus("a", "b", "c")).collect()] == ["x", None, None, "z"]


def test_twins_keep_unpaired_columns(spark):
    df = spark.createDataFrame([("1", "5", "6", "u"), ("2", ".", "6", "u"), ("3", None, "Unknown", "u")], "id string, `VSA a.b,c` string, `VSA-CVD a.b,c` string, `VSA-CVD only` string")
    out = K.merge_twin_columns(df)
    assert out.columns == ["id", "VSA-CVD only", "VSD-All a.b,c"]
    assert one(out) == [("1", "u", "5"), ("2", "u", "6"), ("3", "u", None)]


def test_invalid_code_three_only(spark):
    df = spark.createDataFrame([(1.0, "3"), (2.0, "3.0"), (3.0, None), (4.0, "text"), (5.0, "1")], "s double, c string")
    assert [r[0] for r in df.select(K.invalidate("s", "c")).collect()] == [None, None, 3.0, 4.0, 5.0]


def test_first_needle_wins(spark):
    df = spark.createDataFrame([("x ASD- then ASD+",), ("ASD-",), ("asd+",), (None,)], "t string")
    assert [r[0] for r in df.select(K.label_from_text("t", [("ASD+", "ASD+"), ("ASD-", "ASD-")])).collect()] == ["ASD+", "ASD-", None, None]


def test_route(spark):
    df = spark.createDataFrame([("Flanker", 1, 2), ("DCCS", 3, 4), (None, 5, 6)], "n string, a int, b int")
    f, d = K.route_value("n", "a", "b", "Flanker", "DCCS")
    assert one(df.select(f, d)) == [(1, 2), (4, 3), (None, None)]


@pytest.mark.parametrize("text,year", [("1/2/69", 1969), ("12/31/99", 1999), ("01/02/68", 2068), ("3/4/00", 2000), ("13/1/05", None), ("x", None)])
def test_two_digit_years(spark, text, year):
    got = spark.createDataFrame([(text,)], "t string").select(K.parse_short_date("t")).first()[0]
    assert (got.year if isinstance(got, dt.date) else None) == year


def test_education_bins(spark):
    df = spark.createDataFrame([(v,) for v in (8.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 18.0, 19.0, None)], "s double")
    assert [r[0] for r in df.select(K.bin_label("s", K.EDUCATION_RULES)).collect()] == [
        "some_hs", "some_hs", "high_school", "some_college", "some_college", "some_grad_level", "college_degree", "some_grad_level", "grad_degree", None]


def test_codes(spark):
    df = spark.createDataFrame([(1,), (64,), (3,), (None,)], "c int")
    assert [r[0] for r in df.select(K.map_codes("c", K.RACE_CODES, "more_than_one_race", "missing")).collect()] == [
        "white", "unknown_not_reported", "more_than_one_race", "missing"]


def test_ratio_by_visit_volume(spark):
    df = spark.createDataFrame([(1, 10.0, 4.0, 2.0, 7.0), (2, 10.0, 4.0, 0.0, 7.0)], "CandID long, a_V12 double, totTiss_V12 double, ICV_V12 double, a_V24 double")
    assert one(K.ratio_to_visit_volume(df, "V12")) == [(1, 5.0, 4.0, 2.0, 7.0), (2, None, 4.0, 0.0, 7.0)]
    with pytest.raises(ValueError):
        K.ratio_to_visit_volume(df, "V24")


def test_vocabulary_of_training_only(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    test = spark.createDataFrame([("a",), ("c",), (None,), ("b",)], "s string")
    assert [r["code"] for r in K.encode_with_vocab(train, test, "s").orderBy("s").collect()] == [-1, 0, 1, -1]


def test_tidy_text(spark):
    df = spark.createDataFrame([("  mALE x ",), (None,)], "t string")
    assert one(df.select(K.tidy_text("t", "unknown", "capital"), K.tidy_text("t", "Missing"))) == [("Male x", "male x"), ("Unknown", "missing")]


def test_visit_delta_needs_visits(spark):
    df = spark.createDataFrame([(1.0, 4.0)], "a_v12 double, a_v24 double")
    assert one(K.visit_delta(df, ["a"], "v12", "v24")) == [(1.0, 4.0, 3.0)]
    with pytest.raises(ValueError):
        K.visit_delta(df, ["a"], None, "v24")


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, `V06 x.y` int, FA_a int, SA_VSA int")
    assert columns.select_regex(df, "^FA_", ["id"]).columns == ["id", "FA_a"]
    assert columns.keep_containing(df, ["v06"], ["id"], case=False).columns == ["id", "V06 x.y"]
    assert columns.drop(df, ["V06 x.y", "no"]).columns == ["id", "FA_a", "SA_VSA"]
    assert columns.rename_affix(df, "p_", except_names=["id"]).columns == ["id", "p_V06 x.y", "p_FA_a", "p_SA_VSA"]
    assert columns.strip_affix(columns.rename_affix(df, suffix="_s"), suffix="_s").columns == df.columns
    assert columns.move_column(df, "SA_VSA", 1).columns == ["id", "SA_VSA", "V06 x.y", "FA_a"]
