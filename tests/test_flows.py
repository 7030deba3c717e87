"""End-to-end flows on small invented sources, all columns text as in raw files."""

import numpy as np
import pytest

from cohortloom.plans import cohort, profile


def raw(spark, header, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"`{h}` string" for h in header))


@pytest.fixture(scope="module")
def sources(spark):
    K = "Identifiers"
    s = lambda *h_rows: raw(spark, *h_rows)
    return {
        "dob_risk_sex": s([K, "V06 DoB", "V12 DoB", "V06 Risk", "V12 Risk", "Sex1"], ("S1", "1/2/05", "1/2/05", "HR", ".", "Male"), ("S2", "3/4/06", "5/4/06", "LR", "LR", "Female"),
                          ("S3", ".", ".", "HR", "LR", "Male"), ("S4", "1/1/05", ".", "HR", ".", "Male")),
        "diagnosis": s([K, "V24 demographics,ASD_Ever_DSMIV", "VSA demographics,ASD_Ever_DSMIV", "VSA-CVD demographics,ASD_Ever_DSMIV"],
                       ("S1", "x ASD- y", ".", "."), ("S2", "ASD+", "No DSMIV ever administered", "was ASD- once")),
        "dx": s([K, "VSA demographics,ASD_Ever_DSMIV", "VSA-CVD demographics,ASD_Ever_DSMIV", "VSA demographics,ASD_DX", "VSA demographics,Project"],
                ("S1", "now ASD+", ".", "q", "Infant"), ("S4", "ASD-", ".", "q", "Down Syndrome Infant")),
        "demographics": s([K, "V06 demographics,Project", "V06 demographics,Sex", "V06 demographics,Cohort", "junk"], ("S1", "Infant", "Male", "c", "j"), ("S2", ".", "Female", "c", "j")),
        "anotb": s([K, "AB_12_Percent", "AB_24_Percent", "V12_AB_validitycode", "V24_AB_validitycode", "extra"], ("S1", "80", "70", "3", "1", "e"), ("S2", "55", "oops", "text", ".", "e")),
        "toolbox": s([K, "VSA NIHToolBox,Inst_24", "VSA-CVD NIHToolBox,Inst_24", "VSA NIHToolBox,Inst_25", "VSA-CVD NIHToolBox,Inst_25", "VSA NIHToolBox,Date_taken",
                      "VSA-CVD NIHToolBox,Date_taken", "VSA NIHToolBox,Score_Age_Corrected_Standard_Score_1", "VSA-CVD NIHToolBox,Score_Age_Corrected_Standard_Score_1",
                      "VSA NIHToolBox,Score_Age_Corrected_Standard_Score_2", "VSA-CVD NIHToolBox,Score_Age_Corrected_Standard_Score_2", "VSA NIHToolBox,Candidate_Age", "VSA-CVD NIHToolBox,Candidate_Age"],
                     ("S1", "NIH Flanker Test", ".", "Dimensional Card", ".", "1/2/15", ".", "101", ".", "99", ".", "120", "."),
                     ("S2", ".", "Dimensional Change", ".", "Flanker", ".", "2/2/16", ".", "88", ".", "77", ".", "118")),
        "brief1": s([K, "GECTScore", "WMTScore", "ShiftTScore", "InhibitTScore", "Grade"], ("S1", "40", "41", "42", "43", "g"), ("UNC0154", "0", "0", "0", "0", "g")),
        "brief2": s([K, "VSA BRIEF2_Parent,GEC_T_score", "VSA-CVD BRIEF2_Parent,GEC_T_score", "VSA BRIEF2_Parent,working_memory_T_score", "VSA BRIEF2_Parent,shift_T_score",
                     "VSA BRIEF2_Parent,inhibit_T_score", "VSA BRIEF2_Parent,T_score", "VSA BRIEF2_Parent,plan_T_score"],
                    ("S1", None, ".", "50", None, "51", "x", "9"), ("S2", ".", "62", ".", ".", ".", "x", "9")),
        "education": s([K, "V06 tsi,mother_education", "z"], ("S1", "college_degree", "z"), ("S1", None, "z"), ("S2", "not_answered", "z"), ("S9", "high_school", "z")),
    }


def test_integrate(spark, sources):
    out = cohort.integrate_behaviour(sources, exclude_ids=["UNC0154"])
    got = {r["Identifiers"]: r.asDict() for r in out.collect()}
    assert set(got) == {"S1", "S2"}  # S3 and S9 have no scores, S4 belongs to an excluded population
    one, two = got["S1"], got["S2"]
    assert (one["Risk"], one["Sex"], one["Combined_ASD_DX"], one["Group"]) == ("HR", "Male", "ASD+", "HR+")
    assert (two["Combined_ASD_DX"], two["Group"]) == ("ASD-", "LR-")
    assert (one["AB_12_Percent"], one["AB_24_Percent"], two["AB_12_Percent"], two["AB_24_Percent"]) == (None, 70.0, 55.0, None)
    assert (one["Flanker_Standard_Age_Corrected"], one["DCCS_Standard_Age_Corrected"]) == (101.0, 99.0)
    assert (two["Flanker_Standard_Age_Corrected"], two["DCCS_Standard_Age_Corrected"]) == (77.0, 88.0)
    assert one["Age_SchoolAge"] == pytest.approx(3652 / 30.44) and two["Age_SchoolAge"] == 118.0  # disputed birth date: age as given
    assert one["VSD-All BRIEF2_Parent,GEC_T_score"] is None or one["VSD-All BRIEF2_Parent,GEC_T_score"] == 40.0
    assert two["VSD-All BRIEF2_Parent,GEC_T_score"] == 62.0
    assert one["V06 tsi,mother_education"] == "college_degree" and two["V06 tsi,mother_education"] is None
    assert not any("Project" in c or "Cohort" in c for c in out.columns)


def test_race_severity_and_ages(spark):
    K = "Identifiers"
    subjects = spark.createDataFrame([("S1", 100.0), ("S2", 110.0), ("S3", None)], f"{K} string, Age_SchoolAge double")
    a = raw(spark, [K, "tsi race", "other"], ("S1", "white", "o"), ("S2", "asian@white", "o"), ("S3", ".", "o"))
    reg = raw(spark, [K, "VSA NIHToolBox,Registration_Data_Race", "VSA-CVD NIHToolBox,Registration_Data_Race"], ("S3", ".", "4"))
    assert {r[K]: r["race"] for r in cohort.add_race(subjects, [a], reg).collect()} == {"S1": "white", "S2": "more_than_one_race", "S3": "asian"}
    early = raw(spark, [K, *cohort.SEVERITY_EARLY], ("S1", ".", "4", "5"))
    school = raw(spark, [K, *cohort.SEVERITY_SCHOOL], ("S1", ".", ".", "7"))
    iq = raw(spark, [K, *cohort.IQ_SCORES, cohort.IQ_SCHOOL, cohort.IQ_AGE], ("S1", "90", ".", "less than 25", "99"))
    out = cohort.add_severity_and_iq(subjects, early, school, iq)
    one = out.where("Identifiers = 'S1'").first()
    assert (one["V24_V36_ados_severity_score"], one["VSA_ados2_severity_score"], one[cohort.IQ_SCHOOL], one["Final_Age_School_Age"]) == (4.0, 7.0, 25.0, 99.0)
    aged = cohort.add_missing_ages(out, spark.createDataFrame([("S3", 70.0)], f"{K} string, Calculated_Age double"))
    assert {r[K]: r["Final_Age_School_Age"] for r in aged.collect()} == {"S1": 99.0, "S2": 110.0, "S3": 70.0}


def test_features_to_predictors(spark):
    long = lambda f: raw(spark, ["Combined_ID", "DCCID", "Visit", f, f"{f}_VQC"], ("c", "1", "V12", "3.5", "ok"), ("c", "1", "V24", "4.5", "ok"), ("c", "2", "V12", ".", "ok"))
    infant = cohort.infant_structures({"Caudate": long("Caudate"), "TOT": long("totTiss"), "ICV": long("ICV")})
    assert sorted(infant.columns) == ["CandID", "Caudate_v12", "Caudate_v24"]
    lobes = cohort.school_age_features(raw(spark, ["CandID", "Frontal_WM", "ICV_vol", "total_Tissue_vol", "Frontal_score"], ("1", "10", "2", "9", "s"), ("1", "10", "2", "9", "s"), ("2", ".", "4", "9", "s")), ["score"])
    subjects = cohort.subject_table(spark.createDataFrame(
        [("1", "UNC1", "ASD-", "HR", "Male", "HR-", 80.0), ("2", "SEA2", "ASD+", "HR", "Female", "HR+", 70.0), ("3", "UNC3", "ASD-", "LR", "Male", "LR-", 60.0)],
        "CandID string, Identifiers string, Combined_ASD_DX string, Risk string, Sex string, Group string, AB_24_Percent double"))
    out, removed = cohort.combine_features(subjects, [lobes, infant], [(lobes, "VSA")])
    got = {r["CandID"]: r for r in out.collect()}
    assert set(got) == {1, 2} and got[1]["Frontal_WM_VSA"] == 5.0 and got[1]["Caudate_v24"] == 4.5 and got[2]["Frontal_WM_VSA"] is None
    assert [r["CandID"] for r in removed.collect()] == [3]
    train, held, names = cohort.predictors_and_target(out, "AB_24_Percent", "volume_VSA", include_group=True)
    assert names == ["Group_HR+", "Group_HR-", "Group_LR-", "Frontal_WM_VSA"]
    assert [r["Site"] for r in train.collect()] == ["UNC"] and [r["Site"] for r in held.collect()] == ["SEA"]


def test_diffusion(spark):
    f = lambda v: raw(spark, ["CandID", "Visit_label", "CandID_Visit", "dMRI_protocol", "FileID", "ILF_L", "Arc_L"], ("1", "v", "c", "p", "f", "1", v), ("1", "v", "c", "p", "g", "1", v))
    out = cohort.diffusion_features({"FA": f("0.5"), "MD": f("")})
    assert out.columns == ["CandID", "FA_Arc_L", "MD_Arc_L"] and [tuple(r) for r in out.collect()] == [("1", 0.5, None)]


def test_membership_summary(spark):
    df = spark.createDataFrame([("1", "g", 1.0, "x"), ("2", "h", 3.0, None)], "id string, grp string, v double, s string")
    numbers, texts = profile.membership_summary(df, {"all": df.select("id"), "one": df.where("id = '1'").select("id")}, "id", "grp")
    assert numbers.where("membership = 'all' AND level = 'all'").first()["mean"] == 2.0
    assert texts.count() == 3


def test_correspondence(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        case, hi = i >= 80, i % 2
        age, a = float(rng.normal(10, 1)), float(rng.normal(4 * hi * case, 0.5))
        rows.append((i, "HR" if case else "LR", a, a + float(rng.normal(0, 0.3)), age, 2 * age + float(rng.normal()) + (2.0 * hi if case else 0), float(rng.normal())))
    df = spark.createDataFrame(rows, "id int, grp string, s1 double, s2 double, age double, f double, h double")
    joined, tests = profile.deviation_correspondence(df, "id", "grp", ["LR"], ["HR"], ["s1", "s2"], ["f", "h"], ["age"], [2])
    assert joined.count() == 120
    got = {r["feature"]: r for r in tests.collect()}
    assert got["f_z"]["p_fdr"] < 0.01 < got["h_z"]["p_fdr"] and got["f_z"]["r_significant"]
