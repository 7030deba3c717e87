"""End-to-end cohort flows composed from the operators: integrate sources, combine features, choose predictors.

Each flow builds one plan.  Only steps that join on repeated keys look at their sources first (one grouped job per source).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import cleaning as K
from cohortloom.functions.cleaning import col
from cohortloom.operators import align, columns, reshape, rows
from cohortloom.operators.resample import holdout_by_group
from cohortloom.operators.scaling import collinear_columns
from cohortloom.operators.suffstats import pairwise_correlation

KEY = "Identifiers"

# ---------------------------------------------------------------- fixed values: column names of the raw sources

ANOTB_KEEP = ("Identifiers", "V12prefrontal_taskCandidate_Age", "V24prefrontal_taskCandidate_Age", "AB_12_Percent", "AB_24_Percent",
              "V12_AB_validitycode", "V24_AB_validitycode", "AB_Reversals_12_Percent", "AB_Reversals_24_Percent")
ANOTB_VALIDITY = {"AB_12_Percent": "V12_AB_validitycode", "AB_24_Percent": "V24_AB_validitycode"}
BRIEF1_DROP = ("TestDate", "TestDescription", "Grade", "Relationship", "TestFormTorP", "Howwellknownteacheronly",
               "Durationofrelationshipteacheronly", "MissingItems")
BRIEF2_AGES = ("VSA BRIEF2_Parent,Candidate_Age", "VSA-CVD BRIEF2_Parent,Candidate_Age")
BRIEF2_TOTALS = ("VSA BRIEF2_Parent,T_score", "VSA-CVD BRIEF2_Parent,T_score", "VSA BRIEF2_Parent,raw_score", "VSA-CVD BRIEF2_Parent,raw_score")
BRIEF_OVERLAY = {"VSA BRIEF2_Parent,GEC_T_score": "GECTScore", "VSA BRIEF2_Parent,working_memory_T_score": "WMTScore",
                 "VSA BRIEF2_Parent,shift_T_score": "ShiftTScore", "VSA BRIEF2_Parent,inhibit_T_score": "InhibitTScore"}
BRIEF2_FINAL = ("VSD-All BRIEF2_Parent,GEC_T_score", "VSD-All BRIEF2_Parent,GEC_raw_score", "VSD-All BRIEF2_Parent,inhibit_T_score",
                "VSD-All BRIEF2_Parent,shift_T_score", "VSD-All BRIEF2_Parent,working_memory_T_score")
DX_DROP = ("VSA demographics,ASD_DX", "VSA-CVD demographics,ASD_DX")
DX2_PARTS = ("CandID", "Cohort", "Family_CandID1", "Family_CandID2", "Project", "Relationship_type", "Site", "Status", "ethnicity", "race")
DX2_FINAL = ("V06 demographics,Risk", "V06 demographics,Sex", "V12 demographics,Risk", "V12 demographics,Sex", "V24 demographics,Risk",
             "V24 demographics,Sex", "V24 demographics,ASD_DX")
TOOLBOX_PARTS = ("Date_taken", "Inst_24", "Inst_25", "Age_Corrected_Standard_Score", "Candidate_Age")
EDUCATION = "V06 tsi,mother_education"
NEVER_DIAGNOSED = "No DSMIV ever administered"
EVER_DX = "VSD-All demographics,ASD_Ever_DSMIV"
INFANT_DX_ORDER = (EVER_DX, "V37Plus demographics,ASD_Ever_DSMIV", "V36 demographics,ASD_Ever_DSMIV", "V24 demographics,ASD_Ever_DSMIV")
EXCLUDED_POPULATIONS = ("Fragile", "Down")
DX_RULES = (("ASD+", "ASD+"), ("ASD-", "ASD-"))
TASK_RULES = (("Flanker", "Flanker"), ("Dimensional", "DCCS"))
TOOLBOX_NAMES = {"VSD-All NIHToolBox,Inst_24": "NIHToolBox,TestName1", "VSD-All NIHToolBox,Inst_25": "NIHToolBox,TestName2",
                 "VSD-All NIHToolBox,Date_taken": "NIHToolBox,Date_taken"}
TOOLBOX_SCORES = ("VSD-All NIHToolBox,Score_Age_Corrected_Standard_Score_1", "VSD-All NIHToolBox,Score_Age_Corrected_Standard_Score_2")
TOOLBOX_AGE = "VSD-All NIHToolBox,Candidate_Age"
CATEGORIES = ("DoB", "Identifiers", "Risk", "Sex", "NIHToolBox,TestName1", "NIHToolBox,TestName2", "V06 demographics,Risk", "V12 demographics,Risk",
              "V24 demographics,Risk", "V06 demographics,Sex", "V12 demographics,Sex", "V24 demographics,Sex", "NIHToolBox,Date_taken",
              "V24 demographics,ASD_DX", "Combined_ASD_DX", EDUCATION)
DEMOGRAPHIC = ("Identifiers", "Risk", "Sex", "DoB", "V12prefrontal_taskCandidate_Age", "V24prefrontal_taskCandidate_Age",
               "V24 demographics,ASD_DX", "Combined_ASD_DX", "NIHToolBox,Date_taken", EDUCATION)

# The named feature sets and the covariates that go with them.
FEATURE_SETS = {
    "volume_infant": {"pattern": "WM_V12|WM_V24|GM_V12|GM_V24", "covariates": ["ICV_V12", "ICV_V24"]},
    "volume_VSA": {"pattern": "WM_VSA|GM_VSA", "covariates": ["ICV_vol_VSA"]},
    "subcort_infant": {
        "pattern": "Amygdala_v12|Putamen_v12|Caudate_v12|Thalamus_v12|GlobusPall_v12|Hippocampus_v12|"
                   "Amygdala_v24|Putamen_v24|Caudate_v24|Thalamus_v24|GlobusPall_v24|Hippocampus_v24",
        "covariates": ["ICV_V12", "ICV_V24"]},
    "subcort_infant+volume_infant": {
        "pattern": "Amygdala_v12|Putamen_v12|Caudate_v12|Thalamus_v12|GlobusPall_v12|Hippocampus_v12|"
                   "Amygdala_v24|Putamen_v24|Caudate_v24|Thalamus_v24|GlobusPall_v24|Hippocampus_v24|"
                   "WM_V12|WM_V24|GM_V12|GM_V24",
        "covariates": ["ICV_V12", "ICV_V24", "ICV_vol_VSA"], "without": ["ICV_V12", "ICV_V24"]},
    "subcort_VSA": {"pattern": r"(?:Amygdala|Caudate|Putamen|Thalamus|Hippocampus|Globus_Pall).*VSA", "covariates": ["ICV_vol_VSA"]},
    "subcort_infant + subcort_VSA": {"pattern": r"(Amygdala|Putamen|Caudate|Thalamus|GlobusPall|Globus_Pall|Hippocampus).*(v12|v24|VSA)",
                                     "covariates": ["ICV_V12", "ICV_V24", "ICV_vol_VSA"]},
    "cortical_thickness_VSA": {"pattern": "CT_VSA"}, "surface_area_VSA": {"pattern": "SA_VSA"},
    "fa_VSA": {"pattern": "^FA_"}, "rd_VSA": {"pattern": "^RD_"}, "md_VSA": {"pattern": "^MD_"}, "ad_VSA": {"pattern": "^AD_"},
}
BEHAVIOURS = ("AB_12_Percent", "AB_24_Percent", "BRIEF2_GEC_T_score", "BRIEF2_GEC_raw_score", "Flanker_Standard_Age_Corrected", "DCCS_Standard_Age_Corrected")
NOT_FEATURES = ("CandID", "Identifiers", "Combined_ASD_DX", "Risk", "Sex", *BEHAVIOURS, "Group", "Group_HR+", "Group_HR-", "Group_LR-")

# ---------------------------------------------------------------- integration of behaviour and demographics


def subject_basics(dob_risk_sex: DataFrame) -> DataFrame:
    """One birth date, risk and sex per subject where all copies of it agree."""
    clean = K.null_sentinels(dob_risk_sex, (".",))
    pick = lambda part: K.consensus(*[c for c in clean.columns if part in c]).alias(part)
    return clean.select(col(KEY), pick("DoB"), pick("Risk"), pick("Sex"))


def infant_diagnosis(diagnosis: DataFrame) -> DataFrame:
    kept = columns.keep_containing(diagnosis, ["Ever_DSMIV"], [KEY])
    merged = K.merge_twin_columns(K.null_sentinels(kept, (NEVER_DIAGNOSED,)))
    labelled = K.apply_to(merged, [c for c in merged.columns if c != KEY], lambda c: K.label_from_text(c, DX_RULES))
    return K.coalesce_columns(labelled, {"ASD_Ever_DSMIV_infant": [c for c in INFANT_DX_ORDER if c in labelled.columns]})


def brief_scores(brief1: DataFrame, brief2: DataFrame, exclude_ids: Sequence[str] = ()) -> DataFrame:
    """Second edition scores, completed from the first edition (without ``exclude_ids``), both collection modes merged."""
    old = columns.drop(brief1, BRIEF1_DROP)
    if exclude_ids:
        old = old.where(~F.coalesce(col(KEY).isin(*exclude_ids), F.lit(False)))
    wanted = [c for c in brief2.columns if c in (KEY, *BRIEF2_AGES) or (("raw_score" in c or "T_score" in c) and c not in BRIEF2_TOTALS)]
    filled = align.overlay(columns.keep(brief2, wanted), old, KEY, BRIEF_OVERLAY)
    return K.merge_twin_columns(filled.drop("filled"))


def task_scores(anotb: DataFrame) -> DataFrame:
    kept = columns.keep(anotb, ANOTB_KEEP)
    valid = K.rewrite(kept, {score: K.invalidate(score, code, 3) for score, code in ANOTB_VALIDITY.items()})
    return columns.drop(valid, ANOTB_VALIDITY.values())


def integrate_behaviour(sources: Mapping[str, DataFrame], exclude_ids: Sequence[str] = ()) -> DataFrame:
    """Nine raw sources to one typed row per subject.

    ``sources``: ``dob_risk_sex``, ``diagnosis``, ``dx``, ``demographics``, ``anotb``, ``toolbox``, ``brief1``, ``brief2``,
    ``education``; all columns text.  Copies of a subject that disagree stop the flow.  ``exclude_ids`` are left out of
    the first edition of the questionnaire.
    """
    dx = K.merge_twin_columns(columns.drop(sources["dx"], DX_DROP))
    dx2 = columns.keep_containing(sources["demographics"], DX2_PARTS, [KEY, *DX2_FINAL])
    toolbox = K.merge_twin_columns(columns.keep_containing(sources["toolbox"], TOOLBOX_PARTS, [KEY]))
    parts = [subject_basics(sources["dob_risk_sex"]), infant_diagnosis(sources["diagnosis"]), dx, dx2, task_scores(sources["anotb"]), toolbox,
             brief_scores(sources["brief1"], sources["brief2"], exclude_ids), columns.keep(sources["education"], [KEY, EDUCATION])]
    merged = K.null_sentinels(align.align_sources(parts, KEY, on_duplicates="join"))
    projects = [c for c in merged.columns if "Project" in c]
    included = rows.drop_rows_any_contains(merged, projects, EXCLUDED_POPULATIONS)
    unused = [c for c in dx.columns if c not in (KEY, EVER_DX)] + [c for c in dx2.columns if c not in (KEY, *DX2_FINAL)]
    labelled = columns.rename(columns.drop(included, unused), TOOLBOX_NAMES)
    labelled = K.rewrite(labelled, {EVER_DX: K.label_from_text(EVER_DX, DX_RULES), "NIHToolBox,TestName1": K.label_from_text("NIHToolBox,TestName1", TASK_RULES),
                                    "NIHToolBox,TestName2": K.label_from_text("NIHToolBox,TestName2", TASK_RULES)})
    diagnosed = K.coalesce_columns(labelled, {"Combined_ASD_DX": [EVER_DX, "ASD_Ever_DSMIV_infant"]})
    typed = K.coerce_numeric(diagnosed, CATEGORIES)
    tested = rows.drop_rows_all_missing(typed, [c for c in typed.columns if c not in DEMOGRAPHIC])
    flanker, dccs = K.route_value("NIHToolBox,TestName1", *TOOLBOX_SCORES, "Flanker", "DCCS")
    months = K.months_between_days(K.parse_short_date("DoB"), K.parse_short_date("NIHToolBox,Date_taken"))
    scored = K.rewrite(tested, {
        "Flanker_Standard_Age_Corrected": flanker, "DCCS_Standard_Age_Corrected": dccs, "Age_SchoolAge": F.coalesce(months, col(TOOLBOX_AGE)),
        "Group": K.cross_label("Risk", "Combined_ASD_DX", K.RISK_GROUPS)})
    slim = columns.drop(scored, [*TOOLBOX_SCORES, "NIHToolBox,TestName1", "NIHToolBox,TestName2", TOOLBOX_AGE, "NIHToolBox,Date_taken", "DoB"])
    brief = [c for c in slim.columns if "BRIEF2" in c and c not in BRIEF2_FINAL]
    return rows.reconcile_duplicates(columns.drop(slim, brief), KEY)


def add_race(subjects: DataFrame, reported: Sequence[DataFrame], registered: DataFrame,
             code: str = "VSD-All NIHToolBox,Registration_Data_Race") -> DataFrame:
    """One race label per subject: first non-missing over the sources, several marks meaning more than one."""
    parts = [K.null_sentinels(columns.keep_containing(p, ["race"], [KEY], case=False), (".",)) for p in reported]
    coded = K.merge_twin_columns(K.null_sentinels(columns.keep_containing(registered, ["race"], [KEY], case=False), (".",)))
    label = K.map_codes(K.as_number(code).cast("int"), K.RACE_CODES, "more_than_one_race", None)
    merged = align.align_sources([*parts, coded.select(col(KEY), label.alias("race_string"))], KEY, on_duplicates="join")
    marked = K.replace_matching(merged, "@", "more_than_one_race", [KEY])
    one = K.coalesce_columns(marked, {"race": [c for c in marked.columns if c != KEY]})
    joined = align.lookup(subjects, one, KEY)
    return K.rewrite(joined, {"race": K.fill_label("race", "unknown_not_reported")})


# Severity columns in order of preference.
SEVERITY_EARLY = ("V37Plus ADOS_Derived,severity_score_lookup", "V36 ADOS_Derived,severity_score_lookup",
                  "V24 ADOS_Derived,severity_score_lookup")
SEVERITY_SCHOOL = ("VSA ados2_module3,severity_score_lookup", "VSA ados2_module2,severity_score_lookup",
                   "VSA ados2_module1,severity_score_lookup")
IQ_SCORES = ("V12 mullen,composite_standard_score", "V24 mullen,composite_standard_score")
IQ_SCHOOL, IQ_AGE = "VSA DAS_SA,GCA_STD_SCORE", "VSA DAS_SA,Candidate_Age"


def add_severity_and_iq(subjects: DataFrame, early: DataFrame, school: DataFrame, iq: DataFrame) -> DataFrame:
    """Severity and ability scores; school age comes from the ability test, else from the subject table."""
    first = lambda df, names, out: K.null_sentinels(df, (".",)).select(
        col(KEY), F.coalesce(*[K.as_number(c) for c in names]).alias(out))
    clean = K.null_sentinels(iq, (".",))
    scores = clean.select(col(KEY), *[K.as_number(c).alias(c) for c in IQ_SCORES],
                          K.replace_literal(IQ_SCHOOL, "less than 25", 25).alias(IQ_SCHOOL), K.as_number(IQ_AGE).alias(IQ_AGE))
    out = subjects
    for part in (first(early, SEVERITY_EARLY, "V24_V36_ados_severity_score"), first(school, SEVERITY_SCHOOL, "VSA_ados2_severity_score"), scores):
        out = align.lookup(out, part, KEY)
    return K.coalesce_columns(out, {"Final_Age_School_Age": [IQ_AGE, "Age_SchoolAge"]})


def add_missing_ages(subjects: DataFrame, ages: DataFrame) -> DataFrame:
    joined = align.lookup(subjects, ages.select(col(KEY), col("Calculated_Age")), KEY)
    return K.rewrite(joined, {"Final_Age_School_Age": F.coalesce(col("Calculated_Age"), col("Final_Age_School_Age"))}).drop("Calculated_Age")


# ---------------------------------------------------------------- features


def school_age_features(raw: DataFrame, unwanted: Sequence[str], measure: str = "") -> DataFrame:
    """School-age measures: quality columns out, text to numbers, names marked with measure and visit."""
    kept = columns.drop_containing(raw, unwanted)
    numbers = K.coerce_numeric(K.null_sentinels(kept, (".",)), ["CandID"])
    return columns.rename_affix(numbers, suffix=f"_{measure}_VSA" if measure else "_VSA", except_names=["CandID"])


def infant_structures(files: Mapping[str, DataFrame], visits: Sequence[str] | None = None) -> DataFrame:
    """One file per structure, several visits each (all that occur, or those in ``visits``), to one wide row per subject; volume
    totals are left out."""
    wide = []
    for name, df in files.items():
        if name == "ICV":
            continue
        features = [c for c in df.columns if c not in ("Combined_ID", "DCCID", "Visit") and not any(p in c for p in ("_VQC", "_ExcludeReason", "Edited"))]
        typed = K.coerce_numeric(df, ["DCCID", "Visit"], [*features])
        wide.append(reshape.widen_visits(typed, "DCCID", "Visit", features, visits))
    merged = align.align_sources(wide, "DCCID")
    return columns.rename(columns.drop(merged, [c for c in merged.columns if c.startswith("totTiss_v")]), {"DCCID": "CandID"})


# Tracts that are not used, and columns that describe the scan.
UNUSED_TRACTS = "Optic|Motor|Fornix|CorticoSpinal|UNC|Reticular|ILF|CT|CF|CC|Temporo|IFOF"
SCAN_COLUMNS = ("Visit_label", "CandID_Visit", "dMRI_protocol", "FileID")


def diffusion_features(files: Mapping[str, DataFrame]) -> DataFrame:
    """``{metric: frame}`` joined by subject, names prefixed with the metric; exact repeats removed."""
    parts = []
    for metric, df in files.items():
        slim = columns.drop(df, SCAN_COLUMNS)
        kept = columns.drop(slim, columns.matching(slim, UNUSED_TRACTS, ["CandID"]))
        numbers = rows.distinct_rows(K.coerce_numeric(K.null_sentinels(kept, (".", "")), ["CandID"]))
        parts.append(columns.rename_affix(numbers, prefix=f"{metric}_", except_names=["CandID"]))
    return align.align_sources(parts, "CandID", on_duplicates="join")


def subject_table(raw: DataFrame) -> DataFrame:
    """Integrated subjects with sex as 0/1 and one column per group."""
    coded = K.rewrite(raw, {"Sex": K.encode_binary("Sex", "Male", "Female")})
    return K.one_hot(coded, "Group")


def combine_features(subjects: DataFrame, features: Sequence[DataFrame], ratios: Sequence[tuple[DataFrame, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """All feature tables on one row per subject, without subjects that lack all features or all behaviours.

    ``ratios`` lists (table whose columns are divided, visit).  Returns the table and the rows without any feature.
    """
    distinct = [rows.distinct_rows(f) for f in (subjects, *features)]
    typed = [f.withColumn("CandID", K.as_number(col("CandID").cast("string")).cast("long")) for f in distinct]
    merged = align.align_sources(typed, "CandID", on_duplicates="join")
    measured = rows.drop_rows_all_missing(merged, [c for c in merged.columns if c not in NOT_FEATURES])
    removed = align.removed_rows(merged, measured)
    out = rows.drop_rows_all_missing(measured, [c for c in BEHAVIOURS if c in measured.columns])
    for table, visit in ratios:
        out = K.ratio_to_visit_volume(out, visit, table.columns)
    return columns.drop_containing(out, ["Tiss"]), removed


# ---------------------------------------------------------------- predictors and target


def predictors_and_target(
    df: DataFrame, target: str, feature_set: str, include_group: bool = False, diagnosed_in_training: bool = False,
    quick: bool = False, max_correlation: float | None = None,
) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Rows with the target, the site, sex and the chosen features; diagnosed subjects are held out unless told otherwise.

    Returns training rows, held-out rows (or None) and the feature names.
    """
    sited = columns.move_column(df.withColumn("Site", K.derive_prefix(KEY)), "Site", 2)
    features = columns.matching(sited, FEATURE_SETS[feature_set]["pattern"], FEATURE_SETS[feature_set].get("without", ()))
    groups = [c for c in ("Group_HR+", "Group_HR-", "Group_LR-") if include_group and c in sited.columns]
    if max_correlation is not None:
        # Missing cells are left to the pairs they concern.
        gone = set(collinear_columns(pairwise_correlation(sited.where(col(target).isNotNull()), features), features, max_correlation))
        features = [f for f in features if f not in gone]
    names = [KEY, "Site", "Sex", "Group", *groups, *features, target]
    if diagnosed_in_training:
        train, held = sited.where(col(target).isNotNull()), None
    else:
        train, held = holdout_by_group(sited, target, "Combined_ASD_DX", ["ASD-"], ["ASD+"])
        held = columns.keep(held, names)
    train = columns.keep(train, names)
    return (rows.sample_rows(train, KEY, 0.1) if quick else train), held, [*groups, *features]
