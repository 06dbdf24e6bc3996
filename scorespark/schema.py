"""Column names, table schemas and the fixed value tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

ENTITY = "student_id"
NAME = "name"
PERIOD = "year"
CATEGORY = "subject"
SCORE = "mark"
LABEL = "label"
SPLIT = "split"

# --- fixed values: the five subjects and the two default years ---------------
SUBJECTS = ["Math", "Physics", "CS", "English", "Statistics"]
BASE_YEAR = 2024
NEXT_YEAR = 2025
SCORE_MIN = 0.0
SCORE_MAX = 100.0
FAIL_MARK = 50.0

# --- fixed values: the nineteen features in their canonical order ------------
FEATURES = [
    "gender",
    "age",
    "logins",
    "total_hours",
    "pct_avg_hours",
    "presence_count",
    "absence_count",
    "pct_attended",
    "attending_from_home",
    "distance_to_uni_km",
    "polar4_quintile",
    "polar3_quintile",
    "adult_he_2001_quintile",
    "adult_he_2011_quintile",
    "tundra_msoa_quintile",
    "tundra_lsoa_quintile",
    "gaps_gcse_quintile",
    "gaps_gcse_ethnicity_quintile",
    "uni_connect_target_ward",
]

# --- fixed values: the source header of every feature and of the label -------
SOURCE_HEADERS = {
    "gender": "Gender",
    "age": "Age",
    "logins": "Count of Module Area Logins",
    "total_hours": "Total Hours in Module Area",
    "pct_avg_hours": "% of Average Hours in Module Area",
    "presence_count": "# of presence",
    "absence_count": "# of Absence",
    "pct_attended": "Percent Attended",
    "attending_from_home": "attending from home?",
    "distance_to_uni_km": "distance to university (km)",
    "polar4_quintile": "POLAR4 Quintile",
    "polar3_quintile": "POLAR3 Quintile",
    "adult_he_2001_quintile": "Adult HE 2001 Quintile",
    "adult_he_2011_quintile": "Adult HE 2011 Quintile",
    "tundra_msoa_quintile": "TUNDRA MSOA Quintile",
    "tundra_lsoa_quintile": "TUNDRA LSOA Quintile",
    "gaps_gcse_quintile": "Gaps GCSE Quintile",
    "gaps_gcse_ethnicity_quintile": "Gaps GCSE Ethnicity Quintile",
    "uni_connect_target_ward": "Uni Connect target ward",
    "label": "label (fail=1, pass=0)",
}

# --- fixed values: allowed range of every feature ----------------------------
FEATURE_RANGES = {
    "gender": (0, 1),
    "age": (16, 60),
    "logins": (0, 200),
    "total_hours": (0, 500),
    "pct_avg_hours": (0, 5),
    "presence_count": (0, 20),
    "absence_count": (0, 20),
    "pct_attended": (0, 100),
    "attending_from_home": (0, 1),
    "distance_to_uni_km": (0, 200),
    "polar4_quintile": (1, 5),
    "polar3_quintile": (1, 5),
    "adult_he_2001_quintile": (1, 5),
    "adult_he_2011_quintile": (1, 5),
    "tundra_msoa_quintile": (1, 5),
    "tundra_lsoa_quintile": (1, 5),
    "gaps_gcse_quintile": (1, 5),
    "gaps_gcse_ethnicity_quintile": (1, 5),
    "uni_connect_target_ward": (0, 1),
}
QUINTILES = [f for f in FEATURES if f.endswith("_quintile")]
# features that take whole values only, so a range check is a set check
WHOLE_FEATURES = ["gender", "attending_from_home", "uni_connect_target_ward", *QUINTILES]

MARKS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField(ENTITY, T.StringType(), False),
    T.StructField(PERIOD, T.IntegerType(), False),
    T.StructField(CATEGORY, T.StringType(), False),
    T.StructField(SCORE, T.DoubleType()),
])
STUDENTS_SCHEMA = T.StructType([
    T.StructField(ENTITY, T.StringType(), False),
    T.StructField(NAME, T.StringType(), False),
])
FEATURE_SCHEMA = T.StructType(
    [T.StructField(f, T.DoubleType()) for f in FEATURES]
    + [T.StructField(LABEL, T.IntegerType()), T.StructField(SPLIT, T.StringType())]
)
MARK_LOG_COLUMNS = [ENTITY, "subject", "predicted_mark", "model_used"]
LABEL_LOG_COLUMNS = ["vle_student_id", "predicted_label", "predicted_proba", "model_used"]


def wide_schema(subjects: Iterable[str] = SUBJECTS) -> T.StructType:
    """One row per (student, year), one double column per subject."""
    return T.StructType(
        [
            T.StructField(ENTITY, T.StringType()),
            T.StructField(NAME, T.StringType()),
            T.StructField(PERIOD, T.IntegerType()),
        ]
        + [T.StructField(s, T.DoubleType()) for s in subjects]
    )


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "frame") -> None:
    """Raise ``ValueError`` naming the columns ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
