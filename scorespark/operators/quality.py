"""Data-quality counts and acceptance gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import in_range, ref
from ..schema import FEATURE_RANGES, WHOLE_FEATURES


def domain_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = FEATURE_RANGES,
                      whole: Sequence[str] = WHOLE_FEATURES) -> DataFrame:
    """Rows outside the allowed range per feature; one aggregation for all features."""
    checked = [f for f in ranges if f in df.columns]
    counts = df.agg(*[
        F.count_if(~in_range(ref(f), *ranges[f], f in whole)).alias(f) for f in checked
    ])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), ref(f).alias("violations")) for f in checked
    ])))


def within_domain(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = FEATURE_RANGES,
                  whole: Sequence[str] = WHOLE_FEATURES) -> DataFrame:
    """Only the rows without a range violation."""
    ok = F.lit(True)
    for f in ranges:
        if f in df.columns:
            ok = ok & in_range(ref(f), *ranges[f], f in whole)
    return df.where(ok)


def uni_connect_rule() -> Column:
    """The flag's definition: participation quintile 1 and attainment-gap quintile 1 or 2."""
    return (F.col("polar3_quintile") == 1) & F.col("gaps_gcse_quintile").isin(1, 2)


def flag_rule_check(df: DataFrame, flag: str = "uni_connect_target_ward",
                    rule: Column | None = None) -> DataFrame:
    """One row: rows checked, and rows whose flag disagrees with the rule either way."""
    expected = uni_connect_rule() if rule is None else rule
    actual = ref(flag) == 1
    return df.agg(
        F.count(expected & actual).alias("checked"),
        F.count_if(expected & ~actual).alias("flag_absent"),
        F.count_if(~expected & actual).alias("flag_unexpected"),
    )


def unit_overlap(a: DataFrame, b: DataFrame, column: str) -> bool:
    """Whether the value ranges of a column overlap in two tables (same unit)."""
    ends = [df.agg(F.min(ref(column)), F.max(ref(column))).first() for df in (a, b)]
    (low_a, high_a), (low_b, high_b) = ends
    if None in (low_a, low_b):
        return False
    span = max(high_a, high_b) - min(low_a, low_b)
    common = min(high_a, high_b) - max(low_a, low_b)
    return span == 0 or common / span > 0.1


def regression_gates(metrics: DataFrame, max_rmse: float = 20.0) -> DataFrame:
    return metrics.agg(F.bool_and(F.col("RMSE") < max_rmse).alias("rmse_ok"))


def classifier_gates(metrics: DataFrame, min_accuracy: float = 0.7) -> DataFrame:
    return metrics.agg(
        F.bool_or(F.col("accuracy") >= min_accuracy).alias("accuracy_ok"),
        F.bool_and(F.coalesce(F.col("recall_fail") > 0, F.lit(False))).alias("recall_ok"),
    )
