"""Column expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def ref(name: str) -> Column:
    """A column by its exact name, spaces and dots included."""
    return F.col(f"`{name}`")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite_or_null(value: Column) -> Column:
    """NaN and infinities of a double become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a plain finite number becomes NULL.

    The pattern guards the cast: Spark also accepts ``1d`` and ``NaN`` as doubles.
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), finite_or_null(trimmed.try_cast("double")))


def numeric_or_null(df: DataFrame, name: str) -> Column:
    """The lenient conversion that fits the column's type."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return parse_number(ref(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or_null(ref(name).cast("double"))
    return ref(name).cast("double")


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Clip to [low, high]; NULL stays NULL (greatest and least skip NULLs)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def sentinel_to_null(value: Column, sentinel=0) -> Column:
    return F.nullif(value, F.lit(sentinel))


def encode_period(period: Column, base: int, count: int = 2) -> Column:
    """base -> 0, base + 1 -> 1, ... for ``count`` periods; others are NULL."""
    offset = period.cast("int") - F.lit(base)
    return F.when((offset >= 0) & (offset < count), offset)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the non-NULL values of one row; NULL when all are NULL."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    present = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return F.try_divide(total, present)


def best_and_worst(names: Sequence[str]) -> tuple[Column, Column]:
    """Names of the highest and the lowest non-NULL column; the first listed wins a tie."""

    def scored(sign: int) -> Column:
        entries = F.array(*[
            F.struct(
                ref(n).cast("double").alias("score"),
                F.lit(sign * i).alias("position"),
                F.lit(n).alias("name"),
            )
            for i, n in enumerate(names)
        ])
        return F.filter(entries, lambda e: e["score"].isNotNull())

    return F.array_max(scored(-1))["name"], F.array_min(scored(1))["name"]


def label_name(label: Column) -> Column:
    return F.when(label == 0, "Pass").otherwise("Fail")


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def format_entity_id(number: Column) -> Column:
    return F.format_string("S%03d", number)


def format_percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share.cast("double") * F.lit(100.0))


def grade(score: Column, cuts: Mapping[str, float], lowest: str = "F") -> Column:
    """Letter for a score: the highest cut point the score reaches, else ``lowest``."""
    ordered = sorted(cuts.items(), key=lambda item: -item[1])
    letter = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, cut in ordered:
        letter = letter.when(score >= F.lit(float(cut)), name)
    return letter.otherwise(lowest)


def in_range(value: Column, low: float, high: float, whole: bool = False) -> Column:
    """NULL values pass: a missing value is not a range violation."""
    ok = value.between(low, high)
    if whole:
        ok = ok & (value == F.floor(value))
    return F.coalesce(ok, F.lit(True))
