"""Joins on group columns that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def join_groups(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of ``small``, one row a group, to ``big``; NULL groups match each other.

    Spark broadcasts ``small`` if its measured size allows, and else splits hot groups.
    """
    named = small.select(*[F.col(f"`{c}`").alias(f"_on_{c}" if c in on else c) for c in small.columns])
    same = F.lit(True)
    for c in on:
        same = same & big[f"`{c}`"].eqNullSafe(F.col(f"`_on_{c}`"))
    return big.join(named, same, how).drop(*[f"_on_{c}" for c in on])
