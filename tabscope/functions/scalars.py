"""Row-level expressions: tiers, flags, maps, dates, rescaling and safe division."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tier names, most severe first.
TIERS = ["Alto", "Medio", "Bajo", "Sin riesgo"]


def risk_tier(
    late_90: str = "atraso_90",
    late_60_89: str = "atraso_60_89",
    late_30_59: str = "atraso_30_59",
    threshold: int = 0,
) -> Column:
    """First lateness column above ``threshold`` names the tier; a missing count falls through."""
    severity = [late_90, late_60_89, late_30_59]
    hits = [F.when(F.col(c) > threshold, F.lit(t)) for c, t in zip(severity, TIERS)]
    return F.coalesce(*hits, F.lit(TIERS[-1]))


def threshold_flag(col: str | Column, threshold: float) -> Column:
    """1 at or above the threshold, else 0; missing gives 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c >= threshold, 1).otherwise(0)


def value_map(col: str, mapping: Mapping[str, int]) -> Column:
    """Replace each value by its code; a value outside the map, or a missing one, fails the job."""
    expr = None
    for value, code in mapping.items():
        cond = F.col(col) == value
        expr = F.when(cond, code) if expr is None else expr.when(cond, code)
    message = F.concat(F.lit(f"no code for {col}: "), F.coalesce(F.col(col).cast("string"), F.lit("NULL")))
    return expr.otherwise(F.raise_error(message).cast("int"))


def epoch_to_timestamp(col: str) -> Column:
    return F.timestamp_seconds(F.col(col))


def month_number(col: str) -> Column:
    return F.month(F.col(col))


def day_of_week(col: str) -> Column:
    """Monday is 0 and Sunday 6."""
    return F.weekday(F.col(col))


def safe_divide(a: Column, b: Column) -> Column:
    """NULL where the divisor is 0, under ANSI too."""
    return F.try_divide(a, b)


def rescale(col: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Linear map of [low, high] onto [to_low, to_high]; NULL when the range is empty."""
    return F.lit(to_low) + F.lit(to_high - to_low) * safe_divide(col - low, high - low)


def round_half_even(col: Column, digits: int) -> Column:
    return F.bround(col, digits)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere after ingest: Spark orders NaN above every number."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df
