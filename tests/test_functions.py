import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions import scalars as S
from tabscope.functions.binning import cut, decade_label, step_bin


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_first_matching_tier_wins_and_missing_falls_through(spark):
    df = spark.createDataFrame(
        [(1, 1, 1), (0, 2, 1), (0, 0, 3), (0, 0, 0), (None, 1, 0), (None, None, None)], "atraso_90 int, atraso_60_89 int, atraso_30_59 int")
    assert values(df, S.risk_tier()) == ["Alto", "Medio", "Bajo", "Sin riesgo", "Medio", "Sin riesgo"]
    assert values(df, S.risk_tier(threshold=1)) == ["Sin riesgo", "Medio", "Bajo", "Sin riesgo", "Sin riesgo", "Sin riesgo"]


def test_flag_gives_zero_for_missing(spark):
    df = spark.createDataFrame([(2,), (3,), (None,)], "rate int")
    assert values(df, S.threshold_flag("rate", 3)) == [0, 1, 0]


def test_value_map_fails_on_unmapped_and_missing(spark):
    df = spark.createDataFrame([("F",), ("M",)], "g string")
    assert values(df, S.value_map("g", {"F": 1, "M": 0})) == [1, 0]
    for bad in ("X", None):
        with pytest.raises(Exception, match="no code for g"):
            spark.createDataFrame([(bad,)], "g string").select(S.value_map("g", {"F": 1, "M": 0})).collect()


def test_dates_from_epoch_seconds(spark):
    moments = [dt.datetime(1998, 4, d, 23, 59, 59, tzinfo=dt.timezone.utc) for d in (6, 10, 11, 12)]
    df = spark.createDataFrame([(int(m.timestamp()),) for m in moments], "s long").withColumn("at", S.epoch_to_timestamp("s"))
    assert values(df, S.day_of_week("at")) == [m.weekday() for m in moments] == [0, 4, 5, 6]
    assert values(df, S.month_number("at")) == [4] * 4


def test_rescale_of_an_empty_range_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, 2.0, 2.0)], "x double, lo double, hi double")
    assert values(df, S.rescale(F.col("x"), F.col("lo"), F.col("hi"), 1.0, 10.0)) == [1.0, None]


def test_half_even_rounding(spark):
    data = [0.25, 0.35, 1.25, 2.5, -0.25]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    assert values(df, S.round_half_even(F.col("x"), 1)) == list(np.round(data, 1))


def test_right_closed_groups_match_pandas(spark):
    ages = [19, 20, 29, 30, 31, 40, 41, 90, None]
    edges, labels = list(range(20, 110, 10)), [f"{a}-{a + 9}" for a in range(20, 100, 10)]
    expected = [None if pd.isna(v) else v for v in pd.cut(pd.Series(ages, dtype=float), edges, labels=labels, right=True, include_lowest=True).astype(object)]
    df = spark.createDataFrame([(a,) for a in ages], "edad int")
    assert values(df, decade_label("edad")) == expected
    assert values(df, cut("edad", edges, labels)) == expected


def test_left_closed_cut(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "x int")
    assert values(df, cut("x", [0, 1, 2], ["a", "b"], closed="left")) == ["a", "b", "b", None]
    assert values(df, cut("x", [0, 1, 2], ["a", "b"], closed="left", include_end=False)) == ["a", "b", None, None]


def test_step_bins_follow_the_edge_comparison(spark):
    edges = np.array([i * 0.1 for i in range(11)])
    data = sorted({*edges, *np.nextafter(edges, -1), *np.nextafter(edges, 2), *np.linspace(-0.2, 1.2, 57)})
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    got = values(df, step_bin("x", 0, 0.1, 10))
    for v, b in zip(data, got):
        inside = edges[0] <= v <= edges[-1]
        assert b == (min(int(np.searchsorted(edges, v, side="right")) - 1, 9) if inside else None), v


def test_nan_becomes_missing(spark):
    df = S.nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string"))
    assert values(df, "x") == [None, 1.0]
