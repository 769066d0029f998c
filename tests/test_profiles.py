"""Profiles and chart tables against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import charts, profile, quantiles


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    n = 3000
    skewed = np.exp(rng.normal(0, 3, n))
    hot = np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 50, n).astype(float))
    gaps = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n) + 0.5 * hot)
    return pd.DataFrame({"skewed": skewed, "hot": hot, "gaps": gaps, "flat": 3.0})


@pytest.fixture(scope="module")
def df(spark, pdf):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "skewed double, hot double, gaps double, flat double").repartition(7).cache()


def by_column(table, name):
    return {r["column"]: r[name] for r in table.collect()}


@pytest.mark.parametrize("few,arrays", [(4096, 256), (3, 256), (0, 14)])
def test_quantiles_equal_numpy(df, pdf, monkeypatch, few, arrays):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ARRAYS", arrays)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["column"], r["q"]): r["value"] for r in quantiles.exact_quantiles(df, list(pdf), probs).collect()}
    for c in pdf:
        for p in probs:
            assert got[c, p] == pytest.approx(pdf[c].quantile(p), rel=1e-12), (c, p)


def test_images_keep_the_order_of_doubles():
    values = np.array([-np.inf, -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, np.inf, np.nan])
    images = quantiles.image(values)
    assert (np.diff(images.astype(object)) > 0).all()
    assert [quantiles.value_of(int(i)) for i in images[:-1]] == values[:-1].tolist() and np.isnan(quantiles.value_of(int(images[-1])))
    assert quantiles.image(np.array([-0.0])) == quantiles.image(np.array([0.0]))


def test_quantiles_of_a_hot_value_between_extremes(spark):
    values = [-1e308] * 3 + [2.0] * 900 + [float(i) for i in range(3, 50)] + [1e308] * 2
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(9)
    probs = [0.0, 0.001, 0.4, 0.95, 0.9999, 1.0]
    got = [r["value"] for r in quantiles.exact_quantiles(frame, ["v"], probs).orderBy("q").collect()]
    assert got == pytest.approx([pd.Series(values).quantile(p) for p in probs], rel=1e-12)


def test_quantiles_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(None, 4)], "a double, b int")
    got = {(r["column"], r["q"]): r["value"] for r in quantiles.exact_quantiles(df, ["a", "b"], [0.25, 0.5]).collect()}
    assert got == {("a", 0.25): None, ("a", 0.5): None, ("b", 0.25): 4.0, ("b", 0.5): 4.0}
    assert quantiles.exact_quantiles(df.limit(0), ["b"], [0.5]).first()["value"] is None


def test_describe_matches_pandas(df, pdf):
    got = {r["column"]: r for r in profile.describe(df).collect()}
    want = pdf.describe()
    for c in pdf:
        for ours, theirs in zip(["count", "mean", "std", "min", "q25", "q50", "q75", "max"], want.index):
            assert got[c][ours] == pytest.approx(want.loc[theirs, c], rel=1e-9, abs=1e-9)


def test_describe_text_and_counts(spark):
    data = [("a", 1), ("b", None), ("b", 1), (None, 2), ("a", 1)]
    df = spark.createDataFrame(data, "s string, n int")
    text = {r["column"]: r for r in profile.describe(df, text=True).collect()}["s"]
    assert (text["count"], text["unique"], text["top"], text["freq"]) == (4, 2, "a", 2)
    assert [tuple(r) for r in profile.value_counts(df).collect()] == [("s", "a", 2), ("s", "b", 2)]
    assert by_column(profile.distinct_counts(df), "distinct") == {"s": 2, "n": 2}
    assert by_column(profile.distinct_counts(df, approximate=True), "distinct") == {"s": 2, "n": 2}
    assert by_column(profile.missing_counts(df), "missing") == {"s": 1, "n": 1}
    assert profile.duplicate_rows(df).first()[0] == 1 == pd.DataFrame(data).duplicated().sum()
    assert profile.duplicate_rows(df.limit(0)).first()[0] == 0
    info = profile.table_info(df).orderBy("position").collect()
    assert [(r["column"], r["type"], r["present"], r["rows"], r["columns"]) for r in info] == [("s", "string", 4, 5, 2), ("n", "int", 4, 5, 2)]
    assert tuple(profile.class_count(df, "s").first()) == (2, True)


def test_outliers_are_strictly_beyond_the_fence(df, pdf):
    q1, q3 = pdf.hot.quantile([0.25, 0.75])
    assert by_column(profile.fences(df, ["hot"]), "upper")["hot"] == pytest.approx(q3 + 1.5 * (q3 - q1))
    q1, q3 = pdf.skewed.quantile([0.25, 0.75])
    upper = sorted(pdf.skewed[pdf.skewed > q3 + 1.5 * (q3 - q1)], reverse=True)
    assert [r.skewed for r in profile.outliers(df, "skewed").collect()] == upper
    negative = df.withColumn("skewed", -F.col("skewed"))
    assert [-r.skewed for r in profile.outliers(negative, "skewed", side="lower").collect()] == upper


def test_centre_and_spread(df, pdf):
    r = profile.centre_and_spread(df, "hot").first()
    s = pdf.hot
    assert (r["mean"], r["median"], r["mode"], r["std"], r["variance"]) == pytest.approx((s.mean(), s.median(), 5.0, s.std(), s.var()))


def test_correlation_is_pairwise_complete(df, pdf):
    got = {(r.a, r.b): r.r for r in profile.correlation_matrix(df).collect()}
    want = pdf.corr()
    for a in pdf:
        for b in pdf:
            if "flat" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_box_stats(df, pdf):
    got = {r["column"]: r for r in profile.box_stats(df, list(pdf), {"skewed": (None, 2.0)}).collect()}
    for c in pdf:
        s = pdf[c].dropna() if c != "skewed" else pdf[c][pdf[c] <= 2.0]
        q1, q3 = s.quantile([0.25, 0.75])
        inside = s[(s >= q1 - 1.5 * (q3 - q1)) & (s <= q3 + 1.5 * (q3 - q1))]
        r = got[c]
        assert (r["q1"], r["median"], r["q3"], r["mean"]) == pytest.approx((q1, s.median(), q3, s.mean()))
        assert (r["whisker_low"], r["whisker_high"]) == (min(inside.min(), q1), max(inside.max(), q3))
        assert r["outliers"] == len(s) - len(inside)


def test_histogram_equals_numpy_and_keeps_all_rows(df, pdf):
    got = charts.histogram(df, list(pdf), 30).toPandas()
    for c in pdf:
        s = pdf[c].dropna()
        counts, edges = np.histogram(s, bins=30)
        mine = got[got["column"] == c].sort_values("bin")
        assert mine["n"].sum() == len(s)
        assert np.allclose(mine["left"], edges[:-1]) and (mine["n"].to_numpy() == counts).all()


def test_step_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 4, 4, 5, 6, -1, None)], "x int")
    got = [r.n for r in charts.step_histogram(df, {"x": (0, 1, 5)}).orderBy("bin").collect()]
    assert got == [1, 1, 0, 0, 3]


def test_density_curve_equals_the_direct_sum(df, pdf):
    s = pdf.gaps.dropna().to_numpy()
    got = charts.density_curve(df, "gaps", bin_width=0.5).orderBy("point").toPandas()
    h = s.std(ddof=1) * len(s) ** (-1 / 5)
    x = np.linspace(s.min(), s.max(), 200)
    want = np.exp(-0.5 * ((s[None, :] - x[:, None]) / h) ** 2).sum(1) / (len(s) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], x) and np.allclose(got["density"], want, atol=1e-12)
    assert np.allclose(got["scaled"], want * len(s) * 0.5)
    assert charts.density_curve(df, "flat").isEmpty()


def test_bars_need_few_values(spark):
    data = [(f"k{i % 3}", f"m{i % 40}", float(i)) for i in range(120)] + [(None, "m1", 1.0)]
    df = spark.createDataFrame(data, "few string, many string, x double")
    got = {(r.category, r.value): r for r in charts.category_bars(df).collect()}
    assert {c for c, _ in got} == {"few"} and len(got) == 3
    s = pd.Series([float(i) for i in range(120) if i % 3 == 1])
    half = 1.96 * s.std() / np.sqrt(len(s))
    r = got["few", "k1"]
    assert (r["n"], r["mean"], r["low"], r["high"]) == pytest.approx((40, s.mean(), s.mean() - half, s.mean() + half))
    assert charts.category_bars(df, ["many"]).isEmpty()


def test_histogram_counts_by_edges(spark):
    rng = np.random.default_rng(6)
    for k in range(12):
        x = np.round(rng.random(rng.integers(20, 300)) * 10 ** rng.integers(0, 3), 2)
        bins = int(rng.integers(3, 31))
        got = charts.histogram(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), ["x"], bins)
        assert [r.n for r in got.orderBy("bin").collect()] == np.histogram(x, bins)[0].tolist(), k


def test_quantiles_of_tails_with_outliers(spark, monkeypatch):
    values = np.concatenate([np.random.default_rng(3).normal(size=20000), [-1e12, 1e12]])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
    probs = [0.0, 0.001, 0.5, 0.999, 1.0]

    def check():
        got = {r["q"]: r["value"] for r in quantiles.exact_quantiles(df, ["v"], probs).collect()}
        for p in probs:
            assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)

    check()
    monkeypatch.setattr(quantiles, "FEW", 2)
    check()
