"""Cleaning, features and the faceted view."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import clean, facets, features, ranks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def credit(spark):
    data = [  # id, debt, tier, dependents, age, income
        (1, 0.1, "Alto", 0, 20, 100.0), (2, 0.2, "Alto", 0, 30, 300.0), (3, 0.3, "Bajo", 1, 31, 50.0),
        (4, 0.4, "Medio", 2, 45, None), (5, None, "Alto", 2, 45, 70.0), (6, 0.6, "Bajo", None, 90, 10.0), (7, 0.2, "Medio", 0, 33, 500.0),
    ]
    return spark.createDataFrame(data, "ID long, radio_deuda double, nivel_riesgo string, num_dependientes int, edad int, ingreso_mensual double")


def test_projections(spark, credit):
    assert clean.rename(credit, {"edad": "age", "nope": "x"}).columns[4] == "age"
    assert "edad" not in clean.drop(credit, "edad", "nope").columns
    assert clean.columns_of_class(credit, "text") == ["nivel_riesgo"]
    assert clean.drop_missing(credit).count() == 4
    assert rows(credit.select("ID", clean.fill_to_int("num_dependientes")))[5] == (6, 0)
    assert rows(clean.without_noise(spark.createDataFrame([(1, -1), (2, 0)], "a int, cluster int"))) == [(2, 0)]


def test_clip_rules_null_what_lies_outside(spark):
    df = spark.createDataFrame([(-0.5, 3.0), (0.0, 1.0), (1.0, 0.5), (1.2, -4.0)], "uso_de_credito double, radio_deuda double")
    got = clean.clip_columns(df, df.columns, clean.CREDIT_CHART_RANGES).collect()
    assert [r[0] for r in got] == [None, 0.0, 1.0, None] and [r[1] for r in got] == [None, 1.0, 0.5, -4.0]


def test_order_and_pages(spark):
    df = spark.range(30).repartition(5)
    assert [r.id for r in clean.page(df, 2, "id").collect()] == [14, 15, 16, 17, 18, 19]
    assert [r.id for r in clean.head(df, 3, "id").collect()] == [0, 1, 2]
    assert [r.id for r in clean.sort_rows(df, "id", descending=True).limit(2).collect()] == [29, 28]
    with pytest.raises(ValueError):
        clean.head(df, 3)


def test_sample_is_exact_and_stable(spark):
    df = spark.range(1000)
    one = rows(clean.sample_rows(df.repartition(3), 50, "id"))
    assert len(set(one)) == 50 and one == rows(clean.sample_rows(df.repartition(7), 50, "id"))
    assert one != rows(clean.sample_rows(df, 50, "id", seed=2))


def test_best_entry_takes_the_first_listed_on_ties(spark):
    df = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.7), (2, "c", 0.7), (3, "d", None)], "ord int, m string, s double")
    assert clean.best_entry(df, "s", "ord").first()["m"] == "b"


def test_value_codes_are_dense_and_sorted(spark):
    data = [(f"v{i % 37:02d}", f"w{i % 5}" if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(data, "a string, b string").repartition(6)
    got = {(r.column, r.value): r.code for r in ranks.value_codes(df, ["a", "b"]).collect()}
    expected = {("a", f"v{i:02d}"): i for i in range(37)} | {("b", f"w{i}"): i for i in range(5)}
    assert got == expected


def test_codes(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "b", "x")], "id int, s string, t string")
    assert rows(features.label_encode(df, "s").select("id", "s_encoded")) == [(1, 1), (2, 0), (3, 2), (4, 1)]
    assert rows(features.category_codes(df)) == [(1, 1, 0), (2, 0, -1), (3, -1, 1), (4, 1, 0)]


def test_joins_and_lookup(spark):
    fact = spark.createDataFrame([(1, 10), (2, 11), (9, 10)], "u int, i int")
    users, items = spark.createDataFrame([(1, "a"), (2, "b")], "u int, n string"), spark.createDataFrame([(10, "x")], "i int, t string")
    assert rows(features.join_dimensions(fact, (users, "u"), (items, "i")).select("u", "i", "n", "t")) == [(1, 10, "a", "x")]
    dim = spark.createDataFrame([(1, "CA"), (1, "CA"), (3, "KY")], "u int, state string")
    assert rows(features.lookup(fact.select("u"), dim, "u", "state").fillna("-")) == [(1, "CA"), (2, "-"), (9, "-")]


def test_standardize_uses_the_population_deviation(spark):
    data = np.random.default_rng(0).normal(5, 3, (50, 2))
    df = spark.createDataFrame([(float(a), float(b), 7.0) for a, b in data], "a double, b double, flat double")
    got = np.array([tuple(r) for r in features.standardize(df, ["a", "b", "flat"]).collect()])
    assert np.allclose(got[:, :2], (data - data.mean(0)) / data.std(0)) and (got[:, 2] == 0).all()


def test_facet_filter_and_guard(credit):
    everything = dict(debt=(0.0, 1.0), tiers=["Alto", "Medio", "Bajo"], age=(0, 200))
    assert [r.ID for r in facets.facet_filter(credit, dependents=0, **everything).collect()] == [1, 2, 7]
    for outside in (-1, 3):
        kept = facets.facet_filter(credit, dependents=outside, **everything)
        assert kept.isEmpty() and facets.indicators(kept).isEmpty()
    assert facets.facet_filter(credit, dependents=2, max_dependents=1, **everything).isEmpty()
    total, mean = facets.indicators(facets.facet_filter(credit, (0.0, 1.0), ["Alto"], 0, (0, 200))).first()
    assert (total, mean) == (2, 200.0)


def test_means_leave_out_missing_keys(credit):
    assert rows(facets.mean_by(credit, "num_dependientes", "radio_deuda")) == [(0, pytest.approx(0.5 / 3)), (1, 0.3), (2, 0.4)]


def test_debt_index_matches_numpy(credit):
    got = rows(facets.debt_index(credit).select("num_dependientes", "indice_endeudamiento"))
    means = np.array([0.5 / 3, 0.3, 0.4])
    expected = np.round(1 + 9 * (means - means.min()) / (means.max() - means.min()), 1)
    assert [v for _, v in got] == list(expected)
    one = facets.debt_index(credit.filter("num_dependientes = 1")).first()
    assert one["indice_endeudamiento"] is None


def test_absent_pairs_keep_a_null_mean(credit):
    got = facets.income_by_age_and_tier(credit, ["40-49", "20-29", "70-79"]).orderBy("ord", "nivel_riesgo").collect()
    assert [(r.ord, r.grupo_edad, r.nivel_riesgo, r.ingreso_mensual) for r in got] == [
        (0, "40-49", "Alto", 70.0), (0, "40-49", "Medio", None), (1, "20-29", "Alto", 200.0), (1, "20-29", "Medio", None),
        (2, "70-79", "Alto", None), (2, "70-79", "Medio", None)]
    assert facets.income_by_age_and_tier(credit, []).isEmpty()
    assert facets.income_by_age_and_tier(credit.limit(0), ["20-29"]).isEmpty()


def test_age_groups_reach_the_maximum(credit):
    assert [r.grupo_edad for r in facets.age_groups(credit).orderBy("ord").collect()] == [f"{a}-{a + 9}" for a in range(20, 91, 10)]
    assert facets.age_groups(credit.filter("edad < 20")).isEmpty()


def test_selection_order(credit):
    got = facets.in_selection(credit, ["40-49", "20-29"]).orderBy("ID").collect()
    assert [(r.ID, r.ord) for r in got] == [(1, 1), (2, 1), (4, 0), (5, 0)]


def test_shares_count_missing_keys_in_the_denominator(spark, credit):
    pdf = pd.DataFrame([tuple(r) for r in credit.collect()], columns=credit.columns)
    got = {(r.column, r.value): (r.n, r.percent) for r in facets.category_shares(credit, ["nivel_riesgo", "num_dependientes"]).collect()}
    for value, n in pdf["num_dependientes"].value_counts().items():
        assert got["num_dependientes", str(int(value))] == (n, pytest.approx(100 * n / len(pdf)))
    assert sum(p for (c, _), (_, p) in got.items() if c == "nivel_riesgo") == pytest.approx(100)
    assert ("num_dependientes", None) not in got


def test_domain(credit):
    r = facets.facet_domain(credit).first()
    assert (r.deuda_min, r.deuda_max, r.edad_min, r.edad_max, r.dependientes_max) == (0.1, 0.6, 20, 90, 2)
    assert rows(facets.facet_values(credit)) == [("Alto",), ("Bajo",), ("Medio",)]
    assert facets.facet_domain(credit.filter(F.lit(False))).first().edad_max is None
