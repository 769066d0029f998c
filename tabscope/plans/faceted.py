"""The faceted view's indicators and grouped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators import clean, facets
from tabscope.plans import Catalog
from tabscope.plans.cleaning import AGE_SQL
from tabscope.plans.views import TIERS, on_credit, on_ratings, order_profile, rating_events, rounded
from tabscope.functions.scalars import day_of_week, month_number, threshold_flag

catalog = Catalog()
query = catalog.query

DEBT = (0.01, 0.09)
SELECTED_AGES = ["50-59", "30-39", "40-49"]


@query("a1_indicators", on_credit("""SELECT count(*) AS total, round(avg(ingreso_mensual), 6) AS ingreso_promedio FROM order_profile
WHERE radio_deuda BETWEEN 0.01 AND 0.09 AND nivel_riesgo IN ('Alto', 'Medio') AND num_dependientes = 1 AND edad BETWEEN 25 AND 60"""))
def indicators(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(facets.indicators(facets.facet_filter(order_profile(spark, folder), DEBT, ["Alto", "Medio"], 1, (25, 60))))


@query("a2_income_by_tier", on_credit("""SELECT nivel_riesgo, round(avg(ingreso_mensual), 6) AS ingreso_mensual FROM order_profile
WHERE radio_deuda BETWEEN 0.01 AND 0.09 GROUP BY nivel_riesgo ORDER BY nivel_riesgo"""))
def income_by_tier(spark: SparkSession, folder: str) -> DataFrame:
    # straight from the tables: a single pass needs no written view
    return clean.sort_rows(rounded(facets.mean_by(order_profile(spark, folder), "nivel_riesgo", "ingreso_mensual", DEBT)), "nivel_riesgo")


@query("a2_credit_use_by_tier", on_credit("""SELECT nivel_riesgo, round(avg(uso_de_credito), 6) AS uso_de_credito FROM order_profile
WHERE radio_deuda BETWEEN 0.01 AND 0.09 GROUP BY nivel_riesgo ORDER BY nivel_riesgo"""))
def credit_use_by_tier(spark: SparkSession, folder: str) -> DataFrame:
    return clean.sort_rows(rounded(facets.mean_by(order_profile(spark, folder), "nivel_riesgo", "uso_de_credito", DEBT)), "nivel_riesgo")


@query("a3_income_by_age_and_tier", on_credit("""SELECT s.ord, s.grupo_edad, t.nivel_riesgo, round(avg(k.ingreso_mensual), 6) AS ingreso_mensual
FROM sel s CROSS JOIN (SELECT DISTINCT nivel_riesgo FROM kept) t LEFT JOIN kept k
  ON k.grupo_edad = s.grupo_edad AND k.nivel_riesgo = t.nivel_riesgo GROUP BY ALL""", AGE_SQL, """kept AS (SELECT a.grupo_edad, p.nivel_riesgo, p.ingreso_mensual FROM order_profile p JOIN ages a
  ON (edad > low OR (edad = low AND low = 20)) AND edad <= low + 10
  WHERE radio_deuda BETWEEN 0.01 AND 0.09 AND num_dependientes = 3 AND edad >= 20 AND a.grupo_edad IN ('60-69', '20-29', '90-99'))""",
    "sel AS (SELECT * FROM (VALUES (0, '60-69'), (1, '20-29'), (2, '90-99')) v(ord, grupo_edad))"))
def income_by_age_and_tier(spark: SparkSession, folder: str) -> DataFrame:
    kept = facets.facet_filter(order_profile(spark, folder), DEBT, TIERS, 3, (20, 200), max_dependents=5)
    return rounded(facets.income_by_age_and_tier(kept, ["60-69", "20-29", "90-99"])).orderBy("ord", "nivel_riesgo")


SHARE = """SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n,
round(count(*) * 100.0 / (SELECT count(*) FROM rows_), 6) AS percent FROM rows_ WHERE {c} IS NOT NULL GROUP BY {c}"""
SHARED = ["occupation", "state", "event_type", "month", "is_weekend", "day"]


@query("a4_category_share", on_ratings(" UNION ALL ".join(SHARE.format(c=c) for c in SHARED), """rows_ AS (
SELECT nullif(occupation, 'MACHINERY') AS occupation, state, event_type, month(ts) AS month,
CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, isodow(ts) - 1 AS day FROM rating_events)"""))
def category_share(spark: SparkSession, folder: str) -> DataFrame:
    rows = rating_events(spark, folder).select(
        F.nullif(F.col("occupation"), F.lit("MACHINERY")).alias("occupation"), "state", "event_type", month_number("ts").alias("month"),
        threshold_flag(day_of_week("ts"), 5).alias("is_weekend"), day_of_week("ts").alias("day"),
    )
    return rounded(facets.category_shares(rows, SHARED))


@query("a13_facet_domain", on_credit("""SELECT min(radio_deuda) AS deuda_min, max(radio_deuda) AS deuda_max, min(edad) AS edad_min,
max(edad) AS edad_max, max(num_dependientes) AS dependientes_max FROM order_profile"""))
def facet_domain(spark: SparkSession, folder: str) -> DataFrame:
    return facets.facet_domain(order_profile(spark, folder))


@query("a13_facet_values", on_credit("SELECT DISTINCT nivel_riesgo FROM order_profile"))
def facet_values(spark: SparkSession, folder: str) -> DataFrame:
    return facets.facet_values(order_profile(spark, folder))


@query("c11_selection_order", on_credit("""SELECT list_position(['50-59', '30-39', '40-49'], grupo_edad) - 1 AS ord,
grupo_edad, count(*) AS n FROM order_profile JOIN ages ON (edad > low OR (edad = low AND low = 20)) AND edad <= low + 10
WHERE grupo_edad IN ('50-59', '30-39', '40-49') GROUP BY ALL ORDER BY ord""", AGE_SQL))
def selection_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = facets.in_selection(order_profile(spark, folder), SELECTED_AGES)
    return rows.groupBy("ord", "grupo_edad").agg(F.count("*").alias("n")).orderBy("ord")


@query("c12_debt_index", on_credit("""SELECT num_dependientes, round(radio_deuda, 6) AS radio_deuda, round_even(1 + 9 * (radio_deuda - min(radio_deuda) OVER ())
 / nullif(max(radio_deuda) OVER () - min(radio_deuda) OVER (), 0), 1) AS indice_endeudamiento
FROM (SELECT num_dependientes, avg(radio_deuda) AS radio_deuda FROM order_profile WHERE radio_deuda BETWEEN 0.01 AND 0.09 GROUP BY ALL)"""))
def debt_index(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(facets.debt_index(order_profile(spark, folder), DEBT))
