"""Renaming, filters, expressions, joins, ordering and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions import scalars as S
from tabscope.functions.binning import cut, decade_label
from tabscope.operators import clean, facets, features
from tabscope.operators.profile import union_all
from tabscope.plans import Catalog
from tabscope.plans.views import (
    credit_raw, on_credit, on_ratings, order_profile, rating_events, rounded, table, with_ctes, written_profile,
)
from tabscope.sources.schemas import CREDIT_RENAMES

catalog = Catalog()
query = catalog.query

CREDIT_COLUMNS = """"ID", atraso_90, atraso_60_89, atraso_30_59, radio_deuda, uso_de_credito, edad, cuentas_abiertas,
num_otros_prestamos, ingreso_mensual, num_dependientes, delincuencia_reciente"""


@query("p1_rename", on_credit(f"SELECT {CREDIT_COLUMNS} FROM order_profile"))
def rename(spark: SparkSession, folder: str) -> DataFrame:
    return clean.rename(credit_raw(spark, folder), {**CREDIT_RENAMES, "no_such_column": "x"})


@query("p2_drop", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def drop(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop(table(spark, folder, "orders"), "o_orderstatus", "o_orderdate", "no_such_column")


@query("p3_select", on_credit("SELECT edad, radio_deuda, uso_de_credito, num_dependientes FROM order_profile"))
def select(spark: SparkSession, folder: str) -> DataFrame:
    return order_profile(spark, folder).select("edad", "radio_deuda", "uso_de_credito", "num_dependientes")


@query("p4_number_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def number_columns(spark: SparkSession, folder: str) -> DataFrame:
    return clean.select_class(table(spark, folder, "part"), "number")


@query("p4_text_columns", "SELECT p_name, p_brand, p_type FROM part")
def text_columns(spark: SparkSession, folder: str) -> DataFrame:
    return clean.select_class(table(spark, folder, "part"), "text")


@query("p5_facet_filter", on_credit(f"""SELECT {CREDIT_COLUMNS}, nivel_riesgo FROM order_profile
WHERE radio_deuda BETWEEN 0.02 AND 0.08 AND nivel_riesgo IN ('Alto', 'Bajo') AND num_dependientes = 2 AND edad BETWEEN 30 AND 55"""))
def facet_filter(spark: SparkSession, folder: str) -> DataFrame:
    return facets.facet_filter(order_profile(spark, folder), (0.02, 0.08), ["Alto", "Bajo"], 2, (30, 55))


@query("p6_facet_guard", on_credit("""
SELECT d.dependientes, count(*) AS total, round(avg(ingreso_mensual), 6) AS ingreso_promedio
FROM (VALUES (-1), (0), (5), (6)) d(dependientes) JOIN order_profile ON num_dependientes = d.dependientes
WHERE d.dependientes BETWEEN 0 AND (SELECT max(num_dependientes) FROM order_profile) AND nivel_riesgo IN ('Alto', 'Medio')
GROUP BY d.dependientes"""))
def facet_guard(spark: SparkSession, folder: str) -> DataFrame:
    view = written_profile(spark, folder)
    asked = [
        facets.indicators(facets.facet_filter(view, (0, 1), ["Alto", "Medio"], n, (0, 200))).withColumn("dependientes", F.lit(n))
        for n in (-1, 0, 5, 6)
    ]
    return rounded(union_all(asked))


@query("p7_range", on_credit("SELECT \"ID\", radio_deuda FROM order_profile WHERE radio_deuda >= 0.03 AND radio_deuda <= 0.05"))
def value_range(spark: SparkSession, folder: str) -> DataFrame:
    return clean.in_range(order_profile(spark, folder), "radio_deuda", 0.03, 0.05).select("ID", "radio_deuda")


@query("p8_chart_clips", on_credit("""SELECT "ID",
CASE WHEN uso_de_credito >= 0 AND uso_de_credito <= 1 THEN uso_de_credito END AS uso_de_credito,
CASE WHEN radio_deuda <= 1 THEN radio_deuda END AS radio_deuda,
CASE WHEN ingreso_mensual <= 50000 THEN ingreso_mensual END AS ingreso_mensual,
CASE WHEN num_otros_prestamos <= 5 THEN num_otros_prestamos END AS num_otros_prestamos,
CASE WHEN cuentas_abiertas <= 30 THEN cuentas_abiertas END AS cuentas_abiertas FROM order_profile"""))
def chart_clips(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clip_columns(order_profile(spark, folder), ["ID", *clean.CREDIT_CHART_RANGES], clean.CREDIT_CHART_RANGES)


@query("p9_group_members", on_credit("""SELECT "ID", nivel_riesgo FROM order_profile WHERE nivel_riesgo IN ('Medio', 'Sin riesgo')"""))
def group_members(spark: SparkSession, folder: str) -> DataFrame:
    return clean.in_values(order_profile(spark, folder).select("ID", "nivel_riesgo"), "nivel_riesgo", ["Medio", "Sin riesgo"])


def _with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return orders.withColumns({
        "o_totalprice": F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")),
        "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
    })


GAPS_SQL = """gaps AS (SELECT o_orderkey, CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS o_totalprice,
nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)"""


@query("p10_drop_missing", with_ctes("SELECT * FROM gaps WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL", GAPS_SQL))
def drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_missing(_with_gaps(spark, folder))


@query("p11_fill_to_int", with_ctes("SELECT o_orderkey, CAST(trunc(coalesce(o_totalprice, 0)) AS INTEGER) AS price FROM gaps", GAPS_SQL))
def fill_to_int(spark: SparkSession, folder: str) -> DataFrame:
    return _with_gaps(spark, folder).select("o_orderkey", clean.fill_to_int("o_totalprice").alias("price"))


@query("c1_risk_tier", on_credit('SELECT "ID", nivel_riesgo FROM order_profile'))
def risk_tier(spark: SparkSession, folder: str) -> DataFrame:
    return order_profile(spark, folder).select("ID", "nivel_riesgo")


@query("c2_threshold_flags", on_ratings("""SELECT event_id, CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
CASE WHEN rate >= 3 THEN 1 ELSE 0 END AS is_good FROM rating_events"""))
def threshold_flags(spark: SparkSession, folder: str) -> DataFrame:
    return rating_events(spark, folder).select(
        "event_id", S.threshold_flag(S.day_of_week("ts"), 5).alias("is_weekend"), S.threshold_flag("rate", 3).alias("is_good")
    )


@query("c3_value_map", "SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS status FROM lineitem")
def value_map(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", S.value_map("l_linestatus", {"F": 1, "O": 0}).alias("status")
    )


@query("c4_label_encode", on_ratings("""SELECT event_id, occupation, CAST(dense_rank() OVER (ORDER BY occupation) - 1 AS INTEGER)
AS occupation_encoded, state, CAST(dense_rank() OVER (ORDER BY state) - 1 AS INTEGER) AS state_encoded FROM rating_events"""))
def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = rating_events(spark, folder).select("event_id", "occupation", "state")
    return features.label_encode(features.label_encode(rows, "occupation"), "state")


@query("c4_label_encode_missing", """WITH g AS (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer)
SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment NULLS LAST) - 1 AS INTEGER) AS code FROM g""")
def label_encode_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("c_mktsegment"))
    return features.label_encode(rows, "c_mktsegment", "code")


@query("c5_category_codes", """WITH g AS (SELECT p_partkey, p_name, p_brand, nullif(p_type, 'ECONOMY') AS p_type FROM part),
t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM g WHERE p_type IS NOT NULL))
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS p_name,
CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand, CAST(coalesce(code, -1) AS INTEGER) AS p_type
FROM g LEFT JOIN t USING (p_type)""")
def category_codes(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return features.category_codes(part.withColumn("p_type", F.nullif(F.col("p_type"), F.lit("ECONOMY"))))


@query("c6_epoch_to_timestamp", "SELECT event_id, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS at FROM events")
def epoch_to_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    rows = table(spark, folder, "events").select("event_id", seconds.alias("seconds"))
    return rows.select("event_id", S.epoch_to_timestamp("seconds").cast("timestamp_ntz").alias("at"))


@query("c7_month", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def month(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", S.month_number("o_orderdate").alias("month"))


@query("c8_day_of_week", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day FROM orders")
def day_of_week(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", S.day_of_week("o_orderdate").alias("day"))


AGE_SQL = """ages AS (SELECT CAST(i AS INTEGER) AS ord, CAST(20 + 10 * i AS INTEGER) AS low, CAST(29 + 10 * i AS INTEGER) AS high,
(20 + 10 * i) || '-' || (29 + 10 * i) AS grupo_edad FROM (SELECT unnest(range(0, (SELECT (max(edad) - 20) // 10 + 1 FROM order_profile))) AS i))"""


@query("c9_age_groups", on_credit("SELECT ord, grupo_edad, low, high FROM ages", AGE_SQL))
def age_groups(spark: SparkSession, folder: str) -> DataFrame:
    return facets.age_groups(order_profile(spark, folder))


@query("c10_right_closed_bins", on_credit("""SELECT "ID", edad, grupo_edad FROM order_profile LEFT JOIN ages
ON (edad > low OR (edad = low AND low = 20)) AND edad <= low + 10""", AGE_SQL))
def right_closed_bins(spark: SparkSession, folder: str) -> DataFrame:
    return order_profile(spark, folder).select("ID", "edad", decade_label("edad").alias("grupo_edad"))


@query("c10_cut_edges", on_credit("""SELECT "ID", CASE WHEN edad BETWEEN 25 AND 40 THEN 'joven' WHEN edad > 40 AND edad <= 50 THEN 'medio'
WHEN edad > 50 AND edad <= 60 THEN 'mayor' END AS tramo FROM order_profile"""))
def cut_edges(spark: SparkSession, folder: str) -> DataFrame:
    return order_profile(spark, folder).select("ID", cut("edad", [25, 40, 50, 60], ["joven", "medio", "mayor"]).alias("tramo"))


@query("c13_round_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS r FROM lineitem")
def half_even(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", S.round_half_even(F.col("l_quantity") / 4, 1).alias("r")
    )


@query("j1_fact_to_users", "SELECT event_id, user_id AS userid, value, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def fact_to_users(spark: SparkSession, folder: str) -> DataFrame:
    fact = table(spark, folder, "events").select("event_id", F.col("user_id").alias("userid"), "value")
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("userid"), "c_mktsegment")
    return features.join_dimensions(fact, (users, "userid"))


@query("j2_fact_to_items", """SELECT l_orderkey, l_linenumber, l_quantity, p_name, p_size, s_name FROM lineitem
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def fact_to_items(spark: SparkSession, folder: str) -> DataFrame:
    fact = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    items = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    sellers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return features.join_dimensions(fact, (items, "l_partkey"), (sellers, "l_suppkey")).drop("l_partkey", "l_suppkey")


@query("j3_lookup", """SELECT c_custkey, c_nationkey AS zcode, n_name AS state FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""")
def lookup(spark: SparkSession, folder: str) -> DataFrame:
    dim = table(spark, folder, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("zcode"), F.col("n_name").alias("state"))
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("zcode"))
    return features.lookup(rows, dim.union(dim), "zcode", "state")


@query("l1_sort_ascending", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_name")
def sort_ascending(spark: SparkSession, folder: str) -> DataFrame:
    return clean.sort_rows(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_name")


@query("l2_sort_descending", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC")
def sort_descending(spark: SparkSession, folder: str) -> DataFrame:
    return clean.sort_rows(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", descending=True)


@query("l3_head", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
def head(spark: SparkSession, folder: str) -> DataFrame:
    return clean.head(table(spark, folder, "lineitem"), 20, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("l4_page", on_credit(f"""SELECT * FROM (SELECT {CREDIT_COLUMNS}, nivel_riesgo FROM order_profile
WHERE nivel_riesgo = 'Alto' AND num_dependientes = 0 ORDER BY "ID" LIMIT 20) ORDER BY "ID" LIMIT 7 OFFSET 14"""))
def page(spark: SparkSession, folder: str) -> DataFrame:
    rows = facets.facet_filter(order_profile(spark, folder), (0, 1), ["Alto"], 0, (0, 200), max_dependents=5)
    return clean.page(rows, 2, "ID")


@query("l5_seeded_sample", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5('1|' || o_orderkey), o_orderkey LIMIT 2000""")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    return clean.sample_rows(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 2000, "o_orderkey", seed=1)


@query("l6_best_entry", on_credit("""SELECT ord, nivel_riesgo, score FROM (
SELECT CASE nivel_riesgo WHEN 'Alto' THEN 0 WHEN 'Medio' THEN 1 WHEN 'Bajo' THEN 2 ELSE 3 END AS ord, nivel_riesgo,
CASE WHEN nivel_riesgo <> 'Bajo' THEN max(edad) END AS score FROM order_profile GROUP BY nivel_riesgo)
WHERE score IS NOT NULL ORDER BY score DESC, ord LIMIT 1"""))
def best_entry(spark: SparkSession, folder: str) -> DataFrame:
    scores = order_profile(spark, folder).groupBy("nivel_riesgo").agg(F.max("edad").alias("score"))
    listed = scores.select(
        (F.array_position(F.array(*[F.lit(t) for t in S.TIERS]), F.col("nivel_riesgo")) - 1).cast("int").alias("ord"),
        "nivel_riesgo", F.when(F.col("nivel_riesgo") != "Bajo", F.col("score")).alias("score"),
    )
    return clean.best_entry(listed, "score", "ord")
