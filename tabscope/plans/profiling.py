"""Column profiles and chart tables of the credit and rating views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators import charts, clean, profile
from tabscope.plans import Catalog
from tabscope.plans.views import FEATURES, on_credit, on_ratings, order_profile, rating_events, rounded, table, with_ctes, written_profile
from tabscope.scratch import materialize

catalog = Catalog()
query = catalog.query

ORDER_TEXT = ["o_orderstatus", "o_orderpriority"]
NUMBERS = ["atraso_90", "atraso_60_89", "atraso_30_59", *FEATURES]


def _gappy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without their key, with missing prices and priorities and with equal rows."""
    return table(spark, folder, "orders").select(
        "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_totalprice") < 400000, F.floor(F.col("o_totalprice") / 10000)).alias("price_step"),
    )


GAPPY_SQL = """gappy AS (SELECT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_totalprice < 400000 THEN CAST(floor(o_totalprice / 10000) AS BIGINT) END AS price_step
FROM orders)"""
GAPPY = ["o_orderstatus", "o_orderpriority", "year", "price_step"]


def _each(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))


@query("a5_value_counts", with_ctes(_each("""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM gappy
WHERE {c} IS NOT NULL GROUP BY {c}""", ORDER_TEXT), GAPPY_SQL))
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(_gappy_orders(spark, folder))


@query("a6_distinct_counts", with_ctes(_each("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct" FROM gappy""", GAPPY), GAPPY_SQL))
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_counts(_gappy_orders(spark, folder))


@query("a7_missing_counts", with_ctes(_each("""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count({c}) AS present FROM gappy""", GAPPY), GAPPY_SQL))
def missing_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.missing_counts(_gappy_orders(spark, folder))


@query("a8_duplicate_rows", with_ctes("""SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
SELECT count(*) AS n FROM gappy GROUP BY o_orderstatus, o_orderpriority, year, price_step)""", GAPPY_SQL))
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_rows(_gappy_orders(spark, folder))


_TYPES = dict(zip(GAPPY, ["string", "string", "int", "bigint"]))


@query("a9_table_info", with_ctes(" UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{_TYPES[c]}' AS type, count({c}) AS present, count(*) AS rows, 4 AS columns FROM gappy"""
    for i, c in enumerate(GAPPY)), GAPPY_SQL))
def table_info(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_info(_gappy_orders(spark, folder))


DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {t}"""


@query("a10_describe", on_credit(" UNION ALL ".join(DESCRIBE.format(c=c, t="order_profile") for c in NUMBERS)))
def describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.describe(written_profile(spark, folder).select(*NUMBERS)))


TOPS = """SELECT '{c}' AS "column", (SELECT count({c}) FROM gappy) AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max, (SELECT count(DISTINCT {c}) FROM gappy) AS "unique",
{c} AS top, n AS freq FROM (SELECT {c}, count(*) AS n FROM gappy WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""


@query("a10_describe_all", with_ctes(
    " UNION ALL ".join([DESCRIBE.format(c=c, t="gappy").replace(" FROM gappy", ' , NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM gappy')
                        for c in ("year", "price_step")] + [f"({TOPS.format(c=c)})" for c in ORDER_TEXT]), GAPPY_SQL))
def describe_all(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.describe(_gappy_orders(spark, folder), text=True))


@query("a11_quantiles", on_credit(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 6) AS value FROM order_profile"""
    for c in FEATURES for q in (0.05, 0.25, 0.5, 0.75, 0.95))))
def quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.quantiles(written_profile(spark, folder), FEATURES, [0.05, 0.25, 0.5, 0.75, 0.95]))


FENCES = """SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"""


@query("a11_fences", on_credit(" UNION ALL ".join(FENCES.format(c=c, t="order_profile") for c in FEATURES)))
def fences(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.fences(written_profile(spark, folder), FEATURES))


OUTLIERS = """SELECT "ID", {c} FROM order_profile WHERE {c} {op} (SELECT {q} FROM order_profile) ORDER BY {c} {d}"""


@query("a12_outliers_upper", on_credit(OUTLIERS.format(c="cuentas_abiertas", op=">", d="DESC",
       q="quantile_cont(cuentas_abiertas, 0.75) + 1.5 * (quantile_cont(cuentas_abiertas, 0.75) - quantile_cont(cuentas_abiertas, 0.25))")))
def outliers_upper(spark: SparkSession, folder: str) -> DataFrame:
    return profile.outliers(written_profile(spark, folder).select("ID", "cuentas_abiertas"), "cuentas_abiertas")


@query("a12_outliers_lower", on_credit(OUTLIERS.format(c="edad", op="<", d="ASC",
       q="quantile_cont(edad, 0.25) - 1.5 * (quantile_cont(edad, 0.75) - quantile_cont(edad, 0.25))")))
def outliers_lower(spark: SparkSession, folder: str) -> DataFrame:
    return profile.outliers(written_profile(spark, folder).select("ID", "edad"), "edad", side="lower")


@query("a14_centre_and_spread", on_ratings("""SELECT round(avg(rate), 6) AS mean, round(quantile_cont(rate, 0.5), 6) AS median,
(SELECT rate FROM rating_events GROUP BY rate ORDER BY count(*) DESC, rate LIMIT 1) AS mode, round(stddev_samp(rate), 6) AS std,
round(var_samp(rate), 6) AS variance FROM rating_events"""))
def centre_and_spread(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.centre_and_spread(rating_events(spark, folder).select("rate"), "rate"))


@query("a15_correlation", on_credit(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM order_profile" for a in NUMBERS for b in NUMBERS)))
def correlation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.correlation_matrix(written_profile(spark, folder), NUMBERS))


@query("a15_correlation_missing", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("NULL::DOUBLE" if "flat" in (a, b) else f"round(corr({a}, {b}), 6) + 0.0") + " AS r FROM g"
    + (" LIMIT 1" if False else "") for a in ("year", "price_step") for b in ("year", "price_step"))
    + "".join(f" UNION ALL SELECT '{a}', '{b}', NULL::DOUBLE" for a, b in
              (("year", "flat"), ("flat", "year"), ("price_step", "flat"), ("flat", "price_step"), ("flat", "flat"))),
    GAPPY_SQL, "g AS (SELECT * FROM gappy)"))
def correlation_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = _gappy_orders(spark, folder).withColumn("flat", F.lit(7))
    return rounded(profile.correlation_matrix(rows, ["year", "price_step", "flat"]))


BARS = """SELECT '{g}' AS category, CAST({g} AS VARCHAR) AS value, '{c}' AS number, count({c}) AS n, round(avg({c}), 6) AS mean,
round(avg({c}) - 1.96 * stddev_samp({c}) / sqrt(count({c})), 6) AS low, round(avg({c}) + 1.96 * stddev_samp({c}) / sqrt(count({c})), 6) AS high
FROM {t} WHERE {g} IS NOT NULL GROUP BY {g}"""


@query("a16_category_bars", on_credit(" UNION ALL ".join(
    BARS.format(g=g, c=c, t="order_profile") for g in ("nivel_riesgo", "num_dependientes") for c in ("ingreso_mensual", "edad", "radio_deuda"))))
def category_bars(spark: SparkSession, folder: str) -> DataFrame:
    # edad has far more than ten values, so it is no category
    return rounded(charts.category_bars(written_profile(spark, folder), ["nivel_riesgo", "num_dependientes", "edad"],
                                        ["ingreso_mensual", "edad", "radio_deuda"]))


@query("a16_income_by_dependents", on_credit("""SELECT num_dependientes, round(avg(ingreso_mensual), 6) AS ingreso_mensual
FROM (SELECT CAST(trunc(coalesce(nullif(num_dependientes, 3), 0)) AS INTEGER) AS num_dependientes, ingreso_mensual FROM order_profile) GROUP BY ALL"""))
def income_by_dependents(spark: SparkSession, folder: str) -> DataFrame:
    rows = order_profile(spark, folder).withColumn("num_dependientes", F.nullif(F.col("num_dependientes"), F.lit(3)))
    filled = rows.withColumn("num_dependientes", clean.fill_to_int("num_dependientes"))
    return rounded(filled.groupBy("num_dependientes").agg(F.avg("ingreso_mensual").alias("ingreso_mensual")))


HIST = """SELECT '{c}' AS "column", CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / {k}), 6) AS "left",
round(lo + (i + 1) * ((hi - lo) / {k}), 6) AS "right", count(x) AS n
FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {t}) e CROSS JOIN range(0, {k}) r(i)
LEFT JOIN (SELECT CAST({c} AS DOUBLE) AS x FROM {t}) v
  ON x >= lo + i::DOUBLE * ((hi - lo) / {k}) AND (x < lo + (i + 1)::DOUBLE * ((hi - lo) / {k}) OR i = {k} - 1) GROUP BY lo, hi, i"""


@query("a17_histogram", on_credit(" UNION ALL ".join(HIST.format(c=c, k=30, t="order_profile") for c in FEATURES)))
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(charts.histogram(written_profile(spark, folder), FEATURES, 30))


@query("a17_rating_histogram", on_ratings(" UNION ALL ".join(HIST.format(c=c, k=20, t="rating_events") for c in ("rate", "balance"))))
def rating_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(rating_events(spark, folder).select("rate", "balance"), "ratings")
    return rounded(charts.histogram(rows, ["rate", "balance"], 20))


STEPS = """SELECT '{c}' AS "column", CAST(i AS INTEGER) AS bin, round(i * {w}, 6) AS "left", round((i + 1) * {w}, 6) AS "right", count({c}) AS n
FROM range(0, {k}) r(i) LEFT JOIN order_profile ON {c} >= i::DOUBLE * {w} AND ({c} < (i + 1)::DOUBLE * {w} OR (i = {k} - 1 AND {c} <= (i + 1)::DOUBLE * {w})) GROUP BY i"""


@query("a18_step_histogram", on_credit(" UNION ALL ".join(
    STEPS.format(c=c, w=f"{float(w)!r}::DOUBLE", k=k) for c, (_, w, k) in charts.CREDIT_STEPS.items())))
def step_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(charts.step_histogram(order_profile(spark, folder)))


@query("a19_density_curve", on_credit("""SELECT CAST(i AS INTEGER) AS point, round(lo + i * (hi - lo) / 199, 6) AS x,
round(d.k / (n * h * sqrt(2 * pi())), 6) AS density, round(d.k / (n * h * sqrt(2 * pi())) * n, 6) AS scaled
FROM (SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n, any_value(h) AS h,
  sum(c * exp(-0.5 * pow((v - (lo + i * (hi - lo) / 199)) / h, 2))) AS k
  FROM range(0, 200) r(i), (SELECT CAST(edad AS DOUBLE) AS v, count(*) AS c FROM order_profile GROUP BY edad),
  (SELECT min(edad) AS lo, max(edad) AS hi, count(*) AS n, stddev_samp(edad) * pow(count(*), -0.2) AS h FROM order_profile) GROUP BY i) d"""))
def density_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(charts.density_curve(written_profile(spark, folder), "edad"))


CURVE = """SELECT '{c}' AS "column", CAST(i AS INTEGER) AS point, round(lo + i * (hi - lo) / 199, 6) AS x,
round(d.k / (n * h * sqrt(2 * pi())), 6) AS density, round(d.k / (n * h * sqrt(2 * pi())) * n * {w}, 6) AS scaled
FROM (SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n, any_value(h) AS h, sum(c * exp(-0.5 * pow((v - (lo + i * (hi - lo) / 199)) / h, 2))) AS k
  FROM range(0, 200) r(i), (SELECT CAST({c} AS DOUBLE) AS v, count(*) AS c FROM order_profile WHERE {f} GROUP BY {c}),
  (SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS n, stddev_samp({c}) * pow(count(*), -0.2) AS h FROM order_profile WHERE {f}) GROUP BY i) d"""
#: Columns whose curve stands over bars of a fixed width, within the chart's range.
CURVES = {"uso_de_credito": "uso_de_credito BETWEEN 0 AND 1", "radio_deuda": "radio_deuda <= 1", "ingreso_mensual": "ingreso_mensual <= 50000"}


@query("a19_density_clipped", on_credit(" UNION ALL ".join(CURVE.format(c=c, f=f, w=f"{float(charts.CREDIT_STEPS[c][1])!r}::DOUBLE") for c, f in CURVES.items())))
def density_clipped(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.clip_columns(written_profile(spark, folder), list(CURVES), clean.CREDIT_CHART_RANGES)
    curves = [charts.density_curve(rows, c, bin_width=charts.CREDIT_STEPS[c][1]).select(F.lit(c).alias("column"), "*") for c in CURVES]
    return rounded(profile.union_all(curves))


BOX = """SELECT '{c}' AS "column", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
round(least(min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)), q1), 6) AS whisker_low,
round(greatest(max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)), q3), 6) AS whisker_high, round(avg({c}), 6) AS mean,
count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM order_profile WHERE {f}) CROSS JOIN (SELECT quantile_cont({c}, 0.25) AS q1,
quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM order_profile WHERE {f}) GROUP BY q1, median, q3"""
BOX_RULES = {
    "uso_de_credito": "uso_de_credito BETWEEN 0 AND 1", "radio_deuda": "radio_deuda <= 1", "num_otros_prestamos": "num_otros_prestamos <= 5",
    "cuentas_abiertas": "cuentas_abiertas <= 30", "ingreso_mensual": "ingreso_mensual <= 50000", "edad": "edad IS NOT NULL",
}


@query("a20_box_stats", on_credit(" UNION ALL ".join(BOX.format(c=c, f=f) for c, f in BOX_RULES.items())))
def box_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.box_stats(written_profile(spark, folder), list(BOX_RULES), clean.CREDIT_CHART_RANGES))


@query("a21_class_count", on_credit("""SELECT count(DISTINCT nivel_riesgo) AS classes, count(DISTINCT nivel_riesgo) = 2 AS is_binary FROM order_profile"""))
def class_count(spark: SparkSession, folder: str) -> DataFrame:
    return profile.class_count(order_profile(spark, folder), "nivel_riesgo")
