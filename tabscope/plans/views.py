"""Stand-in views: the credit and rating tables built from the given star schema.

Each view exists twice, as a DataFrame and as the SQL the checks use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.scalars import risk_tier
from tabscope.operators.clean import rename
from tabscope.operators.features import join_dimensions
from tabscope.scratch import materialize
from tabscope.sources.schemas import CREDIT_RENAMES

# more than one late line names a tier, so that all four tiers occur
TIER_THRESHOLD = 1
FEATURES = [
    "uso_de_credito", "edad", "radio_deuda", "ingreso_mensual", "cuentas_abiertas", "num_otros_prestamos", "num_dependientes",
]
TIERS = ["Alto", "Medio", "Bajo", "Sin riesgo"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def credit_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with lines, under the credit file's own column names."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("late_90"),
        F.count_if(F.col("l_returnflag") == "A").alias("late_60_89"),
        F.count_if(F.col("l_linestatus") == "O").alias("late_30_59"),
        F.round(F.sum(F.col("l_discount") * F.col("l_extendedprice")) / F.sum("l_extendedprice"), 6).alias("debt_ratio"),
        F.round(F.avg("l_discount") * 10, 6).alias("rev_util"),
        (F.lit(20) + F.floor(F.avg("l_quantity"))).cast("int").alias("age"),
        F.count("*").alias("open_credit"),
        F.count_distinct("l_suppkey").alias("real_estate"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("monthly_inc"),
        (F.col("o_custkey") % 6).cast("int").alias("dependents"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("dlq_2yr"),
    )
    return lines.join(orders, "l_orderkey").withColumnRenamed("l_orderkey", "ID")


def order_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The credit table after renaming, with its risk tier."""
    renamed = rename(credit_raw(spark, folder), CREDIT_RENAMES)
    return renamed.withColumn("nivel_riesgo", risk_tier(threshold=TIER_THRESHOLD))


def written_profile(spark: SparkSession, folder: str) -> DataFrame:
    """``order_profile`` written anew, for the work that reads it several times."""
    return materialize(order_profile(spark, folder), "order-profile")


def rating_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events joined to their user and the user's nation."""
    events = table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("userid"), F.col("value").alias("rate"), "ts", "event_type"
    )
    users = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("userid"), F.col("c_mktsegment").alias("occupation"),
        F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("balance"),
    )
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    return join_dimensions(events, (users, "userid"), (nations, "n_nationkey")).drop("n_nationkey")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to the digits both engines agree on; order of summation shows below that."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


CREDIT_SQL = """credit_lines AS (
  SELECT l_orderkey,
         count(*) FILTER (WHERE l_returnflag = 'R') AS atraso_90,
         count(*) FILTER (WHERE l_returnflag = 'A') AS atraso_60_89,
         count(*) FILTER (WHERE l_linestatus = 'O') AS atraso_30_59,
         round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS radio_deuda,
         round(avg(l_discount) * 10, 6) AS uso_de_credito,
         CAST(20 + floor(avg(l_quantity)) AS INTEGER) AS edad,
         count(*) AS cuentas_abiertas,
         count(DISTINCT l_suppkey) AS num_otros_prestamos
  FROM lineitem GROUP BY l_orderkey),
order_profile AS (
  SELECT l_orderkey AS "ID", atraso_90, atraso_60_89, atraso_30_59, radio_deuda, uso_de_credito, edad,
         cuentas_abiertas, num_otros_prestamos, o_totalprice AS ingreso_mensual,
         CAST(o_custkey % 6 AS INTEGER) AS num_dependientes,
         CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS delincuencia_reciente,
         CASE WHEN atraso_90 > 1 THEN 'Alto' WHEN atraso_60_89 > 1 THEN 'Medio'
              WHEN atraso_30_59 > 1 THEN 'Bajo' ELSE 'Sin riesgo' END AS nivel_riesgo
  FROM credit_lines JOIN orders ON l_orderkey = o_orderkey)"""

RATING_SQL = """rating_events AS (
  SELECT event_id, user_id AS userid, value AS rate, ts, event_type, c_mktsegment AS occupation,
         c_acctbal AS balance, n_name AS state
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def scaled_sql(source: str, columns: list[str], keep: str, name: str = "scaled") -> str:
    """CTE of standardised columns, rounded to six digits."""
    parts_ = [
        f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END, 6) AS {c}"
        for c in columns
    ]
    return f"{name} AS (SELECT {keep}, {', '.join(parts_)} FROM {source})"


def with_ctes(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def on_credit(select: str, *ctes: str) -> str:
    return with_ctes(select, CREDIT_SQL, *ctes)


def on_ratings(select: str, *ctes: str) -> str:
    return with_ctes(select, RATING_SQL, *ctes)
