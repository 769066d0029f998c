"""Files of each supported layout, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.operators.facets import mean_by
from tabscope.plans import Catalog
from tabscope.plans.views import on_credit, order_profile, rounded, table
from tabscope.scratch import new_path
from tabscope.sources import read_csv, read_documents, read_named_columns, read_pipe, read_tsv, write_table
from tabscope.sources.schemas import schema_of

catalog = Catalog()
query = catalog.query

CUSTOMER = schema_of(
    c_custkey=T.LongType(), c_name=T.StringType(), c_nationkey=T.IntegerType(), c_acctbal=T.DoubleType(),
    c_mktsegment=T.StringType(),
)
RECORD_SEPARATOR = "\x1e"


def _file(df: DataFrame, **options) -> str:
    path = new_path(df.sparkSession, "file")
    df.write.options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


@query("s1_csv_header", "SELECT * FROM customer")
def csv_header(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, _file(table(spark, folder, "customer"), header=True), CUSTOMER)


@query("s1_csv_inferred", "SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, _file(table(spark, folder, "supplier"), header=True))


@query("s2_tsv_named", """
SELECT user_id AS userid, event_id AS itemid, value AS rate, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM events""")
def tsv_named(spark: SparkSession, folder: str) -> DataFrame:
    ratings = table(spark, folder, "events").select(
        "user_id", "event_id", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    )
    schema = schema_of(userid=T.LongType(), itemid=T.LongType(), rate=T.DoubleType(), timestamp=T.LongType())
    return read_tsv(spark, _file(ratings, sep="\t"), schema)


@query("s3_pipe_header", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def pipe_header(spark: SparkSession, folder: str) -> DataFrame:
    return read_pipe(spark, _file(table(spark, folder, "customer"), sep="|", header=True), CUSTOMER)


@query("s1_csv_missing", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS o_orderpriority
FROM orders""")
def csv_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Missing prices and priorities in several spellings, types inferred."""
    spelling = F.element_at(F.array(F.lit("NA"), F.lit("null"), F.lit("N/A")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rest = F.col("o_orderkey") % 5
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey"), F.when(rest < 4, F.col("o_totalprice").cast("string")).otherwise(spelling).alias("o_totalprice"),
        F.when(rest > 0, F.col("o_orderpriority")).otherwise(spelling).alias("o_orderpriority"))
    return read_csv(spark, _file(rows, header=True)).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("s4_pipe_latin1", "SELECT doc_id, lang, text FROM documents")
def pipe_latin1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    path = _file(docs, sep="|", header=True, encoding="ISO-8859-1")
    schema = schema_of(doc_id=T.LongType(), lang=T.StringType(), text=T.StringType())
    return read_pipe(spark, path, schema, encoding="ISO-8859-1")


@query("s5_named_one_column", "SELECT p_name FROM part")
def named_one_column(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return read_named_columns(spark, _file(part, sep="|", encoding="ISO-8859-1"), part.schema, ["p_name"])


@query("s6_documents", "SELECT text, count(*) AS copies FROM documents GROUP BY text")
def documents(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "text")
    table(spark, folder, "documents").select("text").write.option("lineSep", RECORD_SEPARATOR).text(path)
    return read_documents(spark, path, RECORD_SEPARATOR).groupBy("text").agg(F.count("*").alias("copies"))


@query("s7_result_table", on_credit(
    "SELECT nivel_riesgo, round(avg(ingreso_mensual), 6) AS ingreso_mensual FROM order_profile GROUP BY nivel_riesgo"))
def result_table(spark: SparkSession, folder: str) -> DataFrame:
    means = mean_by(order_profile(spark, folder), "nivel_riesgo", "ingreso_mensual")
    return spark.read.parquet(write_table(rounded(means), new_path(spark, "report")))
