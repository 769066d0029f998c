"""Delimited and text readers, and the result sink.

Every reader takes a schema: inference costs a whole extra pass. ``read_csv`` falls back to
inference (whole numbers, decimals, truth values, text) when none is given, because the inputs may
be unknown to the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.scalars import nan_to_null


# Spellings of a missing value in delimited files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
           "n/a", "nan", "null")
_INFERRED = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


# fixed values: encodings in which a byte of a quote or a line end is nothing else
_SPLITTABLE = ("UTF-8", "US-ASCII", "ISO-8859-1", "WINDOWS-1252")


def _breaks_in_quotes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a quoted value may hold a line break: then the line it begins in has an odd number of quotes.

    One split pass over the text. A carriage return inside a line counts as a break, too.
    """
    if encoding.upper() not in _SPLITTABLE:
        return True
    line = F.col("value")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(path, lineSep="\n").filter(odd | line.rlike("\r(?!$)")).isEmpty()


def _delimited(
    spark: SparkSession, path: str, schema: T.StructType | None, sep: str, header: bool, encoding: str, multi_line: bool | None, missing: Sequence[str]
) -> DataFrame:
    """Text columns first; missing spellings become NULL before any type is looked at.

    ``multi_line`` lets quoted values hold line breaks; such a file is read by one task. By default the
    text is looked at first, and files with a record per line are split.
    """
    if multi_line is None:
        multi_line = _breaks_in_quotes(spark, path, encoding)
    # a doubled quote inside a quoted field is a quote
    reader = spark.read.options(sep=sep, header=header, encoding=encoding, escape='"', multiLine=multi_line)
    if schema is not None and not header:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    raw = reader.csv(path)
    raw = raw.select(*[F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is None:
        schema = _inferred(raw)
    # Columns are matched by name, so the file's column order does not matter under a header; a
    # value that does not parse becomes NULL.
    return nan_to_null(raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]))


def _inferred(raw: DataFrame) -> T.StructType:
    """The first of ``_INFERRED`` that every value of a column parses as, else text: one pass."""
    held = {c: F.col(f"`{c}`") for c in raw.columns}
    row = raw.agg(*[
        F.count(F.when(x.isNotNull() & x.try_cast(kind).isNull(), 1)).alias(f"{i} {kind}")
        for i, x in enumerate(held.values()) for kind in _INFERRED
    ]).first()
    kinds = [next((t for k, t in _INFERRED.items() if row[f"{i} {k}"] == 0), T.StringType()) for i in range(len(held))]
    return T.StructType([T.StructField(c, t) for c, t in zip(held, kinds)])


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True, multi_line: bool | None = None, missing: Sequence[str] = MISSING
) -> DataFrame:
    """Comma-separated file; types are inferred only when no schema is given."""
    return _delimited(spark, path, schema, ",", header, "UTF-8", multi_line, missing)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool | None = None, missing: Sequence[str] = MISSING) -> DataFrame:
    """Tab-separated file without a header; the schema supplies the names."""
    return _delimited(spark, path, schema, "\t", False, "UTF-8", multi_line, missing)


def read_pipe(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, encoding: str = "UTF-8", multi_line: bool | None = None,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Pipe-separated file; ``encoding='ISO-8859-1'`` for Latin-1, ``header`` as the file has it."""
    return _delimited(spark, path, schema, "|", header, encoding, multi_line, missing)


def read_named_columns(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Sequence[str],
    sep: str = "|",
    encoding: str = "ISO-8859-1",
    multi_line: bool | None = None,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Headerless file with supplied names, keeping some columns; the parser skips the others."""
    return _delimited(spark, path, schema, sep, False, encoding, multi_line, missing).select(*columns)


def read_documents(spark: SparkSession, path: str, record_sep: str | None = None) -> DataFrame:
    """One row per document in column ``text``.

    Without ``record_sep`` each file is one document. With it, many documents share a splittable
    file, which is the layout to use for large collections.
    """
    if record_sep is None:
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return spark.read.text(path, lineSep=record_sep).withColumnRenamed("value", "text")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> str:
    """Write a result table as Parquet and return its path."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
