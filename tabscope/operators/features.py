"""Encoding, lookups, standardising and feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.operators.clean import columns_of_class
from tabscope.operators.ranks import value_codes


def _with_codes(df: DataFrame, targets: dict[str, str], missing: str) -> DataFrame:
    """Add a code column per source column. ``missing``: ``"-1"`` or ``"last"``."""
    codes = value_codes(df, list(targets))
    out = df
    if missing == "last":
        counts = codes.groupBy("column").agg(F.count("*").cast("int").alias("n"))
    for column, target in targets.items():
        # joined by value; Spark broadcasts the dimension while it is small and shuffles otherwise
        dim = codes.filter(F.col("column") == column).select(
            F.col("value").alias(column), F.col("code").alias("_code")
        )
        fallback = F.lit(-1) if missing == "-1" else F.coalesce(
            counts.filter(F.col("column") == column).select("n").scalar(), F.lit(0)
        )
        coded = F.coalesce(F.col("_code"), fallback).cast("int")
        if target == column:
            out = out.join(dim, column, "left").withColumn(column, coded).drop("_code")
        else:
            out = out.join(dim, column, "left").withColumn(target, coded).drop("_code")
    return out.select(*df.columns, *[t for t in targets.values() if t not in df.columns])


def label_encode(df: DataFrame, column: str, target: str | None = None) -> DataFrame:
    """Code of each value in sorted order of the values; missing takes the code after the last."""
    return _with_codes(df, {column: target or f"{column}_encoded"}, "last")


def category_codes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace string columns (all by default) by sorted codes; missing is -1."""
    columns = columns_of_class(df, "text") if columns is None else list(columns)
    return _with_codes(df, {c: c for c in columns}, "-1") if columns else df


def lookup(df: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Add the dimension's value for each key, NULL when unknown; duplicate keys keep the smallest value."""
    unique = dimension.groupBy(key).agg(F.min(value).alias(value))
    return df.join(unique, key, "left")


def join_dimensions(fact: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    """Inner equi-joins of a fact table to its dimensions, one after the other.

    The join strategy is left to the optimiser: it broadcasts by measured size and splits skewed keys.
    """
    out = fact
    for dimension, key in dimensions:
        out = out.join(dimension, key, "inner")
    return out


def standardize(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Subtract the mean and divide by the population deviation; a column without spread becomes 0.

    ``digits`` rounds the result, which makes equal rows equal whatever the order of summation.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).alias("s")
    ).scalar()

    def scaled(c: str) -> Column:
        centred = F.col(c) - stats[f"m_{c}"]
        value = F.when(stats[f"s_{c}"] > 0, F.try_divide(centred, stats[f"s_{c}"])).otherwise(centred * 0.0)
        return F.round(value, digits) if digits is not None else value

    return df.withColumns({c: scaled(c) for c in columns})


def spread_array(df: DataFrame, column: str, size: int, prefix: str = "x") -> DataFrame:
    """One double column per array element."""
    parts = {f"{prefix}{i}": F.col(column)[i].cast("double") for i in range(size)}
    return df.withColumns(parts).drop(column)


def assemble(df: DataFrame, columns: Sequence[str], target: str = "features") -> DataFrame:
    """Feature vector out of numeric columns, next to what else the table holds."""
    return VectorAssembler(inputCols=list(columns), outputCol=target, handleInvalid="error").transform(df)
