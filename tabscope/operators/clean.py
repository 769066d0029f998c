"""Projections, filters, ordering and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names the table does not have are ignored."""
    return df.withColumnsRenamed(dict(names))


def drop(df: DataFrame, *columns: str) -> DataFrame:
    """Drop the columns that are present."""
    return df.drop(*columns)


def columns_of_class(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``number`` or ``text`` columns."""
    wanted = {"number": T.NumericType, "text": T.StringType}[kind]
    return [f.name for f in df.schema if isinstance(f.dataType, wanted)]


def select_class(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*columns_of_class(df, kind))


def in_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows inside a closed range; an absent bound is open. Missing values never pass."""
    conds: list[Column] = []
    if low is not None:
        conds.append(F.col(column) >= F.lit(low))
    if high is not None:
        conds.append(F.col(column) <= F.lit(high))
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def in_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


# Closed ranges the charts of the credit table are drawn on.
CREDIT_CHART_RANGES: dict[str, tuple[float | None, float | None]] = {
    "uso_de_credito": (0, 1),
    "radio_deuda": (None, 1),
    "ingreso_mensual": (None, 50000),
    "num_otros_prestamos": (None, 5),
    "cuentas_abiertas": (None, 30),
}


def clip_rule(column: str, ranges: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """The column's value inside its range and NULL outside; columns without a rule pass whole."""
    low, high = ranges.get(column, (None, None))
    value = F.col(column)
    if low is not None:
        value = F.when(value >= F.lit(low), value)
    if high is not None:
        value = F.when(F.col(column) <= F.lit(high), value)
    return value


def clip_columns(
    df: DataFrame, columns: Sequence[str], ranges: Mapping[str, tuple[float | None, float | None]]
) -> DataFrame:
    """Each column clipped by its own rule, one pass for all: a value outside becomes NULL."""
    return df.select(*[clip_rule(c, ranges).alias(c) for c in columns])


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop()


def fill_to_int(column: str, value: int = 0) -> Column:
    """Missing becomes ``value``; then truncated to int."""
    return F.coalesce(F.col(column), F.lit(value)).cast("int")


def without_noise(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows that belong to a cluster."""
    return df.filter(F.col(cluster) != -1)


def sort_rows(df: DataFrame, *keys: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])


def head(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First n rows in key order; a top-k, not a full sort."""
    if not keys:
        raise ValueError("the first rows are only defined with a sort key")
    return df.orderBy(*keys).limit(n)


def page(df: DataFrame, number: int, *keys: str, size: int = 7, of_first: int = 20) -> DataFrame:
    """Page ``number`` (from 0) of the first ``of_first`` rows in key order."""
    return head(df, of_first, *keys).orderBy(*keys).offset(number * size).limit(size)


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 1) -> DataFrame:
    """Exactly n rows without replacement, the same ones on every run and every partitioning.

    Rows are ranked by a digest of their key and the seed, so this is a top-k.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)


def best_entry(df: DataFrame, score: str, order: str) -> DataFrame:
    """Row with the highest score, ties to the first listed; rows without a score do not compete."""
    return df.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), order).limit(1)
