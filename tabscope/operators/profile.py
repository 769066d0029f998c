"""Column profiles: shape, missing, duplicates, distinct values, describe, outliers, correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.operators.clean import clip_columns, columns_of_class
from tabscope.operators.quantiles import exact_quantiles, quartiles_wide


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` with values as text: all columns of a row in one pass."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")


def _rows_of(row: DataFrame, structs: list[Column]) -> DataFrame:
    """One result row turned into one row per struct."""
    return row.select(F.inline(F.array(*structs)))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing and present values per column, one aggregate for all."""
    present = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    return _rows_of(present, [
        F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(c)).alias("missing"), F.col(c).alias("present"))
        for c in df.columns
    ])


def table_info(df: DataFrame) -> DataFrame:
    """Shape, and each column's position, type and number of present values."""
    present = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    return _rows_of(present, [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f.name).alias("present"), F.col("_rows").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        )
        for i, f in enumerate(df.schema)
    ])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows equal to an earlier one; copies are counted before they are shuffled."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per value of each text column, descending within the column."""
    columns = columns_of_class(df, "text") if columns is None else columns
    return (
        long_values(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .orderBy("column", F.col("n").desc(), "value")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column; ``approximate`` trades exactness for one small sketch."""
    columns = df.columns if columns is None else list(columns)
    if approximate:
        sketches = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return _rows_of(sketches, [F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in columns])
    found = (
        long_values(df, columns).filter(F.col("value").isNotNull()).distinct()
        .groupBy("column").agg(F.count("*").alias("distinct"))
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def describe(df: DataFrame, text: bool = False) -> DataFrame:
    """One row per column: count, mean, deviation (n-1), extremes, exact quartiles.

    ``text=True`` adds the text columns with their distinct count, most frequent value (ties to the
    smallest) and its frequency.
    """
    numbers = columns_of_class(df, "number")
    moments = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c)
        for c in numbers
    ])
    table = _rows_of(moments, [F.col(c) for c in numbers]).join(
        F.broadcast(quartiles_wide(df, numbers)), "column", "left"
    ).select("column", "count", "mean", "std", "min", F.col("q1").alias("q25"), F.col("median").alias("q50"),
             F.col("q3").alias("q75"), "max")
    if not text:
        return table
    words = columns_of_class(df, "text")
    counts = long_values(df, words).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    tops = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), first["value"].alias("top"), (-first["n"]).alias("freq")
    )
    return table.unionByName(tops, allowMissingColumns=True)


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    return exact_quantiles(df, columns, probs)


def fences(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, their distance and the outlier fences of each column."""
    return quartiles_wide(df, columns).select(
        "column", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper"),
    )


def outliers(df: DataFrame, column: str, side: str = "upper") -> DataFrame:
    """Rows strictly beyond a fence, farthest first."""
    bound = fences(df, [column]).select(side).scalar()
    if side == "upper":
        return df.filter(F.col(column) > bound).orderBy(F.col(column).desc())
    return df.filter(F.col(column) < bound).orderBy(F.col(column).asc())


def centre_and_spread(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, mode (ties to the smallest), deviation and variance (n-1) of one column."""
    # the mode comes from counts: a map of all values in one task would grow with the column
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    mode = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v")))["v"].alias("m")).scalar()
    median = exact_quantiles(df, [column], [0.5]).select("value").scalar()
    return df.agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.var_samp(column).alias("variance")
    ).select("mean", median.alias("median"), mode.alias("mode"), "std", "variance")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson coefficient of every pair over the rows where both are present; NULL without spread.

    A first pass finds means and missing values; the second sums centred products. Only pairs with
    missing values need sums of their own.
    """
    columns = columns_of_class(df, "number") if columns is None else list(columns)
    first = df.agg(F.count("*").alias("rows"), *[
        F.struct(F.avg(c).alias("mean"), F.count(c).alias("n")).alias(c) for c in columns
    ]).first()
    centred = {c: F.col(c).cast("double") - F.lit(float(first[c]["mean"] or 0.0)) for c in columns}
    whole = {c for c in columns if first[c]["n"] == first["rows"]}

    def coefficient(a: str, b: str) -> Column:
        x, y = centred[a], centred[b]
        if a in whole and b in whole:
            return F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)))
        x, y = F.when(F.col(b).isNotNull(), x), F.when(F.col(a).isNotNull(), y)
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[coefficient(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    out = []
    for i, (a, b) in enumerate(pairs):
        for p, q in {(a, b), (b, a)}:
            out.append(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"r{i}").alias("r")))
    return _rows_of(row, out)


def box_stats(
    df: DataFrame,
    columns: Sequence[str],
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Box-plot numbers per column: quartiles, whisker ends, mean, outlier count.

    A whisker ends at the last value within 1.5 quartile distances of the box, and never inside it.
    """
    rows = clip_columns(df, columns, ranges or {})
    box = quartiles_wide(rows, columns)
    # bounded: one row per column
    ends = {r["column"]: r for r in box.collect()}
    stats = []
    for c in columns:
        q1, q3 = ends[c]["q1"], ends[c]["q3"]
        x = F.col(c).cast("double")
        if q1 is None:
            stats.append(F.struct(F.lit(c).alias("column"), *[F.lit(None).cast("double").alias(n) for n in
                         ("q1", "median", "q3", "whisker_low", "whisker_high", "mean")], F.lit(0).cast("bigint").alias("outliers")).alias(c))
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        stats.append(F.struct(
            F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(ends[c]["median"]).alias("median"), F.lit(q3).alias("q3"),
            F.least(F.min(F.when(x >= low, x)), F.lit(q1)).alias("whisker_low"),
            F.greatest(F.max(F.when(x <= high, x)), F.lit(q3)).alias("whisker_high"),
            F.avg(x).alias("mean"), F.count_if((x < low) | (x > high)).alias("outliers"),
        ).alias(c))
    return _rows_of(rows.agg(*stats), [F.col(c) for c in columns])


def class_count(df: DataFrame, column: str) -> DataFrame:
    """Number of classes of a target and whether it is binary."""
    classes = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("one"))
    return classes.agg(F.count("*").alias("classes"), (F.count("*") == 2).alias("is_binary"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
