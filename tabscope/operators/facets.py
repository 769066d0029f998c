"""The faceted view: filter by controls, then indicators and grouped means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.binning import decade_label
from tabscope.functions.scalars import rescale, round_half_even
from tabscope.operators.clean import in_range


def facet_domain(df: DataFrame) -> DataFrame:
    """One row with the bounds of the controls."""
    return df.agg(
        F.min("radio_deuda").alias("deuda_min"),
        F.max("radio_deuda").alias("deuda_max"),
        F.min("edad").cast("int").alias("edad_min"),
        F.max("edad").cast("int").alias("edad_max"),
        F.max("num_dependientes").cast("int").alias("dependientes_max"),
    )


def facet_values(df: DataFrame, column: str = "nivel_riesgo") -> DataFrame:
    """Distinct values a membership control offers."""
    return df.select(column).distinct()


def age_groups(df: DataFrame, column: str = "edad", start: int = 20, width: int = 10) -> DataFrame:
    """Group labels from ``start`` up to the maximum of the column, with their order and edges."""
    top = df.agg(F.max(column).cast("int").alias("top"))
    lows = F.when(F.col("top") >= start, F.sequence(F.lit(start), F.col("top"), F.lit(width)))
    low = top.select(F.posexplode(lows).alias("ord", "low"))
    high = F.col("low") + (width - 1)
    label = F.concat(F.col("low").cast("string"), F.lit("-"), high.cast("string"))
    return low.select("ord", label.alias("grupo_edad"), "low", high.alias("high"))


def facet_filter(
    df: DataFrame,
    debt: tuple[float, float],
    tiers: Sequence[str],
    dependents: int,
    age: tuple[float, float],
    max_dependents: int | None = None,
) -> DataFrame:
    """Rows that satisfy all controls.

    A number of dependents outside ``[0, maximum of the table]`` yields no rows. Pass
    ``max_dependents`` when the maximum is known, to save the pass that looks it up.
    """
    if max_dependents is None:
        top = df.agg(F.max("num_dependientes").alias("top")).scalar()
    else:
        top = F.lit(max_dependents)
    return df.filter(
        F.col("radio_deuda").between(*debt)
        & F.col("nivel_riesgo").isin(list(tiers))
        & (F.col("num_dependientes") == dependents)
        & F.col("edad").between(*age)
        & F.lit(dependents).between(F.lit(0), top)
    )


def indicators(filtered: DataFrame) -> DataFrame:
    """Row count and mean income; no row at all when nothing passed the filter."""
    return filtered.agg(
        F.count("*").alias("total"), F.avg("ingreso_mensual").alias("ingreso_promedio")
    ).filter(F.col("total") > 0)


def mean_by(df: DataFrame, key: str, value: str, debt: tuple[float, float] | None = None) -> DataFrame:
    """Mean of ``value`` per key; rows without a key are left out."""
    rows = df if debt is None else in_range(df, "radio_deuda", *debt)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(value))


def debt_index(df: DataFrame, debt: tuple[float, float] | None = None) -> DataFrame:
    """Mean debt ratio per number of dependents with its 1-to-10 index, one decimal, half to even."""
    means = mean_by(df, "num_dependientes", "radio_deuda", debt)
    ends = means.agg(F.struct(F.min("radio_deuda").alias("lo"), F.max("radio_deuda").alias("hi")).alias("e")).scalar()
    index = rescale(F.col("radio_deuda"), ends["lo"], ends["hi"], 1.0, 10.0)
    return means.withColumn("indice_endeudamiento", round_half_even(index, 1))


def in_selection(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows of the selected age groups with ``ord``, the caller's order of the groups."""
    selected = F.array(*[F.lit(g) for g in groups])
    place = F.array_position(selected, F.col("grupo_edad"))
    rows = df.withColumn("grupo_edad", decade_label("edad")).filter(F.col("grupo_edad").isin(list(groups)))
    return rows.withColumn("ord", (place - 1).cast("int"))


def income_by_age_and_tier(filtered: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean income for each selected age group and each tier seen among them.

    Pairs without rows are kept with a NULL mean. ``ord`` is the caller's order of the groups. With
    no group selected, or nothing observed, the result is empty.
    """
    selected = list(groups) or [""]
    rows = filtered.withColumn("grupo_edad", decade_label("edad")).filter(F.col("grupo_edad").isin(selected))
    means = rows.groupBy("grupo_edad", "nivel_riesgo").agg(F.avg("ingreso_mensual").alias("ingreso_mensual"))
    order = F.posexplode(F.array(*[F.lit(g) for g in selected])).alias("ord", "grupo_edad")
    grid = means.select("nivel_riesgo").distinct().select(order, "nivel_riesgo")
    return grid.join(means, ["grupo_edad", "nivel_riesgo"], "left").select(
        "ord", "grupo_edad", "nivel_riesgo", "ingreso_mensual"
    )


def category_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column and their percent of all rows, ascending by count.

    Rows without a value count in the denominator and have no line of their own. All columns are
    counted in one pass.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = (
        df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(totals), "column")
        .filter(F.col("value").isNotNull())
        .select("column", "value", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))
        .orderBy("column", "n", "value")
    )
